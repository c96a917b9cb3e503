"""Queries of the text problems 5 to 10, over whole tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import chunking, ocr, packing, pii, tokenizer, truncation


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return ocr.lines_to_repair(table(spark, d, "pages", "doc_id", "page", "raw_text"))


def p5_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return ocr.paragraphs(table(spark, d, "pages", "doc_id", "page", "raw_text"))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.pieces(table(spark, d, "chunks", "doc_id", "chunk_index", "request_id", "text"), table(spark, d, "conversion_requests", "request_id", "chunk_size", "chunk_overlap"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that had to be cut: those with a second piece."""
    return _pieces(spark, d).where("piece = 1").select("doc_id", "chunk_index")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def _private(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(F.lit("pages").alias("src"), "doc_id", F.col("page").alias("item_no"), F.col("raw_text").alias("text"))
    chunks = table(spark, d, "chunks").select(F.lit("chunks").alias("src"), "doc_id", F.col("chunk_index").alias("item_no"), "text")
    return pages.unionByName(chunks)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.items(_private(spark, d))


def p7_masked(spark: SparkSession, d: str) -> DataFrame:
    return _private(spark, d).withColumn("text", pii.masked(F.col("text")))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode(table(spark, d, "documents", "doc_id", "text"))


def p8_sizes(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.sizes(table(spark, d, "documents", "doc_id", "text"))


def p9_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokenizer.sizes(table(spark, d, "documents", "doc_id", "text")))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """How full each container is."""
    return p9_pack(spark, d).groupBy("container").agg(F.count("*").alias("n_parts"), F.sum("n_tokens").alias("used"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return truncation.judge(table(spark, d, "documents", "doc_id", "text", "source"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).where("cut").select("doc_id")


def p10_sources(spark: SparkSession, d: str) -> DataFrame:
    """How often each source cuts."""
    return truncation.shares(_judged(spark, d))


QUERIES = {f.__name__: f for f in (p5_found, p5_paragraphs, p6_found, p6_pieces, p7_found, p7_masked, p8_ids, p8_sizes, p9_pack, p9_containers, p10_found, p10_sources)}
SQL = {
    "p6_found": """
        WITH r AS (SELECT DISTINCT request_id, coalesce(chunk_size, 500) AS size FROM conversion_requests)
        SELECT DISTINCT c.doc_id, c.chunk_index FROM chunks c LEFT JOIN r USING (request_id) WHERE length(c.text) // 4 > coalesce(r.size, 500)""",
}
