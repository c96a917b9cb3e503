"""Sections, their hierarchy and content, metadata, summary, routing and confidence."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .structure import PAGE, numbered

LEVELS = 6


def parents(heads: DataFrame) -> DataFrame:
    """heads (doc_id, seq, level, ...) with parent_seq: the latest earlier heading of the greatest lower level since the
    last heading of level 1, or null. Levels that a sibling leaves behind stay open, as in the format that this follows.
    An as-of lookup by windows; only the columns of headings are sorted, never texts of pages."""
    order = W.partitionBy("doc_id").orderBy("seq")
    epoch = heads.withColumn("_epoch", F.sum(F.when(F.col("level") == 1, 1).otherwise(0)).over(order))
    before = W.partitionBy("doc_id", "_epoch").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    last = {k: F.last(F.when(F.col("level") == k, F.col("seq")), ignorenulls=True).over(before) for k in range(1, LEVELS)}
    rows = epoch.withColumns({f"_p{k}": v for k, v in last.items()})
    choice = F.coalesce(*[F.when(F.col("level") > k, F.col(f"_p{k}")) for k in range(LEVELS - 1, 0, -1)])
    return rows.withColumn("parent_seq", choice).drop("_epoch", *[f"_p{k}" for k in last])


LINEAGE = "doc_id string, page int, seq int, title string, level int, parent_seq int, path array<int>, full_title string"


def lineage(heads: DataFrame) -> DataFrame:
    """doc_id, page, seq, title, level, parent_seq, path (seq of the ancestors and its own; sorting by it is depth first)
    and full_title (titles of the ancestors and its own) of headings (doc_id, page, seq, text, level).

    A fold over the headings of one file since its last heading of level 1; it holds one open heading per level."""
    rows = numbered(heads.select(*PAGE, "seq", "text", "level"), "epoch", "seq", of=F.when(F.col("level") == 1, 1).otherwise(0))
    rows = rows.repartition("doc_id", "epoch").sortWithinPartitions("doc_id", "epoch", "seq").select("doc_id", "epoch", "page", "seq", "text", "level")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, open_at = None, {}
        for batch in batches:
            parents, paths, titles = [], [], []
            for doc, epoch, _, seq, text, level in zip(*[c.to_pylist() for c in batch.columns]):
                if (doc, epoch) != at:
                    at, open_at = (doc, epoch), {}
                up = open_at.get(max((k for k in open_at if k < level), default=0), ((), ()))
                own = ((*up[0], seq), (*up[1], text))
                open_at[level] = own
                parents.append(up[0][-1] if up[0] else None)
                paths.append(own[0])
                titles.append(" > ".join(own[1]))
            keep = [batch.column(i) for i in (0, 2, 3, 4, 5)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(parents, pa.int32()), pa.array(paths, pa.list_(pa.int32())), pa.array(titles, pa.string())], names=["doc_id", "page", "seq", "title", "level", "parent_seq", "path", "full_title"])

    return rows.mapInArrow(fold, LINEAGE)


def sections(heads: DataFrame, paras: DataFrame, tables: DataFrame) -> DataFrame:
    """One section per heading: doc_id, seq, id (sec_0, ...), title, level, page, parent_seq, path, full_title (see
    lineage()), content, tables_refs. paras: paragraphs, or the content of each page.

    Every heading gets all paragraphs of its page. Files without headings but with paragraphs get one section
    `Documento` with all of them."""
    here = lineage(heads)
    refs = tables.groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("table_no", "id"))), lambda t: t["id"]).alias("tables_refs"))
    out = here.join(page_content(paras), [*PAGE], "left").join(refs, [*PAGE], "left")
    out = out.select(
        "doc_id", "seq", F.concat(F.lit("sec_"), F.col("seq") - 1).alias("id"), "title", "level", "page", "parent_seq", "path", "full_title",
        F.coalesce("content", F.lit("")).alias("content"), F.coalesce("tables_refs", F.array().cast("array<string>")).alias("tables_refs"),
    )
    return out.unionByName(untitled(heads, paras))


def _in_order(*cols: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*cols, "text"))), lambda p: p["text"]), "\n\n")


def page_content(paras: DataFrame) -> DataFrame:
    """doc_id, page, content: the paragraphs of a page with empty lines between; contents stay as they are."""
    return paras if "content" in paras.columns else paras.groupBy(*PAGE).agg(_in_order("para_no").alias("content"))


def untitled(heads: DataFrame, paras: DataFrame) -> DataFrame:
    """The one section of each file without headings, with all its paragraphs."""
    bare = page_content(paras).join(heads.select("doc_id").distinct(), "doc_id", "left_anti").withColumnRenamed("content", "text")
    rows = bare.groupBy("doc_id").agg(_in_order("page").alias("content"))
    none = F.array().cast("array<string>")
    return rows.select(
        "doc_id", F.lit(1).alias("seq"), F.lit("sec_0").alias("id"), F.lit("Documento").alias("title"), F.lit(1).alias("level"), F.lit(1).alias("page"), F.lit(None).cast("int").alias("parent_seq"),
        F.array(F.lit(1)).alias("path"), F.lit("Documento").alias("full_title"), "content", none.alias("tables_refs"),
    )


def full_text(pages: DataFrame, between: str = "\n\n") -> DataFrame:
    """doc_id, text: the pages of each file in order; null pages count as empty. One row per file, as prompts need it."""
    text = F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("raw_text", F.lit("")).alias("t")))), lambda p: p["t"])
    return pages.groupBy("doc_id").agg(F.array_join(text, between).alias("text"))


def metadata(pages: DataFrame, heads: DataFrame) -> DataFrame:
    """doc_id, title (the first heading, null without), page_count, language."""
    title = heads.groupBy("doc_id").agg(F.min_by("text", "seq").alias("title"))
    return pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("page_count")).join(title, "doc_id", "left").select("doc_id", "title", "page_count", F.lit("pt").alias("language"))


def summary(pages: DataFrame, first: int = 3, limit: int = 500) -> DataFrame:
    """doc_id, summary: the texts of the first pages, cut to `limit` characters with dots. The filter on the rank becomes a
    group limit before the shuffle: of a file every task sends its first pages only."""
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy("page"))
    top = pages.select(*PAGE, F.coalesce("raw_text", F.lit("")).alias("text")).withColumn("_r", rank).where(F.col("_r") <= first)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), " ")
    return top.groupBy("doc_id").agg(whole.alias("t")).select("doc_id", F.when(F.length("t") > limit, F.concat(F.substring("t", 1, limit), F.lit("..."))).otherwise(F.col("t")).alias("summary"))


def preview(pages: DataFrame, limit: int = 5000) -> DataFrame:
    """doc_id, preview: pages in order until `limit` characters are reached, cut to it. Only lengths are summed along a
    file; the texts of the few pages that are kept meet them in a join."""
    some = pages.where("raw_text is not null")
    before = F.sum("n").over(W.partitionBy("doc_id").orderBy("page").rowsBetween(W.unboundedPreceding, -1))
    kept = some.select(*PAGE, F.length("raw_text").alias("n")).withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < limit).select(*PAGE)
    text = some.select(*PAGE, F.substring("raw_text", 1, limit).alias("text")).join(kept, [*PAGE], "left_semi")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n\n")
    return text.groupBy("doc_id").agg(F.substring(whole, 1, limit).alias("preview"))


# Fixed values in routing(): the reasons' wording and the weights of parts.
def routing(pages: DataFrame, classified: DataFrame, tables: DataFrame, equations: DataFrame, footnotes: DataFrame, paras: DataFrame, prefer_tables: bool = False, prefer_equations: bool = False, least: float = 0.7, figures: DataFrame | None = None) -> DataFrame:
    """doc_id, page, complexity, requires_full_page_vision, for_vision, for_text (ids), n_elements, reason: which parts
    of a page plain text cannot give. Every page has a row; a page without elements is simple."""
    merged, big = F.col("has_merged_cells"), (F.size("data") > 20) | (F.size("columns") > 10)
    why = (
        F.when(F.lit(prefer_tables), "Vision preferred for tables")
        .when(F.col("confidence") < least, F.format_string("Low extraction confidence: %.2f", "confidence"))
        .when(merged, "Table has merged cells")
        .when(big, F.format_string("Large table: %dx%d", F.size("data"), F.size("columns")))
    )
    t = tables.select(*PAGE, F.lit(1).alias("kind"), F.col("table_no").alias("no"), "id", why.alias("why"), F.when(merged, 5).otherwise(2).alias("score"))
    e = equations.select(*PAGE, F.lit(3).alias("kind"), F.col("eq_no").alias("no"), "id", F.lit("Equation processing via vision" if prefer_equations else None).cast("string").alias("why"), F.lit(2).alias("score"))
    if figures is not None:  # a figure can only be described by looking at it
        nth = F.row_number().over(W.partitionBy(*PAGE).orderBy("id"))
        t = t.unionByName(figures.select(*PAGE, F.lit(2).alias("kind"), nth.alias("no"), "id", F.lit("Figure requires vision for description").alias("why"), F.lit(2).alias("score")))
    parts = t.unionByName(e).groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("kind", "no", "id", "why"))).alias("p"), F.sum("score").alias("score"), F.count("*").alias("n"))
    plain = classified.groupBy(*PAGE).agg(F.count_if(F.col("kind") == "heading").alias("h"), F.count_if(F.col("kind") == "list").alias("l"))
    others = paras.groupBy(*PAGE).agg(F.count("*").alias("q"))
    notes = footnotes.groupBy(*PAGE).agg(F.count("*").alias("f"))
    rows = pages.select(*PAGE)
    for other in (parts, plain, others, notes):
        rows = rows.join(other, [*PAGE], "left")
    rows = rows.fillna(0, ["score", "n", "h", "l", "q", "f"]).withColumn("p", F.coalesce("p", F.expr("array()").cast("array<struct<kind:int,no:int,id:string,why:string>>")))
    ids = lambda keep: F.transform(F.filter("p", keep), lambda x: x["id"])
    rows = rows.withColumns({"for_vision": ids(lambda x: x["why"].isNotNull()), "for_text": ids(lambda x: x["why"].isNull()), "n_elements": (F.col("n") + F.col("h") + F.col("l") + F.col("q") + F.col("f")).cast("int")})
    full = (F.col("n_elements") > 0) & (F.size("for_vision") / F.greatest("n_elements", F.lit(1)) > 0.5)
    score = F.col("score") + F.when(F.col("h") > 5, 1).otherwise(0)
    reasons = F.concat(F.filter(F.transform("p", lambda x: x["why"]), lambda x: x.isNotNull()), F.when(full, F.array(F.lit("High ratio of complex elements"))).otherwise(F.array().cast("array<string>")))
    return rows.select(
        *PAGE, F.when(score >= 8, "complex").when(score >= 3, "moderate").otherwise("simple").alias("complexity"), full.alias("requires_full_page_vision"), "for_vision", "for_text", "n_elements",
        F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).otherwise("Standard text extraction").alias("reason"),
    )


def confidence(pages: DataFrame, heads: DataFrame, paras: DataFrame, schema: DataFrame | None = None) -> DataFrame:
    """doc_id, confidence: the mean of the schema's confidence (if given: doc_id, confidence), of the mean page length
    over 500 (1 at most) and of 0.9 with sections or 0.5 without."""
    length = pages.groupBy("doc_id").agg(F.least(F.avg(F.coalesce(F.length("raw_text"), F.lit(0))) / 500, F.lit(1.0)).alias("a"))
    some = heads.select("doc_id").union(paras.select("doc_id")).distinct().withColumn("b", F.lit(0.9))
    rows = length.join(some, "doc_id", "left").fillna(0.5, ["b"])
    if schema is None:
        return rows.select("doc_id", ((F.col("a") + F.col("b")) / 2).alias("confidence"))
    rows = rows.join(schema.select("doc_id", F.col("confidence").alias("s")), "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("s").isNull(), (F.col("a") + F.col("b")) / 2).otherwise((F.col("s") + F.col("a") + F.col("b")) / 3).alias("confidence"))
