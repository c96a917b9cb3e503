"""Queries of the record problems 1 to 4, over whole tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import dates, drift, money, nested


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.linked_rows(table(spark, d, "schema_inferences", "infer_id", "fields")).drop("kind")


def p1_rows(spark: SparkSession, d: str) -> DataFrame:
    """All flat tables in one, with their attributes."""
    return nested.linked_rows(table(spark, d, "schema_inferences", "infer_id", "fields"), attributes=True)


def p1_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Rows and texts with rows of each flat table."""
    rows = nested.linked_rows(table(spark, d, "schema_inferences", "infer_id", "fields"))
    return rows.groupBy("kind").agg(F.count("*").alias("n_rows"), F.countDistinct("infer_id").alias("n_texts"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "schema_inferences", "infer_id", "feed", "file_no", "fields"))


def p2_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return drift.fingerprints(table(spark, d, "schema_inferences", "infer_id", "feed", "file_no", "fields"))


def p2_routes(spark: SparkSession, d: str) -> DataFrame:
    """Whether each file has its feed's last schema, and else the steps to it."""
    return drift.routes(table(spark, d, "schema_inferences", "infer_id", "feed", "file_no", "fields"))


def p2_consistent(spark: SparkSession, d: str) -> DataFrame:
    return drift.consistent(table(spark, d, "schema_inferences", "infer_id", "feed", "file_no", "fields"))


def _dates(spark: SparkSession, d: str) -> DataFrame:
    return dates.normalise(table(spark, d, "entity_dates", "mention_id", "original", "origin"), table(spark, d, "origin_zones"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _dates(spark, d).where("stamp is not null").select("mention_id", "stamp")


def p3_status(spark: SparkSession, d: str) -> DataFrame:
    """What became of the mentions, by status and reading."""
    return _dates(spark, d).groupBy("status", "reading").agg(F.count("*").alias("n"))


def _money(spark: SparkSession, d: str) -> DataFrame:
    return money.convert(table(spark, d, "entity_money", "money_id", "original", "value", "currency", "context"), table(spark, d, "currency_rates"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _money(spark, d).select("money_id", "brl_cents")


def p4_units(spark: SparkSession, d: str) -> DataFrame:
    """Rows and sum of each source unit."""
    return _money(spark, d).groupBy("unit").agg(F.count("*").alias("n"), F.sum(F.col("brl_cents").cast("decimal(38,0)")).cast("string").alias("brl_cents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_rows, p1_kinds, p2_found, p2_fingerprints, p2_routes, p2_consistent, p3_found, p3_status, p4_found, p4_units)}
SQL: dict[str, str] = {}
