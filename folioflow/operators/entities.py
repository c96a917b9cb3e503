"""Entities by pattern, and their union with entities from elsewhere."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MONTHS, WS
from ..inference import elements
from .sections import full_text

# Patterns of dates, amounts and numbers.
DATE = r"(?U)\b(\d{1,2})[/\-](\d{1,2})[/\-](\d{2,4})\b"
DATE_WORDS = rf"(?iU)\b(\d{{1,2}})[{WS}]+de[{WS}]+({'|'.join(MONTHS)})[{WS}]+de[{WS}]+(\d{{4}})\b"
MONEY = {"BRL": ("R$", rf"R\$[{WS}]*([\d.,]+)"), "USD": ("US$", rf"US\$[{WS}]*([\d.,]+)")}
#: Opt-in patterns of numbers of persons and companies.
IDS = {"cpf": r"\b\d{3}\.?\d{3}\.?\d{3}[-.]?\d{2}\b", "cnpj": r"\b\d{2}\.?\d{3}\.?\d{3}[/]?\d{4}[-.]?\d{2}\b"}


def _all(x: Column, pattern: str, group: int = 0) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit(pattern), F.lit(group)))


def dates(x: Column) -> Column:
    """Array of struct original, normalized: each notation once, numeric ones first. Years of two digits are of this
    century; nothing checks that the day exists."""
    g = lambda o, p, i: F.regexp_extract(o, p, i)

    def numeric(o: Column) -> Column:
        y = g(o, DATE, 3)
        iso = F.concat_ws("-", F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y), F.lpad(g(o, DATE, 2), 2, "0"), F.lpad(g(o, DATE, 1), 2, "0"))
        return F.struct(o.alias("original"), iso.alias("normalized"))

    number = F.create_map(*[F.lit(v) for i, m in enumerate(MONTHS, 1) for v in (m, f"{i:02d}")])

    def words(o: Column) -> Column:
        iso = F.concat_ws("-", g(o, DATE_WORDS, 3), number[F.lower(g(o, DATE_WORDS, 2))], F.lpad(g(o, DATE_WORDS, 1), 2, "0"))
        return F.struct(o.alias("original"), iso.alias("normalized"))

    return F.concat(F.transform(_all(x, DATE), numeric), F.transform(_all(x, DATE_WORDS), words))


def money(x: Column) -> Column:
    """Array of struct original, value, currency: each amount once, in reais first; the value of unreadable digits is
    null."""

    def of(currency: str, sign: str, pattern: str) -> Column:
        def one(n: Column) -> Column:
            plain = F.replace(F.replace(n, F.lit("."), F.lit("")), F.lit(","), F.lit(".")) if currency == "BRL" else F.replace(n, F.lit(","), F.lit(""))
            return F.struct(F.concat(F.lit(f"{sign} "), n).alias("original"), plain.try_cast("double").alias("value"), F.lit(currency).alias("currency"))

        return F.transform(_all(x, pattern, 1), one)

    return F.concat(*[of(k, *v) for k, v in MONEY.items()])


def identity_numbers(x: Column) -> Column:
    """Array of struct kind, original."""

    def of(kind: str, pattern: str) -> Column:
        return F.transform(_all(x, pattern), lambda o: F.struct(F.lit(kind).alias("kind"), o.alias("original")))

    return F.concat(*[of(k, p) for k, p in IDS.items()])


def explode(df: DataFrame, array: Column, *keys: str) -> DataFrame:
    """One row per entity with the keys; whole texts are read, entity by entity rows come out."""
    return df.select(*keys, F.explode(array).alias("e")).select(*keys, "e.*")


def merge(first: DataFrame, second: DataFrame, *keys: str, by: str = "original") -> DataFrame:
    """All rows of first, and those of second whose `by` first has not for the same keys. Null `by` matches nothing."""
    unseen = second.join(first.select(*keys, by).distinct(), [*keys, by], "left_anti")
    return first.withColumn("origin_rank", F.lit(1)).unionByName(unseen.withColumn("origin_rank", F.lit(2)), allowMissingColumns=True)


def of_files(pages: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """doc_id and arrays people, organizations, locations, dates, monetary_values, technical_terms: dates and amounts by
    pattern over a file's whole text, its pages two line breaks apart. answers (doc_id, answer, one a file): their
    entities come first, then those by pattern whose original they lack; without them only patterns find any."""
    text = full_text(pages).withColumnRenamed("text", "t")
    none = F.lit(None).cast("string").alias("context")
    by = {"dates": F.transform(dates(F.col("t")), lambda e: F.struct(e["original"], e["normalized"], none)), "monetary_values": F.transform(money(F.col("t")), lambda e: F.struct(e["original"], e["value"], e["currency"], none))}
    found = text.select("doc_id", *[v.alias(f"_{k}") for k, v in by.items()])
    given = elements.read_entities(answers if answers is not None else text.select("doc_id", F.lit(None).cast("string").alias("answer")).limit(0))
    rows = found.join(given, "doc_id", "left")
    fields = {f.name: F.coalesce(f.name, F.from_json(F.lit("[]"), f.dataType)) for f in given.schema if f.name != "doc_id"}

    def joined(first: Column, second: Column) -> Column:
        return F.concat(first, F.filter(second, lambda e: ~F.array_contains(F.transform(first, lambda x: x["original"]), e["original"])))

    fields |= {k: joined(fields[k], F.col(f"_{k}")) for k in by}
    return rows.select("doc_id", *[v.alias(k) for k, v in fields.items()])
