"""Retrieval chunks: greedy packing of paragraphs with overlap, chunks of sections and of tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.runtime import checkpointed, settled

SIZE, OVERLAP, MOST = 500, 50, 2000
TABLE_ROWS = 20


def _units(x: Column, most: int) -> Column:
    """What is packed: paragraphs (`p`); of a paragraph of more than `most` tokens its sentences (`f` the first, `s` the
    others)."""
    paras = F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), "\n\n+"), X.strip), lambda p: p != "")
    unit = lambda s, k: F.struct(s.alias("x"), k.alias("k"))
    long = lambda p: F.transform(X.sentences(p), lambda s, i: unit(s, F.when(i == 0, "f").otherwise("s")))
    return F.flatten(F.transform(paras, lambda p: F.when(X.tokens(p) > most, long(p)).otherwise(F.array(unit(p, F.lit("p"))))))


def split(x: Column | str, size: int = SIZE, overlap: int = OVERLAP, most: int = MOST) -> Column:
    """Chunks of a text, greedily packed: a unit that would bring the chunk beyond `size` tokens begins the next one.

    The next chunk repeats the last unit if there is an overlap and the unit is a sentence, or the new one is smaller
    than the overlap. Sentences of one chunk are joined by blanks when the next unit is a sentence too, else units by
    empty lines. One fold per text, no shuffle. Null and blank texts have no chunks."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), none.alias("cur"), F.lit(0).alias("t"))
    state = lambda done, cur, t: F.struct(done.alias("done"), cur.alias("cur"), t.cast("int").alias("t"))
    push = lambda a, sep: F.concat(a["done"], F.array(F.array_join(a["cur"], sep)))

    def step(a: Column, u: Column) -> Column:
        n = X.tokens(u["x"])
        first, sentence = u["k"] == "f", u["k"] != "p"
        full = F.size(a["cur"]) > 0
        over = (a["t"] + n > size) & full
        last = F.element_at(a["cur"], -1)
        repeat = sentence | (n < overlap) if overlap > 0 else F.lit(False)
        flushed = state(F.when(full, push(a, "\n\n")).otherwise(a["done"]), F.array(u["x"]), n)
        done = F.when(sentence, push(a, " ")).otherwise(push(a, "\n\n"))
        again = state(done, F.when(repeat, F.array(last, u["x"])).otherwise(F.array(u["x"])), F.when(repeat, X.tokens(last)).otherwise(F.lit(0)) + n)
        return F.when(first, flushed).when(over, again).otherwise(state(a["done"], F.concat(a["cur"], F.array(u["x"])), a["t"] + n))

    return F.aggregate(_units(X.c(x), most), start, step, lambda a: F.when(F.size(a["cur"]) > 0, push(a, "\n\n")).otherwise(a["done"]))


def _parts(size: int, overlap: int, most: int) -> Column:
    """A section's chunks: its content if that fits, else its pieces; none without content."""
    content = F.col("_stripped")
    return F.when(X.tokens(content) <= size, F.when(content != "", F.array(content)).otherwise(F.array().cast("array<string>"))).otherwise(split(content, size, overlap, most))


def _cut(sections: DataFrame, size: int, overlap: int, most: int) -> DataFrame:
    """sections with `parts`, their chunks."""
    return settled(settled(sections.withColumn("_stripped", X.strip("content"))).withColumn("parts", _parts(size, overlap, most)).drop("content", "_stripped"))


def of_sections(sections: DataFrame, size: int = SIZE, overlap: int = OVERLAP, most: int = MOST) -> DataFrame:
    """doc_id, path, part, section_id, section_title, page, text, token_count, has_table: one chunk per section that fits,
    else its pieces; none for a section without content."""
    rows = _cut(sections, size, overlap, most).select("doc_id", "path", F.col("id").alias("section_id"), F.col("full_title").alias("section_title"), "page", (F.size("tables_refs") > 0).alias("has_table"), F.posexplode("parts").alias("part", "text"))
    return rows.select("doc_id", "path", "part", "section_id", "section_title", "page", "text", X.tokens("text").alias("token_count"), "has_table")


def table_text(columns: Column, data: Column, title: Column | None = None) -> Column:
    """A table as text: title, header, at most 20 rows and how many more there are."""
    bar = lambda row: F.concat(F.lit("| "), F.array_join(row, " | ", ""), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(columns, lambda _: F.lit("---")), "|"), F.lit("|"))
    head = F.when(F.size(columns) > 0, F.array(bar(columns), rule)).otherwise(F.array().cast("array<string>"))
    more = F.when(F.size(data) > TABLE_ROWS, F.array(F.format_string("... (%d linhas adicionais)", F.size(data) - TABLE_ROWS))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(head, F.transform(F.slice(data, 1, TABLE_ROWS), bar), more)
    if title is not None:
        lines = F.concat(F.when(title.isNotNull(), F.array(F.concat(F.lit("Tabela: "), title))).otherwise(F.array().cast("array<string>")), lines)
    return F.array_join(lines, "\n")


def of_tables(tables: DataFrame) -> DataFrame:
    text = table_text(F.col("columns"), F.col("data"))
    rows = tables.withColumn("text", text).where(X.strip("text") != "")
    return rows.select("doc_id", "table_no", F.lit(None).cast("string").alias("section_id"), F.lit("Tabela").alias("section_title"), "page", "text", X.tokens("text").alias("token_count"), F.lit(True).alias("has_table"))


def generate(sections: DataFrame, tables: DataFrame, size: int = SIZE, overlap: int = OVERLAP, most: int = MOST) -> DataFrame:
    """All chunks of every file, sections depth first, then tables: doc_id, chunk_index (from 0), id, section_id,
    section_title, page, text, token_count, has_table, has_figure."""
    # Pieces are cut once and written; only their counts are ordered within a file, never texts.
    cut = _cut(sections, size, overlap, most).where("size(parts) > 0")
    cut = checkpointed(cut.select("doc_id", "path", F.col("id").alias("section_id"), F.col("full_title").alias("section_title"), "page", (F.size("tables_refs") > 0).alias("has_table"), "parts"))
    sums = cut.select("doc_id", "path", F.size("parts").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("doc_id").orderBy("path").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("doc_id", "path", before.alias("first"))
    body = cut.join(offsets, ["doc_id", "path"]).select("doc_id", "section_id", "section_title", "page", "has_table", "first", F.posexplode("parts").alias("part", "text"))
    body = body.withColumn("chunk_index", (F.col("first") + F.col("part")).cast("int")).withColumn("token_count", X.tokens("text"))
    extra = of_tables(tables)
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy("table_no")) - 1
    nth = extra.select("doc_id", "table_no").withColumn("rank", rank).join(sums.groupBy("doc_id").agg(F.sum("n").alias("all")), "doc_id", "left")
    extra = extra.join(nth.select("doc_id", "table_no", (F.col("rank") + F.coalesce("all", F.lit(0))).cast("int").alias("chunk_index")), ["doc_id", "table_no"])
    columns = ["doc_id", "chunk_index", "section_id", "section_title", "page", "text", "token_count", "has_table"]
    every = body.select(columns).unionByName(extra.select(columns))
    return every.select("doc_id", "chunk_index", F.format_string("chunk_%04d", "chunk_index").alias("id"), *columns[2:], F.lit(False).alias("has_figure"))
