"""From pages to elements: headings, paragraphs, list items, tables, equations, footnotes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.runtime import settled

#: A block without font is read in these sizes; a heading's font is this many times the body's.
BODY, RATIO = 12.0, 1.2
#: Blocks this far down the page can be footnotes.
FOOT = 0.85
#: How sure a table found in text is.
TABLE_CONFIDENCE = 0.6

PAGE = ("doc_id", "page")


def once(pages: DataFrame) -> DataFrame:
    """Each page once; rows of a page are copies of one another."""
    return pages.dropDuplicates([*PAGE])


def blocks(pages: DataFrame) -> DataFrame:
    """One block per line of raw_text: doc_id, page, block_idx, text, bbox, font_name, font_size, is_bold, is_italic.

    Plain text has no fonts (null) and a made-up box of 17 points a line. Null and empty texts give no blocks."""
    lines = pages.where("raw_text is not null and raw_text <> ''").select(*PAGE, F.posexplode(F.split("raw_text", "\n")).alias("block_idx", "text"))
    y = F.col("block_idx") * 17.0
    box = F.struct(F.lit(0.0).alias("x0"), y.alias("y0"), F.lit(500.0).alias("x1"), (y + 12.0).alias("y1"), F.col("page"))
    none = F.lit(None)
    return lines.select("*", box.alias("bbox"), none.cast("string").alias("font_name"), none.cast("double").alias("font_size"), none.cast("boolean").alias("is_bold"), none.cast("boolean").alias("is_italic"))


def level(body: float | Column = BODY, threshold: float | Column | None = None) -> Column:
    """Heading level of a block by its text, then its font, then boldness; null for none."""
    size, text = F.col("font_size"), X.strip("text")
    ratio = size / F.lit(body)
    threshold = body * RATIO if threshold is None else threshold
    by_size = F.when(size > body * RATIO, F.when(ratio > 1.8, 1).when(ratio > 1.5, 2).when(ratio > 1.2, 3))
    at_size = F.when(size >= threshold, F.when(ratio >= 1.8, 1).when(ratio >= 1.5, 2).when(ratio >= 1.2, 3))
    bold = F.when(F.coalesce("is_bold", F.lit(False)) & (F.length(text) < 100) & ~text.rlike("[.,;]$"), 3)
    return F.coalesce(X.heading_level("text"), by_size, at_size, bold)


def classify(block: DataFrame, body: float | Column = BODY, threshold: float | Column | None = None) -> DataFrame:
    """Non-blank blocks with `level`, `list_type` and `kind`: heading before list before text."""
    named = block.where(X.strip("text") != "").withColumns({"level": level(body, threshold), "list_type": X.list_type("text")})
    kind = F.when(F.col("level").isNotNull(), "heading").when(F.col("list_type").isNotNull(), "list").otherwise("text")
    return settled(named, *PAGE).withColumn("kind", kind)


def numbered(rows: DataFrame, name: str, *order: str, of: Column | None = None) -> DataFrame:
    """rows with `name`, their ordinal from 1 in their file, or with `of` the sum of it up to them. Rows are numbered within
    their page; a page's offset comes from the sums of the pages before, so a file of a third of all rows is never sorted
    as one."""
    one = F.lit(1) if of is None else of
    page = W.partitionBy(*PAGE).orderBy(*order)
    inside = F.row_number().over(page) if of is None else F.sum(one).over(page)
    counts = rows.groupBy(*PAGE).agg(F.sum(one).alias("_n"))
    before = W.partitionBy("doc_id").orderBy("page").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*PAGE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.withColumn("_i", inside).join(offsets, [*PAGE]).withColumn(name, (F.col("_i") + F.col("_before")).cast("int")).drop("_i", "_before")


def runs(hits: Column, least: int = 1) -> Column:
    """hits, an array of struct x and run, cut where run changes: an array of arrays of x with at least `least` each. Takes
    time in proportion to hits."""

    def cut(h: Column) -> Column:
        before = F.concat(F.array(F.lit(-1)), F.transform(h, lambda r: r["run"]))
        flags = F.zip_with(F.transform(h, lambda r, k: F.struct(r["run"].alias("run"), (k + 1).alias("at"))), F.slice(before, F.lit(1), F.size(h)), lambda r, p: F.when(r["run"] != p, r["at"]))
        starts = F.filter(flags, lambda a: a.isNotNull())
        parts = lambda s: F.zip_with(s, F.concat(F.slice(s, 2, 1 << 30), F.array(F.size(h) + 1)), lambda a, z: F.when(z - a >= least, F.transform(F.slice(h, a, z - a), lambda r: r["x"])))
        return X.let(starts, lambda s: F.filter(parts(s), lambda r: r.isNotNull()))

    return X.let(hits, lambda h: F.when(F.size(h) >= least, cut(h)).otherwise(F.array().cast("array<array<string>>")))


def page_elements(classified: DataFrame) -> DataFrame:
    """doc_id, page, heads (array of block_idx, text, level), paras (array of texts), n_lists of classified blocks: those
    of a page in one row. Runs of text are cut in the page's array; pages that are partitioned by doc_id and page already
    are not shuffled again."""
    row = F.struct("block_idx", "text", "level", (F.col("kind") == "text").alias("plain"))
    pages = classified.groupBy(*PAGE).agg(F.array_sort(F.collect_list(row)).alias("c"), F.count_if(F.col("kind") == "list").cast("int").alias("n_lists"))
    ranked = F.transform("c", lambda r, k: F.struct(r["text"].alias("text"), k.alias("k"), r["plain"].alias("plain")))
    hits = F.transform(F.filter(ranked, lambda r: r["plain"]), lambda r, n: F.struct(r["text"].alias("x"), (r["k"] - n).alias("run")))
    heads = F.transform(F.filter("c", lambda r: r["level"].isNotNull()), lambda r: F.struct(r["block_idx"], X.collapse(r["text"]).alias("text"), r["level"]))
    return pages.select(*PAGE, heads.alias("heads"), F.transform(runs(hits), lambda p: X.collapse(F.array_join(p, " "))).alias("paras"), "n_lists")


def headings_of(elements: DataFrame) -> DataFrame:
    """doc_id, page, block_idx, seq, text, level of page_elements()."""
    rows = elements.where("size(heads) > 0").select(*PAGE, F.explode("heads").alias("h")).select(*PAGE, "h.block_idx", "h.text", "h.level")
    return numbered(rows, "seq", "block_idx")


def contents_of(elements: DataFrame) -> DataFrame:
    """doc_id, page, content: the paragraphs of each page that has some, with empty lines between."""
    return elements.where("size(paras) > 0").select(*PAGE, F.array_join("paras", "\n\n").alias("content"))


def headings(classified: DataFrame, tidy=X.collapse) -> DataFrame:
    """doc_id, page, block_idx, seq (from 1 in the file), id, text, level, bbox."""
    rows = numbered(classified.where("kind = 'heading'"), "seq", "block_idx")
    return rows.select(*PAGE, "block_idx", "seq", F.concat(F.lit("h_"), "seq").alias("id"), tidy("text").alias("text"), "level", "bbox")


def list_items(classified: DataFrame, tidy=X.collapse) -> DataFrame:
    """doc_id, page, block_idx, seq, id, text without marker, list_type, bbox; items have level 0 and no index."""
    rows = numbered(classified.where("kind = 'list'"), "seq", "block_idx")
    return rows.select(*PAGE, "block_idx", "seq", F.concat(F.lit("li_"), "seq").alias("id"), tidy(X.without_marker("text")).alias("text"), "list_type", "bbox")


def paragraphs(classified: DataFrame, tidy=X.collapse) -> DataFrame:
    """Runs of text blocks that no heading or list item parts: doc_id, page, para_no (from 1 on the page), first_block,
    n_blocks, text, bbox. Blank blocks do not part a run. Windows and groups are one page each."""
    run = F.sum(F.when(F.col("kind") != "text", 1).otherwise(0)).over(W.partitionBy(*PAGE).orderBy("block_idx"))
    rows = classified.withColumn("_run", run).where("kind = 'text'")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "text"))), lambda b: b["text"]), " ")
    edge = lambda f, k: f(F.col("bbox")[k]).alias(k)
    box = F.struct(edge(F.min, "x0"), edge(F.min, "y0"), edge(F.max, "x1"), edge(F.max, "y1"))
    out = rows.groupBy(*PAGE, "_run").agg(F.min("block_idx").alias("first_block"), F.count("*").cast("int").alias("n_blocks"), tidy(joined).alias("text"), box.alias("bbox"))
    return out.select(*PAGE, F.row_number().over(W.partitionBy(*PAGE).orderBy("first_block")).alias("para_no"), "first_block", "n_blocks", "text", "bbox")


def is_table_row(x: Column) -> Column:
    count = lambda s: F.floor((F.length(x) - F.length(F.replace(x, F.lit(s), F.lit("")))) / len(s))
    return (count("\t") >= 2) | (count("|") >= 2) | (count("  ") >= 3)


def table_runs(x: Column) -> Column:
    """Runs of at least two table-like lines of a text, each an array of its lines. Lines next to each other have the same
    distance between their number and their rank among such lines; runs are cut where it changes. Nothing is shuffled."""
    rows = F.transform(F.split(x, "\n"), lambda line, i: F.struct(line.alias("x"), i.alias("i")))
    return runs(F.transform(F.filter(rows, lambda r: is_table_row(r["x"])), lambda r, k: F.struct(r["x"].alias("x"), (r["i"] - k).alias("run"))), 2)


def cells(lines: Column) -> Column:
    """Rows of non-empty cells; the first line tells the separator: tab, then bar, then two blanks. Rows without cells
    are left out."""
    head = F.get(lines, F.lit(0))
    full = lambda row: F.filter(row, lambda c: c != "")
    cut = lambda sep: F.transform(lines, lambda s: full(F.transform(F.split(s, sep), X.strip)))
    wide = F.transform(lines, lambda s: full(F.split(X.strip(s), rf"[{X.WS}]{{2,}}")))
    rows = F.when(head.contains("\t"), cut("\t")).when(head.contains("|"), cut(r"\|")).otherwise(wide)
    return F.filter(rows, lambda r: F.size(r) > 0)


def tables(pages: DataFrame) -> DataFrame:
    """Tables in plain text: doc_id, page, table_no (from 1 in the file, runs without cells counted), id, columns, data,
    confidence. Null texts have none."""
    runs = pages.where("raw_text is not null").select(*PAGE, F.posexplode(table_runs(F.col("raw_text"))).alias("run", "lines"))
    rows = numbered(runs, "table_no", "run").withColumn("rows", cells(F.col("lines"))).where("size(rows) > 0")
    return rows.select(
        *PAGE, "table_no", F.concat(F.lit("table_"), "table_no").alias("id"), F.get("rows", F.lit(0)).alias("columns"), F.slice("rows", 2, 1_000_000_000).alias("data"),
        F.lit(TABLE_CONFIDENCE).alias("confidence"), F.lit(False).alias("has_merged_cells"),
    )


# How formulas are written.
EQUATIONS = (r"\$\$(.+?)\$\$", r"\$(.+?)\$", r"\\begin\{equation\}(.+?)\\end\{equation\}", r"\\begin\{align\}(.+?)\\end\{align\}")


def equations(pages: DataFrame) -> DataFrame:
    """doc_id, page, eq_no (from 1 in the file), id, latex, is_inline. Patterns are tried one after the other over the
    whole text, so what stands between two display formulas is found as inline too."""

    def by(i: int, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("raw_text", F.lit(f"(?s){pattern}"), F.lit(1)), lambda s: F.struct(F.lit(i).alias("pattern"), X.strip(s).alias("latex")))

    found = F.concat(*[by(i, p) for i, p in enumerate(EQUATIONS)])
    rows = pages.where("instr(raw_text, '$') > 0 or instr(raw_text, 'begin{') > 0").select(*PAGE, F.posexplode(found).alias("pos", "e"))
    rows = numbered(rows, "eq_no", "pos")
    return rows.select(*PAGE, "eq_no", F.concat(F.lit("eq_"), "eq_no").alias("id"), F.col("e.latex").alias("latex"), (F.col("e.pattern") == 1).alias("is_inline"))


def footnotes(block: DataFrame) -> DataFrame:
    """Blocks in the last part of a page that begin with a marker: doc_id, page, block_idx, marker, text."""
    height = F.coalesce(F.max(F.col("bbox.y1")).over(W.partitionBy(*PAGE)), F.lit(0.0))
    t = X.strip("text")
    p = rf"(?d)^(\d+|[*†‡§])[{X.WS}]*(.+)"
    low = block.withColumn("_h", height).where((F.col("bbox.y0") > F.col("_h") * FOOT) & t.rlike(p))
    return low.select(*PAGE, "block_idx", F.regexp_extract(t, p, 1).alias("marker"), F.regexp_extract(t, p, 2).alias("text"))


def calibrate(sizes: DataFrame, key: str = "doc_id", size: str = "font_size", pos: str = "pos") -> DataFrame:
    """key, body (the most frequent size, of equals the one seen first, of those the
    smaller; 12 without sizes) and threshold (1.2 times body,
    14 without sizes)."""
    counts = sizes.groupBy(key, F.round(size, 1).alias("size")).agg(F.count(size).alias("n"), F.min(pos).alias("first"))
    best = counts.groupBy(key).agg(F.max_by(F.when(F.col("n") > 0, F.col("size")), F.struct("n", -F.col("first"), -F.col("size"))).alias("body"))
    return best.select(key, F.coalesce("body", F.lit(BODY)).alias("body"), F.coalesce(F.col("body") * RATIO, F.lit(14.0)).alias("threshold"))


def classify_calibrated(block: DataFrame) -> DataFrame:
    """classify() by the body size and threshold of each file's own fonts."""
    pos = F.shiftleft(F.col("page").cast("bigint"), 32) + F.col("block_idx")
    fonts = calibrate(block.where(X.strip("text") != "").select("doc_id", "font_size", pos.alias("pos")))
    body, threshold = fonts["body"].alias("_body"), fonts["threshold"].alias("_threshold")
    with_fonts = block.join(fonts.select("doc_id", body, threshold), "doc_id", "left")
    return classify(with_fonts, F.coalesce("_body", F.lit(BODY)), F.coalesce("_threshold", F.lit(BODY * RATIO))).drop("_body", "_threshold")
