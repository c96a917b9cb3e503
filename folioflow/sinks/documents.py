"""Markdown and hybrid JSON, one row per file."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.figures import render_figure, unreferenced
from ..operators.structure import PAGE


def anchor(x: Column) -> Column:
    """Lower case, blanks to hyphens, letters, digits and hyphens only."""
    return F.regexp_replace(F.replace(F.lower(x), F.lit(" "), F.lit("-")), r"[^\p{L}\p{N}-]", "")


def markdown_table(columns: Column, data: Column) -> Column:
    """Rows padded with empty cells, or cut, to the header's length."""
    n = F.size(columns)
    bar = lambda row: F.concat(F.lit("| "), F.array_join(row, " | ", ""), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(columns, lambda _: F.lit("---")), "|"), F.lit("|"))
    fit = lambda row: F.slice(F.concat(row, F.array_repeat(F.lit(""), n)), F.lit(1), n)
    return F.array_join(F.concat(F.array(bar(columns), rule), F.transform(data, lambda r: bar(fit(r)))), "\n")


def _by_path(*fields: Column) -> Column:
    return F.array_sort(F.collect_list(F.struct("path", *fields)))


def toc(sections: DataFrame) -> DataFrame:
    """doc_id, toc: one line per section, depth first, two blanks per depth."""
    line = F.concat(F.repeat(F.lit("  "), F.size("path") - 1), F.lit("- ["), "title", F.lit("](#"), anchor(F.col("title")), F.lit(")"))
    return sections.groupBy("doc_id").agg(F.array_join(F.transform(_by_path(line.alias("line")), lambda s: s["line"]), "\n").alias("toc"))


def markdown(metadata: DataFrame, sections: DataFrame, tables: DataFrame, summary: DataFrame, footnotes: DataFrame, frontmatter: bool = True, figures: DataFrame | None = None) -> DataFrame:
    """doc_id, markdown: frontmatter, title, contents, summary, sections depth first with the tables and figures (see
    operators.figures) of their page, figures of pages without section, notes.
    One row per file is the sink's form; every part is gathered per file."""
    grid = tables.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_no", markdown_table(F.col("columns"), F.col("data")).alias("md")))), lambda t: F.concat(t["md"], F.lit("\n"))), "\n").alias("grid"))
    none = F.lit(None).cast("string")
    body = sections.join(grid, [*PAGE], "left")
    apart = None
    if figures is not None:
        image = F.struct("id", F.concat(render_figure(F.col("title"), F.col("caption"), F.col("alt_text"), F.col("asset_path")), F.lit("\n")).alias("md"))
        shown = F.array_join(F.transform(F.array_sort(F.collect_list(image)), lambda f: f["md"]), "\n")
        body = body.join(figures.groupBy(*PAGE).agg(shown.alias("figs")), [*PAGE], "left")
        apart = unreferenced(figures, sections).groupBy("doc_id").agg(shown.alias("apart"))
    else:
        body = body.withColumn("figs", none)
    head = F.concat(F.repeat(F.lit("#"), F.least("level", F.lit(6))), F.lit(" "), "title", F.lit("\n"))
    part = F.array_join(F.array(head, F.when(F.col("content") != "", F.concat("content", F.lit("\n"))), F.col("grid"), F.col("figs")), "\n")
    text = body.groupBy("doc_id").agg(F.array_join(F.transform(_by_path(part.alias("md")), lambda s: s["md"]), "\n").alias("body"))
    notes = footnotes.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "block_idx", F.concat(F.lit("[^"), "marker", F.lit("]: "), "text", F.lit("\n")).alias("n")))), lambda x: x["n"]), "\n").alias("notes"))
    rows = metadata
    for other in (toc(sections), summary, text, notes, *([apart] if apart is not None else [])):
        rows = rows.join(other, "doc_id", "left")
    title = F.when(F.col("title").isNotNull(), F.concat(F.lit('title: "'), "title", F.lit('"')))
    front = F.array_join(F.array(F.lit("---"), title, F.lit("document_type: unknown"), F.concat(F.lit("source_file: "), "doc_id"), F.concat(F.lit("page_count: "), "page_count"), F.concat(F.lit("language: "), "language"), F.lit("---\n")), "\n")
    parts = [
        front if frontmatter else F.lit(None).cast("string"), F.when(F.col("title").isNotNull(), F.concat(F.lit("# "), "title", F.lit("\n"))),
        F.when(F.col("toc").isNotNull(), F.concat(F.lit("## Sumário\n\n"), "toc", F.lit("\n"))), F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("## Resumo\n\n"), "summary", F.lit("\n"))),
        F.col("body"), none if apart is None else F.when(F.col("apart").isNotNull(), F.concat(F.lit("## Figuras\n\n"), "apart")), F.when(F.col("notes").isNotNull(), F.concat(F.lit("## Notas\n\n"), "notes")),
    ]
    return rows.select("doc_id", F.array_join(F.array(*parts), "\n").alias("markdown"))


def hybrid_json(metadata: DataFrame, sections: DataFrame, tables: DataFrame, chunks: DataFrame, summary: DataFrame, confidence: DataFrame, structured: DataFrame | None = None, entities: DataFrame | None = None, figures: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """doc_id, json: a fixed layer (metadata, content with the figures given, entities, null if not extracted, processing
    info, chunks), raw_text_by_page if pages are given, and the inferred layer as given
    (structured: doc_id, structured_data as JSON text) or a note that there is none. Sections are flat with parent_id
    and path, since no type nests without end; nulls are written."""
    full = {"ignoreNullFields": "false"}
    s = sections.withColumn("parent_id", F.when(F.col("parent_seq").isNotNull(), F.concat(F.lit("sec_"), F.col("parent_seq") - 1)))
    refs = F.array().cast("array<string>").alias("figures_refs")
    if figures is not None:
        s = s.join(figures.groupBy(*PAGE).agg(F.array_sort(F.collect_set("id")).alias("figures_refs")), [*PAGE], "left")
        refs = F.coalesce("figures_refs", F.array().cast("array<string>")).alias("figures_refs")
    s = s.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("path", "id", "parent_id", "title", "level", "content", F.col("page").alias("page_start"), F.col("page").alias("page_end"), "tables_refs", refs))).alias("sections"))
    cols = F.transform("columns", lambda c: F.struct(c.alias("name"), F.lit("text").alias("type")))
    t = tables.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("table_no", "id", "page", cols.alias("columns"), "data", "has_merged_cells", F.lit("text_extraction").alias("source"), "confidence"))).alias("tables"))
    c = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "id", "text", "token_count", "section_id", "section_title", "page", "has_table", "has_figure"))).alias("chunks"))
    rows = metadata
    others = [s, t, c, summary, confidence, *([structured] if structured is not None else [])]
    if entities is not None:
        others.append(entities.select("doc_id", F.struct(*[k for k in entities.columns if k != "doc_id"]).alias("entities")))
    if figures is not None:
        others.append(figures.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("page").alias("_page"), "id", "title", "caption", "alt_text", "figure_type", "page"))), lambda f: f.dropFields("_page")).alias("figures")))
    for other in others:
        rows = rows.join(other, "doc_id", "left")
    no_figures = F.from_json(F.lit("[]"), "array<struct<id:string,title:string,caption:string,alt_text:string,figure_type:string,page:int>>")
    rows = rows.withColumn("figures", no_figures if figures is None else F.coalesce("figures", no_figures))
    raw = []
    if pages is not None:
        raw = ["raw_text_by_page"]
        rows = rows.join(pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", F.coalesce("raw_text", F.lit("")).alias("text")))).alias(raw[0])), "doc_id", "left")
    if entities is None:
        rows = rows.withColumn("entities", F.lit(None).cast("string"))
    note = F.lit('{"_schema_inferred": false, "_document_type": "unknown", "_note": "Schema inference was disabled"}')
    inferred = F.parse_json(F.coalesce("structured_data", note) if structured is not None else note)
    meta = F.struct("doc_id", "title", F.lit("unknown").alias("document_type"), "language", "page_count")
    content = F.struct("summary", "sections", "tables", "figures")
    info = F.struct(F.round("confidence", 3).alias("overall_confidence"))
    return rows.select("doc_id", F.to_json(F.struct(meta.alias("metadata"), content.alias("content"), "entities", info.alias("processing_info"), "chunks", *raw, inferred.alias("structured_data")), full).alias("json"))
