"""Queries of whole documents, figures, fonts, spans, vision and streams, over whole tables, with equivalent SQL."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..inference import answers, elements
from ..operators import figures, sections, structure, vision
from ..sinks import documents as sinks
from ..sources import files
from ..sources.tables import table
from ..streaming import jobs
from . import pipeline
from .queries import SQL as BATCH
from .queries import _CLASSIFIED, _HEADS, _LINES, _PAGES, _PARAS, _TABLES, _TREE, WS, _chunk_pages, _chunk_sql, _classified, _equation_sql, _pages, _strip
from .runtime import checkpointed

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


# Parts of SQL: the tree of sections with paths, contents, tables and notes of pages.
_UP = (
    ", up AS (SELECT doc_id, page, seq, title, level, [seq] AS path, title AS full_title FROM tree WHERE parent_seq IS NULL UNION ALL "
    "SELECT t.doc_id, t.page, t.seq, t.title, t.level, list_append(u.path, t.seq), u.full_title || ' > ' || t.title FROM tree t JOIN up u ON t.doc_id = u.doc_id AND t.parent_seq = u.seq)"
)
_PAGE_TABLES = _TABLES[_TABLES.index(", l AS (") :].replace("l AS (", "tl AS (", 1).replace(" FROM l)", " FROM tl)")
_REST = _PARAS[len(_CLASSIFIED) :]
_CONTENT = ", content AS (SELECT doc_id, page, string_agg(text, chr(10) || chr(10) ORDER BY para_no) AS content FROM q GROUP BY doc_id, page)"
_SECTIONS = (
    _TREE + _UP + _REST.replace("r AS (SELECT *, sum(", "rr AS (SELECT *, sum(").replace("FROM r WHERE", "FROM rr WHERE") + _CONTENT
    + ", sec AS (SELECT up.doc_id, up.page, up.seq, up.title, up.level, up.path, up.full_title, coalesce(content, '') AS content FROM up LEFT JOIN content USING (doc_id, page) "
    "UNION ALL SELECT doc_id, 1, 1, 'Documento', 1, [1], 'Documento', string_agg(text, chr(10) || chr(10) ORDER BY page, para_no) FROM q WHERE doc_id NOT IN (SELECT doc_id FROM h) GROUP BY doc_id)"
)
_NOTE = rf"'^(\d+|[*†‡§])[{WS}]*(.+)'"
_NOTES = f", nl AS (SELECT *, max(block_idx) OVER (PARTITION BY doc_id, page) * 17.0 + 12.0 AS height FROM s), nn AS (SELECT doc_id, page, block_idx, regexp_extract(t, {_NOTE}, 1) AS marker, regexp_extract(t, {_NOTE}, 2) AS text FROM nl WHERE block_idx * 17.0 > height * 0.85 AND regexp_matches(t, {_NOTE}))"
_ANCHOR = r"regexp_replace(replace(lower(title), ' ', '-'), '[^\p{L}\p{N}\-]', '', 'g')"
_GRID = (
    "'| ' || array_to_string(columns, ' | ') || ' |' || chr(10) || '|' || array_to_string(list_transform(columns, lambda c: '---'), '|') || '|' || "
    "coalesce((SELECT string_agg(chr(10) || '| ' || array_to_string(list_resize(r, len(columns), ''), ' | ') || ' |', '' ORDER BY i) FROM (SELECT unnest(data) AS r, generate_subscripts(data, 1) AS i)), '')"
)


def _convert(spark, d) -> dict[str, DataFrame]:
    return pipeline.convert(table(spark, d, "pages", "doc_id", "page", "raw_text"))


@query(f"WITH {_PAGES} SELECT doc_id, string_agg(coalesce(raw_text, ''), chr(10) || chr(10) ORDER BY page) AS text FROM p GROUP BY doc_id")
def document_texts(spark, d):
    """The whole text of each file."""
    return sections.full_text(_pages(spark, d))


@query(f"WITH {_PAGES} SELECT doc_id, CAST(greatest(1, sum(coalesce(length(raw_text), 0)) // 2000) AS INTEGER) AS page_count FROM p GROUP BY doc_id")
def estimated_pages(spark, d):
    """Pages reckoned from characters, as for files that have none."""
    return files.estimated_pages(_pages(spark, d).select("doc_id", F.col("raw_text").alias("text")))


@query(f"WITH RECURSIVE {_TREE}{_UP} SELECT doc_id, string_agg(repeat('  ', len(path) - 1) || '- [' || title || '](#' || {_ANCHOR} || ')', chr(10) ORDER BY path) AS toc FROM up GROUP BY doc_id")
def toc_render(spark, d):
    """Contents of the files that have headings."""
    heads = structure.headings_of(checkpointed(structure.page_elements(_classified(spark, d))))
    return sinks.toc(sections.lineage(heads))


@query(f"WITH RECURSIVE {_SECTIONS} SELECT doc_id, 'sec_' || (seq - 1) AS id, page, CAST(level AS INTEGER) AS level, full_title, content FROM sec")
def section_tree(spark, d):
    return _convert(spark, d)["sections"].select("doc_id", "id", "page", "level", "full_title", "content")


@query(
    f"WITH RECURSIVE {_SECTIONS}{_PAGE_TABLES}, gt AS (SELECT doc_id, page, table_no, {_GRID} || chr(10) AS md FROM t), gr AS (SELECT doc_id, page, string_agg(md, chr(10) ORDER BY table_no) AS grid FROM gt GROUP BY doc_id, page)"
    f", se AS (SELECT doc_id, path, concat_ws(chr(10), repeat('#', least(level, 6)) || ' ' || title || chr(10), CASE WHEN content <> '' THEN content || chr(10) END, grid) AS md, repeat('  ', len(path) - 1) || '- [' || title || '](#' || {_ANCHOR} || ')' AS line FROM sec LEFT JOIN gr USING (doc_id, page))"
    ", bo AS (SELECT doc_id, string_agg(md, chr(10) ORDER BY path) AS body, string_agg(line, chr(10) ORDER BY path) AS toc FROM se GROUP BY doc_id)"
    + _NOTES + ", no AS (SELECT doc_id, string_agg('[^' || marker || ']: ' || text || chr(10), chr(10) ORDER BY page, block_idx) AS notes FROM nn GROUP BY doc_id)"
    ", rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS k FROM p), su AS (SELECT doc_id, string_agg(coalesce(raw_text, ''), ' ' ORDER BY page) AS t FROM rk WHERE k <= 3 GROUP BY doc_id)"
    ", sm AS (SELECT doc_id, CASE WHEN length(t) > 500 THEN substring(t, 1, 500) || '...' ELSE t END AS summary FROM su)"
    ", me AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS page_count FROM p GROUP BY doc_id), ti AS (SELECT doc_id, title FROM h WHERE seq = 1)"
    " SELECT doc_id, concat_ws(chr(10), concat_ws(chr(10), '---', 'title: \"' || title || '\"', 'document_type: unknown', 'source_file: ' || doc_id, 'page_count: ' || page_count, 'language: pt', '---' || chr(10)), '# ' || title || chr(10), "
    "'## Sumário' || chr(10) || chr(10) || toc || chr(10), CASE WHEN summary <> '' THEN '## Resumo' || chr(10) || chr(10) || summary || chr(10) END, body, '## Notas' || chr(10) || chr(10) || notes) AS markdown "
    "FROM me LEFT JOIN ti USING (doc_id) LEFT JOIN bo USING (doc_id) LEFT JOIN sm USING (doc_id) LEFT JOIN no USING (doc_id)"
)
def markdown_render(spark, d):
    return _convert(spark, d)["markdown"]


@query(
    f"WITH RECURSIVE {_SECTIONS}{_PAGE_TABLES}, ns AS (SELECT doc_id, count(*) AS n_sections, string_agg(full_title, ' / ' ORDER BY path) AS titles FROM sec GROUP BY doc_id), nt AS (SELECT doc_id, count(*) AS n_tables FROM t GROUP BY doc_id)"
    ", rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS k FROM p), su AS (SELECT doc_id, string_agg(coalesce(raw_text, ''), ' ' ORDER BY page) AS t FROM rk WHERE k <= 3 GROUP BY doc_id)"
    ", me AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS page_count, least(avg(coalesce(length(raw_text), 0)) / 500, 1.0) AS a FROM p GROUP BY doc_id), ti AS (SELECT doc_id, title FROM h WHERE seq = 1) "
    "SELECT me.doc_id, title, page_count, CASE WHEN length(t) > 500 THEN substring(t, 1, 500) || '...' ELSE t END AS summary, CAST(coalesce(n_sections, 0) AS INTEGER) AS n_sections, CAST(coalesce(n_tables, 0) AS INTEGER) AS n_tables, "
    "round((a + CASE WHEN n_sections IS NULL THEN 0.5 ELSE 0.9 END) / 2, 3)::DOUBLE AS confidence FROM me LEFT JOIN ti USING (doc_id) LEFT JOIN su USING (doc_id) LEFT JOIN ns USING (doc_id) LEFT JOIN nt USING (doc_id)"
)
def json_layers(spark, d):
    """What the hybrid JSON of each file says, read back from it."""
    got = _convert(spark, d)["json"]
    get = lambda p: F.get_json_object("json", f"$.{p}")
    many = lambda p: F.coalesce(F.json_array_length(get(p)), F.lit(0))
    return got.select(
        "doc_id", get("metadata.title").alias("title"), get("metadata.page_count").cast("int").alias("page_count"), get("content.summary").alias("summary"), many("content.sections").alias("n_sections"),
        many("content.tables").alias("n_tables"), get("processing_info.overall_confidence").cast("double").alias("confidence"),
    )


def _sections_chunks_sql() -> str:
    cut = _chunk_sql(500, 50, 2000)
    inner = cut[cut.index(",\n a AS (") :].replace("ch AS INTEGER) AS chunk_no", "ch AS INTEGER) AS part")
    names = {" a AS (": " xa AS (", " b AS (": " xb AS (", " c AS (": " xc AS (", " FROM a)": " FROM xa)", " FROM b)": " FROM xb)", " FROM c ": " FROM xc ", "FROM p WHERE": "FROM big WHERE"}
    for old, new in names.items():
        inner = inner.replace(old, new)
    steps, final = inner[: inner.rindex("\n SELECT")], inner[inner.rindex("\n SELECT") :]
    body = _strip("content")
    return (
        f"WITH RECURSIVE {_SECTIONS}{_PAGE_TABLES}, so AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY path) AS ord, {body} AS b FROM sec), big AS (SELECT doc_id, ord AS page, content AS raw_text FROM so WHERE length(b) // 4 > 500)"
        + steps + f", pieces AS ({final}), every AS (SELECT doc_id, ord, 0 AS part, b AS text FROM so WHERE length(b) // 4 <= 500 AND b <> '' UNION ALL SELECT doc_id, page, part, text FROM pieces UNION ALL "
        f"SELECT doc_id, 1000000 + table_no, 0, {_GRID.replace('unnest(data)', 'unnest(data[1:20])').replace('generate_subscripts(data, 1)', 'generate_subscripts(data[1:20], 1)')}"
        " || CASE WHEN len(data) > 20 THEN chr(10) || '... (' || (len(data) - 20) || ' linhas adicionais)' ELSE '' END FROM t) "
        ", ix AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord, part) - 1 AS INTEGER) AS chunk_index FROM every) "
        "SELECT ix.doc_id, chunk_index, printf('chunk_%04d', chunk_index) AS id, 'sec_' || (so.seq - 1) AS section_id, coalesce(so.full_title, 'Tabela') AS section_title, CAST(coalesce(so.page, t.page) AS INTEGER) AS page, ix.text, CAST(length(ix.text) // 4 AS INTEGER) AS token_count, "
        "so.doc_id IS NULL OR (ix.doc_id IN (SELECT doc_id FROM h) AND EXISTS (SELECT 1 FROM t WHERE t.doc_id = so.doc_id AND t.page = so.page)) AS has_table, false AS has_figure "
        "FROM ix LEFT JOIN so ON ix.doc_id = so.doc_id AND ix.ord = so.ord LEFT JOIN t ON ix.doc_id = t.doc_id AND ix.ord = 1000000 + t.table_no"
    )


@query(_sections_chunks_sql().replace("array_to_string(list_resize(r, len(columns), ''), ' | ')", "array_to_string(r, ' | ')"))
def chunk_sections(spark, d):
    return _convert(spark, d)["chunks"]


@query(f"WITH {_LINES}" + _CLASSIFIED[len(_LINES) :] + _REST.replace("min(block_idx) AS first_block", "min(block_idx) AS first_block, min(block_idx) * 17.0::DOUBLE AS y0, max(block_idx) * 17.0::DOUBLE + 12.0 AS y1").replace("para_no, first_block", "para_no, y0, y1, first_block") + " SELECT doc_id, page, para_no, 0.0::DOUBLE AS x0, y0, 500.0::DOUBLE AS x1, y1 FROM q")
def paragraph_boxes(spark, d):
    """The box around each paragraph's blocks."""
    return structure.paragraphs(_classified(spark, d)).select("doc_id", "page", "para_no", "bbox.*")


# Fonts and spans --------------------------------------------------------------------------------------------------------

_CAL = (
    "b AS (SELECT l_orderkey AS doc, l_linenumber AS pos, 'Item ' || l_partkey AS text, l_quantity AS size, l_linestatus = 'F' AS bold FROM lineitem), ct AS (SELECT doc, round(size, 1) AS size, count(*) AS n, min(pos) AS first FROM b GROUP BY doc, round(size, 1)), "
    "rk AS (SELECT doc, size AS body, row_number() OVER (PARTITION BY doc ORDER BY n DESC, first, size) AS k FROM ct)"
)
_RATIO = "(size / body)"


@query(
    f"WITH {_CAL} SELECT CAST(b.doc AS VARCHAR) AS doc_id, pos AS block_idx, CASE WHEN size > body * 1.2::DOUBLE AND {_RATIO} > 1.8::DOUBLE THEN 1 WHEN size > body * 1.2::DOUBLE AND {_RATIO} > 1.5::DOUBLE THEN 2 WHEN size > body * 1.2::DOUBLE AND {_RATIO} > 1.2::DOUBLE THEN 3 "
    f"WHEN size >= body * 1.2::DOUBLE AND {_RATIO} >= 1.8::DOUBLE THEN 1 WHEN size >= body * 1.2::DOUBLE AND {_RATIO} >= 1.5::DOUBLE THEN 2 WHEN size >= body * 1.2::DOUBLE AND {_RATIO} >= 1.2::DOUBLE THEN 3 WHEN bold THEN 3 END AS level FROM b JOIN rk ON b.doc = rk.doc AND k = 1"
)
def heading_fonts(spark, d):
    """Levels by font and boldness: an order's lines stand for a file's blocks, quantities for sizes."""
    li = table(spark, d, "lineitem")
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(1).alias("page"))
    block = li.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("block_idx"), F.concat(F.lit("Item "), "l_partkey").alias("text"), box.alias("bbox"), F.col("l_quantity").alias("font_size"), (F.col("l_linestatus") == "F").alias("is_bold"))
    return structure.classify_calibrated(block).select("doc_id", "block_idx", "level")


def _spans(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    font = F.concat(F.when(F.col("l_returnflag") == "R", "Arial").otherwise("Times"), F.when(F.col("l_linestatus") == "F", "-Bold").otherwise(""), F.when(F.col("l_tax") > 0.05, "-Italic").otherwise(""))
    return li.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("block_idx"), (F.col("l_linenumber") % 2).cast("int").alias("line_idx"), F.col("l_linenumber").cast("int").alias("span_idx"), F.concat("l_partkey", F.lit(" ")).alias("text"), font.alias("font"), F.col("l_quantity").alias("size"), F.lit(None).cast("string").alias("bbox"))


_SPANS = (
    "sp AS (SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, CAST(l_linenumber % 2 AS INTEGER) AS line_idx, l_linenumber AS span_idx, l_partkey || ' ' AS text, "
    "CASE WHEN l_returnflag = 'R' THEN 'Arial' ELSE 'Times' END || CASE WHEN l_linestatus = 'F' THEN '-Bold' ELSE '' END || CASE WHEN l_tax > 0.05::DOUBLE THEN '-Italic' ELSE '' END AS font, l_quantity AS size FROM lineitem), "
    "fo AS (SELECT doc_id, line_idx, font, row_number() OVER (PARTITION BY doc_id, line_idx ORDER BY count(*) DESC, min(span_idx), font DESC) AS k FROM sp GROUP BY doc_id, line_idx, font)"
)


@query(f"WITH {_SPANS}, l AS (SELECT doc_id, line_idx, string_agg(text, '' ORDER BY span_idx, text) AS text, round(avg(size), 6) AS font_size, bool_or(contains(font, 'Bold')) AS is_bold, bool_or(contains(font, 'Italic')) AS is_italic FROM sp GROUP BY doc_id, line_idx) SELECT l.*, fo.font AS font_name FROM l JOIN fo ON l.doc_id = fo.doc_id AND l.line_idx = fo.line_idx AND k = 1")
def span_lines(spark, d):
    """Lines from spans; an order's lines stand for the spans of a file."""
    return files.lines(_spans(spark, d)).select("doc_id", "line_idx", "text", F.round("font_size", 6).alias("font_size"), "is_bold", "is_italic", "font_name")


@query(
    "WITH s AS (SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, l_linenumber AS page, l_quantity > 48 AS t, l_tax > 0.02::DOUBLE AS i, l_discount AS ratio FROM lineitem WHERE l_linenumber <= 5), g AS (SELECT doc_id, bool_or(t) AS t, bool_or(i) AS i, avg(ratio) AS r FROM s GROUP BY doc_id) "
    "SELECT doc_id, CASE WHEN NOT t AND i THEN 'pdf_scanned' WHEN t AND i AND r < 0.1 THEN 'pdf_mixed' ELSE 'pdf_native' END AS doc_type FROM g"
)
def pdf_kinds(spark, d):
    """Kinds of PDF by their first pages; an order's lines stand for pages."""
    li = table(spark, d, "lineitem")
    text = F.when(F.col("l_quantity") > 48, F.repeat(F.lit("x"), F.lit(51))).otherwise(F.lit("  x  "))
    return files.classify_pdf(li.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.col("l_linenumber").alias("page"), text.alias("text"), (F.col("l_tax") > 0.02).cast("int").alias("n_images"), F.col("l_discount").alias("text_area"), F.lit(1.0).alias("page_area")))


# Routing and vision -----------------------------------------------------------------------------------------------------


@query(
    "WITH " + _TABLES + _equation_sql("X")[len("WITH X") :].split(" SELECT doc_id, page, CAST(row_number()")[0]
    + ", eq AS (SELECT doc_id, page, 'eq_' || row_number() OVER (PARTITION BY doc_id ORDER BY page, pattern, pos) AS id, row_number() OVER (PARTITION BY doc_id ORDER BY page, pattern, pos) AS no FROM e)"
    ", tv AS (SELECT doc_id, page, string_agg('table_' || table_no, ',' ORDER BY table_no) AS for_vision, string_agg('Low extraction confidence: 0.60', '; ' ORDER BY table_no) AS why FROM t GROUP BY doc_id, page), ev AS (SELECT doc_id, page, string_agg(id, ',' ORDER BY no) AS for_text FROM eq GROUP BY doc_id, page) "
    "SELECT p.doc_id, p.page, coalesce(for_vision, '') AS for_vision, coalesce(for_text, '') AS for_text, coalesce(why, '') AS why FROM p LEFT JOIN tv USING (doc_id, page) LEFT JOIN ev USING (doc_id, page)"
)
def routing_plans(spark, d):
    """What is sent to vision, what stays text, and why, of each chunk."""
    p = _chunk_pages(spark, d)
    b = structure.blocks(p)
    c = structure.classify(b)
    r = sections.routing(p, c, structure.tables(p), structure.equations(p), structure.footnotes(b), structure.paragraphs(c))
    why = F.array_join(F.filter(F.split("reason", "; "), lambda x: ~x.isin("High ratio of complex elements", "Standard text extraction")), "; ")
    return r.select("doc_id", "page", F.array_join("for_vision", ",").alias("for_vision"), F.array_join("for_text", ",").alias("for_text"), why.alias("why"))


@query(f"WITH {_TABLES}, vd AS (SELECT DISTINCT doc_id, page FROM t), nd AS (SELECT doc_id, count(*) AS calls FROM vd GROUP BY doc_id) SELECT d.doc_id, coalesce(calls, 0) AS vision_calls, CAST(3000 AS BIGINT) AS tokens FROM (SELECT DISTINCT doc_id FROM p) d LEFT JOIN nd USING (doc_id)")
def vision_totals(spark, d):
    """Calls and tokens per file; every chunk with a table stands for a page that was asked about."""
    p = _chunk_pages(spark, d)
    asked = structure.tables(p).select("doc_id", "page").distinct()
    return vision.totals(p, asked, schema=True, extracted=True)


# Figures ----------------------------------------------------------------------------------------------------------------

_FIGS = "fg AS (SELECT DISTINCT doc_id, page, 'fig_v_' || page || '_' || chunk_index AS id FROM chunks WHERE has_figure AND doc_id IS NOT NULL AND page IS NOT NULL)"


def _figures(spark, d) -> DataFrame:
    c = table(spark, d, "chunks").where("has_figure and doc_id is not null and page is not null")
    none = F.lit(None).cast("string")
    return figures.collect(c.select("doc_id", "page", F.concat(F.lit("fig_v_"), "page", F.lit("_"), "chunk_index").alias("id"), none.alias("title"), none.alias("caption"), none.alias("alt_text"), F.lit("other").alias("figure_type")).distinct())


@query(f"WITH {_HEADS}, {_FIGS}, a AS (SELECT doc_id, page, string_agg(id, ',' ORDER BY id) AS refs FROM fg GROUP BY doc_id, page) SELECT h.doc_id, h.seq, a.refs FROM h JOIN a USING (doc_id, page)")
def figure_references(spark, d):
    """Figures on the pages of headings; chunks with a figure stand for figures."""
    return figures.references(structure.headings(_classified(spark, d)), _figures(spark, d)).select("doc_id", "seq", F.array_join("figures_refs", ",").alias("refs"))


@query(f"WITH {_HEADS}, {_FIGS} SELECT doc_id, page, id FROM fg WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = fg.doc_id AND h.page = fg.page)")
def unreferenced_figures(spark, d):
    return figures.unreferenced(_figures(spark, d), structure.headings(_classified(spark, d))).select("doc_id", "page", "id")


@query(f"WITH {_TABLES} SELECT doc_id, page, table_no, {_GRID} AS markdown FROM t")
def table_render(spark, d):
    """Tables of chunks as Markdown."""
    return structure.tables(_chunk_pages(spark, d)).select("doc_id", "page", "table_no", figures.render_table(F.col("columns"), F.col("data")).alias("markdown"))


@query(_equation_sql("p AS (SELECT DISTINCT doc_id, chunk_index AS page, text AS raw_text FROM chunks)").replace("SELECT doc_id, page, CAST(row_number()", "SELECT doc_id, page, CASE WHEN pattern = 1 THEN '$' || " + _strip("raw") + " || '$' ELSE '$$' || chr(10) || " + _strip("raw") + " || chr(10) || '$$' END AS markdown, CAST(row_number()").replace(f", {_strip('raw')} AS latex, pattern = 1 AS is_inline FROM e", " FROM e"))
def equation_render(spark, d):
    e = structure.equations(_chunk_pages(spark, d))
    return e.select("doc_id", "page", "eq_no", figures.render_equation(F.col("latex"), F.col("is_inline"), F.lit(None).cast("string")).alias("markdown"))


@query("WITH a AS (SELECT DISTINCT doc_id, 'chunk_' || chunk_index AS id, 1 AS rank, page FROM chunks WHERE has_table AND doc_id IS NOT NULL), b AS (SELECT DISTINCT doc_id, 'chunk_' || chunk_index AS id, 2 AS rank, CAST(NULL AS INTEGER) AS page FROM chunks WHERE doc_id IS NOT NULL) SELECT doc_id, id, arg_min(page, rank) FILTER (rank = 1) AS page, min(rank) AS rank FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id, id")
def united_elements(spark, d):
    """Elements of two sources, each id once, the first source's before the second's."""
    c = table(spark, d, "chunks").where("doc_id is not null").select("doc_id", F.concat(F.lit("chunk_"), "chunk_index").alias("id"), "page", "has_table").distinct()
    first = c.where("has_table").select("doc_id", "id", "page", F.lit(1).alias("rank"))
    return elements.united(first, c.select("doc_id", "id", F.lit(2).alias("rank"))).select("doc_id", "id", "page", "rank")


# Inferred schemas -------------------------------------------------------------------------------------------------------

_KINDS = "SELECT DISTINCT infer_id, nullif(trim(document_type), '') AS kind, feed, file_no, infer_id % 3 AS n_sections, file_no % 4 AS n_data FROM schema_inferences WHERE infer_id IS NOT NULL"


def _inferred(spark, d) -> DataFrame:
    rows = table(spark, d, "schema_inferences").where("infer_id is not null").select("infer_id", F.nullif(F.trim("document_type"), F.lit("")).alias("kind"), "feed", "file_no").distinct()
    numbers = lambda n: F.transform(F.sequence(F.lit(0), n), lambda i: i)
    data = F.map_from_entries(F.transform(F.slice(numbers(F.lit(3)), F.lit(1), F.coalesce((F.col("file_no") % 4).cast("int"), F.lit(0))), lambda i: F.struct(F.concat(F.lit("k"), i).alias("k"), i.alias("v"))))
    schema = F.struct(F.slice(numbers(F.lit(2)), F.lit(1), (F.col("infer_id") % 3).cast("int")).alias("sections"))
    doc = F.to_json(F.struct(F.col("kind").alias("documentType"), F.col("feed").alias("title"), schema.alias("schema"), data.alias("extractedData")))
    return rows.select(F.col("infer_id").cast("string").alias("doc_id"), F.concat(F.lit("Resposta:\n```json\n"), doc, F.lit("\n```\nfim")).alias("answer"), "kind")


@query(
    f"WITH k AS ({_KINDS}) SELECT CAST(infer_id AS VARCHAR) AS doc_id, coalesce(CASE WHEN kind <> 'documento' THEN kind END, 'documento_geral') AS document_type, "
    "round(greatest(((kind IS NOT NULL AND kind <> 'documento')::INT + CASE WHEN coalesce(feed, '') <> '' THEN 0.5 ELSE 0 END + CASE WHEN n_sections >= 2 THEN 1 WHEN n_sections >= 1 THEN 0.5 ELSE 0 END + CASE WHEN n_data >= 3 THEN 1 WHEN n_data >= 1 THEN 0.5 ELSE 0 END) / 5, 0.3), 2)::DOUBLE AS confidence FROM k"
)
def schema_answers(spark, d):
    """Schemas inferred from fenced answers that are made of the stored rows: read, completed, typed and rated."""
    return answers.inferred(_inferred(spark, d)).select("doc_id", "document_type", "confidence")


@query(f"WITH k AS ({_KINDS}) SELECT CAST(infer_id AS VARCHAR) AS doc_id, coalesce(kind, 'documento') AS document_type, coalesce(feed, '') AS title, '' AS summary, CAST(n_sections AS INTEGER) AS n_sections, CAST(coalesce(n_data, 0) AS INTEGER) AS n_data, CAST(infer_id AS VARCHAR) AS source FROM k")
def schema_completed(spark, d):
    """What a completed schema holds, defaults where the answer lacks a key."""
    got = answers.inferred(_inferred(spark, d))
    get = lambda p: F.get_json_object("fields", f"$.{p}")
    return got.select(
        "doc_id", get("documentType").alias("document_type"), get("title").alias("title"), get("summary").alias("summary"), F.coalesce(F.json_array_length(get("schema.sections")), F.lit(0)).alias("n_sections"),
        F.coalesce(F.size(F.json_object_keys(get("extractedData"))), F.lit(0)).alias("n_data"), get("_meta.source").alias("source"),
    )


@query("SELECT DISTINCT mention_id, original FROM entity_dates WHERE mention_id IS NOT NULL AND coalesce(original, '') <> ''")
def answered_entities(spark, d):
    """Dates of answers that are made of the stored mentions; those without original are no entities."""
    rows = table(spark, d, "entity_dates").where("mention_id is not null").select("mention_id", "original").distinct()
    a = rows.select(F.col("mention_id").alias("doc_id"), F.concat(F.lit("ok: "), F.to_json(F.struct(F.array(F.struct("original")).alias("dates")))).alias("answer"))
    return elements.read_entities(a).select(F.col("doc_id").alias("mention_id"), F.explode("dates").alias("e")).select("mention_id", "e.original")


# Streams ----------------------------------------------------------------------------------------------------------------


@query(BATCH["job_progress_latest"])
def job_stream(spark, d):
    """The latest state per job by a stream over the table's file, run until nothing is left; its result is written and read."""
    return jobs.drained(spark, f"{d}/job_events.parque[t]")  # a pattern also takes a single file


@query(BATCH["job_progress_changes"])
def job_change_stream(spark, d):
    """The change feed by a stream over the table's file, run until nothing is left."""
    return jobs.drained_changes(spark, f"{d}/job_events.parque[t]")
