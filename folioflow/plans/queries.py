"""Queries of the engine's own operators over whole tables, each with equivalent SQL where SQL can say it."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..inference import answers, elements
from ..operators import chunks, entities, sections, structure
from ..sinks import documents as sinks
from ..sources.tables import table
from ..streaming import jobs
from . import pipeline
from .runtime import settled

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


# Parts of SQL -----------------------------------------------------------------------------------------------------------

WS = X.WS


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def _replace(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"


def _last(x: str, needle: str) -> str:
    """Where needle begins last, from 0, else -1; needle is a pattern."""
    return f"CASE WHEN regexp_matches({x}, '(?s){needle}') THEN length(regexp_extract({x}, '(?s)^(.*){needle}', 1)) ELSE -1 END"


_PAGES = "p AS (SELECT DISTINCT doc_id, page, raw_text FROM pages)"
_LINES = _PAGES + ", l AS (SELECT doc_id, page, unnest(string_split(raw_text, chr(10))) AS text, CAST(generate_subscripts(string_split(raw_text, chr(10)), 1) - 1 AS INTEGER) AS block_idx FROM p WHERE raw_text <> '')"
_LEVEL = rf"CASE WHEN regexp_matches(t, '^(\d+\.)+[{WS}]*\d*\.?[{WS}]*') THEN least(length(t) - length(replace(t, '.', '')), 6) WHEN length(t) < 100 AND regexp_matches(t, '\p{{Lu}}') AND NOT regexp_matches(t, '[\p{{Ll}}\p{{Lt}}ªº]') THEN 1 END"
_LIST = rf"CASE WHEN regexp_matches(t, '(?i)^(\d+[.)]|[a-z][.)]|\([ivxlcdm]+\)|\(\d+\))[{WS}]+') THEN 'ordered' WHEN regexp_matches(t, '^[\-•●○◦▪▸►*][{WS}]+') THEN 'unordered' END"
_CLASSIFIED = (
    _LINES
    + f", s AS (SELECT *, {_strip('text')} AS t FROM l), c AS (SELECT *, {_LEVEL} AS level, {_LIST} AS list_type FROM s WHERE t <> ''), k AS (SELECT *, CASE WHEN level IS NOT NULL THEN 'heading' WHEN list_type IS NOT NULL THEN 'list' ELSE 'text' END AS kind FROM c)"
)
_COLLAPSE = lambda x: f"trim({_replace(x, f'[{WS}]+', ' ')})"
_HEADS = _CLASSIFIED + f", h AS (SELECT doc_id, page, block_idx, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, block_idx) AS INTEGER) AS seq, {_COLLAPSE('text')} AS title, CAST(level AS INTEGER) AS level FROM k WHERE kind = 'heading')"
_PARAS = _CLASSIFIED + (
    ", r AS (SELECT *, sum(CASE WHEN kind <> 'text' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY block_idx) AS run FROM k), "
    f"g AS (SELECT doc_id, page, min(block_idx) AS first_block, CAST(count(*) AS INTEGER) AS n_blocks, {_COLLAPSE('string_agg(text, chr(32) ORDER BY block_idx)')} AS text FROM r WHERE kind = 'text' GROUP BY doc_id, page, run), "
    "q AS (SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY first_block) AS INTEGER) AS para_no, first_block, n_blocks, text FROM g)"
)
_TREE = _HEADS.replace("h AS (SELECT doc_id", "h AS (SELECT doc_id") + (
    ", e AS (SELECT *, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS ep FROM h), "
    "w AS (SELECT *, " + ", ".join(f"last_value(CASE WHEN level = {k} THEN seq END IGNORE NULLS) OVER (PARTITION BY doc_id, ep ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p{k}" for k in range(1, 6)) + " FROM e), "
    "tree AS (SELECT doc_id, page, seq, title, level, coalesce(" + ", ".join(f"CASE WHEN level > {k} THEN p{k} END" for k in range(5, 0, -1)) + ") AS parent_seq FROM w)"
)
_CHUNK_PAGES = "p AS (SELECT DISTINCT doc_id, chunk_index AS page, text AS raw_text FROM chunks)"
_ROW = "((length(x) - length(replace(x, chr(9), ''))) >= 2 OR (length(x) - length(replace(x, '|', ''))) >= 2 OR (length(x) - length(replace(x, '  ', ''))) // 2 >= 3)"
_TABLES = _CHUNK_PAGES + (
    ", l AS (SELECT doc_id, page, unnest(string_split(raw_text, chr(10))) AS x, generate_subscripts(string_split(raw_text, chr(10)), 1) AS i FROM p WHERE raw_text IS NOT NULL), "
    f"m AS (SELECT *, {_ROW} AS hit FROM l), n AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, page, hit ORDER BY i) AS run FROM m), "
    "o AS (SELECT doc_id, page, run, min(i) AS first, list(x ORDER BY i) AS lines FROM n WHERE hit GROUP BY doc_id, page, run HAVING count(*) >= 2), "
    "u AS (SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, first) AS INTEGER) AS table_no, lines, CASE WHEN contains(lines[1], chr(9)) THEN chr(9) WHEN contains(lines[1], '|') THEN '|' ELSE '  ' END AS sep FROM o), "
    f"v AS (SELECT doc_id, page, table_no, list_filter(list_transform(lines, lambda s: list_filter(CASE WHEN sep = '  ' THEN string_split_regex({_strip('s')}, '[{WS}]{{2,}}') ELSE list_transform(string_split(s, sep), lambda c: {_strip('c')}) END, lambda c: c <> '')), lambda r: len(r) > 0) AS rows FROM u), "
    "t AS (SELECT doc_id, page, table_no, rows[1] AS columns, rows[2:] AS data FROM v WHERE len(rows) > 0)"
)


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return structure.once(table(spark, d, "pages", "doc_id", "page", "raw_text"))


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return structure.classify(structure.blocks(_pages(spark, d)))


def _chunk_pages(spark: SparkSession, d: str) -> DataFrame:
    return structure.once(table(spark, d, "chunks").select("doc_id", F.col("chunk_index").alias("page"), F.col("text").alias("raw_text")))


# Text -------------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, CAST(coalesce(length(text), 0) AS INTEGER) AS n_chars, CAST(coalesce(length(text) // 4, 0) AS INTEGER) AS n_tokens FROM documents")
def doc_token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"), X.tokens("text").alias("n_tokens"))


@query(rf"SELECT doc_id, regexp_replace(text, '{X.CONTROL}', '', 'g') AS text FROM documents")
def text_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", X.clean("text").alias("text"))


@query("SELECT doc_id, page, " + _replace(_replace(_replace("raw_text", r"[ \t]+", " "), r" *\n *", r"\n"), r"\n{3,}", r"\n\n") .replace(r", '\n', 'g'", ", chr(10), 'g'").replace(r", '\n\n', 'g'", ", chr(10) || chr(10), 'g'") + " AS text FROM (SELECT DISTINCT doc_id, page, raw_text FROM pages)")
def whitespace_compact(spark, d):
    return _pages(spark, d).select("doc_id", "page", X.compact_space("raw_text").alias("text"))


@query("SELECT doc_id, " + _replace(_replace(_replace(_replace("replace(replace(text, '–', '-'), '—', '-')", r"\.{4,}", "..."), "-{3,}", "--"), "_{3,}", "__"), " +([.,;:!?])", r"\1") + " AS text FROM documents")
def punctuation_norm(spark, d):
    return table(spark, d, "documents").select("doc_id", X.plain_punctuation("text").alias("text"))


_DEDUP = f"""WITH {_PAGES}, l AS (SELECT doc_id, page, unnest(string_split(raw_text, chr(10))) AS line, generate_subscripts(string_split(raw_text, chr(10)), 1) AS i FROM p WHERE raw_text IS NOT NULL),
 s AS (SELECT *, {_strip("line")} AS t FROM l),
 w AS (SELECT *, last_value(nullif(t, '') IGNORE NULLS) OVER (PARTITION BY doc_id, page ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
 SELECT doc_id, page, string_agg(line, chr(10) ORDER BY i) AS text FROM w WHERE t = '' OR before IS NULL OR t <> before GROUP BY doc_id, page"""


@query(_DEDUP)
def line_dedup(spark, d):
    return _pages(spark, d).where("raw_text is not null").select("doc_id", "page", X.without_repeated_lines("raw_text").alias("text"))


def _no_page_numbers(x: str) -> str:
    for p in X.PAGE_NUMBERS:
        x = f"regexp_replace({x}, '{p}', chr(10), 'g')"
    return x


@query(f"WITH {_PAGES} SELECT doc_id, page, {_no_page_numbers('raw_text')} AS text FROM p")
def page_number_strip(spark, d):
    return _pages(spark, d).select("doc_id", "page", X.without_page_numbers("raw_text").alias("text"))


@query(f"WITH {_PAGES} SELECT doc_id, page, " + _replace("raw_text", rf"([{X.WORD}]+)-[{WS}]*\n[{WS}]*([{X.WORD}]+)", r"\1\2") + " AS text FROM p")
def hyphen_merge(spark, d):
    return _pages(spark, d).select("doc_id", "page", X.merge_hyphenated("raw_text").alias("text"))


@query("SELECT DISTINCT doc_id, chunk_index, regexp_replace(regexp_replace(text, '" + rf"\n[{WS}]*[\-•●○][{WS}]*" + "', chr(10) || '- ', 'g'), '" + rf"\n[{WS}]*(\d+[.)])[{WS}]*" + r"', chr(10) || '\1 ', 'g') AS text FROM chunks")
def list_compact(spark, d):
    return _chunk_pages(spark, d).select("doc_id", F.col("page").alias("chunk_index"), X.compact_lists("raw_text").alias("text"))


_CUT = "substring(text, 1, 500)"
_STOP = "greatest(" + ", ".join(_last("cut", rf"[{m}]{e}") for m in ".?!" for e in (" ", r"\n")) + ")"


@query(
    f"WITH a AS (SELECT doc_id, text, {_CUT} AS cut FROM documents), b AS (SELECT *, {_STOP} AS stop, " + _last("cut", r"\n\n") + " AS para FROM a) "
    "SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN length(text) <= 500 THEN text ELSE CASE WHEN stop > 500 * 0.7 THEN substring(cut, 1, stop + 1) WHEN para > 500 * 0.5 THEN substring(cut, 1, para) ELSE cut END || chr(10) || chr(10) || '[... documento truncado ...]' END AS text FROM b"
)
def smart_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", X.smart_truncate("text", 500).alias("text"))


@query("WITH a AS (SELECT doc_id, text, substring(text, 1, 77) AS cut FROM documents), b AS (SELECT *, " + _last("cut", " ") + " AS space FROM a) SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN length(text) <= 80 THEN text ELSE CASE WHEN space > 40 THEN substring(cut, 1, space) ELSE cut END || '...' END AS text FROM b")
def truncate_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.truncate_words("text", 80).alias("text"))


_SENTENCES = lambda x: f"list_filter(list_transform(string_split({_replace(x, f'([.!?])[{WS}]+([{X.CAPITALS}])', chr(92) + '1' + chr(1) + chr(92) + '2')}, chr(1)), lambda s: {_strip('s')}), lambda s: s <> '')"


@query(f"WITH a AS (SELECT doc_id, {_SENTENCES('text')} AS s FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(generate_subscripts(s, 1) AS INTEGER) AS sentence_no, unnest(s) AS sentence FROM a")
def sentence_split(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(X.sentences("text")).alias("i", "sentence"))
    return rows.select("doc_id", (F.col("i") + 1).alias("sentence_no"), "sentence")


@query(f"WITH a AS (SELECT doc_id, list_transform(string_split({_strip('text')}, chr(10)), lambda s: {_strip('s')})[1:5] AS s FROM documents) SELECT doc_id, list_filter(s, lambda t: length(t) > 10 AND length(t) < 100 AND NOT regexp_matches(t, '[.,;:]$'))[1] AS title FROM a")
def likely_title(spark, d):
    return table(spark, d, "documents").select("doc_id", X.likely_title("text").alias("title"))


@query(f"WITH {_PAGES} SELECT doc_id, page, try_cast(unnest(regexp_extract_all(raw_text, '(?i)(?:página|pág\\.?|pg\\.?|p\\.)[{WS}]*(\\d+)', 1)) AS INTEGER) AS mentioned FROM p")
def page_mentions(spark, d):
    return _pages(spark, d).select("doc_id", "page", F.explode(X.page_mentions("raw_text")).alias("mentioned"))


def _date_sql(x: str) -> str:
    cases = []
    for p, (y, m, dd) in X.DATE_PATTERNS:
        g = lambda i, p=p: f"regexp_extract({x}, '{p}', {i})"
        cases.append(f"WHEN regexp_matches({x}, '{p}') THEN {g(y)} || '-' || lpad({g(m)}, 2, '0') || '-' || lpad({g(dd)}, 2, '0')")
    return f"CASE {' '.join(cases)} END"


@query(f"SELECT DISTINCT mention_id, {_date_sql('original')} AS iso FROM entity_dates")
def parse_date_br(spark, d):
    return table(spark, d, "entity_dates").select("mention_id", X.date_br("original").alias("iso")).distinct()


_AMOUNT = "CASE WHEN contains(n, ',') AND contains(n, '.') THEN replace(replace(n, '.', ''), ',', '.') ELSE replace(n, ',', '.') END"


@query(
    "WITH a AS (SELECT DISTINCT money_id, original AS o, regexp_extract(original, '([\\d.,]+)', 1) AS n FROM entity_money) SELECT money_id, "
    f"try_cast({_AMOUNT} AS DOUBLE) AS amount, CASE WHEN contains(o, 'R$') OR contains(o, 'BRL') THEN 'BRL' WHEN contains(o, 'US$') OR contains(o, 'USD') THEN 'USD' WHEN contains(o, 'EUR') OR contains(o, '€') THEN 'EUR' END AS code FROM a"
)
def parse_money_br(spark, d):
    amount, code = X.money_br("original")
    return table(spark, d, "entity_money").select("money_id", "original").distinct().select("money_id", amount.alias("amount"), code.alias("code"))


@query(
    "SELECT DISTINCT request_id, lower(regexp_extract(file_name, '[^/\\\\]+(\\.[^./\\\\]+)$', 1)) AS extension, lower(regexp_extract(file_name, '[^/\\\\]+(\\.[^./\\\\]+)$', 1)) IN ('.pdf', '.docx', '.doc') AS supported, "
    "regexp_replace(regexp_replace(file_name, '[<>:\"/\\\\|?*]', '_', 'g'), '_+', '_', 'g') AS safe_name FROM conversion_requests"
)
def file_kinds(spark, d):
    ext = X.file_extension("file_name")
    return table(spark, d, "conversion_requests").select("request_id", ext.alias("extension"), ext.isin(".pdf", ".docx", ".doc").alias("supported"), X.safe_filename("file_name").alias("safe_name")).distinct()


@query("SELECT doc_id, CASE WHEN n_chars < 1024 THEN printf('%.1f B', n_chars::DOUBLE) WHEN n_chars < 1048576 THEN printf('%.1f KB', n_chars / 1024.0::DOUBLE) ELSE printf('%.1f MB', n_chars / 1048576.0::DOUBLE) END AS size FROM documents")
def file_size_words(spark, d):
    return table(spark, d, "documents").select("doc_id", X.file_size("n_chars").alias("size"))


def _normal_sql() -> str:
    """The whole chain as steps of SQL, one after the other."""
    nl = "chr(10)"
    numbers = _no_page_numbers("t1")
    parts = f"list_filter(list_transform(string_split(t2, repeat({nl}, 3)), lambda p: list_filter(list_transform(string_split(p, {nl}), lambda s: {_strip('s')}), lambda s: s <> '')), lambda p: len(p) >= 2)"
    ends = lambda i: f"list_filter(list_transform(parts, lambda p: substring(p[{i}], 1, 100)), lambda e: length(e) > 5)"
    twice = lambda x: f"list_filter(list_distinct({x}), lambda e: len(list_filter({x}, lambda y: y = e)) >= 2)"
    drop = rf"regexp_replace(regexp_replace(x, '(?m)^\Q' || e || '\E[{WS}]*\n', '', 'g'), '(?m)\n\Q' || e || '\E[{WS}]*$', '', 'g')"
    space = _replace(_replace(_replace("t3", r"[ \t]+", " "), r" *\n *", r"\n"), r"\n{3,}", r"\n\n").replace(r", '\n', 'g'", f", {nl}, 'g'").replace(r", '\n\n', 'g'", f", {nl} || {nl}, 'g'")
    marks = _replace(_replace(_replace(_replace("replace(replace(t5, '–', '-'), '—', '-')", r"\.{4,}", "..."), "-{3,}", "--"), "_{3,}", "__"), " +([.,;:!?])", r"\1")
    lists = rf"regexp_replace(regexp_replace(t6, '\n[{WS}]*[\-•●○][{WS}]*', {nl} || '- ', 'g'), '\n[{WS}]*(\d+[.)])[{WS}]*', {nl} || '\1 ', 'g')"
    return f"""WITH {_PAGES},
 n1 AS (SELECT doc_id, page, raw_text, replace(replace(regexp_replace(coalesce(raw_text, ''), '{X.CONTROL}', '', 'g'), chr(13) || {nl}, {nl}), chr(13), {nl}) AS t1 FROM p),
 n2 AS (SELECT *, {numbers} AS t2 FROM n1), n3 AS (SELECT *, {parts} AS parts FROM n2), n4 AS (SELECT *, list_concat({twice(ends(1))}, {twice(ends(-1))}) AS again FROM n3),
 n5 AS (SELECT doc_id, page, raw_text, CASE WHEN len(string_split(t2, {nl})) >= 20 AND len(string_split(t2, repeat({nl}, 3))) >= 2 THEN list_reduce(list_prepend(t2, again), lambda x, e: {drop}) ELSE t2 END AS t3 FROM n4),
 n6 AS (SELECT *, {space} AS t4 FROM n5), l AS (SELECT doc_id, page, unnest(string_split(t4, {nl})) AS line, generate_subscripts(string_split(t4, {nl}), 1) AS i FROM n6), s AS (SELECT *, {_strip("line")} AS t FROM l),
 w AS (SELECT *, last_value(nullif(t, '') IGNORE NULLS) OVER (PARTITION BY doc_id, page ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
 n7 AS (SELECT doc_id, page, string_agg(line, {nl} ORDER BY i) AS t5 FROM w WHERE t = '' OR before IS NULL OR t <> before GROUP BY doc_id, page),
 n8 AS (SELECT *, {marks} AS t6 FROM n7), n9 AS (SELECT doc_id, page, {_strip(lists)} AS text FROM n8),
 z AS (SELECT n9.doc_id, n9.page, text, coalesce(length(raw_text), 0) AS a, length(text) AS b FROM n9 JOIN p ON n9.doc_id = p.doc_id AND n9.page = p.page)
 SELECT doc_id, page, text, CAST(a AS INTEGER) AS chars_before, CAST(b AS INTEGER) AS chars_after, CASE WHEN a > 0 THEN round((a - b)::DOUBLE / a * 100, 1) ELSE 0.0 END AS saved_pct, CAST(a // 4 - b // 4 AS BIGINT) AS tokens_saved FROM z"""


@query(_normal_sql())
def normalise_pages(spark, d):
    """The whole chain, with the characters and tokens it saves."""
    t = settled(_pages(spark, d).select("doc_id", "page", "raw_text", X.normalise("raw_text").alias("text")))
    before, after = F.coalesce(F.length("raw_text"), F.lit(0)), F.length("text")
    return t.select("doc_id", "page", "text", before.alias("chars_before"), after.alias("chars_after"), F.when(before > 0, F.round((before - after) / before * 100, 1)).otherwise(0.0).alias("saved_pct"), (F.floor(before / 4) - F.floor(after / 4)).alias("tokens_saved"))


# Structure --------------------------------------------------------------------------------------------------------------


@query(f"WITH {_HEADS} SELECT doc_id, page, block_idx, seq, title AS text, level FROM h")
def heading_detect(spark, d):
    return structure.headings(_classified(spark, d)).select("doc_id", "page", "block_idx", "seq", "text", "level")


_MARKER = "trim(" + _replace(_replace(_replace("text", rf"^[\-•●○◦▪▸►*][{WS}]+", ""), rf"(?i)^(\d+|\([a-z]\)|\([ivx]+\))[.)][{WS}]+", ""), f"[{WS}]+", " ") + ")"
_CHUNK_CLASSIFIED = _CLASSIFIED.replace(_PAGES, _CHUNK_PAGES)


@query(f"WITH {_CHUNK_CLASSIFIED} SELECT doc_id, page, block_idx, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, block_idx) AS INTEGER) AS seq, {_MARKER} AS text, list_type FROM k WHERE kind = 'list'")
def list_item_detect(spark, d):
    return structure.list_items(structure.classify(structure.blocks(_chunk_pages(spark, d)))).select("doc_id", "page", "block_idx", "seq", "text", "list_type")


@query(f"WITH {_PARAS} SELECT doc_id, page, para_no, first_block, n_blocks, text FROM q")
def paragraph_sessions(spark, d):
    return structure.paragraphs(_classified(spark, d)).drop("bbox")


@query(f"WITH {_TABLES} SELECT doc_id, page, table_no, array_to_string(columns, ' | ') AS header, CAST(len(data) AS INTEGER) AS n_rows, coalesce(array_to_string(list_transform(data, lambda r: array_to_string(r, ' | ')), ' ; '), '') AS body FROM t")
def table_islands(spark, d):
    t = structure.tables(_chunk_pages(spark, d))
    return t.select("doc_id", "page", "table_no", F.array_join("columns", " | ").alias("header"), F.size("data").alias("n_rows"), F.array_join(F.transform("data", lambda r: F.array_join(r, " | ")), " ; ").alias("body"))


def _equation_sql(source: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT doc_id, page, {i} AS pattern, generate_subscripts(regexp_extract_all(raw_text, '(?s){p}', 1), 1) AS pos, unnest(regexp_extract_all(raw_text, '(?s){p}', 1)) AS raw FROM p" for i, p in enumerate(structure.EQUATIONS)
    )
    return f"WITH {source}, e AS ({parts}) SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, pattern, pos) AS INTEGER) AS eq_no, {_strip('raw')} AS latex, pattern = 1 AS is_inline FROM e"


@query(_equation_sql(_PAGES))
def equation_extract(spark, d):
    return structure.equations(_pages(spark, d)).drop("id")


@query(
    f"WITH {_LINES}, n AS (SELECT *, max(block_idx) OVER (PARTITION BY doc_id, page) * 17.0 + 12.0 AS height, {_strip('text')} AS t FROM l) "
    rf"SELECT doc_id, page, block_idx, regexp_extract(t, '^(\d+|[*†‡§])[{WS}]*(.+)', 1) AS marker, regexp_extract(t, '^(\d+|[*†‡§])[{WS}]*(.+)', 2) AS text FROM n WHERE block_idx * 17.0 > height * 0.85 AND regexp_matches(t, '^(\d+|[*†‡§])[{WS}]*(.+)')"
)
def footnote_detect(spark, d):
    return structure.footnotes(structure.blocks(_pages(spark, d)))


@query(
    "WITH s AS (SELECT l_orderkey AS doc, l_linenumber AS pos, round(l_quantity, 1) AS size FROM lineitem), c AS (SELECT doc, size, count(*) AS n, min(pos) AS first FROM s GROUP BY doc, size), "
    "r AS (SELECT doc, size, row_number() OVER (PARTITION BY doc ORDER BY n DESC, first, size) AS k FROM c) SELECT doc AS doc_id, size AS body, size * 1.2::DOUBLE AS threshold FROM r WHERE k = 1"
)
def font_calibration(spark, d):
    """The quantities of an order's lines stand for font sizes; the pages have none."""
    return structure.calibrate(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), F.col("l_quantity").alias("font_size")))


# Sections ---------------------------------------------------------------------------------------------------------------


@query(f"WITH {_TREE} SELECT doc_id, seq, level, parent_seq FROM tree")
def section_hierarchy(spark, d):
    return sections.parents(structure.headings(_classified(spark, d)).select("doc_id", "seq", "level"))


@query(f"WITH RECURSIVE {_TREE}, up AS (SELECT doc_id, seq, title AS full_title FROM tree WHERE parent_seq IS NULL UNION ALL SELECT t.doc_id, t.seq, u.full_title || ' > ' || t.title FROM tree t JOIN up u ON t.doc_id = u.doc_id AND t.parent_seq = u.seq) SELECT doc_id, seq, full_title FROM up")
def section_titles(spark, d):
    heads = structure.headings(_classified(spark, d))
    return sections.lineage(heads).select("doc_id", "seq", "full_title")


@query(f"WITH {_PARAS} SELECT doc_id, page, string_agg(text, chr(10) || chr(10) ORDER BY para_no) AS content FROM q GROUP BY doc_id, page")
def section_content(spark, d):
    return sections.page_content(structure.paragraphs(_classified(spark, d)))


@query(f"WITH {_PARAS} SELECT doc_id, 'Documento' AS title, string_agg(text, chr(10) || chr(10) ORDER BY page, para_no) AS content FROM q WHERE doc_id NOT IN (SELECT doc_id FROM k WHERE kind = 'heading') GROUP BY doc_id")
def no_heading_fallback(spark, d):
    c = _classified(spark, d)
    return sections.untitled(structure.headings(c), structure.paragraphs(c)).select("doc_id", "title", "content")


@query(f"WITH {_HEADS}, f AS (SELECT doc_id, title FROM h WHERE seq = 1), n AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS page_count FROM p GROUP BY doc_id) SELECT n.doc_id, f.title, n.page_count, 'pt' AS language FROM n LEFT JOIN f USING (doc_id)")
def doc_metadata(spark, d):
    return sections.metadata(_pages(spark, d), structure.headings(_classified(spark, d)))


@query(f"WITH {_PAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS k FROM p), s AS (SELECT doc_id, string_agg(coalesce(raw_text, ''), ' ' ORDER BY page) AS t FROM r WHERE k <= 3 GROUP BY doc_id) SELECT doc_id, CASE WHEN length(t) > 500 THEN substring(t, 1, 500) || '...' ELSE t END AS summary FROM s")
def first_pages_summary(spark, d):
    return sections.summary(_pages(spark, d))


@query(f"WITH {_PAGES}, r AS (SELECT *, coalesce(sum(length(raw_text)) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM p WHERE raw_text IS NOT NULL) SELECT doc_id, substring(string_agg(raw_text, chr(10) || chr(10) ORDER BY page), 1, 5000) AS preview FROM r WHERE done < 5000 GROUP BY doc_id")
def doc_preview(spark, d):
    p = _pages(spark, d).where("raw_text is not null")
    return sections.preview(p)


_COUNTS = (
    ", tc AS (SELECT doc_id, page, count(*) AS n FROM t GROUP BY ALL), hc AS (SELECT doc_id, page, count(*) FILTER (kind = 'heading') AS h, count(*) FILTER (kind = 'list') AS l FROM k GROUP BY ALL), "
    "qc AS (SELECT doc_id, page, count(*) AS q FROM qq GROUP BY ALL)"
)


@query(
    "WITH "
    + _TABLES.replace("l AS (", "tl AS (").replace(" FROM l)", " FROM tl)")
    + _PARAS.replace(_PAGES, "").replace("q AS (SELECT", "qq AS (SELECT")
    + _COUNTS
    + ", fn AS (SELECT doc_id, page, count(*) AS f FROM (SELECT *, max(block_idx) OVER (PARTITION BY doc_id, page) * 17.0 + 12.0 AS height FROM s) WHERE block_idx * 17.0 > height * 0.85 AND "
    + rf"regexp_matches(t, '^(\d+|[*†‡§])[{WS}]*(.+)') GROUP BY ALL), "
    + "eq AS (SELECT doc_id, page, " + " + ".join(f"len(regexp_extract_all(raw_text, '(?s){p}', 1))" for p in structure.EQUATIONS) + " AS e FROM p), "
    + "z AS (SELECT p.doc_id, p.page, coalesce(n, 0) AS n, coalesce(h, 0) AS h, coalesce(l, 0) AS l, coalesce(q, 0) AS q, coalesce(f, 0) AS f, coalesce(e, 0) AS e FROM p LEFT JOIN tc USING (doc_id, page) LEFT JOIN hc USING (doc_id, page) LEFT JOIN qc USING (doc_id, page) LEFT JOIN fn USING (doc_id, page) LEFT JOIN eq USING (doc_id, page)) "
    + "SELECT doc_id, page, CASE WHEN 2 * n + 2 * e + (h > 5)::INT >= 8 THEN 'complex' WHEN 2 * n + 2 * e + (h > 5)::INT >= 3 THEN 'moderate' ELSE 'simple' END AS complexity, CAST(n + e + h + l + q + f AS INTEGER) AS n_elements, n > 0 AND n / (n + e + h + l + q + f) > 0.5 AS requires_full_page_vision FROM z"
)
def complexity_routing(spark, d):
    p = _chunk_pages(spark, d)
    b = structure.blocks(p)
    c = structure.classify(b)
    r = sections.routing(p, c, structure.tables(p), structure.equations(p), structure.footnotes(b), structure.paragraphs(c))
    return r.select("doc_id", "page", "complexity", "n_elements", "requires_full_page_vision")


@query(f"WITH {_CLASSIFIED}, a AS (SELECT doc_id, least(avg(coalesce(length(raw_text), 0)) / 500, 1.0) AS a FROM p GROUP BY doc_id), b AS (SELECT DISTINCT doc_id, 0.9 AS b FROM k WHERE kind IN ('heading', 'text')) SELECT doc_id, CAST(round((a + coalesce(b, 0.5)) / 2, 6) AS DOUBLE) AS confidence FROM a LEFT JOIN b USING (doc_id)")
def overall_confidence(spark, d):
    c = _classified(spark, d)
    return sections.confidence(_pages(spark, d), structure.headings(c), structure.paragraphs(c)).select("doc_id", F.round("confidence", 6).alias("confidence"))


# Chunks -----------------------------------------------------------------------------------------------------------------


def _chunk_sql(size: int, overlap: int, most: int) -> str:
    tok = lambda x: f"length({x}) // 4"
    last = "s.cur[len(s.cur)]"
    sentence = "u.k <> 'p'"
    repeat = f"({'true' if overlap > 0 else 'false'} AND ({sentence} OR {tok('u.x')} < {overlap}))"
    over = f"(u.k <> 'f' AND s.t + {tok('u.x')} > {size})"
    return f"""WITH RECURSIVE {_PAGES},
 a AS (SELECT doc_id, page, list_filter(list_transform(string_split_regex(raw_text, '\\n\\n+'), lambda x: {_strip("x")}), lambda x: x <> '') AS ps FROM p WHERE raw_text IS NOT NULL),
 b AS (SELECT doc_id, page, generate_subscripts(ps, 1) AS i, unnest(ps) AS x FROM a),
 c AS (SELECT doc_id, page, i, x, CASE WHEN {tok("x")} > {most} THEN {_SENTENCES("x")} END AS ss FROM b),
 un AS (SELECT doc_id, page, i, 0 AS j, x, 'p' AS k FROM c WHERE ss IS NULL UNION ALL SELECT doc_id, page, i, j, x, CASE WHEN j = 1 THEN 'f' ELSE 's' END FROM (SELECT doc_id, page, i, generate_subscripts(ss, 1) AS j, unnest(ss) AS x FROM c WHERE ss IS NOT NULL)),
 un2 AS (SELECT doc_id, page, x, k, row_number() OVER (PARTITION BY doc_id, page ORDER BY i, j) AS rn, lead(k) OVER (PARTITION BY doc_id, page ORDER BY i, j) AS nk FROM un),
 st AS (
  SELECT doc_id, page, rn, 0 AS ch, {tok("x")} AS t, [x] AS cur, nk FROM un2 WHERE rn = 1
  UNION ALL
  SELECT u.doc_id, u.page, u.rn, s.ch + CASE WHEN u.k = 'f' OR {over} THEN 1 ELSE 0 END,
   CASE WHEN u.k = 'f' THEN {tok("u.x")} WHEN {over} THEN CASE WHEN {repeat} THEN {tok(last)} ELSE 0 END + {tok("u.x")} ELSE s.t + {tok("u.x")} END,
   CASE WHEN u.k = 'f' THEN [u.x] WHEN {over} THEN CASE WHEN {repeat} THEN [{last}, u.x] ELSE [u.x] END ELSE list_append(s.cur, u.x) END, u.nk
  FROM un2 u JOIN st s ON u.doc_id = s.doc_id AND u.page = s.page AND u.rn = s.rn + 1),
 fin AS (SELECT doc_id, page, ch, arg_max(cur, rn) AS cur, arg_max(coalesce(nk, ''), rn) AS nk FROM st GROUP BY doc_id, page, ch)
 SELECT doc_id, page, CAST(ch AS INTEGER) AS chunk_no, CASE WHEN nk = 's' THEN array_to_string(cur, ' ') ELSE array_to_string(cur, chr(10) || chr(10)) END AS text FROM fin"""


def _split(spark, d, size: int, overlap: int, most: int) -> DataFrame:
    return _pages(spark, d).select("doc_id", "page", F.posexplode(chunks.split("raw_text", size, overlap, most)).alias("chunk_no", "text"))


@query(_chunk_sql(100, 50, 2000))
def chunk_split(spark, d):
    return _split(spark, d, 100, 50, 2000)


@query(_chunk_sql(60, 20, 80))
def chunk_split_sentences(spark, d):
    """Small limits, so that paragraphs are cut into sentences."""
    return _split(spark, d, 60, 20, 80)


@query(
    f"WITH {_TABLES} SELECT doc_id, page, table_no, '| ' || array_to_string(columns, ' | ') || ' |' || chr(10) || '|' || array_to_string(list_transform(columns, lambda c: '---'), '|') || '|' "
    "|| coalesce((SELECT string_agg(chr(10) || '| ' || array_to_string(r, ' | ') || ' |', '' ORDER BY i) FROM (SELECT unnest(data[1:20]) AS r, generate_subscripts(data[1:20], 1) AS i)), '') "
    "|| CASE WHEN len(data) > 20 THEN chr(10) || '... (' || (len(data) - 20) || ' linhas adicionais)' ELSE '' END AS text FROM t"
)
def chunk_table(spark, d):
    return chunks.of_tables(structure.tables(_chunk_pages(spark, d))).select("doc_id", "page", "table_no", "text")


# Entities ---------------------------------------------------------------------------------------------------------------

_MENTIONS = "m AS (SELECT DISTINCT doc_id, mention_id, concat_ws(' ', context, original) AS x FROM entity_dates)"
_NUMERIC = r"\b(\d{1,2})[/\-](\d{1,2})[/\-](\d{2,4})\b"
_WORDY = rf"(?i)\b(\d{{1,2}})[{WS}]+de[{WS}]+({'|'.join(X.MONTHS)})[{WS}]+de[{WS}]+(\d{{4}})\b"
_DATES = (
    f"{_MENTIONS}, n AS (SELECT DISTINCT doc_id, mention_id, unnest(regexp_extract_all(x, '{_NUMERIC}')) AS o FROM m), w AS (SELECT DISTINCT doc_id, mention_id, unnest(regexp_extract_all(x, '{_WORDY}')) AS o FROM m), "
    f"e AS (SELECT doc_id, mention_id, o AS original, CASE WHEN length(regexp_extract(o, '{_NUMERIC}', 3)) = 2 THEN '20' ELSE '' END || regexp_extract(o, '{_NUMERIC}', 3) || '-' || lpad(regexp_extract(o, '{_NUMERIC}', 2), 2, '0') || '-' || lpad(regexp_extract(o, '{_NUMERIC}', 1), 2, '0') AS normalized FROM n "
    f"UNION ALL SELECT doc_id, mention_id, o, regexp_extract(o, '{_WORDY}', 3) || '-' || lpad(CAST(list_position([{', '.join(repr(m) for m in X.MONTHS)}], lower(regexp_extract(o, '{_WORDY}', 2))) AS VARCHAR), 2, '0') || '-' || lpad(regexp_extract(o, '{_WORDY}', 1), 2, '0') FROM w)"
)


def _dates(spark, d) -> DataFrame:
    m = table(spark, d, "entity_dates").select("doc_id", "mention_id", F.concat_ws(" ", "context", "original").alias("x")).distinct()
    return entities.explode(m, entities.dates(F.col("x")), "doc_id", "mention_id")


@query(f"WITH {_DATES} SELECT doc_id, mention_id, original, normalized FROM e")
def entity_dates(spark, d):
    return _dates(spark, d)


def _money_sql(currency: str, sign: str, pattern: str) -> str:
    plain = "replace(replace(n, '.', ''), ',', '.')" if currency == "BRL" else "replace(n, ',', '')"
    return f"SELECT money_id, '{sign} ' || n AS original, try_cast({plain} AS DOUBLE) AS value, '{currency}' AS currency FROM (SELECT DISTINCT money_id, unnest(regexp_extract_all(x, '{pattern}', 1)) AS n FROM m)"


@query("WITH m AS (SELECT DISTINCT money_id, concat_ws(' ', context, original) AS x FROM entity_money) " + " UNION ALL ".join(_money_sql(k, s, p) for k, (s, p) in entities.MONEY.items()))
def entity_money(spark, d):
    m = table(spark, d, "entity_money").select("money_id", F.concat_ws(" ", "context", "original").alias("x")).distinct()
    return entities.explode(m, entities.money(F.col("x")), "money_id")


@query(
    f"WITH {_DATES}, a AS (SELECT DISTINCT doc_id, mention_id, original FROM entity_dates WHERE normalized IS NOT NULL), b AS (SELECT DISTINCT doc_id, mention_id, original FROM e) "
    "SELECT *, 1 AS origin_rank FROM a UNION ALL SELECT b.*, 2 FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = b.doc_id AND a.mention_id = b.mention_id AND a.original = b.original)"
)
def entity_merge(spark, d):
    """Mentions that came with a date stand for those of another extractor."""
    first = table(spark, d, "entity_dates").where("normalized is not null").select("doc_id", "mention_id", "original").distinct()
    return entities.merge(first, _dates(spark, d).select("doc_id", "mention_id", "original").distinct(), "doc_id", "mention_id")


@query("WITH c AS (SELECT DISTINCT doc_id, chunk_index, text FROM chunks) " + " UNION ALL ".join(f"SELECT DISTINCT doc_id, chunk_index, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS original FROM c" for k, p in entities.IDS.items()))
def doc_identity_numbers(spark, d):
    c = _chunk_pages(spark, d).select("doc_id", F.col("page").alias("chunk_index"), F.col("raw_text").alias("text")).where("text is not null")
    return entities.explode(c, entities.identity_numbers(F.col("text")), "doc_id", "chunk_index")


# Tables of chunks on the page that their chunk names, beside the headings of the file's pages.
_PLACED = (
    _HEADS + _TABLES[len(_CHUNK_PAGES) :].replace("l AS (", "tl AS (", 1).replace(" FROM l)", " FROM tl)").replace("FROM p WHERE", "FROM cp WHERE", 1).replace(", tl AS (", f", {_CHUNK_PAGES.replace('p AS', 'cp AS', 1)}, tl AS (", 1)
    + ", pl AS (SELECT t.doc_id, c.page, t.table_no FROM t JOIN (SELECT DISTINCT doc_id, chunk_index, page FROM chunks) c ON t.doc_id = c.doc_id AND t.page = c.chunk_index)"
)


def _placed_tables(spark, d) -> DataFrame:
    at = table(spark, d, "chunks").select("doc_id", "chunk_index", F.col("page").alias("_at")).distinct()
    t = structure.tables(_chunk_pages(spark, d)).withColumnRenamed("page", "chunk_index").join(at, ["doc_id", "chunk_index"])
    return t.drop("chunk_index").withColumnRenamed("_at", "page")


@query(f"WITH {_PLACED} SELECT doc_id, page, table_no FROM pl WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = pl.doc_id AND h.page = pl.page)")
def unreferenced_tables(spark, d):
    """Tables on pages without a heading: a left anti join."""
    named = structure.headings(_classified(spark, d)).select("doc_id", "page").distinct()
    return _placed_tables(spark, d).join(named, ["doc_id", "page"], "left_anti").select("doc_id", "page", "table_no")


@query(f"WITH {_PLACED}, a AS (SELECT doc_id, page, string_agg('table_' || table_no, ',' ORDER BY table_no) AS refs FROM pl GROUP BY doc_id, page) SELECT h.doc_id, h.seq, a.refs FROM h JOIN a USING (doc_id, page)")
def table_references(spark, d):
    """Sections with the tables of their page."""
    classified = _classified(spark, d)
    tree = sections.sections(structure.headings(classified), structure.contents_of(structure.page_elements(classified)), _placed_tables(spark, d))
    return tree.where("size(tables_refs) > 0").select("doc_id", "seq", F.array_join("tables_refs", ",").alias("refs"))


# Answers of models ------------------------------------------------------------------------------------------------------


@query()
def answer_repair(spark, d):
    """Stored structures as answers: objects found, cut ones repaired."""
    rows = table(spark, d, "schema_inferences", "infer_id", "fields").dropDuplicates(["infer_id"]).withColumn("object", answers.parsed("fields"))
    return rows.select("infer_id", F.get_json_object("object", "$._error").isNull().alias("readable"), F.coalesce(F.size(F.json_object_keys("object")), F.lit(0)).alias("n_keys"))


@query()
def answer_confidence(spark, d):
    rows = table(spark, d, "schema_inferences").dropDuplicates(["infer_id"])
    doc = F.to_json(F.struct(F.col("document_type").alias("documentType"), F.col("feed").alias("title"), F.col("inferred_at").cast("string").alias("date"), F.parse_json(answers.parsed("fields")).alias("extractedData")))
    return rows.select("infer_id", answers.confidence(doc).alias("confidence"))


_HITS = "SELECT doc_id, " + ", ".join("(" + " + ".join(f"bool_or(contains(lower(coalesce(raw_text, '')), '{w}'))::INT" for w in words) + f") AS {k}" for k, words in elements.KEYWORDS.items()) + " FROM p GROUP BY doc_id"
_MOST = "greatest(" + ", ".join(elements.KEYWORDS) + ")"


@query(f"WITH {_PAGES}, h AS ({_HITS}) SELECT doc_id, CASE WHEN {_MOST} = 0 THEN NULL " + " ".join(f"WHEN {k} = {_MOST} THEN '{k}'" for k in elements.KEYWORDS) + f" END AS document_type, CAST({_MOST} AS INTEGER) AS hits FROM h")
def doc_type_keywords(spark, d):
    return elements.keyword_type(_pages(spark, d))


@query(
    f"WITH {_TABLES}, i AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY table_no) - 1 AS idx FROM t) "
    "SELECT doc_id, page, 'table_v_' || page || '_' || idx AS id, array_to_string(columns, ' | ') AS header, CAST(len(data) AS INTEGER) AS n_rows, coalesce(array_to_string(list_transform(data, lambda r: array_to_string(r, ' | ')), ' ; '), '') AS body FROM i"
)
def answered_tables(spark, d):
    """Tables of chunks, written as a model would answer and read back."""
    t = structure.tables(_chunk_pages(spark, d)).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("table_no", F.col("columns").alias("headers"), "data"))).alias("tables"))
    a = t.select("doc_id", "page", F.concat(F.lit("```json\n"), F.to_json(F.struct("tables")), F.lit("\n```")).alias("answer"))
    got = elements.tables(elements.read_pages(a))
    return got.select("doc_id", "page", "id", F.array_join("columns", " | ").alias("header"), F.size("data").alias("n_rows"), F.array_join(F.transform("data", lambda r: F.array_join(r, " | ")), " ; ").alias("body"))


# Sinks ------------------------------------------------------------------------------------------------------------------


@query(f"WITH {_TREE} SELECT doc_id, seq, regexp_replace(replace(lower(title), ' ', '-'), '[^\\p{{L}}\\p{{N}}-]', '', 'g') AS anchor FROM tree".replace("[^\\p{L}\\p{N}-]", r"[^\p{L}\p{N}\-]"))
def section_anchors(spark, d):
    return structure.headings(_classified(spark, d)).select("doc_id", "seq", sinks.anchor(F.col("text")).alias("anchor"))


@query()
def hybrid_json(spark, d):
    return pipeline.convert(table(spark, d, "pages", "doc_id", "page", "raw_text"))["json"]


# Jobs -------------------------------------------------------------------------------------------------------------------

_SPANS = jobs.STAGES | {k: jobs.STAGES[v] for k, v in jobs.ALIASES.items()}
_SPAN_SQL = "span AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in _SPANS.items()) + ") AS v(stage, lo, hi))"
_EVENTS = (
    f"{_SPAN_SQL}, ev AS (SELECT DISTINCT * FROM job_events WHERE job_id IS NOT NULL AND ts IS NOT NULL), "
    "pe AS (SELECT ev.*, CASE WHEN status = 'completed' THEN 100 ELSE CAST(floor(lo + (hi - lo) * CASE WHEN coalesce(total, 0) > 0 THEN coalesce(current, 0) / total ELSE 0.0 END) AS INTEGER) END AS progress FROM ev LEFT JOIN span USING (stage))"
)
_JOB_ORDER = "ts NULLS FIRST, received_at NULLS FIRST, current NULLS FIRST, stage NULLS FIRST, status NULLS FIRST"
_JOB_LAST = _JOB_ORDER.replace("NULLS FIRST", "DESC NULLS LAST")


@query(f"WITH {_EVENTS} SELECT job_id, ts, stage, current, status, progress FROM pe")
def job_percent(spark, d):
    return jobs.events(table(spark, d, "job_events")).select("job_id", "ts", "stage", "current", "status", "progress")


@query(
    f"WITH {_EVENTS}, a AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY {_JOB_LAST}) AS k FROM pe), b AS (SELECT job_id, progress, row_number() OVER (PARTITION BY job_id ORDER BY {_JOB_LAST}) AS k FROM pe WHERE progress IS NOT NULL), n AS (SELECT job_id, count(*) AS n_events FROM pe GROUP BY job_id) "
    "SELECT a.job_id, a.status, a.stage, b.progress, n.n_events FROM a LEFT JOIN b ON a.job_id = b.job_id AND b.k = 1 JOIN n ON a.job_id = n.job_id WHERE a.k = 1"
)
def job_progress_latest(spark, d):
    return jobs.latest(table(spark, d, "job_events"))


@query(f"WITH {_EVENTS}, w AS (SELECT *, lag(progress) OVER (PARTITION BY job_id ORDER BY {_JOB_ORDER}) AS before FROM pe WHERE progress IS NOT NULL) SELECT job_id, ts, status, stage, progress FROM w WHERE before IS NULL OR before <> progress OR status IN ('completed', 'failed')")
def job_progress_changes(spark, d):
    return jobs.changes(table(spark, d, "job_events"))


@query(f"WITH {_EVENTS}, a AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY {_JOB_LAST}) AS k FROM pe), s AS (SELECT job_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 AS sec FROM pe GROUP BY job_id) SELECT status, count(*) AS n_jobs, round(avg(sec), 3) AS mean_seconds FROM a JOIN s USING (job_id) WHERE k = 1 GROUP BY status")
def job_durations(spark, d):
    return jobs.duration(table(spark, d, "job_events"))
