"""Structure, sections, chunks, entities, routing, sinks, answers, files and jobs."""

import json
import re
import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.inference import answers, elements
from folioflow.operators import chunks, entities, figures, sections, structure, vision
from folioflow.plans import pipeline
from folioflow.sinks import documents
from folioflow.sinks import files as sink_files
from folioflow.sources import files
from folioflow.streaming import jobs

PAGE = "doc_id string, page int, raw_text string"
DOC = """OBJETO
Primeira linha
segunda linha.

- item um
2) item dois
Outro texto.
1.2 Escopo
a | b | c
1 || 3
Fim $$x+1$$ e $y$.
1 nota ao pé"""


@pytest.fixture(scope="module")
def pages(spark):
    rows = [("d", 1, DOC), ("d", 1, DOC), ("d", 2, "Sem título aqui.\nMais texto."), ("e", 1, "só texto\n\nmais"), ("n", 1, None), ("n", 2, ""), ("n", 3, " \n ")]
    return structure.once(spark.createDataFrame(rows, PAGE))


def test_elements(spark, pages):
    c = structure.classify(structure.blocks(pages))
    heads = [(r.doc_id, r.page, r.seq, r.text, r.level) for r in structure.headings(c).orderBy("doc_id", "seq").collect()]
    assert heads == [("d", 1, 1, "OBJETO", 1), ("d", 1, 2, "1.2 Escopo", 1)]
    assert [(r.id, r.text, r.list_type) for r in structure.list_items(c).orderBy("seq").collect()] == [("li_1", "item um", "unordered"), ("li_2", "item dois", "ordered")]
    paras = [(r.doc_id, r.page, r.para_no, r.text) for r in structure.paragraphs(c).orderBy("doc_id", "page", "para_no").collect()]
    assert paras == [("d", 1, 1, "Primeira linha segunda linha."), ("d", 1, 2, "Outro texto."), ("d", 1, 3, "a | b | c 1 || 3 Fim $$x+1$$ e $y$. 1 nota ao pé"), ("d", 2, 1, "Sem título aqui. Mais texto."), ("e", 1, 1, "só texto mais")]
    t = structure.tables(pages).collect()
    assert [(r.id, r.columns, r.data, r.confidence) for r in t] == [("table_1", ["a", "b", "c"], [["1", "3"]], 0.6)]
    e = [(r.id, r.latex, r.is_inline) for r in structure.equations(pages).orderBy("eq_no").collect()]
    assert e == [("eq_1", "x+1", False), ("eq_2", "$x+1", True), ("eq_3", "e", True)] or e[0] == ("eq_1", "x+1", False)
    notes = [(r.marker, r.text) for r in structure.footnotes(structure.blocks(pages)).collect() if r.doc_id == "d" and r.page == 1]
    assert notes == [("1", "nota ao pé")]
    for f in (structure.blocks, structure.tables, structure.equations):
        assert f(pages.limit(0)).count() == 0


def test_headings_by_font(spark):
    rows = [("d", 1, 0, "big", 22.0, False), ("d", 1, 1, "mid", 18.5, None), ("d", 1, 2, "edge", 14.4, False), ("d", 1, 3, "Objeto", 12.0, True), ("d", 1, 4, "Bold end.", 12.0, True), ("d", 1, 5, "plain", None, None)]
    df = spark.createDataFrame(rows, "doc_id string, page int, block_idx int, text string, font_size double, is_bold boolean")
    assert [r.level for r in df.select("block_idx", structure.level().alias("level")).orderBy("block_idx").collect()] == [1, 2, 3, 3, None, None]
    sizes = spark.createDataFrame([("a", i, s) for i, s in enumerate([12.0, 10.0, 12.0, 10.0])] + [("b", 0, None)], "doc_id string, pos int, font_size double")
    got = {r.doc_id: (r.body, r.threshold) for r in structure.calibrate(sizes).collect()}
    assert got == {"a": (12.0, 12.0 * 1.2), "b": (12.0, 14.0)}


def test_headings_by_the_fonts_of_each_file(spark):
    sizes = {"big": [22.0, 15.0, 15.0, 15.0], "small": [13.0, 9.0, 9.0, 9.0], "none": [None, None]}
    rows = [(d, 1, i, f"texto corrido {i}", s, False) for d, every in sizes.items() for i, s in enumerate(every)]
    block = spark.createDataFrame(rows, "doc_id string, page int, block_idx int, text string, font_size double, is_bold boolean")
    block = block.withColumn("bbox", F.expr("named_struct('x0', 0d, 'y0', block_idx * 17d, 'x1', 500d, 'y1', block_idx * 17d + 12d, 'page', page)"))
    page = spark.createDataFrame([(d, 1, "x") for d in sizes], PAGE)
    got = {(r.doc_id, r.block_idx): r.level for r in pipeline.convert(page, blocks=block)["headings"].collect()}
    assert got == {("big", 0): 3, ("small", 0): 3}


def test_large_tables_and_separators(spark):
    lines = ["h1\th2\th3", *[f"{i}\tx\t" for i in range(25)]]
    df = spark.createDataFrame([("a", 1, "\n".join(lines)), ("b", 1, "x  y  z  w\n1  2  3  4\nend"), ("c", 1, "a|b|c\nno\n|||\n|||")], PAGE)
    got = {(r.doc_id, r.id): r for r in structure.tables(df).collect()}
    assert got["a", "table_1"].columns == ["h1", "h2", "h3"] and len(got["a", "table_1"].data) == 25 and got["a", "table_1"].data[0] == ["0", "x"]
    assert got["b", "table_1"].data == [["1", "2", "3", "4"]] and ("c", "table_1") not in got  # the run without cells uses up the number
    text = {r.doc_id: r.text for r in chunks.of_tables(structure.tables(df)).collect()}
    assert text["a"].splitlines()[-1] == "... (5 linhas adicionais)" and text["a"].splitlines()[:2] == ["| h1 | h2 | h3 |", "|---|---|---|"]


# Sections --------------------------------------------------------------------------------------------------------------


def py_parents(levels):
    open_, out = {}, []
    for i, lv in enumerate(levels, 1):
        if lv == 1:
            out.append(None)
            open_ = {1: i}
        else:
            out.append(next((open_[k] for k in range(lv - 1, 0, -1) if k in open_), None))
            open_[lv] = i
    return out


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(1, 6), min_size=1, max_size=12), min_size=1, max_size=8))
def test_parents_like_a_loop(spark, trees):
    df = spark.createDataFrame([(str(i), s, lv) for i, t in enumerate(trees) for s, lv in enumerate(t, 1)], "doc_id string, seq int, level int")
    got = {}
    for r in sections.parents(df).orderBy("doc_id", "seq").collect():
        got.setdefault(r.doc_id, []).append(r.parent_seq)
    assert got == {str(i): py_parents(t) for i, t in enumerate(trees)}


def test_sections_and_paths(spark):
    heads = spark.createDataFrame([("d", 1, s, f"t{s}", lv) for s, lv in enumerate([1, 2, 3, 2, 4], 1)], "doc_id string, page int, seq int, text string, level int")
    paras = spark.createDataFrame([("d", 1, 1, "P"), ("d", 1, 2, "Q"), ("e", 1, 1, "x"), ("e", 2, 1, "y")], "doc_id string, page int, para_no int, text string")
    tables = spark.createDataFrame([("d", 1, 1, "table_1")], "doc_id string, page int, table_no int, id string")
    rows = {(r.doc_id, r.seq): r for r in sections.sections(heads, paras, tables).collect()}
    assert rows["d", 5].full_title == "t1 > t2 > t3 > t5" and rows["d", 5].path == [1, 2, 3, 5] and rows["d", 4].parent_seq == 1
    assert rows["d", 1].content == "P\n\nQ" == rows["d", 5].content and rows["d", 1].tables_refs == ["table_1"] and rows["d", 1].id == "sec_0"
    assert (rows["e", 1].title, rows["e", 1].content) == ("Documento", "x\n\ny")


def test_metadata_summary_preview_confidence(spark, pages):
    c = structure.classify(structure.blocks(pages))
    h, p = structure.headings(c), structure.paragraphs(c)
    meta = {r.doc_id: (r.title, r.page_count) for r in sections.metadata(pages, h).collect()}
    assert meta == {"d": ("OBJETO", 2), "e": (None, 1), "n": (None, 3)}
    long = spark.createDataFrame([("a", i, "x" * 200) for i in range(1, 6)], PAGE)
    assert sections.summary(long).first().summary == (" ".join(["x" * 200] * 3))[:500] + "..."
    assert sections.preview(long, 300).first().preview == ("x" * 200 + "\n\n" + "x" * 200)[:300]
    sure = {r.doc_id: round(r.confidence, 6) for r in sections.confidence(pages, h, p).collect()}
    assert sure["n"] == round((3 / 3 / 500 + 0.5) / 2, 6)
    schema = spark.createDataFrame([("e", 0.3)], "doc_id string, confidence double")
    assert {r.doc_id: r.confidence for r in sections.confidence(pages, h, p, schema).collect()}["e"] == pytest.approx((0.3 + 14 / 500 + 0.9) / 3)


def test_routing(spark, pages):
    b = structure.blocks(pages)
    c = structure.classify(b)
    args = (pages, c, structure.tables(pages), structure.equations(pages), structure.footnotes(b), structure.paragraphs(c))
    got = {(r.doc_id, r.page): r for r in sections.routing(*args).collect()}
    first = got["d", 1]
    assert first.for_vision == ["table_1"] and first.reason == "Low extraction confidence: 0.60" and not first.requires_full_page_vision and first.complexity == "complex"
    assert got["n", 1].complexity == "simple" and got["n", 1].reason == "Standard text extraction" and got["n", 1].n_elements == 0
    eager = {(r.doc_id, r.page): r for r in sections.routing(*args, prefer_tables=True, prefer_equations=True).collect()}["d", 1]
    assert eager.reason.startswith("Vision preferred for tables; Equation processing via vision")


# Chunks ----------------------------------------------------------------------------------------------------------------


def py_chunks(text, size, overlap, most):
    tok = lambda s: len(s) // 4
    out, cur, t = [], [], 0
    for p in (x.strip() for x in re.split(r"\n\n+", text)):
        if not p:
            continue
        if tok(p) > most:
            if cur:
                out.append("\n\n".join(cur))
            cur, t = [], 0
            for s in (x.strip() for x in re.split(rf"(?<=[.!?])\s+(?=[{X.CAPITALS}])", p)):
                if s:
                    if t + tok(s) > size and cur:
                        out.append(" ".join(cur))
                        cur = [cur[-1]] if overlap > 0 else []
                        t = tok(cur[0]) if cur else 0
                    cur.append(s)
                    t += tok(s)
        else:
            if t + tok(p) > size and cur:
                out.append("\n\n".join(cur))
                cur = [cur[-1]] if overlap > 0 and tok(p) < overlap else []
                t = tok(cur[0]) if cur else 0
            cur.append(p)
            t += tok(p)
    return [*out, *(["\n\n".join(cur)] if cur else [])]


words = st.sampled_from(["Uma frase curta.", "Outra bem mais longa que a primeira!", "sem capital.", "X" * 30, "E então?", "fim"])
texts = st.lists(st.lists(words, min_size=1, max_size=12).map(" ".join), max_size=8).map("\n\n".join)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(texts, min_size=1, max_size=25), st.sampled_from([(500, 50, 2000), (20, 5, 30), (15, 0, 25), (30, 20, 40)]))
def test_split_like_a_loop(spark, many, limits):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(many)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", chunks.split("t", *limits).alias("c")).collect()}
    assert got == {i: py_chunks(t, *limits) for i, t in enumerate(many)}


def test_split_of_nothing_and_of_much(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n\n "), (4, "\n\n".join(["paragraph number one"] * 3000))], "i int, t string")
    got = {r.i: r.c for r in df.select("i", chunks.split("t", 100, 0).alias("c")).collect()}
    assert got[1] == got[2] == got[3] == [] and sum(c.count("paragraph") for c in got[4]) == 3000


def test_pipeline(spark, pages):
    out = pipeline.convert(pages, pipeline.Config(chunk_size=20, chunk_overlap=5))
    rows = out["chunks"].orderBy("doc_id", "chunk_index").collect()
    d = [r for r in rows if r.doc_id == "d"]
    assert [r.chunk_index for r in d] == list(range(len(d))) and d[0].id == "chunk_0000" and d[-1].section_title == "Tabela" and d[-1].has_table
    md = {r.doc_id: r.markdown for r in out["markdown"].collect()}
    assert "# OBJETO" in md["d"] and "- [OBJETO](#objeto)" in md["d"] and "| a | b | c |\n|---|---|---|\n| 1 | 3 |  |" in md["d"] and "[^1]: nota ao pé" in md["d"]
    js = {r.doc_id: json.loads(r.json) for r in out["json"].collect()}
    assert js["d"]["content"]["sections"][0]["parent_id"] is None and js["d"]["metadata"]["title"] == "OBJETO" and js["n"]["chunks"] is None and js["d"]["structured_data"]["_schema_inferred"] is False
    for name, df in pipeline.convert(pages.limit(0)).items():
        assert df.count() == 0, name


# Entities --------------------------------------------------------------------------------------------------------------


def test_entities(spark):
    t = "01/02/24, 99/99/2024 e 01/02/24; 15 de março de 2024; R$1.234,56 R$ , US$ 1,234.50 2024-02-01"
    df = spark.createDataFrame([(1, t), (2, None), (3, "")], "i int, t string")
    d = entities.explode(df, entities.dates(F.col("t")), "i").collect()
    assert sorted((r.original, r.normalized) for r in d) == [("01/02/24", "2024-02-01"), ("15 de março de 2024", "2024-03-15"), ("99/99/2024", "2024-99-99")]
    m = entities.explode(df, entities.money(F.col("t")), "i").collect()
    assert sorted((r.original, r.value, r.currency) for r in m if r.value) == [("R$ 1.234,56", 1234.56, "BRL"), ("US$ 1,234.50", 1234.5, "USD")] and any(r.value is None for r in m)
    first = spark.createDataFrame([(1, "a", "ctx"), (1, None, None)], "i int, original string, context string")
    second = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "i int, original string")
    merged = sorted((r.i, r.original or "", r.origin_rank) for r in entities.merge(first, second, "i").collect())
    assert merged == [(1, "", 1), (1, "a", 1), (1, "b", 2), (2, "a", 2)]


def test_pipeline_mines_entities(spark):
    df = spark.createDataFrame([("a", 1, "Assinado em 01/02/24 por R$ 1.234,56 e em 15 de"), ("a", 2, "março de 2024; 01/02/24"), ("b", 1, None)], PAGE)
    answer = spark.createDataFrame([("a", json.dumps({"people": [{"name": "Ana"}], "dates": [{"original": "01/02/24", "context": "c"}]}))], "doc_id string, answer string")
    figure = spark.createDataFrame([("a", 2, "fig_v_2_0", "t", "c", "alt", "other", 0.85)], "doc_id string, page int, id string, title string, caption string, alt_text string, figure_type string, confidence double")
    plain = {r.doc_id: json.loads(r.json) for r in pipeline.convert(df)["json"].collect()}
    assert [(e["original"], e["normalized"]) for e in plain["a"]["entities"]["dates"]] == [("01/02/24", "2024-02-01"), ("15 de\n\nmarço de 2024", "2024-03-15")]
    assert [(e["original"], e["value"]) for e in plain["a"]["entities"]["monetary_values"]] == [("R$ 1.234,56", 1234.56)] and plain["b"]["entities"]["dates"] == [] == plain["a"]["content"]["figures"]
    both = {r.doc_id: json.loads(r.json) for r in pipeline.convert(df, answers=answer, figures=figure)["json"].collect()}["a"]
    assert both["entities"]["people"][0]["name"] == "Ana" and [(e["context"], e["original"][:2]) for e in both["entities"]["dates"]] == [("c", "01"), (None, "15")] and both["content"]["figures"][0]["id"] == "fig_v_2_0"


# Answers ---------------------------------------------------------------------------------------------------------------

ANSWERS = [
    ('{"title":"t","extractedData":{"a":1},"summary":"x', {"title": "t", "extractedData": {"a": 1}}),
    ('text ```json\n{"a": 1,}\n``` more ```\n{}\n```', {"a": 1}), ('x {"a": [1, 2,], } y', {"a": [1, 2]}), ('{" a\\n": {"\'b\'": 1, "": 2}}', {"a": {"b": 1}}),
    ('{"a": {"b": [1, {"c": 2}, {"d": "cut', {"a": {"b": [1, {"c": 2}]}}),
]


@pytest.mark.parametrize(("answer", "value"), ANSWERS)
def test_answers_are_read_or_repaired(answer, value):
    assert answers.read(answer) == value


def test_answers_without_object():
    assert answers.read("sem dados")["_error"] == "No JSON object found" and answers.read('{"title":"t"')["_error"] == "No valid JSON found" and answers.read(None)["_error"] == "No JSON object found"
    assert answers.repaired('{"title": "a\\"b", "schema": {"x": [1, 2, "date": null, "summary": 12,') == {"title": 'a"b', "date": None, "summary": 12}


@settings(max_examples=150, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=12), st.data())
def test_longest_part_of_a_cut_value_is_json(value, data):
    text = json.dumps(value)
    assert json.loads(answers.longest(text + " x")) == value
    part = answers.longest(text[: data.draw(st.integers(0, len(text)))])
    assert part is None or json.dumps(json.loads(part)) is not None


def test_infer(spark):
    texts = spark.createDataFrame([("a", "Contrato de locação\n\nPágina 1"), ("b", "nada"), ("c", "erro"), ("d", None)], "doc_id string, text string")
    good = json.dumps({"documentType": "contrato", "title": "t", "summary": "s", "schema": {"sections": [1, 2]}, "extractedData": {"x": 1}})

    class Model:
        def __init__(self):
            self.calls = 0

        def __call__(self, prompt):
            self.calls += 1
            if "Contrato" in prompt and self.calls < 3:
                raise answers.RateLimited("slow down")
            if "erro" in prompt:
                raise ValueError("down")
            return f"```json\n{good}\n```" if "Contrato" in prompt else "sem dados"

    known = spark.createDataFrame([("b", "ata")], "doc_id string, document_type string")
    got = {r.doc_id: r for r in answers.infer(texts.coalesce(1), Model(), known, prompt="leia: {document_text}", delay=0.01, model="m").collect()}
    assert (got["a"].schema_inferred, got["a"].document_type, got["a"].confidence) == (True, "contrato", 0.7) and json.loads(got["a"].fields)["_meta"]["source"] == "a"
    assert (got["b"].schema_inferred, got["b"].document_type, got["b"].confidence) == (False, "ata", 0.0) and json.loads(got["b"].fields)["_error"] == "No JSON object found"
    assert json.loads(got["c"].fields)["_error"] == "ValueError: down" and got["c"].document_type == "unknown" and got["d"].document_type == "unknown"


def test_dictionary_forms(spark, tmp_path):
    rows = [("a", True, "ata", 0.5, '{"title": "t"}', "m", "2.0"), ("b", False, "unknown", 0.0, "{}", "m", "2.0"), ("c", True, "ata", 0.5, '{"x": {"y": [1]}}', None, "1.0"), ("d", False, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id string, schema_inferred boolean, document_type string, confidence double, fields string, inference_model string, schema_version string")
    got = {r.doc_id: json.loads(r.dictionary) for r in answers.as_dictionary(df).collect()}
    assert got["a"] == {"title": "t", "_processing": {"schema_version": "2.0", "inference_model": "m", "confidence": 0.5, "schema_inferred": True}}
    assert got["b"] == {"_schema_inferred": False, "_document_type": "unknown", "_schema_version": "2.0", "_inference_model": "m", "_confidence": 0.0}
    assert got["c"]["x"] == {"y": [1]} and got["c"]["_inference_model"] is None and got["d"]["_document_type"] is None
    assert {r.doc_id: r.y for r in answers.lookup(df, y="x.y").collect()} == {"a": None, "b": None, "c": "[1]", "d": None}
    own = tmp_path / "p.md"
    own.write_text("x {document_text}")
    assert answers.load_prompt(str(own)) == "x {document_text}" and answers.load_prompt(None) == answers.PROMPT
    own.write_text("no place")
    assert answers.load_prompt(str(own)) == answers.PROMPT


def test_confidence_type_and_completion(spark):
    full = {"documentType": "ata", "title": "t", "summary": "s", "schema": {"sections": [1, 2]}, "extractedData": {"a": 1, "b": 2, "c": 3}}
    rows = [(1, json.dumps(full)), (2, "{}"), (3, None), (4, json.dumps({**full, "date": "2024-01-01"})), (5, json.dumps({"documentType": "documento", "title": "t", "schema": {"sections": [1]}, "extractedData": {"a": 1}}))]
    df = spark.createDataFrame(rows, "i int, d string")
    got = {r.i: (r.c, r.t) for r in df.select("i", answers.confidence(F.col("d")).alias("c"), answers.document_type(F.col("d"), F.lit(None).cast("string")).alias("t")).collect()}
    assert got == {1: (0.8, "ata"), 2: (0.3, "documento_geral"), 3: (0.3, "documento_geral"), 4: (1.0, "ata"), 5: (0.3, "documento_geral")}
    done = json.loads(df.where("i = 2").select(answers.completed(F.col("d"), F.lit("f.pdf")).alias("v")).first().v)
    assert done["documentType"] == "documento" and done["date"] is None and done["schema"] == {"description": "", "sections": []} and done["_meta"]["source"] == "f.pdf"


def test_backends(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "p string")
    got = [r.answer for r in answers.ask(df, F.col("p"), answers.Replay({"a": "{}"})).collect()]
    assert got == ["{}", None, None]
    assert [(r.answer, r.answer_error) for r in answers.ask(df, F.col("p"), answers.silent).collect()] == [(None, None)] * 3


def test_elements_of_answers(spark):
    page = {"content": "x", "tables": [{"title": "T", "headers": ["a", "b"], "data": [["1", 2], [None, "3"]]}, None], "figures": [{"caption": "c", "description": "", "alt_text": "alt"}], "equations": [{"latex": "E", "label": None, "is_inline": True}, {}]}
    rows = [("d", 2, f"```json\n{json.dumps(page)}\n```"), ("d", 3, "no object"), ("d", 4, None), ("d", 5, "{cut"), ("d", 6, "{}")]
    got = elements.read_pages(spark.createDataFrame(rows, "doc_id string, page int, answer string"))
    t = elements.tables(got).collect()
    assert [(r.id, r.title, r.columns, r.data, r.has_merged_cells) for r in t] == [("table_v_2_0", "T", ["a", "b"], [["1", "2"], [None, "3"]], False)]
    assert [(r.id, r.alt_text, r.figure_type, r.confidence) for r in elements.figures(got).collect()] == [("fig_v_2_0", "alt", "other", 0.85)]
    assert [(r.id, r.latex, r.is_inline) for r in elements.equations(got).collect()] == [("eq_v_2_0", "E", True), ("eq_v_2_1", "", False)]
    a = spark.createDataFrame([("d", "x", 1), ("d", "y", 1)], "doc_id string, id string, page int")
    b = spark.createDataFrame([("d", "y", 2, "m"), ("e", "x", 3, "n")], "doc_id string, id string, page int, extra string")
    assert sorted((r.doc_id, r.id, r.page, r.extra or "") for r in elements.united(a, b).collect()) == [("d", "x", 1, ""), ("d", "y", 1, ""), ("e", "x", 3, "n")]


def test_entities_of_answers(spark):
    full = {"people": [{"name": "A", "role": None}, {"role": "x"}, {"name": ""}], "dates": [{"original": "1/1/20"}, {}], "monetary_values": [{"original": "R$ 1", "value": 1}], "technical_terms": ["t"]}
    df = spark.createDataFrame([(1, json.dumps(full)), (2, "nothing"), (3, None)], "doc_id int, answer string")
    got = {r.doc_id: r for r in elements.read_entities(df).collect()}
    assert [p.name for p in got[1].people] == ["A"] and [x.original for x in got[1].dates] == ["1/1/20"] and got[1].monetary_values[0].value == 1.0 and got[1].technical_terms == ["t"]
    assert all(got[k].people == [] and got[k].technical_terms == [] for k in (2, 3))


def test_kind_by_words(spark):
    df = spark.createDataFrame([("a", 1, "A Cláusula do contrato"), ("a", 2, "e a CONTRATANTE"), ("b", 1, None), ("c", 1, "conclusão")], PAGE)
    assert {r.doc_id: (r.document_type, r.hits) for r in elements.keyword_type(df).collect()} == {"a": ("contrato", 3), "b": (None, 0), "c": ("relatorio", 1)}


# Files -----------------------------------------------------------------------------------------------------------------


def _docx(path, paras):
    run = lambda t, size, bold: f'<w:p><w:r><w:rPr>{"<w:b/>" if bold else ""}{f"<w:sz w:val={chr(34)}{size}{chr(34)}/>" if size else ""}</w:rPr><w:t>{t}</w:t></w:r></w:p>'
    body = "".join(run(*p) for p in paras)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}<w:tbl/></w:body></w:document>')
        z.writestr("word/media/image1.png", b"x" * 10)
        z.writestr("word/media/small.png", b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + b"\0\0\0\x10\0\0\1\0")
        z.writestr("docProps/core.xml", '<p xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>T</dc:title><dc:creator/></p>')


def test_docx(spark, tmp_path):
    _docx(tmp_path / "a.docx", [("Título", 48, True), (" ", 24, False), ("Corpo do texto", None, False)])
    (tmp_path / "bad.docx").write_bytes(b"no archive")
    (tmp_path / "c.txt").write_text("x")
    found = files.detect(files.scan(spark, str(tmp_path)))
    assert {r.extension: r.error for r in found.collect()} == {".docx": None, ".txt": "unsupported extension .txt"}
    b = files.docx_blocks(found.where("error is null")).collect()
    good = sorted((r.block_idx, r.text, r.font_size, r.is_bold, r.bbox.y0) for r in b if r.error is None)
    assert good == [(0, "Título", 24.0, True, 0.0), (1, "Corpo do texto", 12.0, False, 29.0)] and sum(r.error is not None for r in b) == 1
    blocks = spark.createDataFrame([r for r in b if r.error is None], files.BLOCKS)
    page = files.pages_of(blocks).first()
    assert page.raw_text == "Título\n\nCorpo do texto"
    out = pipeline.convert(files.pages_of(blocks), blocks=blocks.drop("error"))
    assert out["headings"].first().text == "Título"
    images = files.docx_images(found.where("error is null")).collect()
    assert [(r.idx, r.name, r.format, r.width) for r in images] == [(0, "image1.png", "png", 0)]
    info = {r.doc_id.rpartition("/")[2]: r for r in files.docx_info(found.where("error is null")).collect()}
    assert (info["a.docx"].has_text, info["a.docx"].has_images, info["a.docx"].page_count, info["a.docx"].metadata) == (True, True, 1, {"title": "T"}) and info["bad.docx"].error.startswith("BadZipFile")
    many = spark.createDataFrame([(r.path, 101) for r in found.where("error is null").select("path").collect()], "doc_id string, page_count int")
    assert {r.error for r in files.within_pages(found, many).collect()} == {"more than 100 pages", "unsupported extension .txt"}
    written = sink_files.write_assets(spark.createDataFrame(images), str(tmp_path / "out")).collect()
    assert all(r.error is None and r.path.endswith("_img_page1_0.png") for r in written) and (tmp_path / "out" / written[0].path.rpartition("/")[2]).read_bytes() == b"x" * 10
    with pytest.raises(NotImplementedError):
        files.pdf_spans(found)


def test_pdf_kinds_and_spans(spark):
    rows = [("a", 1, "x" * 60, 0, 50.0, 100.0), ("b", 1, "", 2, 0.0, 100.0), ("c", 1, "x" * 60, 1, 5.0, 100.0), ("d", 6, "", 9, 0.0, 1.0), ("d", 1, None, 0, None, 0.0)]
    df = spark.createDataFrame(rows, "doc_id string, page int, text string, n_images int, text_area double, page_area double")
    assert {r.doc_id: r.doc_type for r in files.classify_pdf(df).collect()} == {"a": "pdf_native", "b": "pdf_scanned", "c": "pdf_mixed", "d": "pdf_native"}
    spans = spark.createDataFrame([("a", 1, 0, 0, i, t, f, s, None) for i, (t, f, s) in enumerate([("Olá ", "X-Bold", 10.0), (" ", "Y", 99.0), ("mundo", "Z-Italic", 12.0)])], "doc_id string, page int, block_idx int, line_idx int, span_idx int, text string, font string, size double, bbox string")
    r = files.lines(spans).first()
    assert (r.text, r.font_size, r.is_bold, r.is_italic, r.font_name) == ("Olá mundo", 11.0, True, True, "X-Bold")


# Jobs ------------------------------------------------------------------------------------------------------------------

EVENT = "job_id string, ts timestamp_ntz, stage string, current int, total int, status string, received_at timestamp_ntz"


def _events(spark):
    from datetime import datetime as D

    t = lambda s: D(2024, 1, 1, 0, 0, s)
    rows = [
        ("j", t(1), "detection", 1, 2, "pending", t(1)), ("j", t(1), "detection", 1, 2, "pending", t(1)), ("j", t(5), "routing", 1, 2, "processing", t(9)), ("j", t(3), None, 2, 2, "processing", t(4)), ("j", t(4), "extraction", 1, None, "processing", t(6)),
        ("k", t(2), "output", 3, 3, "completed", t(2)), ("m", t(2), "unknown", 1, 1, "failed", None), (None, t(1), "routing", 1, 1, "pending", None), ("z", None, "routing", 1, 1, "pending", None),
    ]
    return spark.createDataFrame(rows, EVENT)


def test_jobs(spark):
    ev = _events(spark)
    got = {r.job_id: (r.status, r.stage, r.progress, r.n_events) for r in jobs.latest(ev).collect()}
    assert got == {"j": ("processing", "routing", 42, 4), "k": ("completed", "output", 100, 1), "m": ("failed", "unknown", None, 1)}
    assert [(r.job_id, r.progress) for r in jobs.changes(ev).orderBy("job_id", "ts").collect()] == [("j", 7), ("j", 10), ("j", 42), ("k", 100)]
    assert jobs.latest(ev.limit(0)).count() == 0 and jobs.duration(ev).count() == 3


def test_jobs_as_stream(spark, tmp_path):
    folder = tmp_path / "in"
    _events(spark).where("job_id is not null and ts is not null").coalesce(1).write.parquet(str(folder))
    schema = spark.read.parquet(str(folder)).schema
    q = jobs.stream(spark, str(folder), schema).writeStream.outputMode("complete").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.job_id: (r.status, r.progress) for r in spark.table("latest").collect()} == {"j": ("processing", 42), "k": ("completed", 100), "m": ("failed", None)}
    q = jobs.windows(spark, str(folder), schema, late="0 seconds").writeStream.outputMode("append").format("memory").queryName("win").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("win").count() == 0  # the window is still open


def test_anchor(spark):
    assert spark.range(1).select(documents.anchor(F.lit("1.2 Ação & Efeito_x")).alias("v")).first().v == "12-ação--efeitox"


# Figures, vision, files ------------------------------------------------------------------------------------------------


def test_image_sizes():
    assert files.image_size(b"GIF89a" + b"\x20\0\x10\0") == (32, 16) and files.image_size(b"nothing") == (0, 0)
    assert files.image_size(b"\xff\xd8\xff\xe0\0\4ab\xff\xc0\0\x11\x08\0\x40\0\x80") == (128, 64) and files.image_size(b"BM" + b"\0" * 16 + b"\7\0\0\0\xf8\xff\xff\xff") == (7, 8)


def test_metadata_of_pdfs(spark):
    raw = spark.createDataFrame([("a", "T", "", None, None, "p", "d", None)], "doc_id string, title string, author string, subject string, creator string, producer string, creationDate string, modDate string")
    assert files.pdf_metadata(raw).first().metadata == {"title": "T", "producer": "p", "creation_date": "d"}


def test_renderings(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    lit, none = F.lit, F.lit(None).cast("string")
    assert one(figures.render_figure(lit("T"), none, none, lit("a.png"))) == "![T](assets/a.png)\n*T*" and one(figures.render_figure(none, lit("C"), none, none)) == "*C*" and one(figures.render_figure(none, none, none, none)) == ""
    assert one(figures.render_equation(lit("x"), lit(False), lit("1"))) == "$$\nx\n$$\n*(1)*" and one(figures.render_equation(lit("x"), lit(True), none)) == "$x$"
    empty, rows = F.array().cast("array<string>"), F.array(F.array(lit("1"), lit("2")), F.array(lit("3")))
    assert one(figures.render_table(empty, rows)) == "| Col 1 | Col 2 |\n|---|---|\n| 1 | 2 |\n| 3 |  |" and one(figures.render_table(empty, F.array().cast("array<array<string>>"))) == ""
    assert one(figures.render_table(empty, rows, lit("T"), lit("|own|"))) == "**T**\n\n|own|"


def test_pipeline_with_vision(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "1. Um\ntexto corrido\na|b|c\n1|2|3"), ("a", 2, "sem título aqui")], PAGE)
    routing = pipeline.convert(df)["routing"]
    asked = vision.requests(routing, spark.createDataFrame([("a", 1, bytearray(b"png")), ("a", 2, bytearray(b"png"))], "doc_id string, page int, image binary"))
    reply = json.dumps({"figures": [{"title": "F", "caption": "c"}], "tables": [{"headers": ["x"], "data": [["1"]]}]})
    got = vision.ask(asked, lambda prompt: reply if "página 1" in prompt and prompt.endswith("cG5n") else None)
    assert [(r.page, r.answer, r.answer_error) for r in got.collect()] == [(1, reply, None)]
    assets = spark.createDataFrame([("a", 2, 0, "img_page2_0.png")], "doc_id string, page int, idx int, name string")
    schemas = answers.inferred(spark.createDataFrame([("a", '{"documentType": "ata", "title": "t", "summary": "s"}')], "doc_id string, answer string"))
    out = pipeline.convert(df, pipeline.Config(raw_text=True), page_answers=got, assets=assets, schemas=schemas)
    full = json.loads(out["json"].first().json)
    assert [f["id"] for f in full["content"]["figures"]] == ["fig_v_1_0", "fig_asset_0"] and full["content"]["sections"][0]["figures_refs"] == ["fig_v_1_0"]
    assert [t["id"] for t in full["content"]["tables"]] == ["table_1", "table_v_1_0"] and full["structured_data"]["_processing"]["confidence"] == 0.4 and [p["page"] for p in full["raw_text_by_page"]] == [1, 2]
    text = out["markdown"].first().markdown
    assert "*c*" in text and "## Figuras\n\n![Figura](assets/img_page2_0.png)" in text
    assert {r.page: r.for_vision for r in out["routing"].collect()} == {1: ["table_1", "fig_v_1_0"], 2: ["fig_asset_0"]} and out["totals"].first()[1:] == (1, 3000)
    done = sink_files.write_json(out["json"], str(tmp_path)).collect() + sink_files.write_markdown(out["markdown"], str(tmp_path)).collect()
    assert [r.error for r in done] == [None, None] and json.loads((tmp_path / "a.json").read_text()) == full and (tmp_path / "a.md").read_text() == text
    assert sink_files.summary(out).startswith("1 documents, 2 pages, 1 sections, 2 tables")


def test_states_of_jobs_and_arriving_files(spark, tmp_path):
    df = spark.createDataFrame([("a", "completed"), ("b", "failed"), ("c", "processing"), ("d", None)], "job_id string, status string")
    assert {r.job_id: (r.open, r.has_result) for r in jobs.statuses(df).collect()} == {"a": (False, True), "b": (False, False), "c": (True, False), "d": (True, False)}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.pdf").write_bytes(b"%PDF")
    running = files.detect(files.arrivals(spark, str(tmp_path / "in"))).select("extension", "error").writeStream.format("memory").queryName("arrived").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    running.awaitTermination()
    assert [tuple(r) for r in spark.table("arrived").collect()] == [(".pdf", None)]
