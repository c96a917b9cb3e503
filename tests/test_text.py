"""Text functions by fixed cases and by what must hold of any text."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import structure

# function, text, result
FIXED = {
    "strip": (X.strip, [(" pad　", "pad"), ("\x1fa\x85", "a"), ("", ""), (None, None)]),
    "sentences": (X.sentences, [("Olá. Tudo bem? SIM! não. Ótimo", ["Olá.", "Tudo bem?", "SIM! não.", "Ótimo"]), ("😀 one. Two", ["😀 one.", "Two"]), ("no end", ["no end"]), ("  ", []), (None, [])]),
    "repeated lines": (X.without_repeated_lines, [("a\n\na\nb\nb \n b\nc", "a\n\nb\nc"), ("a\n\n\na", "a\n\n"), ("", ""), ("x\ny\nx", "x\ny\nx"), (None, None)]),
    "page numbers": (
        X.without_page_numbers,
        [("a\n - 3 - \nb", "a\nb"), ("b\nPágina 3 de 9\nc", "b\nc"), ("c\n 3/9 \nd", "c\nd"), ("d\n17\ne", "d\ne"), ("e\nPage 4\nf", "e\nf"), ("a\n12345\nb", "a\n12345\nb"), ("- 3 -\n", "- 3 -\n"), (None, None)],
    ),
    "truncated": (
        lambda x: X.smart_truncate(x, 20),
        [("short", "short"), ("One two three four. Five six", "One two three four." + X.TRUNCATED), ("aaaaaaaaaaaa\n\nbbbbbbbbbbbb", "aaaaaaaaaaaa" + X.TRUNCATED), ("a" * 25, "a" * 20 + X.TRUNCATED), ("ab. cdefghijklmnopqrstuvw", "ab. cdefghijklmnopqr" + X.TRUNCATED), (None, None)],
    ),
    "words": (lambda x: X.truncate_words(x, 13), [("one two three four", "one two..."), ("fits exactly!", "fits exactly!"), ("abcdefghijklmnop", "abcdefghij..."), ("a bcdefghijklmnop", "a bcdefghi..."), (None, None)]),
    "level": (X.heading_level, [("1.2 Escopo", 1), ("3.14 é pi", 1), ("1. Ver art. 5.", 3), ("1.1.1.1.1.1.1.1. x", 6), ("OBJETO", 1), ("LEI Nº 10", None), ("Objeto", None), ("A" * 100, None), ("42", None), (None, None)]),
    "hyphens": (X.merge_hyphenated, [("a-\nb c-\n  ço", "ab cço"), ("héllo-\nwörld", "héllowörld"), ("well-known", "well-known"), (None, None)]),
    "collapse": (X.collapse, [("x\n\n\ty  　 z ", "x y z"), (" ", ""), (None, None)]),
    "clean": (X.clean, [("\x00\x1fa\x7f\x85b\tc\nd\re", "ab\tc\nd\re"), (None, None)]),
    "mentions": (X.page_mentions, [("pág. 3 e página 17, P.5", [3, 17, 5]), ("nada", []), ("p. 99999999999", [None]), (None, None)]),
    "lists": (X.compact_lists, [("x\n  • y\n 2)z", "x\n- y\n2) z"), ("• y", "• y"), (None, None)]),
    "punctuation": (X.plain_punctuation, [("wait.... --- ____ , no – yes — !", "wait... -- __, no - yes -!"), (None, None)]),
    "space": (X.compact_space, [("a \t b  \n\n\n\n  c", "a b\n\nc"), (None, None)]),
    "unix": (X.unix_lines, [("x\r\ny\rz", "x\ny\nz"), (None, None)]),
    "tables": (structure.table_runs, [("a|b|c\n1||3\nx\na|b|c\ny\n\t\t\n2\t3\t4", [["a|b|c", "1||3"], ["\t\t", "2\t3\t4"]]), ("a|b|c", []), ("", []), ("a  b  c  d\na  b  c  d", [["a  b  c  d", "a  b  c  d"]])]),
}


@pytest.mark.parametrize("name", FIXED)
def test_fixed_cases(spark, name):
    column, cases = FIXED[name]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", column(F.col("t")).alias("v")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aB é.!?-–\n\t|1•)", max_size=120), min_size=20, max_size=40))
def test_what_holds_of_any_text(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    once = {"lines": X.without_repeated_lines, "space": X.compact_space, "collapse": X.collapse, "clean": X.clean}
    cols = {f"{k}{n}": f("t") if n == 1 else f(f("t")) for k, f in once.items() for n in (1, 2)}
    rows = df.select("t", *[v.alias(k) for k, v in cols.items()], X.sentences("t").alias("s"), X.smart_truncate("t", 50).alias("cut"), X.truncate_words("t", 40).alias("words"), structure.table_runs(F.col("t")).alias("runs")).collect()
    for r in rows:
        assert all(r[f"{k}1"] == r[f"{k}2"] for k in once)  # done twice changes nothing more
        assert set(r["lines1"].split("\n")) <= set(r.t.split("\n")) and r["lines1"].count("\n") <= r.t.count("\n")
        assert "".join("".join(r.s).split()) == "".join(r.t.split()) and all(x and x == x.strip() for x in r.s)
        assert len(r.cut) <= 50 + len(X.TRUNCATED) and r.cut.removesuffix(X.TRUNCATED) == r.t[: len(r.cut.removesuffix(X.TRUNCATED))]
        assert len(r.words) <= 40 and all(len(run) >= 2 for run in r.runs) and "\n".join(r.t.split("\n")) == r.t


def test_many_lines_in_linear_time(spark):
    text = "\n".join(f"a|{k // 2}|c" if k % 5 else "" for k in range(60_000))
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(F.length(X.without_repeated_lines("t")).alias("n"), F.size(structure.table_runs(F.col("t"))).alias("k")).first()
    assert 0 < got.n < len(text) and got.k == 12_000


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    lit = F.lit
    assert [one(X.list_type(lit(t))) for t in ("1) item", "a. x", "(iv) y", "(2) z", "- b", "* c", "-d", "x")] == ["ordered"] * 4 + ["unordered"] * 2 + [None] * 2
    assert one(X.without_marker(lit("• 3) item"))) == "item"
    assert one(X.file_size(lit(None).cast("long"))) is None and one(X.file_size(lit(1536))) == "1.5 KB" and one(X.file_size(lit(10))) == "10.0 B" and one(X.file_size(lit(1 << 41))) == "2.0 TB"
    assert one(X.safe_filename(lit('a<>b|"c".pdf'))) == "a_b_c_.pdf" and one(X.safe_filename(lit("n" * 250 + ".pdf"))) == "n" * 200 + ".pdf"
    assert [one(X.file_extension(lit(t))) for t in ("A.PDF", "x/.hidden", "a.b/c", "d.tar.gz")] == [".pdf", "", "", ".gz"]
    assert one(X.date_br(lit("em 1/2/2024 ou 2023-05-06"))) == "2024-02-01" and one(X.date_br(lit("2023-5-6"))) == "2023-05-06" and one(X.date_br(lit("x"))) is None
    value, code = X.money_br(lit("US$ 1.234,50"))
    assert (one(value), one(code)) == (1234.5, "USD")
    assert one(X.compatible(lit("ﬁm  Ⅳ"))) == "fim IV" and one(X.compatible(lit(None).cast("string"))) is None
    assert one(X.likely_title(lit("short\nThis is a title\nx"))) == "This is a title"
    assert one(X.tokens(lit(None).cast("string"))) == 0 and json.loads(one(F.to_json(F.struct(X.tokens(lit("12345678")).alias("n")))))["n"] == 2


def test_repeated_edges_and_whole_chain(spark):
    part = "\n".join(["Header of the report", *[f"line {i}" for i in range(8)], "Footer of it"])
    text = "\n\n\n".join([part, part.replace("line", "row"), part.replace("line", "item")])
    df = spark.createDataFrame([(text,), ("short",), (None,)], "t string")
    got = [r.v for r in df.select(X.without_repeated_edges("t").alias("v")).collect()]
    assert "Header" not in got[0] and "Footer" not in got[0] and got[0].count("line") == 8 and got[1:] == ["short", None]
    chain = [r.v for r in df.select(X.normalise("t", limit=50).alias("v")).collect()]
    assert len(chain[0]) <= 50 + len(X.TRUNCATED) and chain[1:] == ["short", ""]
