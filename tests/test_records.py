"""Nested records, drift, dates, amounts: small fixtures against brute force and hand-made cases."""

import json
import random
from datetime import UTC, datetime, timedelta
from decimal import Decimal
from fractions import Fraction
from zoneinfo import ZoneInfo

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.functions import jsontext, structindex
from folioflow.records import dates, drift, money, nested, units

# Nested ----------------------------------------------------------------------------------------------------------------


def walk(value, path="", up="$", element=False):
    """Cases by plain recursion."""
    if isinstance(value, str):
        inner = value.strip()
        if inner[:1] in ("{", "[", '"'):
            try:
                read = json.loads(inner)
                while isinstance(read, str):
                    read = json.loads(read)
            except ValueError:
                return
            if isinstance(read, dict | list):
                yield from walk(read, path, up, element)
    elif isinstance(value, dict):
        if element:
            yield path, up
            up = path
        for k, v in value.items():
            yield from walk(v, f"{path}.{k}" if path else k, up)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walk(v, f"{path}[{i}]", up, True)


scalars = st.none() | st.booleans() | st.integers() | st.text(max_size=8) | st.sampled_from(['a"b', "\\", "}{", "[1,", ' {"x": 1', "é "])
values = st.recursive(scalars, lambda inner: st.lists(inner, max_size=4) | st.dictionaries(st.text(min_size=1, max_size=4), inner, max_size=4) | st.builds(json.dumps, inner), max_leaves=20)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.dictionaries(st.text(min_size=1, max_size=4), values, max_size=5) | st.lists(values, max_size=4), min_size=1, max_size=6), st.booleans())
def test_links_like_recursion(records, indent):
    texts = [json.dumps(r, ensure_ascii=False, indent=1 if indent else None) for r in records]
    out = nested.link([t.encode() for t in texts])
    got = sorted(zip(out.src, out.node, out.parent))
    assert got == sorted((i, *case) for i, r in enumerate(records) for case in walk(r))


def test_index_of_members_and_items():
    ix = structindex.build(pa.array(['{"a": [1, "x,y"], "b": {"c": null}}', "", None, "[", "x"]))
    assert ix.closed.tolist() == [True, False, False, False, False]
    show = lambda spans: [bytes(ix.buffer[a:z]).decode().strip() for a, z in spans]
    assert show(ix.item_value) == ["1", '"x,y"'] and show(ix.member_value) == ["null"] and show(ix.member_key) == ["c"]


def test_linked_rows(spark):
    doc = {"items": [{"n": 1, "deep": [{"x": None}]}, {"n": 2}], "text": json.dumps([{"k": "v"}]), "plain": {"z": 3}}
    whole = json.dumps(doc)
    rows = [(1, whole, "a"), (1, whole, "a"), (2, f"```json\n{whole}\n```", "b"), (3, json.dumps(whole), None), (4, whole[:-5], "d"), (5, None, "e"), (6, "", "f"), (7, "no json", None), (None, whole, "g"), (8, "[]", "h")]
    df = spark.createDataFrame(rows, "infer_id bigint, fields string, node string")  # a clashing column
    got = nested.linked_rows(df).collect()
    cases = sorted(walk(doc))
    for k in (1, 2, 3):
        assert sorted((r.node, r.parent_node) for r in got if r.infer_id == k) == cases
    assert {r.infer_id for r in got} == {1, 2, 3}
    flat = nested.flat_table(nested.linked_rows(df, attributes=True), "items[]", ["n", "missing"]).where("infer_id = 1").orderBy("node").collect()
    assert [(r.node, r.n, r.missing) for r in flat] == [("items[0]", "1", None), ("items[1]", "2", None)]
    root = nested.linked_rows(df, attributes=True).where("infer_id = 1 and node = '$'").first()
    assert root.attrs["plain.z"] == "3"
    assert nested.linked_rows(df.limit(0)).count() == 0


def test_very_long_and_deep_text(spark):
    deep = "[" * 300 + "{}" + "]" * 300
    long = json.dumps({"a": [{"v": "x" * 2_000_000}]})
    df = spark.createDataFrame([(1, deep), (2, long)], "infer_id bigint, fields string")
    got = {r.infer_id: r.node for r in nested.linked_rows(df).collect()}
    assert got == {1: "[0]" * 300, 2: "a[0]"}


# Drift -----------------------------------------------------------------------------------------------------------------


def _files(spark, *files, feed="f"):
    rows, k = [], 0
    for no, records in files:
        for r in records:
            k += 1
            rows.append((k, feed, no, r if r is None or isinstance(r, str) else json.dumps(r)))
    return spark.createDataFrame(rows, "infer_id bigint, feed string, file_no int, fields string")


def _changes(df):
    return sorted((r.file_no, r.change, r.field, r.new_field) for r in drift.changes(df).collect())


def test_changes(spark):
    old = [{"unit": f"Eixo {i}", "total": 10.5 + i, "items": [{"name": "a", "qty": i}], "who": {"id": i, "role": "r"}, "flag": True, "gone": "x"} for i in range(6)]
    new = [{"place": f"Eixo {i}", "total": str(10.5 + i), "items_v2": [{"name": "a", "qty": i}], "who": {"id": i, "papel": "r", "extra": [1]}, "flag": None, "fresh": 7} for i in range(6)]
    df = _files(spark, (3, old), (7, new))
    assert _changes(df) == sorted([(7, "renamed", "unit", "place"), (7, "type_changed", "total", ""), (7, "renamed", "items", "items_v2"), (7, "renamed", "who.role", "who.papel"), (7, "added", "who.extra", ""), (7, "removed", "flag", ""), (7, "added", "fresh", ""), (7, "removed", "gone", "")])
    assert _changes(df.unionByName(df)) == _changes(df)  # repeated rows count once


def test_below_a_reported_field_and_json_in_text(spark):
    old = [{"a": {"x": 1, "y": 2}, "t": json.dumps([{"k": 1}])}]
    new = [{"a": [{"x": 1}], "t": [{"k": "s"}]}]
    assert _changes(_files(spark, (1, old), (2, new))) == [(2, "type_changed", "a", ""), (2, "type_changed", "t[].k", "")]


def test_files_without_readable_records(spark):
    df = _files(spark, (1, [{"a": 1}]), (2, [None, "", "cut {"]), (3, [{"a": 1}]))
    assert _changes(df) == [(2, "removed", "a", ""), (3, "added", "a", "")]
    assert drift.changes(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(1, None, 1, "{}"), (2, "f", None, "{}"), (None, "f", 1, "{}")], df.schema)
    assert drift.changes(nulls).count() == 0


def test_consistent_table_follows_renames(spark):
    f = lambda k, v: [{k: f"{v} {i}", "n": i} for i in range(5)]
    df = _files(spark, (1, f("titulo", "a b")), (2, f("titulo_v2", "a b")), (3, f("tit_v2", "a b")))
    rows = drift.consistent(df).collect()
    assert len(rows) == 15 and all(set(r.fields) == {"tit_v2", "n"} for r in rows)
    prints = {r.file_no: r.fingerprint for r in drift.fingerprints(df).collect()}
    assert len(set(prints.values())) == 3


def test_consistent_table_follows_steps_of_members(spark):
    f = lambda who, text, opts, n: [{"who": {"id": i, who: f"papel {i}"}, "items": [{text: f"a b {i}", opts: ["x", "y"], "n": n(i)}]} for i in range(5)]
    new = [r | {"flag": True} for r in f("role_doc", "titulo_v2", "opcoes_doc", lambda i: i)]
    df = _files(spark, (1, f("role", "titulo", "opcoes", lambda i: f"{i},5")), (2, f("role_doc", "titulo", "opcoesPrincipal", lambda i: f"{i},5")), (3, new), (4, [{"items": [{"titulo_v2": "a b 1"}], "who": {"id": 1}, "flag": None}]))
    rows = drift.consistent(df).orderBy("infer_id").collect()
    assert {r.file_no: r.schema_from for r in rows} == {1: 2, 2: 3, 3: 4, 4: None}
    for r in rows:
        items, who = json.loads(r.fields["items"]), json.loads(r.fields["who"])
        assert set(r.fields) == {"items", "who", "flag"} and set(who) == {"id", "role_doc"} and set(items[0]) == {"titulo_v2", "opcoes_doc", "n"}, r
    first = rows[1]
    assert json.loads(first.fields["items"]) == [{"titulo_v2": "a b 1", "opcoes_doc": ["x", "y"], "n": 1.5}] and json.loads(first.fields["who"])["role_doc"] == "papel 1" and first.fields["flag"] is None
    assert json.loads(rows[-1].fields["items"])[0]["n"] is None and rows[10].fields["flag"] == "true"


def test_casts():
    assert drift._cast("1.234,56", "number") == "1234.56" and drift._cast("não", "boolean") == "false" and drift._cast({"a": 1}, "array") == '[{"a": 1}]' and drift._cast(None, "number") is None


# Dates -----------------------------------------------------------------------------------------------------------------

ZONES = [("SPO", "America/Sao_Paulo", True), ("NYC", "America/New_York", False), ("LIS", "Europe/Lisbon", True)]
CASES = [
    ("26/08/2019", "SPO", "2019-08-26"), ("08/26/2019", "NYC", "2019-08-26"), ("05.06.20", "NYC", "2020-05-06"), ("05.06.20", "LIS", "2020-06-05"), ("4 de outubro de 2019", None, "2019-10-04"),
    ("16 DE MAIO DE 2023", "SPO", "2023-05-16"), ("11. August 2018", "NYC", "2018-08-11"), ("November 29, 2024", "SPO", "2024-11-29"), ("2025-120", None, "2025-04-30"), ("20211224", None, "2021-12-24"), (" 2018-06-30 ", None, "2018-06-30"),
    ("1573885231", None, "2019-11-16T06:20:31.000000Z"), ("1514023236550", "SPO", "2017-12-23T10:00:36.550000Z"), ("2020-01-02 03:04:05,5 -03:30", None, "2020-01-02T06:34:05.500000Z"), ("20250525T183907Z", None, "2025-05-25T18:39:07.000000Z"),
    ("18:53 de 22 de jul. de 2020", "LIS", "2020-07-22T17:53:00.000000Z"), ("30 de junho de 2017, às 6h46.", "SPO", "2017-06-30T09:46:00.000000Z"), ("Sun, 11 Jun 2023 18:26:31 -0400", None, "2023-06-11T22:26:31.000000Z"), ("May 3, 2025, 12:28 AM", "NYC", "2025-05-03T04:28:00.000000Z"),
    ("15/04/2019 - 03:55h", "SPO", "2019-04-15T06:55:00.000000Z"), ("9/1/2025 21:36 (GMT+5:30)", "SPO", "2025-01-09T16:06:00.000000Z"), ("10/26/2020 18:40 (UTC−2)", "NYC", "2020-10-26T20:40:00.000000Z"), ("2018-10-28 00:11 CEST", "LIS", "2018-10-27T22:11:00.000000Z"),
    ("2021-12-26 13:42:05z", None, "2021-12-26T13:42:05.000000Z"),
    ("31/02/2024", "SPO", None), ("2023-366", None, None), ("99/99/2020", "SPO", None), ("05/2022", "SPO", None), ("2025", None, None), ("ontem", "SPO", None), (None, "SPO", None), ("", "SPO", None), ("2020-01-01 25:00", "SPO", None), ("2020-01-01 10:00", None, None), ("2020-01-01 10:00", "???", None), ("01/02/2020", "???", None), ("2020-01-01 13:00 pm", "SPO", None), ("2020-01-01 10:00 XYZ", "SPO", None), ("9" * 5000, "SPO", None),
]


@pytest.fixture(scope="module")
def zones(spark):
    return spark.createDataFrame(ZONES, "origin string, zone_name string, day_first boolean")


def _stamps(spark, zones, cases):
    df = spark.createDataFrame([(i, o, z, "x") for i, (o, z) in enumerate(cases)], "mention_id bigint, original string, origin string, stamp string")
    return {r.mention_id: r for r in dates.normalise(df.unionByName(df), zones).collect()}


def test_notations(spark, zones):
    got = _stamps(spark, zones, [(o, z) for o, z, _ in CASES])
    assert len(got) == len(CASES)
    assert {o: got[i].stamp for i, (o, _, _) in enumerate(CASES)} == {o: s for o, _, s in CASES}


def test_clock_changes_like_the_zone_database(spark, zones):
    rng, cases = random.Random(1), []
    for origin, name, _ in ZONES:
        for _ in range(150):
            cases.append((origin, name, datetime(rng.randint(2016, 2025), rng.choice([2, 3, 10, 11]), rng.randint(1, 28), rng.randint(0, 4), rng.randint(0, 59))))
    got = _stamps(spark, zones, [(t.strftime("%Y-%m-%d %H:%M:%S"), o) for o, _, t in cases])
    for i, (_, name, t) in enumerate(cases):
        here = t.replace(tzinfo=ZoneInfo(name), fold=0)
        assert got[i].stamp == here.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ"), (t, name)


def test_mixture_learns_the_order(spark):
    """Without a known order, values that can only be read one way settle those that can be read both ways."""
    zone = spark.createDataFrame([("A", "UTC", None), ("B", "UTC", None), ("C", "UTC", None)], "origin string, zone_name string, day_first boolean")
    cases = [(f"{13 + i % 15}/05/2020", "A") for i in range(60)] + [("03/04/2020", "A")] + [(f"05/{13 + i % 15}/2020", "B") for i in range(60)] + [("03/04/2020", "B"), ("03/04/2020", "C"), ("04/04/2020", "C")]
    got = _stamps(spark, zone, cases)
    assert (got[60].stamp, got[121].stamp) == ("2020-04-03", "2020-03-04")
    assert got[122].status == "ambiguous" and got[122].stamp is None and got[123].stamp == "2020-04-04"


def test_dates_of_empty_tables(spark, zones):
    empty = spark.createDataFrame([], "mention_id bigint, original string, origin string")
    assert dates.normalise(empty, zones).count() == 0
    some = spark.createDataFrame([(1, "2020-01-02", "SPO")], empty.schema)
    assert dates.normalise(some, zones.limit(0)).first().stamp == "2020-01-02"


# Units and amounts -----------------------------------------------------------------------------------------------------


def test_graph_composes_affine_functions():
    g = units.UnitGraph().add("C", "K", 1, "273.15").add("F", "C", Fraction(5, 9), Fraction(-160, 9))
    f, o = g.to("K")["F"]
    assert f * 212 + o == Fraction("373.15")
    with pytest.raises(units.Inconsistent):
        units.UnitGraph().add("a", "b", 2).add("b", "c", 3).add("a", "c", 7).to("c")
    with pytest.raises(units.Inconsistent):
        units.UnitGraph().add("a", "b", 2).add("a", "b", 3)
    with pytest.raises(ValueError, match="no way back"):
        units.UnitGraph().add("a", "b", 0)


RATES = [("BRL", Decimal(1)), ("USD", Decimal("5.1237")), ("EUR", Decimal("5.5689")), ("GBP", Decimal("6.4313")), ("JPY", Decimal("0.0347"))]
PLAIN = "O serviço atende mil usuários."
AMOUNTS = [
    # original, value, currency, context, amount, unit
    ("R$ 4.106,05", None, None, None, "4106.05", "BRL:one"), ("5.775", 1.0, "USD", "valores em reais", "5775", "BRL:one"), ("9,294.05", None, None, "US$ millions", "9294.05", "USD:million"), ("R$1.186", None, None, PLAIN, "1186", "BRL:one"),
    ("R$ 646,3k", None, None, None, "646.3", "BRL:thousand"), ("4.334 centavos", None, "USD", None, "4334", "BRL:cent"), ("9,865 cents USD", None, None, None, "9865", "USD:cent"), ("2450 eurocents", None, None, None, "2450", "EUR:cent"), ("5077 p (GBP)", None, None, None, "5077", "GBP:cent"),
    ("(R$ 9,67)", None, None, None, "-9.67", "BRL:one"), ("US$912.21-", None, None, None, "-912.21", "USD:one"), ("− R$ 3,65", None, None, None, "-3.65", "BRL:one"), ("€ -169,21", None, None, None, "-169.21", "EUR:one"), ("R$ 42.896,-", None, None, None, "42896", "BRL:one"),
    ("R$ 1.974.--", None, None, None, "1974", "BRL:one"), ("U$ 17,344.-", None, None, None, "17344", "USD:one"), ("R$72.290.", None, None, None, "72290", "BRL:one"), ("306 743,08 €", None, None, None, "306743.08", "EUR:one"), ("€ 2,15 Mrd.", None, None, None, "2.15", "EUR:billion"),
    ("166,4 Mio. Euro", None, None, None, "166.4", "EUR:million"), ("5,87BRL", None, None, None, "5.87", "BRL:one"), ("cinquenta e nove milhões de reais", None, None, None, "59", "BRL:million"), ("forty-two thousand US dollars", None, None, None, "42", "USD:thousand"), ("oitenta libras", None, None, None, "80", "GBP:one"),
    ("12,00", None, None, "Demonstrativo anual, in TEUR.", "12", "EUR:thousand"), ("8", None, None, "(R$ '000)", "8", "BRL:thousand"), ("8", None, "€", None, "8", "EUR:one"), ("¥ 4", None, None, None, "4", "JPY:one"), (None, 12.345, "usd", None, "12.345", "USD:one"), ("US$ 94 M", None, None, None, "94", "USD:million"),
]
UNREADABLE = [("a combinar", None, "BRL", None), ("R$ ,", None, "BRL", None), ("R$ XX.XXX,XX", 5.0, "BRL", None), ("US$ --", 1.0, None, None), ("", 1.0, "BRL", None), ("12", None, None, PLAIN), (None, None, "BRL", None), (None, 3.0, None, None), (None, float("nan"), "BRL", None)]


def test_amounts(spark):
    rows = [(i, *a[:4]) for i, a in enumerate([*AMOUNTS, *UNREADABLE])]
    df = spark.createDataFrame(rows, "money_id bigint, original string, value double, currency string, context string")
    rates = spark.createDataFrame([*RATES, (None, None)], "currency string, brl_per_unit decimal(12,4)")
    got = {r.money_id: r for r in money.convert(df.unionByName(df), rates).collect()}
    factor = {"one": 1, "cent": Fraction(1, 100), "thousand": 1000, "million": 10**6, "billion": 10**9}
    for i, (original, *_, amount, unit) in enumerate(AMOUNTS):
        currency, scale = unit.split(":")
        exact = Fraction(amount) * factor[scale] * Fraction(dict(RATES)[currency]) * 100
        cents = int(abs(exact) + Fraction(1, 2)) * (1 if exact >= 0 else -1)
        assert (got[i].unit, got[i].brl_cents) == (unit, cents), original
    assert set(got) == set(range(len(AMOUNTS)))
    assert money.convert(df.limit(0), rates).count() == 0 and money.convert(df, rates.limit(0)).where("unit not like 'BRL%'").count() == 0


def test_halves_go_away_from_zero(spark):
    df = spark.createDataFrame([(1, "R$ 0,005", None, None, None), (2, "-R$ 0,005", None, None, None), (3, "1.234.567.890.123,45 reais", None, None, None)], "money_id bigint, original string, value double, currency string, context string")
    rates = spark.createDataFrame([("BRL", Decimal(1))], "currency string, brl_per_unit decimal(12,4)")
    got = {r.money_id: r.brl_cents for r in money.convert(df, rates).collect()}
    assert got[3] == 123456789012345
    assert got[1] in (500, 1) and got[2] == -got[1]  # a lone mark before three digits groups thousands


def test_time_is_utc_in_any_session(spark, zones):
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        got = _stamps(spark, zones, [("2020-01-02T00:00:00Z", None), ("1577934000", None), ("1/1/2020 10:00", "SPO")])
        assert [got[i].stamp for i in range(3)] == ["2020-01-02T00:00:00.000000Z", (datetime(1970, 1, 1) + timedelta(seconds=1577934000)).strftime("%Y-%m-%dT%H:%M:%S.%fZ"), "2020-01-01T13:00:00.000000Z"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


DECOYS = ['note [1]: {"a":[{"b":1}]}', 'see {x}: {"a":[{"b":1}]}', 'say "hi {" now {"a":[{"b":1}]}', '[2] [x] {"a":[{"b":1}]} and {more', '```json\n{"a":[{"b":1}]}\n```']
BROKEN_JSON = ['{"a":[{"b":1}],"c":[{"d"', '{"a":1 "b":[{"c":2}]}', "{'a':[{'b':1}]}", "{{{{[", "no json [here", ""]


def test_json_behind_other_brackets(spark):
    rows = [(k, "f", k, t) for k, t in enumerate(DECOYS + BROKEN_JSON)]
    df = spark.createDataFrame(rows, "infer_id bigint, feed string, file_no int, fields string")
    assert sorted((r.infer_id, r.node, r.parent_node) for r in nested.linked_rows(df).collect()) == [(k, "a[0]", "$") for k in range(len(DECOYS))]
    assert [jsontext.read(t.encode()) for t in DECOYS] == [{"a": [{"b": 1}]}] * len(DECOYS)
    assert [jsontext.read(t.encode()) for t in BROKEN_JSON] == [None] * len(BROKEN_JSON)
    assert drift.fingerprints(df).select("fingerprint").distinct().count() == 1


def test_routes_of_files(spark):
    files = [{"old_name": 1, "x": "k"}, {"name_old": 1, "x": "k"}, {"name_old": 1, "x": "k", "y": True}, {"name_old": 2, "x": "k", "y": False}]
    df = spark.createDataFrame([(k * 10 + j, "f", k, json.dumps(f)) for k, f in enumerate(files) for j in range(3)] + [(99, "f", 7, None)], "infer_id bigint, feed string, file_no int, fields string")
    got = {r.file_no: r for r in drift.routes(df.where("infer_id < 99")).collect()}
    assert [got[k].current for k in range(4)] == [False, False, True, True] and got[3].steps == [] and got[2].steps == []
    assert [(s.file_no, s.change) for s in got[0].steps] == [(1, "renamed"), (2, "added")] and got[0].collisions == []
    assert {r.file_no: r.fingerprint for r in drift.routes(df).collect()}[7] is None
    assert drift.routes(df.limit(0)).count() == 0


def test_mixture_of_an_origin_without_zone(spark):
    """Its own clear dates settle the order where no table names it; too few leave it open."""
    clear = [(k, f"{13 + k % 15}/0{1 + k % 9}/2024", "Atlantis") for k in range(200)]
    df = spark.createDataFrame([*clear, (900, "03/04/2024", "Atlantis"), (901, "03/04/2024", "Mu"), (902, "03/04/2024", None), (903, "03/04/2024 10:00", "Atlantis")], "mention_id bigint, original string, origin string")
    zones = spark.createDataFrame([("SP", "America/Sao_Paulo", True)], "origin string, zone_name string, day_first boolean")
    got = {r.mention_id: (r.stamp, r.status) for r in dates.normalise(df, zones).where("mention_id >= 900").collect()}
    assert got == {900: ("2024-04-03", "date"), 901: (None, "ambiguous"), 902: (None, "ambiguous"), 903: (None, "no_zone")}
