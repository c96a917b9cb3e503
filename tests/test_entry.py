"""The driver contract: every query runs on the smallest tables and equals its SQL."""

import json
import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in sorted(os.listdir(DIR)):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return c


def _rows(pdf):
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, bool | str):
            return v
        if hasattr(v, "isoformat"):
            return "NaT" if str(v) == "NaT" else str(v)
        return round(float(v), 6) if not isinstance(v, list) else str(v)

    pdf = pdf[sorted(pdf.columns)]
    return sorted(repr(tuple(plain(v) for v in row)) for row in pdf.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, DIR)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
    else:
        ours, theirs = df.toPandas(), con.sql(sql).df()
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert _rows(ours) == _rows(theirs)


def _all(spark, *names):
    return [entry.queries()[n](spark, DIR).toPandas() for n in names]


def test_record_queries_agree_with_each_other(spark, con):
    """What the queries without SQL must have in common, over whole tables."""
    found, rows, kinds, ours = _all(spark, "p1_found", "p1_rows", "p1_kinds", "p2_found")
    assert len(found) == kinds["n_rows"].sum() == (rows["node"] != "$").sum() and set(found["parent_node"]) - {"$"} <= set(found["node"])
    prints, routes, table = _all(spark, "p2_fingerprints", "p2_routes", "p2_consistent")
    count = lambda q: con.sql(q).fetchall()[0][0]
    assert len(table) == count("SELECT count(DISTINCT infer_id) FROM schema_inferences") and len(routes) == count("SELECT count(*) FROM (SELECT DISTINCT feed, file_no FROM schema_inferences WHERE feed IS NOT NULL AND file_no IS NOT NULL)")
    assert len(prints) == routes["fingerprint"].notna().sum() and not ours.duplicated().any() and set(ours["change"]) <= {"added", "removed", "renamed", "type_changed"}
    last = routes.sort_values("file_no").groupby("feed").tail(1)
    assert all(len(s) == 0 for s in last["steps"])
    stamps, status = _all(spark, "p3_found", "p3_status")
    assert status["n"].sum() == count("SELECT count(DISTINCT mention_id) FROM entity_dates") and len(stamps) == status[status["status"].isin(["date", "instant"])]["n"].sum() and stamps["mention_id"].is_unique
    cents, units = _all(spark, "p4_found", "p4_units")
    assert len(cents) == units["n"].sum() and cents["brl_cents"].sum() == sum(map(int, units["brl_cents"])) and cents["money_id"].is_unique


def test_documents_agree_with_their_parts(spark):
    docs, tree, chunk = _all(spark, "hybrid_json", "section_tree", "chunk_sections")
    full = [json.loads(j) for j in docs["json"]]
    assert sum(len(d["content"]["sections"]) for d in full if d["content"]["sections"]) == len(tree) and sum(len(d["chunks"]) for d in full if d["chunks"]) == len(chunk)
    assert sorted(c["text"] for d in full for c in d["chunks"] or []) == sorted(chunk["text"]) and sorted(s["content"] for d in full for s in d["content"]["sections"] or []) == sorted(tree["content"])


def test_flagship(spark):
    assert entry.entry(spark).limit(1).count() == 1
