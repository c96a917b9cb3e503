"""What the text queries without SQL must hold of the whole tables."""

import itertools
import os

import duckdb
import pytest

from folioflow.llm import chunking, pii, queries, tokenizer

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR) or not os.path.exists(tokenizer.FOLDER), reason="no test tables or vocabulary")


def _got(spark, *names):
    return [queries.QUERIES[n](spark, DIR).toPandas() for n in names]


def test_pieces_cover_their_chunks_with_the_wanted_overlap(spark):
    found, pieces = _got(spark, "p6_found", "p6_pieces")
    sql = f"SELECT DISTINCT c.doc_id, c.chunk_index, c.text, coalesce(r.chunk_size, 500), coalesce(r.chunk_overlap, 50) FROM '{DIR}/chunks.parquet' c LEFT JOIN (SELECT DISTINCT request_id, chunk_size, chunk_overlap FROM '{DIR}/conversion_requests.parquet') r USING (request_id)"
    source = {(d, n): rest for d, n, *rest in duckdb.sql(sql).fetchall()}
    groups = {k: g.sort_values("piece") for k, g in pieces.groupby(["doc_id", "chunk_index"])}
    assert set(groups) == set(map(tuple, found.itertuples(index=False))) and len(groups) > 5
    for key, g in groups.items():
        text, size, overlap = source[key]
        spans = [(a - 1, a - 1 + len(t)) for a, t in zip(g["start_pos"], g["text"])]
        assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(text[a:z] == t and (z - a) // 4 <= size for (a, z), t in zip(spans, g["text"]))
        assert {(z - a) // 4 for (_, z), (a, _) in itertools.pairwise(spans)} <= {min(overlap, size - 1)} and chunking.cut(text, size, overlap) == spans


def test_masks_have_the_found_items(spark):
    found, masked = _got(spark, "p7_found", "p7_masked")
    text = {(r.src, r.doc_id, r.item_no): r.text or "" for r in masked.itertuples()}
    marks = sum(t.count(f"[{k.upper()}]") for t in text.values() for k in ("email", "phone", "id_number", "address", "name"))
    assert marks == len(found) > 0 and all(pii.mask(t) == t or "[" in t for t in list(text.values())[:50])


def test_ids_decode_to_the_texts_and_containers_hold_them(spark):
    ids, sizes, parts, boxes = _got(spark, "p8_ids", "p8_sizes", "p9_pack", "p9_containers")
    text = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{DIR}/documents.parquet'").fetchall())
    tokens = tokenizer.encoder().tokens
    assert {r.doc_id: b"".join(tokens[i] for i in r.ids).decode() for r in ids.itertuples()} == text
    n = {r.doc_id: len(r.ids) for r in ids.itertuples()}
    assert n == dict(zip(sizes["doc_id"], sizes["n_tokens"])) == parts.groupby("doc_id")["n_tokens"].sum().to_dict()
    assert boxes["used"].max() <= 1024 and boxes["used"].sum() == sum(n.values()) and boxes["n_parts"].sum() == len(parts) and len(boxes) <= sum(n.values()) / 1024 * 1.05 + 1


def test_shares_of_cut_texts_and_repaired_pages(spark):
    found, sources, lines, paras = _got(spark, "p10_found", "p10_sources", "p5_found", "p5_paragraphs")
    assert sources["n_cut"].sum() == len(found) == found["doc_id"].nunique() and sources["n_texts"].sum() == len(duckdb.sql(f"SELECT doc_id FROM '{DIR}/documents.parquet'").fetchall())
    assert not lines.duplicated().any() and set(lines["kind"]) <= {"furniture", "hyphen", "misread"} and paras["text"].str.strip().ne("").all()
