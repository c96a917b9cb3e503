"""Cutting oversized texts at topic boundaries, with overlap.

The text is cut into units (sentences, lines, clauses, words). Around every end of a unit two blocks of text are
compared by their words; where their cohesion drops into a valley, a topic ends. Each piece ends at the deepest valley
that its size window allows and the next one begins so far before it that both share the wanted number of tokens.

A token is four code points, rounded down over a text, as everywhere in this engine.
"""

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The project's defaults for a request that names no size or overlap.
SIZE, OVERLAP = 500, 50
#: Units on each side of a gap that are compared, and dimensions of their hashed word counts.
BLOCK, DIMENSIONS = 4, 64
#: A piece is at least this share of the limit, unless it is the last.
LEAST = 0.5

# Ends of units, strongest first, and how much a valley there is raised.
_ENDS = (
    (re.compile(r"\n[ \t]*\n\s*"), 0.3),
    (re.compile(r"[.!?…][\"”»')\]]*\s+(?=[^a-zß-öø-ÿ])|[。！？]"), 0.2),
    (re.compile(r"\n[ \t]*"), 0.1),
    (re.compile(r"[;:,]\s+"), 0.0),
    (re.compile(r"\s+"), -0.1),
)
_WORD = re.compile(r"\w{3,}")


def tokens(text: str) -> int:
    return len(text) // 4


def _gaps(text: str, level: int) -> np.ndarray:
    return np.array([m.end() for m in _ENDS[level][0].finditer(text) if m.end() < len(text)], np.int64)


class _Cohesion:
    """Depth of the valley at places of a text, from hashed word counts of its stretches."""

    def __init__(self, text: str, ends: np.ndarray):
        self.ends = ends
        bounds = np.concatenate(([0], ends, [len(text)]))
        counts = np.zeros((len(bounds) - 1, DIMENSIONS))
        words = [(m.start(), zlib.crc32(m.group().lower()[:6].encode()) % DIMENSIONS) for m in _WORD.finditer(text)]
        if words:
            at = np.array(words)
            np.add.at(counts, (np.searchsorted(bounds, at[:, 0], "right") - 1, at[:, 1]), 1)
        total = np.vstack((np.zeros(DIMENSIONS), np.cumsum(counts, 0)))
        n = len(bounds) - 1
        k = np.arange(1, n)
        left = total[k] - total[np.maximum(k - BLOCK, 0)]
        right = total[np.minimum(k + BLOCK, n)] - total[k]
        norm = np.linalg.norm(left, axis=1) * np.linalg.norm(right, axis=1)
        similar = np.where(norm > 0, (left * right).sum(1) / np.where(norm > 0, norm, 1), 0.0)
        # Depth: how far the similarity rises to the nearest peak on either side.
        self.depth = np.zeros(len(ends))
        for way in (slice(None), slice(None, None, -1)):
            s = similar[way].tolist()
            rise, peak, last = [], 0.0, None
            for x in s:
                if last is None or x > last:  # uphill: the peak on this side is here
                    peak = x
                rise.append(peak - x)
                last = x
            rise = np.array(rise)
            self.depth += rise[way]


def cut(text: str, size: int | None = None, overlap: int | None = None) -> list[tuple[int, int]]:
    """Pieces (start, end) that cover the text in order, each of at most `size` tokens.

    Consecutive pieces share `overlap` tokens exactly (from a word's start if one lies within those code points); an
    overlap of the size or more is lowered to a token less than the size, else no piece could advance. Null takes the
    defaults; a size below 1 counts as 1. A text within the limit, the empty one too, is one piece."""
    size = max(1, SIZE if size is None else size)
    overlap = min(max(0, OVERLAP if overlap is None else overlap), size - 1)
    n, longest = len(text), size * 4 + 3
    if n <= longest:
        return [(0, n)]
    levels = [_gaps(text, k) for k in range(len(_ENDS))]
    sentence = np.unique(np.concatenate(levels[:3]))
    cohesion = _Cohesion(text, sentence)
    raised = np.full(len(sentence), 0.0)
    for k in (2, 1, 0):
        raised[np.isin(sentence, levels[k])] = _ENDS[k][1]
    value = cohesion.depth + raised
    out, start = [], 0
    while n - start > longest:
        low, high = start + max(int(longest * LEAST), overlap * 4 + 4), start + longest
        a, z = np.searchsorted(sentence, [low, high + 1])
        if a < z:
            end = int(sentence[a + int(np.argmax(value[a:z]))])
        else:
            end = high
            for gaps in levels[3:]:
                a, z = np.searchsorted(gaps, [low, high + 1])
                if a < z:
                    end = int(gaps[z - 1])
                    break
        out.append((start, end))
        start = end
        if overlap:
            start = end - overlap * 4
            for back in range(4):  # the same number of tokens with up to three code points more
                at = end - overlap * 4 - back
                if at <= 0 or text[at - 1].isspace() and not text[at].isspace():
                    start = at
                    break
    out.append((start, n))
    return out


def pieces(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """The pieces of every chunk larger than its request's chunk_size: doc_id, chunk_index, piece, start_pos (code point
    from 1), text, token_count.

    chunks: doc_id, chunk_index, request_id, text; requests: request_id, chunk_size, chunk_overlap; other columns are
    ignored. Null limits, or a request that isn't there, mean the defaults. Chunks within the limit, null and empty
    texts give none. Repeated rows count once. Keys and lengths alone meet the requests, so a request with a third of all
    chunks moves some bytes a chunk; the texts that are too long are fetched by their own key, which no request skews.
    Texts that fit the smallest limit of all requests never move."""
    limits = requests.select("request_id", F.coalesce("chunk_size", F.lit(SIZE)).alias("size"), F.coalesce("chunk_overlap", F.lit(OVERLAP)).alias("overlap")).where("request_id is not null").dropDuplicates(["request_id"])
    least = requests.agg(F.least(F.min("chunk_size"), F.lit(SIZE)).alias("least")).scalar()
    size = F.floor(F.length("text") / 4)
    long = chunks.select("doc_id", "chunk_index", "request_id", "text", size.alias("tokens")).where(size > least)
    told = long.select("doc_id", "chunk_index", "request_id", "tokens").join(limits, "request_id", "left").fillna({"size": SIZE, "overlap": OVERLAP}).where(F.col("tokens") > F.col("size"))
    told = told.groupBy(F.col("doc_id").alias("_doc"), F.col("chunk_index").alias("_no")).agg(F.min_by(F.struct("size", "overlap"), F.struct("size", "overlap")).alias("limit"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("chunk_index").eqNullSafe(F.col("_no"))
    over = long.join(told, same).dropDuplicates(["doc_id", "chunk_index"]).select("doc_id", "chunk_index", "text", "limit.size", "limit.overlap")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, no, starts, texts, counts = [], [], [], [], []
            cols = {name: batch.column(name) for name in batch.schema.names}
            for i, (text, limit, lap) in enumerate(zip(*[cols[c].to_pylist() for c in ("text", "size", "overlap")])):
                for k, (a, z) in enumerate(cut(text, limit, lap)):
                    at.append(i)
                    no.append(k)
                    starts.append(a + 1)
                    texts.append(text[a:z])
                    counts.append(tokens(text[a:z]))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [cols["doc_id"].take(take), cols["chunk_index"].take(take), pa.array(no, pa.int32()), pa.array(starts, pa.int32()), pa.array(texts, pa.string()), pa.array(counts, pa.int32())],
                names=["doc_id", "chunk_index", "piece", "start_pos", "text", "token_count"],
            )

    return over.mapInArrow(rows, "doc_id string, chunk_index int, piece int, start_pos int, text string, token_count int")
