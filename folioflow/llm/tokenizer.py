"""Byte-pair encoding with a public vocabulary.

Texts are cut into pre-tokens. The distinct ones of a batch are looked up all at once in a minimal perfect hash of the
vocabulary; those that are no token are merged pair by pair, with a heap over linked bytes.
"""

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

#: Where the vocabulary files are, unless the caller says so.
FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: how this family of vocabularies cuts a text.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Merged pre-tokens that a worker keeps; a bound of memory, beyond it they are merged anew.
CACHE = 200_000


def load(path: str) -> list[bytes]:
    """Tokens by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def _mix(x: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    x = x ^ (np.uint64(0x9E3779B97F4A7C15) * (np.asarray(seed).astype(np.uint64) + np.uint64(1)))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(texts: pa.Array) -> np.ndarray:
    """A 64-bit polynomial hash of each text's bytes, all at once."""
    from ..functions.structindex import buffers

    b, offs = buffers(texts)
    n = len(b)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(min(n, int(np.diff(offs).max(initial=0))) + 1, 0x100000001B3, np.uint64)) if n else np.zeros(1, np.uint64)
        length = np.diff(offs)
        place = np.arange(n) - np.repeat(offs[:-1], length)
        term = (b.astype(np.uint64) + np.uint64(1)) * power[place] if n else np.zeros(0, np.uint64)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)))
        return _mix(total[offs[1:]] - total[offs[:-1]], 7) + length.astype(np.uint64)


class PerfectHash:
    """A minimal perfect hash of byte strings: each bucket has a seed that sends its keys to free slots."""

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        self.keys = pa.array(keys, pa.large_binary())
        prints = fingerprints(self.keys)
        if len(np.unique(prints)) != self.n:
            raise ValueError("two keys share a fingerprint")
        self.buckets = max(1, self.n // 3)
        with np.errstate(over="ignore"):
            bucket = (prints % np.uint64(self.buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            size = np.bincount(bucket, minlength=self.buckets)
            begin = np.concatenate(([0], np.cumsum(size)))
            self.seed = np.zeros(self.buckets, np.int32)
            self.slot = np.full(self.n, -1, np.int64)
            free = np.ones(self.n, bool)
            for k in np.argsort(-size, kind="stable"):
                own = order[begin[k] : begin[k + 1]]
                if not len(own):
                    break
                seed = 0
                while True:
                    tries = np.arange(seed, seed + 64)
                    spots = (_mix(prints[own][None, :], tries[:, None]) % np.uint64(self.n)).astype(np.int64)
                    good = free[spots].all(1)
                    if len(own) > 1:
                        s = np.sort(spots, 1)
                        good &= (np.diff(s, axis=1) > 0).all(1)
                    if good.any():
                        hit = int(np.argmax(good))
                        self.seed[k] = tries[hit]
                        free[spots[hit]] = False
                        self.slot[spots[hit]] = own
                        break
                    seed += 64

    def find(self, texts: pa.Array) -> np.ndarray:
        """The index of each text among the keys, -1 for others."""
        if not self.n or not len(texts):
            return np.full(len(texts), -1, np.int64)
        with np.errstate(over="ignore"):
            p = fingerprints(texts)
            spot = (_mix(p, self.seed[(p % np.uint64(self.buckets)).astype(np.int64)]) % np.uint64(self.n)).astype(np.int64)
        at = self.slot[spot]
        # The print picks the only key that it can be; the bytes decide.
        same = pc.equal(self.keys.take(pa.array(at)), texts.cast(pa.large_binary())).fill_null(False).to_numpy(zero_copy_only=False)
        return np.where(same, at, -1)


class Encoder:
    def __init__(self, tokens: list[bytes], pattern: str = PATTERN):
        self.tokens = tokens
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.hash = PerfectHash(tokens)
        self.cut = regex.compile(pattern)
        self.cache: dict[bytes, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Pairs of least rank first, leftmost of equals, until no pair is a token."""
        if (known := self.cache.get(piece)) is not None:
            return known
        n = len(piece)
        part = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap: list[tuple[int, int, bytes]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                both = part[i] + part[j]
                if (rank := self.ranks.get(both)) is not None:
                    heapq.heappush(heap, (rank, i, both))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or part[i] + part[after[i]] != both:
                continue
            j = after[i]
            alive[j] = False
            part[i] = both
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out = [self.ranks[part[i]] for i in range(n) if alive[i]]
        if len(self.cache) < CACHE:
            self.cache[piece] = out
        return out

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's begin; nulls have none."""
        code: dict[str, int] = {}
        stream: list[int] = []
        begin = [0]
        for t in texts:
            if t:
                stream += [code.setdefault(p, len(code)) for p in self.cut.findall(t)]
            begin.append(len(stream))
        words = [p.encode("utf-8", "replace") for p in code]
        found = self.hash.find(pa.array(words, pa.large_binary()))
        lists = [None] * len(words)
        for i in np.flatnonzero(found < 0).tolist():
            lists[i] = self.merge(words[i])
        width = np.array([1 if x is None else len(x) for x in lists], np.int64)
        flat = np.concatenate([np.array([f] if x is None else x, np.int32) for f, x in zip(found.tolist(), lists)]) if words else np.zeros(0, np.int32)
        first = np.concatenate(([0], np.cumsum(width)))
        s = np.array(stream, np.int64)
        w = width[s] if len(s) else s
        ends = np.concatenate(([0], np.cumsum(w)))
        offset = np.arange(int(ends[-1])) - np.repeat(ends[:-1], w) + np.repeat(first[s], w) if len(s) else s
        return flat[offset] if len(s) else np.zeros(0, np.int32), ends[np.array(begin)]


@lru_cache(maxsize=4)
def encoder(folder: str = FOLDER, vocabulary: str = VOCABULARY) -> Encoder:
    """One per worker process. Executors without the vocabulary's folder read the copy that SparkContext.addFile() gave them."""
    path = os.path.join(folder, vocabulary)
    return Encoder(load(path if os.path.exists(path) else SparkFiles.get(vocabulary)))


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """key and `ids`, the token ids of the text without special tokens; an empty list for empty and null texts.

    One row out per row in, in place: no shuffle. Strings of special tokens are ordinary text. Columns other than key
    and text are dropped, so clashing names do not matter."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(folder, vocabulary)
        for batch in batches:
            ids, begin = e.batch(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids, pa.int32()))], names=[key, "ids"])

    return df.select(key, text).mapInArrow(rows, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def sizes(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """key and `n_tokens`, 0 for empty and null texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(folder, vocabulary)
        for batch in batches:
            _, begin = e.batch(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(begin), pa.int32())], names=[key, "n_tokens"])

    return df.select(key, text).mapInArrow(rows, f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens int")
