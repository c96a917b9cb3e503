"""Filling containers of a fixed capacity with items of varying length.

Only the histogram of lengths is packed: combinations of a few lengths that fill a container up to a small window are
enumerated, non-negative least squares tells how often to repeat each so that together they use up the histogram, the
rounded counts are taken, and what is left is filled greedily. The plan, some thousand rows whatever the corpus, then
places every item by its rank among the items of its length.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.runtime import checkpointed

#: Tokens a container holds. Bounds the histogram that reaches the driver.
CAPACITY = 1024
#: A combination may leave this share of the capacity unused.
WINDOW = 0.01
#: Items that are ranked in one group; a more frequent length is ranked in as many groups as it needs.
GROUP = 500_000
#: Combinations offered for each length and number of times it leads, spread over all second lengths that fit; and steps
#: of the least squares.
KEPT, STEPS = 40, 400

Plan = list[tuple[tuple[tuple[int, int], ...], int]]  # ((length, times), ...), repeats


def combinations(counts: np.ndarray, capacity: int, window: int) -> list[tuple[tuple[int, int], ...]]:
    """Up to three different lengths, each some times, that fill capacity less at most window."""
    lengths = np.flatnonzero(counts)
    have = counts > 0
    out: dict[tuple, None] = {}
    for a in lengths.tolist():
        most = min(capacity // a, int(counts[a]))
        for k in sorted({most, max(1, most // 2), max(1, most // 3), 1, 2, 3}, reverse=True):
            if k > most:
                continue
            rest = capacity - k * a
            if rest <= window:
                out[((a, k),)] = None
                continue
            b = lengths[(lengths < a) & (lengths <= rest)]
            times = np.minimum(rest // b, counts[b])
            left = rest - times * b
            third = (left > window) & have[left] & (left != a) & (left != b)
            fit = np.flatnonzero((left <= window) | third)
            if len(fit) > KEPT:
                fit = fit[np.linspace(0, len(fit) - 1, KEPT).astype(int)]
            for x, m, r, more in zip(b[fit].tolist(), times[fit].tolist(), left[fit].tolist(), third[fit].tolist()):
                out[((a, k), (x, m), (r, 1)) if more else ((a, k), (x, m))] = None
    return list(out)


def nnls(columns: list[tuple[tuple[int, int], ...]], target: np.ndarray) -> np.ndarray:
    """x >= 0 that brings the columns' sum near target, by projected accelerated gradient; scaled by the counts, so
    that rare lengths count too."""
    rows = np.array([length for c in columns for length, _ in c])
    value = np.array([k for c in columns for _, k in c], float)
    owner = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    weight = 1 / np.sqrt(np.maximum(target, 1.0))
    value = value * weight[rows]
    goal = target * weight
    n, m = len(columns), len(target)
    norm = np.bincount(owner, value**2, n)
    scale = 1 / np.sqrt(norm)  # columns of length one
    value = value * scale[owner]
    x = y = np.zeros(n)
    v = np.random.default_rng(0).random(n)
    for _ in range(20):  # the largest eigenvalue, by powers
        v = np.bincount(owner, value * np.bincount(rows, value * v[owner], m)[rows], n)
        size = np.linalg.norm(v)
        v = v / size
    step, t = 1 / (1.05 * size), 1.0
    for _ in range(STEPS):
        gradient = np.bincount(owner, value * (np.bincount(rows, value * y[owner], m) - goal)[rows], n)
        new = np.maximum(0.0, y - step * gradient)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x * scale


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """counts[length] items of each length 1..capacity to containers; uses every item exactly once."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    out: Plan = []
    columns = combinations(left, capacity, max(1, int(capacity * WINDOW)))
    if columns:
        x = nnls(columns, left.astype(float))
        for j in np.argsort(-x, kind="stable").tolist():
            repeats = int(round(x[j]))
            if repeats < 1:
                break
            repeats = min([repeats, *[int(left[length]) // k for length, k in columns[j]]])
            if repeats:
                for length, k in columns[j]:
                    left[length] -= k * repeats
                out.append((columns[j], repeats))
    # The rest: the longest item first, then always the longest that still fits; equal containers all at once.
    lengths = np.flatnonzero(left).tolist()
    while lengths:
        room, used = capacity, []
        for length in reversed(lengths):
            k = min(room // length, int(left[length]))
            if k:
                # The first length opens the container, as often as it is alone in it; others fill up.
                used.append((length, k))
                room -= k * length
            if room < lengths[0]:
                break
        repeats = max(1, min(int(left[length]) // k for length, k in used))
        for length, k in used:
            left[length] -= k * repeats
        out.append((tuple(used), repeats))
        lengths = [length for length in lengths if left[length]]
    return out


def place(found: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The plan as sorted intervals: keys (length << 40 | first rank), times in a container, first container; and the
    number of containers."""
    keys, times, firsts = [], [], []
    next_rank: dict[int, int] = {}
    base = 0
    for used, repeats in found:
        for length, k in used:
            r = next_rank.get(length, 0)
            keys.append((length << 40) | r)
            times.append(k)
            firsts.append(base)
            next_rank[length] = r + k * repeats
        base += repeats
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return np.array(keys, np.int64)[order], np.array(times, np.int64)[order], np.array(firsts, np.int64)[order], base


def pack(items: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """One row per part of an item: key, part, start (tokens before the part), n_tokens, container.

    items: key and size; other columns are ignored. Only an item beyond the capacity is split, into parts of the full
    capacity and a last one that is packed like any other. Items without tokens (size 0 or null) take no room and are
    spread over the containers. Items with the same key are different items. Containers are numbered from 0 without
    gaps. An empty table gives an empty table.

    The sizes are written once. The driver gets capacity + 1 counts and then one count for each group of ranks (one more
    for every GROUP items); the plan goes back to the tasks. Which of several items of one length goes where depends on
    how the input is partitioned."""
    sized = items.select(F.col(key).alias("key"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("size"))
    start = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("size") - 1) / capacity)).cast("int"))).alias("part")
    parts = sized.select("key", "size", start).select("key", "part", F.least(F.lit(capacity), F.col("size") - F.col("part") * F.lit(capacity).cast("bigint")).cast("int").alias("length"))
    # Numbered before it is written: rows with one key, or none, still part into groups.
    parts = checkpointed(parts.withColumn("id", F.monotonically_increasing_id()))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in parts.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most capacity + 1 rows
        counts[length] = n
    groups = np.maximum(1, -(-counts // GROUP))
    many = F.get(F.array(*[F.lit(int(g)) for g in groups]), F.col("length")) if groups.max() > 1 else F.lit(1)
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("id"), many).cast("int"))
    first = np.concatenate(([0], np.cumsum(groups)))
    before = np.zeros(int(first[-1]), np.int64)
    if groups.max() > 1:
        held = np.zeros(len(before), np.int64)
        for length, s, n in salted.groupBy("length", "salt").agg(F.count("*").alias("n")).collect():  # a row per group
            held[first[length] + s] = n
        for a, z in zip(first[:-1], first[1:]):
            before[a:z] = np.cumsum(held[a:z]) - held[a:z]
    keys, times, firsts, total = place(plan(counts, capacity))
    ranked = salted.withColumn("rank", F.row_number().over(W.partitionBy("length", "salt").orderBy("id")) - 1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, part, length, s, rank = (batch.column(i) for i in range(5))
            n, r = length.to_numpy(), rank.to_numpy().astype(np.int64)
            r = r + before[first[n] + s.to_numpy()]
            full = n > 0
            at = np.maximum(np.searchsorted(keys, (n.astype(np.int64) << 40) | r, "right") - 1, 0)
            box = r % max(1, total)
            if len(keys):
                box = np.where(full, firsts[at] + (r - (keys[at] & ((1 << 40) - 1))) // times[at], box)
            begin = part.to_numpy().astype(np.int64) * capacity
            yield pa.RecordBatch.from_arrays([name, part, pa.array(begin), length, pa.array(box, pa.int64())], names=[key, "part", "start", "n_tokens", "container"])

    kind = items.schema[key].dataType.simpleString()
    return ranked.select("key", "part", "length", "salt", "rank").mapInArrow(rows, f"`{key}` {kind}, part int, start bigint, n_tokens int, container bigint")
