"""Schemas that drift between the files of a feed.

Every file gets a profile of its fields (types, place among the siblings, sketches of the values). Profiles of
consecutive files are compared; what differs is a change. The changes of a feed, chained, are its migration steps:
they route every record to one consistent table with the names and types of the feed's last file.
"""

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..functions.jsontext import read as read_root
from ..functions.jsontext import unwrap
from ..plans.runtime import checkpointed

TYPES = ("number", "string", "boolean", "object", "array")
#: Slots of the sketch of a field's values and of their shapes; a slot keeps the least hash that falls into it.
SLOTS, SHAPES = 16, 4
#: Least score of a pair of a removed and an added field to be one renamed field.
RENAME_SCORE = 0.55

_PYTHON = {bool: 2, int: 0, float: 0, str: 1, dict: 3, list: 4}


class _Field:
    __slots__ = ("n", "seen", "types", "pos", "logs", "ints", "slots")

    def __init__(self):
        self.n = self.seen = self.ints = 0
        self.types, self.pos, self.logs, self.slots = [0] * 5, 0, 0.0, {}

    def put(self, value: bytes, at: int, width: int) -> None:
        h = xxh64_intdigest(value) >> 1
        k = at + h % width
        if h < self.slots.get(k, 1 << 63):
            self.slots[k] = h

    def add(self, value, pos: int) -> None:
        self.seen += 1
        self.pos += pos
        if value is None:
            return
        self.n += 1
        kind = _PYTHON[type(value)]
        self.types[kind] += 1
        if kind == 0:
            self.ints += isinstance(value, int)
            self.logs += math.log10(abs(value) + 1)
        elif kind == 1:
            self.text(value)
        elif kind == 3:
            for k in value:
                self.put(k.encode(), 0, SLOTS)
        elif kind == 4:
            for x in value:
                if isinstance(x, dict):
                    for k in x:
                        self.put(k.encode(), 0, SLOTS)
                elif isinstance(x, str):
                    self.text(x)
                elif x is not None:
                    self.put(str(x).encode(), 0, SLOTS)

    def text(self, value: str) -> None:
        self.put(value.encode(), 0, SLOTS)
        self.put(re.sub(r"[^\W\d]+", "a", re.sub(r"\d+", "0", value)).encode() if len(value) < 200 else b"long", SLOTS, SHAPES)


def _profile(fields: dict[str, _Field], record: dict) -> None:
    for pos, (name, value) in enumerate(record.items()):
        value = unwrap(value)
        if name not in fields:
            fields[name] = _Field()
        fields[name].add(value, pos)
        inner = [value] if isinstance(value, dict) else value if isinstance(value, list) else ()
        prefix = f"{name}." if isinstance(value, dict) else f"{name}[]."
        for x in inner:
            x = unwrap(x)
            if isinstance(x, dict):
                for p, (k, v) in enumerate(x.items()):
                    path = prefix + k
                    if path not in fields:
                        fields[path] = _Field()
                    fields[path].add(unwrap(v), p)


def profiles(df: DataFrame) -> DataFrame:
    """One row per feed, file_no and field of its readable records, fields of nested objects included one level deep.

    Records count once however often they are repeated. Built per batch and merged by sums and minima, so a feed or file
    that holds a third of all rows is pre-aggregated before anything is shuffled."""
    sums = ["seen", "n", *TYPES, "pos", "logs", "ints"]
    mins = [f"m{i}" for i in range(SLOTS + SHAPES)]
    schema = "feed string, file_no int, field string, seen bigint, n bigint, " + ", ".join(f"`{t}` bigint" for t in TYPES) + ", pos bigint, logs double, ints bigint, " + ", ".join(f"{m} bigint" for m in mins)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict = {}
            for feed, file_no, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                record = read_root(raw)
                if isinstance(record, dict):
                    _profile(found.setdefault((feed, file_no), {}), record)
            out = [(feed, no, name, f.seen, f.n, *f.types, f.pos, f.logs, f.ints, *[f.slots.get(i) for i in range(len(mins))]) for (feed, no), fields in found.items() for name, f in fields.items()]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["feed", "file_no", "field", *sums, *mins]).convert_dtypes(), schema=_arrow(sums, mins), preserve_index=False)

    once = df.select("infer_id", "feed", "file_no", "fields").where("infer_id is not null").dropDuplicates(["infer_id"]).select("feed", "file_no", "fields")
    partial = once.mapInArrow(rows, schema)
    return partial.groupBy("feed", "file_no", "field").agg(*[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in mins])


def _arrow(sums: list[str], mins: list[str]) -> pa.Schema:
    kinds = {"logs": pa.float64()}
    return pa.schema([("feed", pa.string()), ("file_no", pa.int32()), ("field", pa.string()), *[(c, kinds.get(c, pa.int64())) for c in [*sums, *mins]]])


# Comparison of two profiles: each a dict of field to its row. ---------------------------------------------------------


def _kind(row) -> str:
    return max(TYPES, key=lambda t: (row[t], -TYPES.index(t)))


def _parent(field: str) -> str:
    return field.rpartition(".")[0]


def _words(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def name_similarity(a: str, b: str) -> float:
    """1 for the same words; high if one is made of the other by adding words, or by leaving out letters."""
    a, b = _words(a), _words(b)
    wa, wb = set(a.split("_")), set(b.split("_"))
    if wa == wb:
        return 1.0
    best = len(wa & wb) / len(wa | wb)
    if wa < wb or wb < wa:
        best = max(best, 0.9)
    short, long = sorted((a.replace("_", ""), b.replace("_", "")), key=len)
    if len(short) >= 2 and short[0] == long[0]:
        it = iter(long)
        if all(c in it for c in short):
            same = next((i for i, (x, y) in enumerate(zip(short, long)) if x != y), len(short))
            best = max(best, 0.8 if same >= len(short) - 1 else 0.4)
    return best


def _overlap(r, a, slots: range) -> float | None:
    x = [(r[f"m{i}"], a[f"m{i}"]) for i in slots]
    x = [(p, q) for p, q in x if not (pd.isna(p) and pd.isna(q))]
    if not any(not pd.isna(p) for p, _ in x) or not any(not pd.isna(q) for _, q in x):
        return None
    # Of the values of the smaller sketch, the share that the other has; few records show few values.
    least = min(sum(not pd.isna(p) for p, _ in x), sum(not pd.isna(q) for _, q in x))
    return sum(p == q for p, q in x) / least


def value_similarity(kind: str, r, a) -> float:
    if kind == "boolean":
        return 0.5
    if kind == "number":
        far = abs(r["logs"] / r["number"] - a["logs"] / a["number"])
        whole = abs(r["ints"] / r["number"] - a["ints"] / a["number"])
        return max(0.0, 0.8 - far) * (1 - whole)
    same = _overlap(r, a, range(SLOTS))
    if kind == "string":
        shape = _overlap(r, a, range(SLOTS, SLOTS + SHAPES)) or 0.0
        return max(same or 0.0, 0.5 * shape) * 0.9 + 0.1 * (same or 0.0) if shape else 0.0
    return 0.5 if same is None else same


def compare(old: dict, new: dict) -> list[tuple[str, str, str]]:
    """Changes (change, field, new_field) from one file's fields to the next one's. Fields below a reported one are
    left out; a field that goes on under another name is one case."""
    out: list[tuple[str, str, str]] = []
    old = {k: v for k, v in old.items() if v["n"]}
    new = {k: v for k, v in new.items() if v["n"]}
    # A child's parent must be there, unreported, on both sides.
    tops = {k for k in old if "." not in k} | {k for k in new if "." not in k}
    changed = set(_scope(out, {k: v for k, v in old.items() if k in tops}, {k: v for k, v in new.items() if k in tops}))
    for parent in sorted({_parent(k) for k in (*old, *new)} - {""}):
        if parent.removesuffix("[]") in changed:
            continue
        inside = lambda d, p=parent: {k: v for k, v in d.items() if _parent(k) == p}
        _scope(out, inside(old), inside(new))
    return out


def _scope(out: list, old: dict, new: dict) -> list[str]:
    place = lambda row: row["pos"] / row["seen"]
    common = [k for k in old if k in new]
    for k in common:
        if _kind(old[k]) != _kind(new[k]):
            out.append(("type_changed", k, ""))
    changed = [o[1] for o in out if o[1] in common]
    gone, come = [k for k in old if k not in new], [k for k in new if k not in old]
    pairs = []
    if gone and come:
        slot = lambda d, k: sum(place(d[c]) < place(d[k]) for c in common)
        before = {k: slot(old, k) for k in gone}
        after = {k: slot(new, k) for k in come}
        for g in gone:
            for c in come:
                kind = _kind(old[g])
                if kind != _kind(new[c]):
                    continue
                name = name_similarity(g.rpartition(".")[2], c.rpartition(".")[2])
                value = value_similarity(kind, old[g], new[c])
                apart = abs(before[g] - after[c]) / max(1, min(4, len(common)))
                if value <= 0 and kind in ("string", "number") and name < 0.5:
                    continue
                score = 0.5 * name + 0.5 * value + 0.4 * (1 - min(1.0, 2 * apart)) - 0.3 * min(1.0, apart)
                if score >= RENAME_SCORE:
                    pairs.append((score, g, c))
    used: set[str] = set()
    for _, g, c in sorted(pairs, reverse=True):
        if ("-", g) not in used and ("+", c) not in used:
            used |= {("-", g), ("+", c)}
            out.append(("renamed", g, c))
            changed += [g, c]
    for k in gone:
        if ("-", k) not in used:
            out.append(("removed", k, ""))
            changed.append(k)
    for k in come:
        if ("+", k) not in used:
            out.append(("added", k, ""))
            changed.append(k)
    return changed


def file_pairs(df: DataFrame) -> DataFrame:
    """Each file of a feed with the one before it: feed, file_no, prev. Only distinct file numbers are sorted."""
    files = df.select("feed", "file_no").where("feed is not null and file_no is not null").distinct()
    return files.withColumn("prev", F.lag("file_no").over(W.partitionBy("feed").orderBy("file_no"))).where("prev is not null")


def changes(df: DataFrame, profiled: DataFrame | None = None) -> DataFrame:
    """Every difference between a file and the previous file of its feed: feed, file_no, change (`added`, `removed`,
    `renamed`, `type_changed`), field, new_field (empty unless renamed).

    A field is there if any readable record has it with a non-null value; its type is the most frequent one. Rows
    without infer_id, feed or file_no belong to no file and are left out; repeated rows count once; files without a readable
    record have no fields. Extra columns are ignored. An empty table gives an empty table. profiled: the profiles, where
    they are at hand."""
    # Each profile goes to its own comparison (side 1) and to the next file's (side 0); it is built only once.
    goes = F.explode(F.array(F.struct(F.col("file_no").alias("own"), F.col("file_no").alias("to"), F.lit(1).alias("side")), F.struct(F.col("prev").alias("own"), F.col("file_no").alias("to"), F.lit(0).alias("side")))).alias("g")
    routes = file_pairs(df).select("feed", goes).select("feed", F.col("g.own").alias("file_no"), "g.to", "g.side")
    both = (profiles(df) if profiled is None else profiled).join(routes, ["feed", "file_no"]).drop("file_no").withColumnRenamed("to", "file_no")
    both = both.repartition("feed", "file_no").sortWithinPartitions("feed", "file_no")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, at = [], None

        def close():
            old = {r["field"]: r for r in held if r["side"] == 0}
            new = {r["field"]: r for r in held if r["side"] == 1}
            return [(*at, *c) for c in compare(old, new)]

        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                if (r["feed"], r["file_no"]) != at:
                    if held:
                        out += close()
                    held, at = [], (r["feed"], r["file_no"])
                held.append(r)
            yield pd.DataFrame(out, columns=["feed", "file_no", "change", "field", "new_field"])
        if held:
            yield pd.DataFrame(close(), columns=["feed", "file_no", "change", "field", "new_field"])

    return both.mapInPandas(rows, "feed string, file_no int, change string, field string, new_field string")


def _main_type() -> Column:
    """The most frequent type of a profile's field."""
    return F.greatest(*[F.struct(F.col(t).alias("n"), F.lit(-i).alias("o"), F.lit(t).alias("t")) for i, t in enumerate(TYPES)])["t"]


def fingerprints(df: DataFrame, profiled: DataFrame | None = None) -> DataFrame:
    """A version per file: feed, file_no, n_fields and fingerprint, a hash of its sorted fields and types. The same
    fingerprint means the same schema, whatever schema_version says."""
    line = F.concat_ws(":", "field", _main_type())
    rows = (profiles(df) if profiled is None else profiled).where("n > 0")
    return rows.groupBy("feed", "file_no").agg(F.count("*").alias("n_fields"), F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(line))), 256).alias("fingerprint"))


def _current(prints: DataFrame) -> DataFrame:
    """feed, file_no, current: whether a file's fingerprint is that of its feed's last file, so that no step applies."""
    last = prints.groupBy("feed").agg(F.max_by("fingerprint", "file_no").alias("last"))
    return prints.join(last, "feed").select("feed", "file_no", (F.col("fingerprint") == F.col("last")).alias("current"))


def routes(df: DataFrame) -> DataFrame:
    """The way of each file to the feed's last schema: feed, file_no, fingerprint (null without readable records), current
    (its fingerprint is the last file's, so no step applies), steps (file_no, change, field, new_field: all later ones, in
    order) and collisions (last names in which several of the file's fields meet).

    One row per file; only the feed's change log and the file's field names are gathered, never records."""
    profiled = checkpointed(profiles(df))
    prints = fingerprints(df, profiled)
    log = migrations(changes(df, profiled))
    names = profiled.where("n > 0").groupBy("feed", "file_no").agg(F.array_sort(F.collect_list("field")).alias("names"))
    files = df.select("feed", "file_no").where("feed is not null and file_no is not null").distinct()
    rows = files.join(prints, ["feed", "file_no"], "left").join(_current(prints), ["feed", "file_no"], "left").join(names, ["feed", "file_no"], "left").join(log, "feed", "left")
    later = F.filter("log", lambda x: x["file_no"] > F.col("file_no"))
    rows = rows.select("feed", "file_no", "fingerprint", F.coalesce("current", F.lit(False)).alias("current"), F.coalesce(F.when(F.col("current"), F.slice("log", 1, 0)).otherwise(later), F.slice("log", 1, 0), F.from_json(F.lit("[]"), log.schema["log"].dataType)).alias("steps"), "names")

    def met(steps: pd.Series, names: pd.Series) -> pd.Series:
        out = []
        for log, own in zip(steps, names):
            renames = [(s["file_no"], _plain(s["field"]), _plain(s["new_field"])) for s in log if s["change"] == "renamed"]
            to = Counter(apply_steps(renames, -1, _plain(n)) for n in (own if own is not None else ()))
            out.append(sorted(k for k, n in to.items() if n > 1))
        return pd.Series(out)

    return rows.withColumn("collisions", F.pandas_udf(met, "array<string>")("steps", "names")).drop("names")


def migrations(changed: DataFrame) -> DataFrame:
    """Chained steps: for each feed its `log` of file_no, change, field and new_field, in the order of its files.

    Only a feed's change log is gathered, never its records."""
    return changed.groupBy("feed").agg(F.array_sort(F.collect_list(F.struct("file_no", "change", "field", "new_field"))).alias("log"))


def apply_steps(log: list, file_no: int, path: str) -> str:
    """Follow a path through all renames later than its file. A rename of `a` moves `a.b` and `a[].b` too."""
    for no, old, new in log:
        if no > file_no and (path == old or path.startswith((old + ".", old + "[]"))):
            path = new + path[len(old) :]
    return path


class _Steps:
    """What a feed's steps do to the records of one of its files. Paths are without [], so a list and a single object,
    which turn into each other, have the same."""

    def __init__(self, log: list, fields: list, file_no: int, current: bool = False):
        renames = [(s["file_no"], _plain(s["field"]), _plain(s["new_field"])) for s in log if s["change"] == "renamed"]
        # A file with the last fingerprint has the last names: what was renamed since was renamed back.
        self.renames = [] if current else [r for r in renames if r[0] > file_no]
        self.first = min((s["file_no"] for s in log if s["file_no"] > file_no), default=None)
        last: dict[str, tuple[int, str]] = {}
        for f in fields:
            to = apply_steps(renames, f["file_no"], _plain(f["field"]))
            last[to] = max(last.get(to, (-1, "")), (f["file_no"], f["kind"]))
        self.kinds = {path: kind for path, (_, kind) in last.items()}
        self.members: dict[str, list[str]] = {}
        for path in sorted(last):
            self.members.setdefault(_parent(path), []).append(path.rpartition(".")[2])

    def record(self, record: dict) -> dict[str, str | None]:
        return {k: _cast(v, self.kinds.get(k)) for k, v in self.members_of(record, "", "").items()}

    def members_of(self, value: dict, path: str, to: str) -> dict:
        """An object at `path`, which the steps move to `to`, with its members' last names and types; members that only
        other files have are null."""
        out: dict = {}
        begin, end = (f"{path}.", f"{to}.") if path else ("", "")
        for name, inner in value.items():
            moved = apply_steps(self.renames, -1, begin + name)
            key = name if moved == end + name else moved.rpartition(".")[2]
            inner = self.moved(unwrap(inner), begin + name, end + key)
            if out.get(key) is None:
                out[key] = inner
        return out | {k: None for k in self.members.get(to, ()) if k not in out}

    def moved(self, value, path: str, to: str):
        if to in self.members:  # else no step goes below
            if isinstance(value, dict):
                value = self.members_of(value, path, to)
            elif isinstance(value, list):
                value = [self.members_of(x, path, to) if isinstance(x, dict) else x for x in map(unwrap, value)]
        return _typed(value, self.kinds.get(to)) if "." in to else value


def _plain(path: str) -> str:
    return path.replace("[].", ".")


def consistent(df: DataFrame) -> DataFrame:
    """One table over all files: infer_id, feed, file_no, schema_from (the file's first step that applies, else null)
    and `fields`, a map of the last name of each top-level field to its value as text.

    Every step of the feed after a record's file applies to it, also to members of objects and of objects in arrays, as
    deep as changes() looks. Renamed: the last name. Added and removed: every record has every field of its feed, null
    where its file has none, for the tables declare no other default; what was removed is kept. Type changed: numbers
    written as text, with a decimal comma too, become plain numbers, yes and no in words booleans, a single value a
    list, other values text, as the feed's last type wants; what cannot be cast stays.

    Records that cannot be read keep a row with null fields. Repeated rows count once."""
    profiled = checkpointed(profiles(df))
    log = migrations(changes(df, profiled))
    last = profiled.where("n > 0").groupBy("feed", "field").agg(F.max_by(_main_type(), "file_no").alias("kind"), F.max("file_no").alias("file_no"))
    kinds = last.groupBy("feed").agg(F.collect_list(F.struct("field", "kind", "file_no")).alias("kinds"))
    current = _current(fingerprints(df, profiled))
    once = df.select("infer_id", "feed", "file_no", "fields").where("infer_id is not null").dropDuplicates(["infer_id"])
    joined = once.join(log.join(kinds, "feed", "full"), "feed", "left").join(current, ["feed", "file_no"], "left").select("infer_id", "feed", "file_no", "fields", "log", "kinds", F.coalesce("current", F.lit(False)).alias("current"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict = {"infer_id": [], "feed": [], "file_no": [], "schema_from": [], "fields": []}
            steps: dict = {}
            ids, feeds, files, texts = [batch.column(i).to_pylist() for i in range(4)]
            for i, at in enumerate(zip(feeds, files)):
                if at not in steps:
                    log, kinds = [[x for x in batch.column(k)[i].as_py() or [] if x["file_no"] is not None] for k in (4, 5)]
                    steps[at] = _Steps(log, kinds, at[1] if at[1] is not None else 1 << 30, batch.column(6)[i].as_py())
                record = read_root(texts[i].encode() if texts[i] else None)
                values = steps[at].record(record) if isinstance(record, dict) else None
                for k, v in (("infer_id", ids[i]), ("feed", at[0]), ("file_no", at[1]), ("schema_from", steps[at].first), ("fields", None if values is None else list(values.items()))):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("infer_id", pa.int64()), ("feed", pa.string()), ("file_no", pa.int32()), ("schema_from", pa.int32()), ("fields", pa.map_(pa.string(), pa.string()))]))

    return joined.mapInArrow(rows, "infer_id bigint, feed string, file_no int, schema_from int, fields map<string,string>")


_YES, _NO = {"sim", "true", "yes", "s", "y"}, {"não", "nao", "false", "no", "n"}


def _cast(value, kind: str | None) -> str | None:
    if value is None:
        return None
    if kind == "array" and not isinstance(value, list):
        value = [value]
    if isinstance(value, str):
        low = value.strip().lower()
        if kind == "number" and re.fullmatch(r"-?[\d.]*,\d+|-?\d+(\.\d+)?", low):
            return low.replace(".", "").replace(",", ".") if "," in low else low
        if kind == "boolean" and low in _YES | _NO:
            return str(low in _YES).lower()
        return value
    if isinstance(value, bool):
        return str(value).lower()
    return json.dumps(value, ensure_ascii=False) if isinstance(value, dict | list) else str(value)


def _typed(value, kind: str | None):
    """A member's value in its last type, as _cast() gives it in text."""
    if value is None or kind in (None, "object"):
        return value
    if kind == "array":
        return value if isinstance(value, list) else [value]
    if kind == "string":
        return value if isinstance(value, str) else _cast(value, kind)
    if isinstance(value, str):
        text = _cast(value, kind)
        if kind == "boolean" and text in ("true", "false"):
            return text == "true"
        if kind == "number" and re.fullmatch(r"-?\d{1,300}(\.\d+)?", text.strip()):
            return float(text) if "." in text else int(text)
    return value
