"""Deeply nested records to linked flat rows.

A batch of JSON texts goes through the structural index (quote, bracket and delimiter bitmaps, depth by prefix sums,
spans) and leaves as rows that name their parent. JSON text inside strings is decoded and indexed in a further round,
as if it stood there nested.
"""

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import structindex
from ..functions.jsontext import embedded, loads, locate

#: Texts a call of the index takes at once, in bytes; bounds the memory of a task, not the result.
BATCH_BYTES = 8 << 20

def _readable(raw: bytes) -> bool:
    try:
        loads(raw)
        return True
    except ValueError:
        return False


class _Rows:
    """Rows of one batch: where each container is and what encloses it, over all rounds."""

    def __init__(self, attributes: bool):
        self.attributes = attributes
        self.src: list[int] = []
        self.node: list[str] = []
        self.parent: list[str] = []
        self.attrs: list[list[tuple[str, str | None]]] = []

    def round(self, texts: list, src: list[int], prefix: list[str], above: list[str], element: list[bool]) -> tuple:
        """Index texts; returns the arguments of the next round. prefix: path of the place the text stands in; above:
        nearest enclosing case; element: whether the place is an array's."""
        ix = structindex.build(pa.array(texts, pa.large_binary()))
        buf = ix.buffer.tobytes()
        starts, ends = ix.root_start.tolist(), ix.root_end.tolist()
        offs = [0]
        for t in texts:
            offs.append(offs[-1] + len(t or b""))
        good = [ok and _readable(buf[a : z + 1]) for ok, a, z in zip(ix.closed.tolist(), starts, ends)]
        nxt: tuple = ([], [], [], [], [])

        def later(text: str, s: int, path: str, case: str, el: bool) -> None:
            for part, x in zip(nxt, (text.encode(), s, path, case, el)):
                part.append(x)

        objects = np.bincount(ix.text[~ix.is_array], minlength=len(texts)) if len(ix.text) else np.zeros(len(texts), int)
        for i in np.flatnonzero(~np.array(good, bool) | (objects == 0)).tolist():
            t = texts[i]
            if not t:
                continue
            if not good[i] and t.lstrip()[:1] == b'"' and (inner := embedded(t)) is not None:  # one string literal around JSON
                later(inner, src[i], prefix[i], above[i], element[i])
            elif (span := locate(t)) is not None and span[1] - span[0] + 1 < len(t) and (not good[i] or span != (starts[i] - offs[i], ends[i] - offs[i])):
                # The first bracket is not where the JSON begins.
                good[i] = False
                later(t[span[0] : span[1] + 1].decode("utf-8", "replace"), src[i], prefix[i], above[i], element[i])
        names: dict[tuple[int, int], str] = {}
        decoded: dict[bytes, str] = {}

        def key(a: int, z: int) -> str:
            raw = buf[a:z]
            if (name := decoded.get(raw)) is None:
                name = decoded[raw] = json.loads(b'"' + raw + b'"') if b"\\" in raw else raw.decode()
            return name

        path: list[str] = []
        case: list[str] = []
        slot: dict[int, int] = {}
        rows = zip(ix.text.tolist(), ix.is_array.tolist(), ix.parent.tolist(), ix.ordinal.tolist(), ix.key_start.tolist(), ix.key_end.tolist())
        arrays = ix.is_array.tolist()
        for c, (t, is_array, parent, ordinal, ks, ke) in enumerate(rows):
            if not good[t]:
                path.append("")
                case.append("")
                continue
            if parent < 0:
                p, up, el = prefix[t], above[t], element[t]
            else:
                el = arrays[parent]
                up = case[parent]
                if el:
                    p = f"{path[parent]}[{ordinal}]"
                else:
                    base = path[parent]
                    p = f"{base}.{key(ks, ke)}" if base else key(ks, ke)
            path.append(p)
            if is_array:
                case.append(up)
                continue
            if el or (self.attributes and parent < 0 and not p):
                slot[c] = len(self.node)
                self.src.append(src[t])
                self.node.append(p or "$")
                self.parent.append(up)
                if self.attributes:
                    self.attrs.append([])
            case.append(p if el else up)
        # Members and items that hold JSON as text; with attributes also the other scalars.
        text_of = ix.text.tolist()
        for o, (ka, kz), (va, vz) in zip(ix.member_of.tolist(), ix.member_key.tolist(), ix.member_value.tolist()):
            if not good[text_of[o]]:
                continue
            raw = buf[va:vz].strip()
            if raw[:1] == b'"' and raw[1:2] in (b"{", b"[", b"\\", b" ") and (inner := embedded(raw)) is not None:
                base = path[o]
                later(inner, src[text_of[o]], f"{base}.{key(ka, kz)}" if base else key(ka, kz), case[o], False)
            elif self.attributes:
                self._attribute(slot, ix, path, o, key(ka, kz), raw)
        for o, ordinal, (va, vz) in zip(ix.item_of.tolist(), ix.item_ordinal.tolist(), ix.item_value.tolist()):
            if not good[text_of[o]]:
                continue
            raw = buf[va:vz].strip()
            if raw[:1] == b'"' and raw[1:2] in (b"{", b"[", b"\\", b" ") and (inner := embedded(raw)) is not None:
                later(inner, src[text_of[o]], f"{path[o]}[{ordinal}]", case[o], True)
            elif self.attributes and raw:
                self._attribute(slot, ix, path, o, f"[{ordinal}]", raw)
        return nxt

    def _attribute(self, slot: dict, ix, path: list[str], o: int, name: str, raw: bytes) -> None:
        """A scalar belongs to the nearest object that has a row; plain objects and arrays between lend their keys."""
        at = o
        while at >= 0 and at not in slot:
            at = int(ix.parent[at])
        if at < 0:
            return
        own = path[at]
        below = path[o][len(own) :].lstrip(".")
        full = f"{below}{'' if name[:1] == '[' or not below else '.'}{name}"
        value = None if raw == b"null" else json.loads(raw) if raw[:1] == b'"' else raw.decode()
        self.attrs[slot[at]].append((full, value))


def link(texts: list[bytes | None], attributes: bool = False) -> _Rows:
    out = _Rows(attributes)
    n = len(texts)
    todo = (texts, list(range(n)), [""] * n, ["$"] * n, [False] * n)
    while todo[0]:
        todo = out.round(*todo)
    return out


def _pieces(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most BATCH_BYTES of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    begin = held = 0
    for i, s in enumerate(sizes):
        if held + s > BATCH_BYTES and i > begin:
            yield begin, i
            begin, held = i, 0
        held += s
    if begin < len(sizes):
        yield begin, len(sizes)


def linked_rows(df: DataFrame, key: str = "infer_id", text: str = "fields", attributes: bool = False) -> DataFrame:
    """One row per object that is an element of an array, at any depth of the JSON in `text`.

    Columns: the key, `node` (path with array positions), `parent_node` (nearest enclosing such object, else `$`) and
    `kind` (the path with `[]` for every position: one flat table per kind). With attributes also the root object as
    `$` and `attrs`, a map of the scalars that belong to the row's object, their paths relative to it.

    Null, blank, cut or otherwise unreadable texts give no rows. Text around the JSON is ignored, with brackets in it too
    (see functions/jsontext.py); JSON text inside a
    string counts as nested in place. Rows with a repeated key are read once (a key's texts are the same), rows without
    key not at all; of a member given twice in one object the last counts for attributes. Other
    columns of df are dropped first, so their names cannot clash. An empty table gives an empty table.
    """
    once = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null").dropDuplicates(["key"])
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, node string, parent_node string" + (", attrs map<string,string>" if attributes else "")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for a, z in _pieces(texts):
                out = link(texts.slice(a, z - a).cast(pa.binary()).to_pylist(), attributes)
                cols = [keys.slice(a, z - a).take(pa.array(out.src, pa.int64())), pa.array(out.node, pa.string()), pa.array(out.parent, pa.string())]
                names = [key, "node", "parent_node"]
                if attributes:
                    last = [list(dict(x).items()) for x in out.attrs]  # of a member given twice the last counts
                    cols.append(pa.array(last, pa.map_(pa.string(), pa.string())))
                    names.append("attrs")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    found = once.mapInArrow(rows, schema)
    return found.withColumn("kind", F.regexp_replace("node", r"\[\d+\]", "[]"))


def flat_table(rows: DataFrame, kind: str, columns: list[str], key: str = "infer_id") -> DataFrame:
    """The flat table of one kind: key, node, parent_node and the named attributes as columns (null where absent)."""
    picked = rows.where(F.col("kind") == kind)
    return picked.select(key, "node", "parent_node", *[F.col("attrs")[c].alias(c) for c in columns])
