"""Structural index over a batch of JSON texts.

All texts of a batch lie in one byte buffer. Quote, escape, bracket and delimiter positions come from whole-buffer
comparisons; the parity of the quotes before a position tells whether it is inside a string; prefix sums of +1 for an
opening and -1 for a closing bracket give the nesting depth; a sort by (text, depth, position) puts every token next
to the container it belongs to. No text is walked character by character in Python.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

OPEN_OBJ, CLOSE_OBJ, OPEN_ARR, CLOSE_ARR, COMMA, COLON = map(ord, "{}[],:")
QUOTE, BACKSLASH = ord('"'), ord("\\")

_STRUCTURAL = np.zeros(256, bool)
_STRUCTURAL[[OPEN_OBJ, CLOSE_OBJ, OPEN_ARR, CLOSE_ARR, COMMA, COLON]] = True
_DELTA = np.zeros(256, np.int32)
_DELTA[[OPEN_OBJ, OPEN_ARR]] = 1
_DELTA[[CLOSE_OBJ, CLOSE_ARR]] = -1


@dataclass
class Index:
    """What was found. Containers are in order of their position.

    text, start, end: the text a container is in, its first and last byte in the buffer.
    is_array; parent: row of the enclosing container or -1; ordinal: commas before it in an enclosing array.
    key_start, key_end: bytes of its key in an enclosing object, else -1.
    member_*: one row per member of an object whose value is no container: container, key bytes, value bytes.
    item_*: one row per scalar element of an array: container, ordinal, value bytes.
    closed: for each text, whether a root container was opened and closed with matching brackets.
    """

    buffer: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    is_array: np.ndarray
    parent: np.ndarray
    ordinal: np.ndarray
    key_start: np.ndarray
    key_end: np.ndarray
    member_of: np.ndarray
    member_key: np.ndarray
    member_value: np.ndarray
    item_of: np.ndarray
    item_ordinal: np.ndarray
    item_value: np.ndarray
    closed: np.ndarray
    root_start: np.ndarray
    root_end: np.ndarray


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; nulls count as empty."""
    a = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if a.null_count:
        a = a.fill_null(b"")
    _, offs, data = a.buffers()
    o = np.frombuffer(offs, np.int64)[a.offset : a.offset + len(a) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def _unescaped_quotes(b: np.ndarray) -> np.ndarray:
    """Positions of quotes that no odd run of backslashes precedes."""
    q, s = np.flatnonzero(b == QUOTE), np.flatnonzero(b == BACKSLASH)
    if not len(s) or not len(q):
        return q
    first = np.concatenate(([True], np.diff(s) > 1))
    begins = s[first][np.cumsum(first) - 1]
    at = np.searchsorted(s, q) - 1
    touching = (at >= 0) & (s[at] == q - 1)
    run = np.where(touching, q - begins[at], 0)
    return q[run % 2 == 0]


def build(texts: pa.Array) -> Index:
    """Index a batch. Each text is read from its first opening bracket to where that one is closed; the rest of the
    text is ignored. A text without brackets, or cut before the end, is not closed and has no containers."""
    b, offs = buffers(texts)
    n = len(offs) - 1
    lows, highs = offs[:-1], offs[1:]
    opening = np.flatnonzero((b == OPEN_OBJ) | (b == OPEN_ARR))
    at = np.searchsorted(opening, lows)
    has = at < len(opening)
    begin = np.where(has, opening[np.minimum(at, max(len(opening) - 1, 0))] if len(opening) else highs, highs)
    begin = np.minimum(begin, highs)

    quotes = _unescaped_quotes(b)
    token = np.flatnonzero(_STRUCTURAL[b]) if len(b) else np.zeros(0, np.int64)
    row = np.searchsorted(offs, token, "right") - 1
    inside = np.searchsorted(quotes, token) - np.searchsorted(quotes, begin)[row] if len(token) else token
    keep = (token >= begin[row]) & (inside % 2 == 0) if len(token) else np.zeros(0, bool)
    token, row = token[keep], row[keep]
    kind = b[token]

    # Depth after each token, counted from the begin of its text.
    delta = _DELTA[kind]
    total = np.cumsum(delta)
    first = np.searchsorted(row, np.arange(n))
    base = np.concatenate(([0], total))[first]
    depth = total - base[row]
    # The root ends where the depth first comes back to 0; later tokens are no part of it.
    zero = np.flatnonzero(depth == 0)
    zrow = row[zero]
    zfirst = np.searchsorted(zrow, np.arange(n))
    ends = np.full(n, -1, np.int64)
    ok = (zfirst < len(zero)) & (np.append(zrow, -1)[np.minimum(zfirst, len(zrow))] == np.arange(n))
    ends[ok] = zero[zfirst[ok]]
    closed = ok & (begin < highs)
    keep = closed[row] & (np.arange(len(token)) <= ends[row]) if len(token) else np.zeros(0, bool)
    token, row, kind, depth, delta = token[keep], row[keep], kind[keep], depth[keep], delta[keep]

    # Level of the container a token belongs to; opening and closing brackets belong to their own.
    level = depth + (delta < 0)
    width = np.int64(level.max() + 2 if len(level) else 2)
    order = np.argsort(row * width + level, kind="stable")
    opens = delta[order] > 0
    owner = np.cumsum(opens) - 1  # in order of (text, level, position)
    o_token = token[order][opens]
    rank = np.argsort(o_token, kind="stable")  # to order of position
    where = np.empty(len(rank), np.int64)
    where[rank] = np.arange(len(rank))
    own = np.empty(len(token), np.int64)
    own[order] = where[owner] if len(owner) else owner  # of each token, in order of position

    is_open, is_close = delta > 0, delta < 0
    c_pos = np.flatnonzero(is_open)
    c_row, c_start = row[c_pos], token[c_pos]
    c_array = kind[c_pos] == OPEN_ARR
    c_end = np.full(len(c_pos), -1, np.int64)
    c_end[own[is_close]] = token[is_close]
    wrong = kind[is_close] != np.where(c_array[own[is_close]], CLOSE_ARR, CLOSE_OBJ)
    if wrong.any():
        closed[row[is_close][wrong]] = False

    # Parent: the owner, one level up, of the same place. Look the place up among the tokens of that level.
    big = np.int64(len(b) + 1)
    keys = (row[order] * width + level[order]) * big + token[order]
    look = (c_row * width + level[c_pos] - 1) * big + c_start
    spot = np.searchsorted(keys, look) - 1
    rooted = level[c_pos] == 1
    parent = np.where(rooted, -1, where[owner[spot]] if len(owner) else -1)
    commas = np.cumsum(kind[order] == COMMA)
    at_open = np.empty(len(c_pos), np.int64)
    at_open[where] = commas[opens] if len(opens) else commas
    ordinal = np.where(rooted, 0, (commas[spot] if len(commas) else 0) - at_open[parent])

    def key_of(colon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(quotes, colon)
        return quotes[np.maximum(k - 2, 0)] + 1, quotes[np.maximum(k - 1, 0)]

    key_start, key_end = np.full(len(c_pos), -1, np.int64), np.full(len(c_pos), -1, np.int64)
    before = np.maximum(c_pos - 1, 0)
    keyed = ~rooted & (kind[before] == COLON)
    if len(quotes):
        key_start[keyed], key_end[keyed] = key_of(token[before[keyed]])

    # Scalars: what lies between a colon (or an array's bracket or comma) and the next comma or closing bracket.
    nxt = np.minimum(np.arange(len(token)) + 1, max(len(token) - 1, 0))
    bare = (kind == COLON) & ~is_open[nxt]
    m = np.flatnonzero(bare)
    mk = np.stack(key_of(token[m]), 1) if len(m) and len(quotes) else np.zeros((0, 2), np.int64)
    mv = np.stack((token[m] + 1, token[nxt[m]]), 1) if len(m) else np.zeros((0, 2), np.int64)
    in_array = c_array[own] if len(own) else np.zeros(0, bool)
    e = np.flatnonzero(in_array & ((kind == COMMA) | is_open) & ~is_open[nxt] & (own[nxt] == own)) if len(own) else np.zeros(0, np.int64)
    e_ord = np.zeros(len(e), np.int64)
    if len(e):
        run = np.empty(len(token), np.int64)
        run[order] = commas
        e_ord = run[e] - at_open[own[e]]
    ev = np.stack((token[e] + 1, token[nxt[e]]), 1) if len(e) else np.zeros((0, 2), np.int64)

    root_end = np.full(n, -1, np.int64)
    roots = np.flatnonzero(rooted)
    root_end[c_row[roots]] = c_end[roots]
    return Index(b, c_row, c_start, c_end, c_array, parent, ordinal, key_start, key_end, own[m] if len(m) else m, mk, mv, own[e] if len(e) else e, e_ord, ev, closed, begin, root_end)
