"""Where the JSON of a text is, and JSON that stands as text inside JSON: the one reader of all record operators."""

import json
import re

_BRACKET = re.compile(rb"[{}\[\]]")
_SPAN = re.compile(rb'"(?:[^"\\]|\\.)*"|[{}\[\]]', re.S)
# How JSON can go on after an opening bracket, at the end of a cut text too.
_PLAUSIBLE = re.compile(rb'\{\s*(?:\}|$|"(?:[^"\\]|\\.)*(?:"\s*(?::|$)|$))|\[\s*(?:$|[\]{\["]|-?\d|(?:null|true|false)\b)', re.S)
_CLOSES = {ord("{"): ord("}"), ord("["): ord("]")}


def loads(raw: bytes | str):
    """The value of a JSON text; raises ValueError for all that is none, also if it is nested too deeply."""
    try:
        return json.loads(raw)
    except RecursionError as e:
        raise ValueError("nested too deeply") from e


def holds_object(value) -> bool:
    """Whether a value is an object or has one at any depth."""
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            return True
        if isinstance(x, list):
            todo += x
    return False


def _closing(text: bytes, begin: int) -> int:
    """Where the bracket at begin is closed, strings skipped; -1 if it isn't, or by the wrong kind."""
    stack: list[int] = []
    for m in _SPAN.finditer(text, begin):
        c = text[m.start()]
        if c in _CLOSES:
            stack.append(_CLOSES[c])
        elif c != 34:
            if stack.pop() != c:
                return -1
            if not stack:
                return m.start()
    return -1


def _pairs(text: bytes) -> dict[int, int]:
    """Opening to closing brackets of a text that need not be JSON, strings not skipped."""
    stack: list[int] = []
    out: dict[int, int] = {}
    for m in _BRACKET.finditer(text):
        c = text[m.start()]
        if c in _CLOSES:
            stack.append(m.start())
        elif stack and _CLOSES[text[stack[-1]]] == c:
            out[stack.pop()] = m.start()
    return out


def locate(text: bytes) -> tuple[int, int] | None:
    """First and last byte of the JSON in a text; what stands around it is ignored.

    The first readable container that holds an object, else the first readable one. A bracket that no JSON can begin
    with is passed over, together with what it encloses. JSON that is never closed ends the search: the text was cut, and
    parts of it count for nothing; neither do the insides of a container that cannot be read. Linear in the text."""
    pairs: dict[int, int] | None = None
    plain: tuple[int, int] | None = None
    at = 0
    while (m := re.compile(rb"[{\[]").search(text, at)) is not None:
        begin = m.start()
        if _PLAUSIBLE.match(text, begin):
            end = _closing(text, begin)
            if end < 0:
                break
            try:
                value = loads(text[begin : end + 1])
                if holds_object(value):
                    return begin, end
                plain = plain or (begin, end)
            except ValueError:
                pass
            at = end + 1
        else:
            pairs = _pairs(text) if pairs is None else pairs
            at = pairs.get(begin, begin) + 1
    return plain


def embedded(raw: bytes) -> str | None:
    """The JSON container that a JSON string literal holds as text, also when it was encoded more than once."""
    try:
        value = loads(raw)
        while isinstance(value, str):
            inner = value.strip()
            if inner[:1] not in ('"', "{", "["):
                return None
            if inner[0] != '"':
                return inner if isinstance(loads(inner), dict | list) else None
            value = loads(inner)
    except ValueError:
        pass
    return None


def unwrap(value):
    """A string that holds a JSON object or array counts as that."""
    if isinstance(value, str) and value.lstrip()[:1] in ("{", "[", '"'):
        inner = embedded(json.dumps(value).encode())
        return value if inner is None else loads(inner)
    return value


def read(raw: bytes | None):
    """The JSON value of a text, a string that holds JSON read on; None if the text is null, blank or unreadable."""
    if not raw:
        return None
    try:
        return unwrap(loads(raw.decode("utf-8", "replace")))
    except ValueError:
        span = locate(raw)
        return None if span is None else loads(raw[span[0] : span[1] + 1])
