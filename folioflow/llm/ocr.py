"""Repair of text from scanned pages: page furniture, words broken across lines, misread characters.

The corpus is its own dictionary. Words that are rare beside a much more frequent neighbour are looked up by walking a
Levenshtein automaton through the trie of the frequent words, so no candidate within reach is missed; what the neighbour
differs in must be a known misreading. Lines that recur at the edges of a file's pages are furniture.
"""

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import checkpointed

#: Least uses of a word of the trie, and how many times as frequent as a misreading of it it must be.
WORD_USES, RATIO = 5, 12
#: Words and templates of furniture that every task holds, the most frequent ones; what a page may have of the others
#: is fetched for it by a join.
SAFE_WORDS, TEMPLATES = 50_000, 5_000
#: Files that must repeat a line at the edges of their pages for it to be a template apart from its numbers, and their
#: least share of the files that have it at an edge.
TEMPLATE_FILES, TEMPLATE_SHARE = 3, 0.3
#: Non-blank lines at the top and the bottom of a page that can be furniture.
TOP, BOTTOM = 2, 3

# What is read for what, beside marks and digits inside words.
CONFUSED = {
    "e": "c", "r": "i", "a": "@", "o": "0", "i": "!í1l", "t": "†", "s": "5", "l": "1i!", "v": "y", "g": "q9", "b": "6", "ã": "ä", "õ": "ö", "ó": "ò", "á": "à", "ê": "è", "é": "6è", "z": "2", "í": "lì", "u": "v", "n": "u", "h": "b", "c": "e", "y": "v", "q": "g", "f": "t", "ç": "c",
    "n ": "ri", "d ": "cl", "m ": "rn", "u ": "ii", "w ": "vv", "h ": "li", "rn": "m", "cl": "d", "ri": "n", "li": "h", "ii": "u", "vv": "w", "fi": "ﬁ", "fl": "ﬂ",
}
_MARKS = frozenset("-\u00ad\u2010\u2011\u00ac")
_HYPHENS = "-­‐‑¬"
_EDGE = r".,;:()\[\]{}\"“”«»?…•/|\x00"
_PARTS = ".,;:()[]{}\"“”«»?…•/|"
_BROKEN = re.compile(rf"[{_HYPHENS}][ \t]*\n\s*(?=[^\W\d_])")
_TAIL = re.compile(rf"[^\s{_EDGE}]*$")
_HEAD = re.compile(rf"\s*([^\s{_EDGE}]*[^\W\d_][^\s{_EDGE}]*)")
_ODD = re.compile(r"(?<=[^\W\d_])[0-9@!|$](?=[^\W\d_])|[†ﬁﬂ]")
_NUMBER_WORDS = r"(?:p[áàa]gina|p[áàa]g|page|folha|fls?|seite|p|pg)"
_PAGE_NO = re.compile(rf"(?:{_NUMBER_WORDS}\.? ?# ?(?:(?:de|of|von|/) ?#)?\.?|[-–—\[(] ?# ?[-–—\])]|#/#|# (?:de|of) #)\s*\.?", re.I)
_ROMAN = re.compile(r"(?=[ivxlcdm])(?:c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3}))", re.I)
# What looks alike becomes alike; a letter that is misread as two becomes those two.
_FOLD = str.maketrans({"0": "o", "1": "i", "!": "i", "l": "i", "|": "i", "r": "i", "@": "a", "†": "t", "5": "s", "c": "e", "$": "s", "6": "b", "y": "v", "q": "g", "2": "z", "n": "ii", "u": "ii", "h": "ii", "m": "iii", "d": "ei", "w": "vv"})


def _trim(token: str) -> str:
    return token.strip("'’*_~+=<>").rstrip("!-‐‑­¬'’")


def tokenise(lower: str) -> list[str]:
    """What stands between blanks and marks, untrimmed; words broken at line ends joined by a zero character."""
    t = _BROKEN.sub("\x00", lower)
    for mark in _PARTS:
        t = t.replace(mark, " ")
    return t.split()


def _left(line: str) -> str:
    """The part of a word before the hyphen that ends a line; empty if that is no letter."""
    head = line.rstrip()[:-1]
    if not head or not head[-1].isalpha():
        return ""
    last = head.rsplit(None, 1)[-1]
    return _TAIL.search(last).group()


def is_word(token: str) -> bool:
    return len(token) > 1 and not token.isdigit() and any(c.isalpha() for c in token)


@lru_cache(maxsize=100_000)
def skeleton(line: str) -> str:
    """A line with what misreading confuses made equal; numbers apart from words stay."""
    s = line.strip().lower()
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    s = re.sub(r"(?<![^\W\d_])\d+(?![^\W\d_])|[^\d]+", lambda m: m.group() if m.group()[0].isdigit() else m.group().translate(_FOLD), s)
    return re.sub(r"\s+", " ", s)


def _masked(line: str) -> str:
    return re.sub(r"(?<![^\W\d_])\d+(?![^\W\d_])", "#", line)


#: Words and characters that a part of a line of furniture has at most.
MOST_WORDS, MOST_CHARS = 12, 90


def furniture_like(s: str, last: bool = True) -> bool:
    """Whether a stripped part of a line could be furniture at all: short, and nothing in it ends or parts a sentence.
    last: whether the line ends with it; another part may end with a full stop or a hyphen."""
    if not s or len(s) > MOST_CHARS or ", " in s or "; " in s or ": " in s or "! " in s or "? " in s:
        return False
    end, before = s[-1], s[-2:-1]
    if end in (".,;:!?" if last else ",;:!?"):
        if before and before not in ". " and not before.isdigit():
            return False
    elif last and end in _MARKS and before.isalpha():
        return False
    at = s.find(". ")
    while at >= 0:  # an abbreviation before a number parts no sentence
        after = s[at + 2]
        if after != " " and not after.isdigit():
            return False
        at = s.find(". ", at + 1)
    return len(s.split()) <= MOST_WORDS


def segments(line: str) -> list[str]:
    return [s for s in re.split(r" {2,}|\t+", line.strip()) if s]


def furniture_parts(s: str) -> list[str]:
    """The parts of a stripped line at wide blanks; none if one of them could not be furniture."""
    parts = segments(s) if "  " in s or "\t" in s else [s]
    return parts if all(furniture_like(p, p is parts[-1]) for p in parts) else []


# ---------------------------------------------------------------------------------------- automaton and trie


class Trie:
    def __init__(self, words: dict[str, int]):
        self.words = words
        self.root: dict = {}
        for w in words:
            at = self.root
            for c in w:
                at = at.setdefault(c, {})
            at[""] = w

    def near(self, word: str) -> list[tuple[str, str, str]]:
        """Every word of the trie that one misreading away from `word`: (word, what it has, what `word` has instead).
        One misreading is any character for another, one too many or too few, or one for two and two for one of the
        fixed pairs. States of the automaton: characters read, and whether the one error was made."""
        n = len(word)
        out: list[tuple[str, str, str]] = []
        # (trie node, read, error or None, rest that the trie must still give before going on)
        stack: list[tuple[dict, int, tuple[str, str] | None, str]] = [(self.root, 0, None, "")]
        while stack:
            node, i, error, rest = stack.pop()
            if rest:
                if (nxt := node.get(rest[0])) is not None:
                    stack.append((nxt, i, error, rest[1:]))
                continue
            if error is not None:  # only the exact rest can follow
                at = node
                for c in word[i:]:
                    at = at.get(c)
                    if at is None:
                        break
                else:
                    if (w := at.get("")) is not None:
                        out.append((w, *error))
                continue
            if i < n and (nxt := node.get(word[i])) is not None:
                stack.append((nxt, i + 1, None, ""))
            for c, nxt in node.items():
                if not c:
                    continue
                if i < n and c != word[i]:
                    stack.append((nxt, i + 1, (c, word[i]), ""))
                stack.append((nxt, i, (c, ""), ""))
            if i < n:
                stack.append((node, i + 1, ("", word[i]), ""))
            for got, true in _TWO.get(word[i : i + 1], ()):
                if word.startswith(got, i):
                    stack.append((node, i + len(got), (true, got), true))
        return out


_TWO: dict[str, list[tuple[str, str]]] = {}
for _true, _got in CONFUSED.items():
    if len(_true) == 2:
        _TWO.setdefault(_got[0], []).append((_got, _true.strip()))


def misread(true: str, got: str) -> bool:
    """Whether `got` is a known misreading of `true`."""
    if len(true) == 1 and len(got) == 1:
        return got in CONFUSED.get(true, "") or got in "@!†|$" or got.isdigit()
    return CONFUSED.get(true if len(true) == 2 else true + " ") == got


def corrections(word: str, n: int, trie: Trie) -> list[tuple[str, int, bool]]:
    """All words that `word`, seen n times, may stand for, with their uses and whether the misreading is one of the fixed
    pairs and not just a digit or mark."""
    out = []
    for w, true, got in trie.near(word):
        if w != word and misread(true, got) and trie.words[w] >= (RATIO * n if got.isalpha() else n):
            out.append((w, trie.words[w], len(true) != 1 or len(got) != 1 or got in CONFUSED.get(true, "")))
    return out


# ---------------------------------------------------------------------------------------- what the corpus says


def statistics(pages: DataFrame) -> DataFrame:
    """Counts of one pass: kind `w` (a word of a line, in lower case), `j` (two parts of a broken word, joined by a zero
    character), `e` (a part of a line at a page's edge: key1 is its file, key2 its skeleton, n its pages) and `p` (pages
    of a file). Summed per batch first. pages: doc_id, page, raw_text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: Counter = Counter()
            edges: dict[tuple[str, str], list[int]] = {}
            for doc, page, text in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                words.update(tokenise(text.lower()))
                number = page or 0
                for line in _edges(text):
                    for s in furniture_parts(line):
                        seen = edges.setdefault((doc, _number_key(s, page) or skeleton(s)), [number, number])
                        seen[0], seen[1] = min(seen[0], number), max(seen[1], number)
            joined: Counter = Counter()
            for w, k in words.items():
                if not is_word(w):
                    continue
                joined["j" if "\x00" in w else "w", _trim(w)] += k
            every = [(kind, w, "", k, 0, 0) for (kind, w), k in joined.items()] + [("e", doc, k, 1, *seen) for (doc, k), seen in edges.items()]
            cols = list(zip(*every)) or [[]] * 6
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["kind", "key1", "key2", "n", "low", "high"])

    raw = pages.select("doc_id", "page", "raw_text").mapInArrow(rows, "kind string, key1 string, key2 string, n bigint, low int, high int")
    return raw.groupBy("kind", "key1", "key2").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def _edges(text: str) -> list[str]:
    """The first and last non-blank lines, stripped."""
    lines = text.split("\n")
    n, top, low = len(lines), [], []
    i = 0
    while i < n and len(top) < TOP:
        if s := lines[i].strip():
            top.append(s)
        i += 1
    j = n - 1
    while j >= i and len(low) < BOTTOM:
        if s := lines[j].strip():
            low.append(s)
        j -= 1
    return top + low


def _number_key(segment: str, page: int | None) -> str | None:
    """A bare number by how far it is from the page's own."""
    s = segment.strip()
    return f"#{int(s) - (page or 0)}" if s.isdigit() and len(s) < 5 else None


def furniture_keys(stats: DataFrame) -> DataFrame:
    """key1 (file), key2 (skeleton): what repeats at the edges of a file's pages. Ends of sentences do not count."""
    sentence = F.col("key2").rlike(r"[.,;:!?]$") & ~F.col("key2").rlike(r"#|^\W*\w{1,6}\W*\d")
    return stats.where("kind = 'e' and low < high").where(~sentence).select("key1", "key2")


def templates(stats: DataFrame) -> DataFrame:
    """Furniture apart from its numbers that several files share."""
    mask = F.regexp_replace("key2", r"(?<![\p{L}])\d+(?![\p{L}])", "#")
    edge = stats.where("kind = 'e'").where(~F.col("key2").startswith("#")).withColumn("mask", mask)
    by_file = edge.groupBy("mask", "key1").agg(F.bool_or(F.col("low") < F.col("high")).alias("again"))
    shared = by_file.groupBy("mask").agg(F.count_if("again").alias("files"), F.count("*").alias("all"))
    sentence = F.col("mask").rlike(r"[.,;:!?]$")
    return shared.where((F.col("files") >= TEMPLATE_FILES) & (F.col("files") >= TEMPLATE_SHARE * F.col("all")) & ~sentence & (F.length("mask") >= 4))


def _shared(word: str) -> Column:
    """Keys of which two words that are one misreading apart share at least one: how they begin or how they end. A
    misreading leaves all but two characters of the longer word at its ends, so one end keeps half of them."""
    c, n = F.col(word), F.length(word)
    ends = lambda k: F.array(F.concat(F.lit(f"{k}<"), F.substring(c, 1, k)), F.concat(F.lit(f"{k}>"), F.right(c, F.lit(k))))
    none = F.array().cast("array<string>")
    return F.concat(F.when(n <= 6, ends(1)).otherwise(none), F.when(n.between(6, 9), ends(2)).otherwise(none), F.when(n >= 9, ends(4)).otherwise(none))


def lexicon(stats: DataFrame) -> DataFrame:
    """word, correction (of the words it may stand for one by a fixed pair, of these the most used) and open (all of
    them, if there are several).

    Words that can be one misreading apart meet in a group by how they begin or end; each group has the trie of its own
    frequent words, which the automaton of every other word of the group walks. Nothing comes to the driver."""
    words = stats.where("kind in ('w', 'j')").select(F.regexp_replace("key1", "\x00", "").alias("word"), "kind", "n")
    words = words.groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("kind") == "w", F.col("n")).otherwise(0)).alias("whole"))
    good = (F.col("whole") >= WORD_USES) & F.col("word").rlike(r"^[\p{L}'’-]{3,40}$")
    suspect = F.length("word").between(3, 40) & F.col("word").rlike(r"\p{L}.*\p{L}")
    rows = words.withColumns({"good": good, "suspect": suspect}).where("good or suspect").select(F.explode(_shared("word")).alias("key"), "good", "word", "n", "whole", "suspect")
    rows = rows.repartition("key").sortWithinPartitions("key", F.desc("good"))
    found = rows.mapInArrow(_looking, "word string, correction string, uses bigint, fixed boolean").distinct()
    every = F.array_sort(F.collect_list(F.struct("fixed", "uses", "correction")))
    return found.groupBy("word").agg(F.max_by("correction", F.struct("fixed", "uses", "correction")).alias("correction"), every.alias("open")).withColumn("open", F.when(F.size("open") > 1, F.col("open")))


def _looking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks the trie of each group's frequent words, which come first in it."""
    at, vocabulary, waiting, trie, most = None, {}, [], None, 0
    for batch in batches:
        out: list[tuple] = []

        def look(word: str, n: int) -> None:
            if n * RATIO <= most or not word.isalpha():
                out.extend((word, *c) for c in corrections(word, n, trie))  # noqa: B023

        def close() -> None:
            nonlocal trie, most, waiting
            if trie is None:
                trie, most = Trie(vocabulary), max(vocabulary.values(), default=0)
                for w in waiting:
                    look(*w)
                waiting = []

        for key, good, word, n, whole, suspect in zip(*[batch.column(i).to_pylist() for i in range(6)]):
            if key != at:
                close()
                at, vocabulary, waiting, trie = key, {}, [], None
            if good:
                vocabulary[word] = whole
                if suspect:
                    waiting.append((word, n))
            elif vocabulary or trie is not None:
                close()
                look(word, n)
        yield _corrected(out)
    if waiting:
        trie, most = Trie(vocabulary), max(vocabulary.values(), default=0)
        yield _corrected([(w, *c) for w, n in waiting if n * RATIO <= most or not w.isalpha() for c in corrections(w, n, trie)])


def _corrected(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.bool_()))], names=["word", "correction", "uses", "fixed"])


def in_context(occurrences: DataFrame, lex: DataFrame, pages: DataFrame) -> DataFrame:
    """word, near, best: for each word that may stand for several, and the words before and after it (near), the one that
    the corpus has most often beside those; of equals as in lexicon()."""
    several = lex.where("open is not null").select("word", F.explode("open").alias("o")).select("word", "o.*")
    near = F.split("near", "\x00")
    tried = occurrences.select("word", "near").distinct().join(several, "word").withColumns({"left": F.concat_ws(" ", near[0], "correction"), "right": F.concat_ws(" ", "correction", F.get(near, F.lit(1)))})
    wanted = tried.select(F.explode(F.array("left", "right")).alias("pair")).distinct()
    held = several.select("correction").distinct().limit(SAFE_WORDS + 1).collect()
    pairs = _pairs(pages, {r[0] for r in held} if len(held) <= SAFE_WORDS else None).join(wanted, "pair", "left_semi").groupBy("pair").agg(F.sum("n").alias("n"))
    for side in ("left", "right"):
        tried = tried.join(pairs.select(F.col("pair").alias(side), F.col("n").alias(f"n_{side}")), side, "left")
    seen = (F.coalesce("n_left", F.lit(0)) + F.coalesce("n_right", F.lit(0))).alias("seen")
    return tried.groupBy("word", "near").agg(F.max_by("correction", F.struct(seen, "fixed", "uses", "correction")).alias("best"))


def _pairs(pages: DataFrame, some: set[str] | None) -> DataFrame:
    """pair, n: words beside each other, counted per batch; only pairs with one of some, if given."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column(0).to_pylist():
                words = [_trim(w) for w in tokenise(text.lower())]
                counts.update(f"{x} {y}" for x, y in zip(words, words[1:]) if some is None or x in some or y in some)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["pair", "n"])

    return pages.select("raw_text").mapInArrow(rows, "pair string, n bigint")


# ---------------------------------------------------------------------------------------- what a page needs


BARE, SURE = "\x01bare", "\x01sure"


def _around(template: str) -> list[str]:
    """A template without each of its characters; none of a short one."""
    return [template[:i] + template[i + 1 :] for i in range(len(template))] if len(template) >= 8 else []


def _stems(word: str) -> tuple[str, ...]:
    return (word.partition("-")[0], word.rpartition("-")[0]) if "-" in word else ()


class Reader:
    """Reads pages with what the corpus says: frequent words with their uses, and templates of furniture."""

    def __init__(self, safe: dict[str, int], known: list[str], spaces: int = 0):
        self.safe = safe
        self.templates = set(known)
        self.spaces = max([4, spaces, *[t.count(" ") for t in known]])  # of all templates
        self.around = {v for t in known for v in _around(t)}
        self.stems = frozenset(v for w in safe for v in _stems(w))
        self.more: dict[str, int] = {}  # what a page has of the words and templates that not every task holds

    def uses(self, word: str) -> int:
        return self.safe.get(word) or self.more.get("w" + word, 0)

    def stem(self, word: str) -> bool:
        return word in self.stems or "s" + word in self.more

    def wants(self, text: str) -> set[str]:
        """Keys of what a page would ask: words (`w`), stems before a hyphen (`s`), templates (`t`) and templates but for
        one character (`d`)."""
        keys = {"w" + x for w in set(tokenise(text.lower())).difference(self.safe) if is_word(w) for x in (w, _trim(w)) if "\x00" not in w}
        lines = text.split("\n")
        for i, line in enumerate(lines):
            if line and (line[-1] in _MARKS or line[-1].isspace() and line.rstrip()[-1:] in _MARKS) and (left := _left(line).lower()):
                keys |= {"w" + left, "s" + left}
                for j in range(i + 1, min(i + 6, len(lines))):
                    if h := _HEAD.match(lines[j]):
                        right = _trim(h.group(1))
                        keys |= {"w" + left + right.lower(), f"w{left}-{right.lower()}"}
            for p in furniture_parts(line.strip()):
                if (k := self.part(p)) not in (BARE, SURE):
                    m = _masked(k)
                    keys |= {"t" + m, *["d" + v for v in _around(m)]}
        return keys

    @lru_cache(maxsize=100_000)  # noqa: B019
    def template(self, skel: str) -> bool:
        m = _masked(skel)
        if m in self.templates:
            return True
        return len(m) >= 8 and m[-1] not in ".,;" and any(v in self.around for v in _around(m))

    @lru_cache(maxsize=200_000)  # noqa: B019
    def part(self, p: str) -> str:
        """Whether a part of a line surely is furniture or is a bare number; else its skeleton."""
        if (p.isdigit() and len(p) < 5) or _ROMAN.fullmatch(p):
            return BARE
        if _PAGE_NO.fullmatch(_masked(p)):
            return SURE
        k = skeleton(p)
        return SURE if self.template(k) or _PAGE_LIKE.fullmatch(_masked(k)) else k

    def extra(self, k: str) -> bool:
        """Whether a skeleton is a template that came with the page."""
        m = _masked(k)
        return "t" + m in self.more or len(m) >= 8 and m[-1] not in ".,;" and any("d" + v in self.more for v in _around(m))

    def furniture(self, lines: list[str], page: int | None) -> tuple[list[bool], list[tuple[int, list[str]]]]:
        """Of each line whether it surely is furniture; and the edge lines that the file itself must tell, with keys."""
        full = [i for i, s in enumerate(lines) if s and not s.isspace()]
        sure = [False] * len(lines)
        bare: list[int] = []
        edge = {*full[:TOP], *full[-BOTTOM:]}
        ask: list[tuple[int, list[str]]] = []
        for i in full:
            s = lines[i].strip()
            if (i not in edge and "  " not in s and s.count(" ") > self.spaces) or not (split := furniture_parts(s)):
                continue
            parts = [self.part(p) for p in split]
            if self.more:
                parts = [SURE if k not in (BARE, SURE) and self.extra(k) else k for k in parts]
            bares, ok = parts.count(BARE), parts.count(SURE)
            open_keys = [k for k in parts if k not in (BARE, SURE)]
            if not open_keys and (ok or bares == 0):
                sure[i] = ok > 0 and (bares == 0 or ok > 0)
            elif not open_keys and bares == len(parts) == 1:
                bare.append(i)
            elif i in edge:
                ask.append((i, open_keys))
        for i in bare:
            at = full.index(i)
            beside = [full[j] for j in (at - 1, at + 1) if 0 <= j < len(full)]
            p = lines[i].strip()
            if any(sure[j] for j in beside) or (not p.isdigit() and i in edge):
                sure[i] = True
            elif i in edge and p.isdigit():
                ask.append((i, [_number_key(p, page) or ""]))
        return sure, ask

    def broken(self, left: str, right: str, mark: str) -> bool:
        """Whether a hyphen after `left` at a line's end breaks a word that goes on with `right`."""
        left, right = left.lower(), _trim(right.lower())
        whole, own = self.uses(left + right), self.uses(f"{left}-{right}")
        if whole or own:
            return whole >= own
        if mark == "-" and self.stem(left) and not self.uses(left):
            return False
        return True

    def word(self, w: str, line: str, i: int, out: list, near: str) -> None:
        """A word that is not frequent: misread by its look, or one for the lexicon; near: the words beside it."""
        t = _trim(w)
        low = t.lower()
        if len(low) < 2 or self.uses(low):
            return
        if _ODD.search(t) and "." not in t and not re.search(rf"{re.escape(t)}[\w.-]*\.\w", line) and not re.search(r"^@|\d{2}", t):
            out.append((i + 1, "misread", t, near))
        else:
            out.append((i + 1, "ask", low, near))

    def page(self, text: str, page: int | None, more: dict[str, int] | None = None) -> tuple[list[tuple[int, str, str, str]], list[tuple[int, list[str]]]]:
        """(line, kind, word, near) where kind is furniture, hyphen, misread or ask (a word that the lexicon must tell; with a
        zero character where a line ends in it); and the lines to ask the file about. more: what the page has of the words
        and templates that the reader lacks."""
        self.more = more or {}
        lines = text.split("\n")
        sure, ask = self.furniture(lines, page)
        out: list[tuple[int, str, str, str]] = [(i + 1, "furniture", "", "") for i, f in enumerate(sure) if f]
        carried: dict[int, int] = {}  # line to the characters at its start that belong to a broken word
        asked = dict(ask)
        # What the whole page has beside frequent words: only lines with it, or with a hyphen at the end, are read.
        lower = text.lower()
        strange = {w for w in set(tokenise(lower)).difference(self.safe) if "\x00" not in w and is_word(w) and not self.uses(_trim(w)) and not self.uses(w)}
        lows = lower.split("\n") if strange else []
        if len(lows) != len(lines):  # a letter whose lower case is longer never adds a line; without strange words none is read
            lows = []
        dashed = {i for i, s in enumerate(lines) if s and (s[-1] in _MARKS or s[-1].isspace() and s.rstrip()[-1:] in _MARKS)}
        odd = {i for i, s in enumerate(lows) if any(w in s for w in strange)}
        for i in sorted(dashed | odd):
            line = lines[i]
            if sure[i]:
                continue
            cut = len(line)
            left = _left(line) if i in dashed else ""
            if left:
                mark, begin_left = line.rstrip()[-1], len(line.rstrip()) - 1 - len(left)
                pick = None
                known = False
                low_left = left.lower()
                seen = 0
                for j in range(i + 1, min(i + 6, len(lines))):
                    if sure[j] or not (h := _HEAD.match(lines[j])):
                        continue
                    right = _trim(h.group(1))
                    low_right = right.lower()
                    if self.uses(low_left + low_right) or self.uses(f"{low_left}-{low_right}"):
                        pick, known = (j, h, right), True
                        break
                    if pick is None and j not in asked:
                        pick = (j, h, right)
                    seen += 1
                    if seen == 3:
                        break
                if pick is None:
                    if not (mark == "-" and self.stem(low_left)):
                        out.append((i + 1, "hyphen", left, ""))
                        cut = begin_left
                elif self.broken(left, pick[2], mark):
                    j, h, right = pick
                    if right[:1].islower() or right.isupper() and left.isupper() or known:
                        out.append((i + 1, "hyphen", f"{left}\x00{right}", ""))
                        cut = begin_left
                        carried[j] = h.end(1)
                        whole = low_left + right.lower()
                        if not self.uses(whole):
                            if _ODD.search(left) or "†" in left:
                                out.append((i + 1, "misread", left, ""))
                            if _ODD.search(right) or "†" in right:
                                out.append((j + 1, "misread", right, ""))
                            out.append((i + 1, "ask", f"{low_left}\x00{right.lower()}\x00{j + 1}", ""))
            begin = carried.pop(i, 0)
            if i in odd:
                row = tokenise(line[begin:cut])
                for k, w in enumerate(row):
                    if w.lower() in strange:
                        beside = [_trim(row[j].lower()) if 0 <= j < len(row) else "" for j in (k - 1, k + 1)]
                        self.word(w, line, i, out, "\x00".join(beside))
        return out, ask


_PAGE_LIKE = re.compile("|".join(skeleton(x).replace(" ", " ?") for x in ("página # de #", "pagina #", "pág. # .", "pág. #.", "page # of #", "page #", "fl. #", "folha #")).replace(".", r"\.?").replace("#", "#"))


def _first_difference(word: str, correction: str) -> int:
    i = 0
    while i < min(len(word), len(correction)) and word[i] == correction[i]:
        i += 1
    return i


def _with_more(text: DataFrame, others: DataFrame, safe: dict[str, int], masks: list[str], spaces: int) -> DataFrame:
    """text with `more`: what each page has of the words and templates in others (key, n)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(safe, masks, spaces)
        for batch in batches:
            at, keys = [], []
            for i, raw in enumerate(batch.column(2).to_pylist()):
                wanted = reader.wants(raw)
                at += [i] * len(wanted)
                keys += wanted
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(keys, pa.string())], names=["_doc", "_page", "key"])

    wanted = text.mapInArrow(rows, "_doc string, _page int, key string")
    more = wanted.join(others, "key").groupBy("_doc", "_page").agg(F.collect_set(F.struct("key", "n")).alias("more"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("page").eqNullSafe(F.col("_page"))
    return text.join(more, same, "left").select(*text.columns, "more")


def inspect(pages: DataFrame, corrections: bool = True) -> tuple[DataFrame, DataFrame]:
    """(found, lexicon): lines that need repair (doc_id, page, line_no, kind, word, correction) and the misread words.
    A repeated row gives its lines again."""
    text = pages.select("doc_id", "page", "raw_text").where("raw_text is not null and length(raw_text) > 0")
    stats = checkpointed(statistics(text))
    lex = checkpointed(lexicon(stats))
    words = stats.where("kind = 'w'").select(F.col("key1").alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    words = words.join(lex, "word", "left_anti").where("n > 1")
    shapes = templates(stats)
    top, known = words.orderBy(F.desc("n"), "word").limit(SAFE_WORDS).collect(), shapes.orderBy(F.desc("files"), "mask").limit(TEMPLATES).collect()
    safe, masks, spaces = {r["word"]: r["n"] for r in top}, [r["mask"] for r in known], 0
    others = None  # beyond what every task holds
    if len(top) == SAFE_WORDS:
        w, n = F.col("word"), F.col("n")
        rest = words.where((n < top[-1]["n"]) | (n == top[-1]["n"]) & (w > top[-1]["word"]))
        stem = F.explode(F.array(F.substring_index(w, "-", 1), F.regexp_replace(w, "-[^-]*$", ""))).alias("stem")
        # Stems of words that the tasks hold are known to them.
        others = rest.select(F.concat(F.lit("w"), w).alias("key"), n).unionByName(rest.where(w.contains("-")).select(stem).select(F.concat(F.lit("s"), "stem").alias("key"), F.lit(1).cast("bigint").alias("n")).distinct())
    if len(known) == TEMPLATES:
        m, n = F.col("mask"), F.col("files")
        rest = shapes.where((n < known[-1]["files"]) | (n == known[-1]["files"]) & (m > known[-1]["mask"])).select("mask")
        without = F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: F.concat(F.lit("d"), F.substring(m, F.lit(1), i - 1), F.substring(m, i + 1, F.length(m))))
        keys = F.explode(F.array_distinct(F.concat(F.array(F.concat(F.lit("t"), m)), F.when(F.length(m) >= 8, without).otherwise(F.array().cast("array<string>"))))).alias("key")
        far = rest.select(keys).distinct().withColumn("n", F.lit(1).cast("bigint"))
        others = far if others is None else others.unionByName(far)
        spaces = shapes.agg(F.coalesce(F.max(F.length("mask") - F.length(F.replace("mask", F.lit(" "), F.lit("")))), F.lit(0))).first()[0]
    none_more = F.lit(None).cast("array<struct<key:string,n:bigint>>").alias("more")
    text = text.withColumn("more", none_more) if others is None else _with_more(text, others, safe, masks, spaces)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(safe, masks, spaces)
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [], [])
            for doc, page, raw, more in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                found, ask = reader.page(raw, page, {x["key"]: x["n"] for x in more} if more else None)
                open_lines = {line + 1 for line, _ in ask}
                for line, kind, word, near in found:
                    for c, v in zip(cols, (doc, page, line, kind, word, near, line in open_lines)):
                        c.append(v)
                for line, keys in ask:
                    for c, v in zip(cols, (doc, page, line + 1, "edge", "\x00".join(keys), "", True)):
                        c.append(v)
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "page", "line_no", "kind", "word", "near", "open"])

    read = checkpointed(text.mapInArrow(rows, "doc_id string, page int, line_no int, kind string, word string, near string, open boolean"))
    key = ["doc_id", "page", "line_no"]
    # Edge lines that the file tells: every part of the line must repeat at its edges.
    parts = read.where("kind = 'edge'").select(*key, F.explode(F.split("word", "\x00")).alias("key2"))
    told = parts.join(furniture_keys(stats).select(F.col("key1").alias("doc_id"), "key2", F.lit(True).alias("hit")), ["doc_id", "key2"], "left")
    told = told.groupBy(*key).agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("all")).where("all").select(*key)
    # Words that the lexicon tells; of a broken word the difference says which line has the wrong character.
    asked = read.where("kind = 'ask'").select(*key, "open", "near", F.split("word", "\x00").alias("p")).withColumn("word", F.concat(F.col("p")[0], F.coalesce(F.get("p", F.lit(1)), F.lit(""))))
    lex_words = lex.select("word", "correction")
    wrong = asked.join(lex_words, "word")
    same = F.length(F.regexp_extract(F.concat_ws("\x01", "word", "correction"), "^([^\x01]*)[^\x01]*\x01\\1", 1))
    line = F.when((F.size("p") == 3) & (same >= F.length(F.col("p")[0])), F.get("p", F.lit(2)).try_cast("int")).otherwise(F.col("line_no"))
    wrong = wrong.select("doc_id", "page", line.alias("line_no"), F.lit("misread").alias("kind"), "word", "near", "correction", "open")
    seen = read.where("kind in ('hyphen', 'misread', 'furniture')").select(*key, "kind", "word", "near", "open")
    if corrections:
        seen = seen.withColumn("low", F.lower("word")).join(lex_words.withColumnRenamed("word", "low"), "low", "left").drop("low")
    else:
        seen = seen.withColumn("correction", F.lit(None).cast("string"))
    other = wrong.unionByName(seen.select(wrong.columns))
    if corrections and not lex.where("open is not null").isEmpty():
        other = other.withColumn("low", F.lower("word"))
        best = in_context(other.where("correction is not null").select(F.col("low").alias("word"), "near"), lex, text)
        other = other.join(best.withColumnRenamed("word", "low"), ["low", "near"], "left").withColumn("correction", F.coalesce("best", "correction")).drop("low", "best")
    other = other.drop("near")
    # Only lines that the file was asked about can turn out to be furniture.
    plain = other.where("not open").unionByName(other.where("open").join(told, key, "left_anti").select(other.columns)).drop("open")
    none = F.lit(None).cast("string")
    return plain.unionByName(told.select(*key, F.lit("furniture").alias("kind"), F.lit("").alias("word"), none.alias("correction"))), lex


def lines_to_repair(pages: DataFrame) -> DataFrame:
    """doc_id, page, line_no (from 1), kind (`furniture`, `hyphen`, `misread`), each once.

    pages: doc_id, page, raw_text; other columns are ignored. Null, empty and blank texts have none; repeated rows count
    once; a null page number counts as 0 in page numbering only; an empty table gives an empty one. A furniture line has
    no other kind."""
    return inspect(pages, corrections=False)[0].select("doc_id", "page", "line_no", "kind").distinct()


def reflow(lines: list[str], furniture: set[int], joins: dict[int, str], words: dict[int, dict[str, str]]) -> list[str]:
    """Paragraphs of a page: furniture left out, broken words joined, misread words replaced, lines run on. A blank
    line, an indented line after a full stop and a heading start a new paragraph."""
    out: list[str] = []
    now, open_word = "", False  # open_word: the next line goes on without a blank
    for i, line in enumerate(lines, 1):
        s = line.strip()
        if i in furniture:
            continue
        if not s:
            if now and not open_word:
                out.append(now)
                now = ""
            continue
        for wrong, right in words.get(i, {}).items():
            s = re.sub(rf"(?<![^\W\d_]){re.escape(wrong)}(?![^\W\d_])", lambda m, r=right: r.capitalize() if m.group()[0].isupper() or not m.group()[0].isalpha() and m.start() == 0 else r, s, flags=re.I)
        if now and not open_word and line[:1] in " \t" and now[-1] in ".!?:":
            out.append(now)
            now = ""
        now += s if open_word or not now else f" {s}"
        open_word = i in joins or (s[-1] in _MARKS and len(s) > 1 and s[-2].isalpha())
        if "\x00" in joins.get(i, ""):  # a word whose other half is on the next page keeps its mark
            now = now.rstrip(_HYPHENS + " ")
    if now:
        out.append(now)
    return out


def paragraphs(pages: DataFrame) -> DataFrame:
    """doc_id, page, paragraph (from 1), text: the repaired, continuous text of every page."""
    found, _ = inspect(pages)
    needs = found.groupBy("doc_id", "page").agg(F.collect_set(F.struct("line_no", "kind", "word", "correction")).alias("needs"))
    once = pages.select("doc_id", "page", "raw_text").where("raw_text is not null").dropDuplicates(["doc_id", "page"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [])
            for doc, page, raw, needs in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                needs = needs or []
                words: dict[int, dict[str, str]] = {}
                for x in needs:
                    if x["kind"] == "misread" and x["correction"]:
                        words.setdefault(x["line_no"], {})[x["word"]] = x["correction"]
                got = reflow(raw.split("\n"), {x["line_no"] for x in needs if x["kind"] == "furniture"}, {x["line_no"]: x["word"] for x in needs if x["kind"] == "hyphen"}, words)
                for k, p in enumerate(got, 1):
                    for c, v in zip(cols, (doc, page, k, p)):
                        c.append(v)
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "page", "paragraph", "text"])

    return once.join(needs, ["doc_id", "page"], "left").select("doc_id", "page", "raw_text", "needs").mapInArrow(rows, "doc_id string, page int, paragraph int, text string")
