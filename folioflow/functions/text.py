"""Scalar text functions as Column expressions. Null stays null unless said otherwise."""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space and word characters as Python's Unicode strings see them, capitals that begin a sentence,
# list markers and months.
WS = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"
CAPITALS = "A-ZÁÀÂÃÉÈÊÍÏÓÔÕÖÚÇÑ"
BULLETS = "-•●○◦▪▸►"
MONTHS = ("janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")
CONTROL = r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}-\x{9f}]"
PAGE_NUMBERS = (
    rf"\n[{WS}]*[-–—][{WS}]*\d+[{WS}]*[-–—][{WS}]*\n",
    rf"\n[{WS}]*[Pp]ágina[{WS}]+\d+[{WS}]*(de[{WS}]+\d+)?[{WS}]*\n",
    rf"\n[{WS}]*[Pp]age[{WS}]+\d+[{WS}]*(of[{WS}]+\d+)?[{WS}]*\n",
    rf"\n[{WS}]*\d+[{WS}]*/[{WS}]*\d+[{WS}]*\n",
    rf"\n[{WS}]*\d{{1,4}}[{WS}]*\n",
)
#: Numeric dates with the places of year, month and day, in the order in which they are tried.
DATE_PATTERNS = ((r"(\d{1,2})/(\d{1,2})/(\d{4})", (3, 2, 1)), (r"(\d{1,2})-(\d{1,2})-(\d{4})", (3, 2, 1)), (r"(\d{4})-(\d{1,2})-(\d{1,2})", (1, 2, 3)))
TRUNCATED = "\n\n[... documento truncado ...]"
UNITS = ("B", "KB", "MB", "GB", "TB")


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c(x), rf"^[{WS}]+|[{WS}]+$", "")


def tokens(x: Column | str) -> Column:
    """Estimated tokens: code points divided by four, rounded down; 0 for null."""
    return F.coalesce(F.floor(F.length(c(x)) / 4).cast("int"), F.lit(0))


def clean(x: Column | str) -> Column:
    """Without control characters other than tab, line feed and carriage return."""
    return F.regexp_replace(c(x), CONTROL, "")


def collapse(x: Column | str) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(c(x), rf"[{WS}]+", " "))


def compatible(x: Column | str) -> Column:
    """Compatibility form (NFKC), then collapsed. Visits Python in Arrow batches, where ASCII texts stay as they are."""

    def nfkc(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))

    return collapse(F.pandas_udf(nfkc, T.StringType())(c(x)))


def sentences(x: Column | str) -> Column:
    """Sentences, stripped, without empty ones; an empty array for null and blank texts."""
    parts = F.split(F.coalesce(c(x), F.lit("")), rf"(?<=[.!?])[{WS}]+(?=[{CAPITALS}])")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def is_upper(x: Column | str) -> Column:
    """Has a cased letter and no lower or title case one."""
    return c(x).rlike(r"\p{Lu}") & ~c(x).rlike(r"[\p{Ll}\p{Lt}ªº]")


def heading_level(x: Column | str) -> Column:
    """Level by text alone, null for no heading: a numbered start counts all dots of the text (6 at most), a short text
    in capitals is level 1."""
    t = strip(x)
    dots = F.length(t) - F.length(F.translate(t, ".", ""))
    return F.when(t.rlike(rf"^(\d+\.)+[{WS}]*\d*\.?[{WS}]*"), F.least(dots, F.lit(6))).when((F.length(t) < 100) & is_upper(t), F.lit(1))


def list_type(x: Column | str) -> Column:
    """`ordered`, `unordered` or null."""
    t = strip(x)
    ordered = rf"(?i)^(\d+[.)]|[a-z][.)]|\([ivxlcdm]+\)|\(\d+\))[{WS}]+"
    return F.when(t.rlike(ordered), "ordered").when(t.rlike(rf"^[{BULLETS}*][{WS}]+"), "unordered")


def without_marker(x: Column | str) -> Column:
    """A list item's text without its bullet, then without its number."""
    t = F.regexp_replace(c(x), rf"^[{BULLETS}*][{WS}]+", "")
    return F.regexp_replace(t, rf"(?i)^(\d+|\([a-z]\)|\([ivx]+\))[.)][{WS}]+", "")


def merge_hyphenated(x: Column | str) -> Column:
    """Words broken by a hyphen at the end of a line in one piece."""
    return F.regexp_replace(c(x), rf"([{WORD}]+)-[{WS}]*\n[{WS}]*([{WORD}]+)", "$1$2")


def page_mentions(x: Column | str) -> Column:
    """Page numbers that a text mentions, in order; numbers beyond an int are null."""
    found = F.regexp_extract_all(c(x), F.lit(rf"(?i)(?:página|pág\.?|pg\.?|p\.)[{WS}]*(\d+)"), F.lit(1))
    return F.transform(found, lambda n: n.try_cast("int"))


def unix_lines(x: Column | str) -> Column:
    return F.replace(F.replace(c(x), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def without_page_numbers(x: Column | str) -> Column:
    """Lines that hold only a page number vanish with both their line ends but one."""
    t = c(x)
    for p in PAGE_NUMBERS:
        t = F.regexp_replace(t, p, "\n")
    return t


def without_repeated_edges(x: Column | str) -> Column:
    """Lines that begin or end at least two of a text's parts (parts lie between three line feeds) vanish. Texts of fewer
    than 20 lines or two parts stay. One array per text, nothing is shuffled."""
    t = c(x)
    parts = F.transform(F.split(t, "\n\n\n"), lambda p: F.filter(F.transform(F.split(p, "\n"), strip), lambda s: s != ""))
    parts = F.filter(parts, lambda p: F.size(p) >= 2)
    repeated = None
    for pick in (lambda p: F.get(p, F.lit(0)), lambda p: F.element_at(p, -1)):
        edge = F.filter(F.transform(parts, lambda p: F.substring(pick(p), 1, 100)), lambda e: F.length(e) > 5)  # noqa: B023
        twice = F.filter(F.array_distinct(edge), lambda e: F.size(F.filter(edge, lambda y: y == e)) >= 2)  # noqa: B023
        repeated = twice if repeated is None else F.concat(repeated, twice)
    quoted = lambda e: F.concat(F.lit("\\Q"), e, F.lit("\\E"))

    def drop(text: Column, e: Column) -> Column:
        text = F.regexp_replace(text, F.concat(F.lit("(?md)^"), quoted(e), F.lit(rf"[{WS}]*\n")), F.lit(""))
        return F.regexp_replace(text, F.concat(F.lit("(?md)\n"), quoted(e), F.lit(rf"[{WS}]*$")), F.lit(""))

    long = (F.size(F.split(t, "\n")) >= 20) & (F.size(F.split(t, "\n\n\n")) >= 2)
    return F.when(long, F.aggregate(repeated, t, drop)).otherwise(t)


def compact_space(x: Column | str) -> Column:
    """Runs of blanks become one, none at line ends, at most one empty line in a row."""
    t = F.regexp_replace(c(x), "[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(t, " *\n *", "\n"), "\n{3,}", "\n\n")


def let(x: Column, use) -> Column:
    """use(x) with x evaluated once, however often it stands in use."""
    return F.transform(F.array(x), use)[0]


def without_repeated_lines(x: Column | str) -> Column:
    """A line like the one before (empty ones aside) vanishes; empty lines stay. Linear in the lines but for one sort."""
    rows = F.transform(F.split(c(x), "\n"), lambda line, i: F.struct(i.alias("i"), line.alias("line"), strip(line).alias("t")))

    def kept(full: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("string")), F.transform(full, lambda r: r["t"]))
        return F.filter(F.zip_with(full, F.slice(before, F.lit(1), F.size(full)), lambda r, p: F.when(p.isNull() | (p != r["t"]), r)), lambda r: r.isNotNull())

    def joined(all_rows: Column) -> Column:
        empty = F.filter(all_rows, lambda r: r["t"] == "")
        return F.array_join(F.transform(F.array_sort(F.concat(empty, let(F.filter(all_rows, lambda r: r["t"] != ""), kept))), lambda r: r["line"]), "\n")

    return F.when(c(x).isNotNull(), let(rows, joined))


def plain_punctuation(x: Column | str) -> Column:
    """Dashes become hyphens, long runs of dots, hyphens and underscores short ones, no blanks before marks."""
    t = F.translate(c(x), "–—", "--")
    for p, r in ((r"\.{4,}", "..."), ("-{3,}", "--"), ("_{3,}", "__"), (r" +([.,;:!?])", "$1")):
        t = F.regexp_replace(t, p, r)
    return t


def compact_lists(x: Column | str) -> Column:
    """One kind of bullet and one blank after list markers."""
    t = F.regexp_replace(c(x), rf"\n[{WS}]*[-•●○][{WS}]*", "\n- ")
    return F.regexp_replace(t, rf"\n[{WS}]*(\d+[.)])[{WS}]*", "\n$1 ")


def _last(t: Column, needle: str) -> Column:
    """Where needle begins last, from 0; -1 if nowhere."""
    at = F.instr(F.reverse(t), needle[::-1])
    return F.when(at == 0, -1).otherwise(F.length(t) - at - len(needle) + 1)


def smart_truncate(x: Column | str, limit: int) -> Column:
    """At most `limit` characters: up to the last end of a sentence beyond 70 % of them, else to the last empty line
    beyond half, then a note. Shorter texts stay."""
    t = c(x)
    cut = F.substring(t, 1, limit)
    stop = F.greatest(*[_last(cut, m + e) for m in ".?!" for e in " \n"])
    para = _last(cut, "\n\n")
    kept = F.when(stop > limit * 0.7, F.substring(cut, F.lit(1), stop + 1)).when(para > limit * 0.5, F.substring(cut, F.lit(1), para)).otherwise(cut)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(kept, F.lit(TRUNCATED)))


def truncate_words(x: Column | str, limit: int, suffix: str = "...") -> Column:
    """At most `limit` characters with the suffix, cut at the last space if that lies beyond half."""
    t = c(x)
    cut = F.substring(t, 1, limit - len(suffix))
    space = _last(cut, " ")
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.when(space > limit // 2, F.substring(cut, F.lit(1), space)).otherwise(cut), F.lit(suffix)))


def likely_title(x: Column | str, limit: int = 100) -> Column:
    """The first of five lines with more than 10 and fewer than `limit` characters that ends in no mark; null if none."""
    lines = F.slice(F.transform(F.split(strip(x), "\n"), strip), 1, 5)
    return F.get(F.filter(lines, lambda s: (F.length(s) > 10) & (F.length(s) < limit) & ~s.rlike("[.,;:]$")), F.lit(0))


def file_size(n: Column | str) -> Column:
    """Bytes in words, steps of 1024, one decimal."""
    n = c(n).cast("double")
    out = F.format_string("%.1f TB", n / 1024.0**4)
    for k in (3, 2, 1, 0):
        out = F.when(n < 1024.0 ** (k + 1), F.format_string(f"%.1f {UNITS[k]}", n / 1024.0**k)).otherwise(out)
    return F.when(n.isNotNull(), out)


def file_extension(x: Column | str) -> Column:
    """With its dot, in lower case; empty if there is none or the name only begins with a dot."""
    return F.lower(F.regexp_extract(c(x), r"[^/\\]+(\.[^./\\]+)$", 1))


def safe_filename(x: Column | str) -> Column:
    """Forbidden characters become one underscore; at most 200 characters before the extension of a longer name."""
    t = F.regexp_replace(F.regexp_replace(c(x), r'[<>:"/\\|?*]', "_"), "_+", "_")
    stem, ext = F.regexp_extract(t, r"(?s)^(.*)\.", 1), F.regexp_extract(t, r"\.([^.]*)$", 1)
    dotted = F.instr(t, ".") > 0
    long = F.when(dotted & (ext != ""), F.concat(F.substring(stem, 1, 200), F.lit("."), ext)).when(dotted, F.substring(stem, 1, 200)).otherwise(F.substring(t, 1, 200))
    return F.when(F.length(t) > 200, long).otherwise(t)


def date_br(x: Column | str) -> Column:
    """The first numeric date as year-month-day without a check that it exists: day first with slashes, else with
    hyphens, else year first."""
    out = None
    for p, (y, m, d) in DATE_PATTERNS:
        g = lambda i, p=p: F.regexp_extract(c(x), p, i)
        hit = F.concat_ws("-", g(y), F.lpad(g(m), 2, "0"), F.lpad(g(d), 2, "0"))
        out = F.when(c(x).rlike(p), hit) if out is None else out.when(c(x).rlike(p), hit)
    return out


def money_br(x: Column | str) -> tuple[Column, Column]:
    """(value, currency) of the first amount in Brazilian notation; either may be null."""
    t = c(x)
    currency = F.when(t.contains("R$") | t.contains("BRL"), "BRL").when(t.contains("US$") | t.contains("USD"), "USD").when(t.contains("EUR") | t.contains("€"), "EUR")
    # "US$" holds no "R$", and neither does any other sign.
    raw = F.regexp_extract(t, r"([\d.,]+)", 1)
    both = raw.contains(",") & raw.contains(".")
    number = F.when(both, F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(raw, F.lit(","), F.lit(".")))
    return number.try_cast("double"), currency


def normalise(x: Column | str, limit: int | None = None, page_numbers: bool = True, edges: bool = True, space: bool = True, repeated: bool = True) -> Column:
    """All steps in order; empty for null."""
    t = unix_lines(clean(F.coalesce(c(x), F.lit(""))))
    t = without_page_numbers(t) if page_numbers else t
    t = without_repeated_edges(t) if edges else t
    t = compact_space(t) if space else t
    t = without_repeated_lines(t) if repeated else t
    t = strip(compact_lists(plain_punctuation(t)))
    return smart_truncate(t, limit) if limit else t
