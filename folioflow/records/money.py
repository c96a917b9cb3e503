"""Amounts in several currencies and scales to hundredths of one currency.

Text is read by built-in expressions into a plain number and a source unit such as `USD:million`. The conversions to
the canonical unit are composed in a graph of units; amounts meet them in an equi-join on the source unit.
"""

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.runtime import settled
from .units import UnitGraph

TARGET = "BRL:cent"
#: A table of rates beyond this is no list of currencies; the graph is built on the driver and its result broadcast.
MOST_RATES = 1000

# Words for currencies, scales and numbers. Text is lower case, with plain spaces and minus signs.
CENTS = (
    ("USD", r"centavos? de d[oó]lar(?:es)?|cents? usd|us cents?|usd cents?|us\$ ?cents?"),
    ("EUR", r"euro ?cents?|c[eê]ntimos? de euros?|centavos? de euros?|cents? eur"),
    ("GBP", r"pence|penny|p \(gbp\)|p gbp|centavos? de libras?"),
    ("BRL", r"centavos?(?: de rea(?:l|is))?|cents?"),
)
CURRENCIES = (
    ("USD", r"us\$|u\$|usd|u\. ?s\. dollars?|us dollars?|d[oó]lar(?:es)?(?: americanos?)?|dollars?"),
    ("EUR", r"€|eur(?![a-z])|euros?"),
    ("GBP", r"£|gbp|libras?(?: esterlinas?)?|pounds?(?: sterling)?"),
    ("JPY", r"¥|jpy|ienes?|yen"),
    ("BRL", r"r ?\$|brl|rea(?:l|is)"),
)
SCALES = (
    ("billion", r"bilh(?:ões|oes|ão|ao)|billions?|bn|bi|mrd\.?|milliarden?"),
    ("million", r"milh(?:ões|oes|ão|ao)|millions?|millionen|mio\.?|mln|mm|mi|m"),
    ("thousand", r"milhares|mil|thousands?|tsd\.?|tausend|k|t(?=eur)|'000"),
)
POWERS = {"thousand": 3, "million": 6, "billion": 9}
WORDS = {
    "um": 1, "uma": 1, "dois": 2, "duas": 2, "três": 3, "tres": 3, "quatro": 4, "cinco": 5, "seis": 6, "sete": 7, "oito": 8, "nove": 9, "dez": 10,
    "onze": 11, "doze": 12, "treze": 13, "catorze": 14, "quatorze": 14, "quinze": 15, "dezesseis": 16, "dezessete": 17, "dezoito": 18, "dezenove": 19,
    "vinte": 20, "trinta": 30, "quarenta": 40, "cinquenta": 50, "sessenta": 60, "setenta": 70, "oitenta": 80, "noventa": 90,
    "cem": 100, "cento": 100, "duzentos": 200, "trezentos": 300, "quatrocentos": 400, "quinhentos": 500, "seiscentos": 600, "setecentos": 700, "oitocentos": 800, "novecentos": 900,
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19,
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}

_L, _R = r"(?<![\p{L}])", r"(?![\p{L}])"
_NUMBER = r"\d(?:[\d.,']| (?=\d{3}(?!\d)))*"


def normal(text: Column) -> Column:
    t = F.regexp_replace(F.lower(text), r"[\s  -​ 　]+", " ")
    return F.trim(F.translate(t, "−–—’", "---'"))


def _first(text: Column, table, left: str = _L, right: str = _R) -> Column:
    out = None
    for name, pattern in table:
        hit = text.rlike(left + "(?:" + pattern + ")" + right)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def number(plain: Column) -> Column:
    """A number of digits and marks as decimal, null if it is empty. Of two kinds of marks the last one is the decimal
    mark; one kind that repeats groups thousands, and so does a lone mark before exactly three digits."""
    tail = F.regexp_extract(plain, r"[.,](\d*)$", 1)
    mark = F.regexp_extract(plain, r"([.,])\d*$", 1)
    marks = F.length(plain) - F.length(F.translate(plain, ".,", ""))
    same = F.length(plain) - F.length(F.when(mark == ",", F.translate(plain, ",", "")).otherwise(F.translate(plain, ".", "")))
    grouping = (mark != "") & F.when(marks == 1, F.length(tail) == 3).otherwise(same > 1)
    digits = F.translate(plain, ".,", "")
    cut = F.substring(digits, F.lit(1), F.length(digits) - F.length(tail))
    whole = F.when((mark == "") | grouping, digits).otherwise(F.concat(cut, F.lit("."), tail))
    return F.nullif(whole, F.lit("")).try_cast("decimal(24,6)")


def spelled(text: Column) -> Column:
    """A number below a thousand in words, null if the text begins with none. `e`, `and` and hyphens join its words."""
    lookup = F.create_map(*[F.lit(x) for kv in WORDS.items() for x in kv])
    words = F.filter(F.split(F.regexp_replace(text, r"[ -]+(?:e |and )?", " "), " "), lambda w: w != "")
    known = F.filter(words, lambda w: F.map_contains_key(lookup, w))
    total = F.aggregate(F.transform(known, lambda w: lookup[w]), F.lit(0), lambda a, x: a + x)
    return F.when(F.map_contains_key(lookup, F.get(words, F.lit(0))), total).cast("decimal(24,6)")


def read(df: DataFrame) -> DataFrame:
    """df with `amount` (signed, in `unit`) and `unit` (`currency:scale`), both null for an unreadable row."""
    keep = df.columns
    # Each step is columns of its own, so that no pattern is tried more than once a row.
    df = df.withColumns({"_t": normal(F.col("original")), "_c": normal(F.col("context")), "_named": _first(normal(F.col("currency")), [(n, rf"^(?:{p})$") for n, p in CURRENCIES], "", "")})
    t, c = F.col("_t"), F.col("_c")
    # A minus before or after the digits, or brackets around all, is negative; `,-`, `.-` and `.--` stand for no cents.
    negative = t.rlike(r"^\(.*\d.*\)$|^-|^[^\d]*-[^\d]*\d|\d ?-$")
    raw = F.regexp_replace(F.regexp_extract(t, f"({_NUMBER})", 1), r"[^\d]+$", "")
    df = df.withColumns({"_raw": F.translate(raw, " '", ""), "_negative": negative, "_cents": F.when(t.rlike(r"cent|c[eê]nt|pen|\bp\b"), _first(t, CENTS))})
    cents, digits = F.col("_cents"), number(F.col("_raw"))
    # Letters may touch the digits on the left ("2k", "5.87brl").
    any_currency = "|".join(f"(?:{p})" for _, p in CURRENCIES)
    sign = F.regexp_extract(t, rf"((?:{_L}|(?<=\p{{L}}))(?:{any_currency}){_R})", 1)
    words = F.when(t.rlike(r"\p{L}|'"), t)
    df = df.withColumns({"_digits": digits, "_sign": F.nullif(sign, F.lit("")), "_size": F.when(cents.isNotNull(), "cent").otherwise(F.coalesce(_first(words, SCALES), F.lit("one")))})
    value = F.coalesce("_digits", F.when(t.rlike(r"^\p{L}"), spelled(t)))
    own = F.coalesce(cents, _first(F.col("_sign"), [(n, rf"^(?:{p})$") for n, p in CURRENCIES], "", ""))
    df = df.withColumns({"_value": value, "_own": own})
    own, own_scale = F.col("_own"), F.col("_size")
    # A table's heading names its unit, with the scale beside it; it is only asked where the amount has none.
    asked = F.when(own.isNull() & F.col("_value").isNotNull(), c)
    units = "|".join(p for _, p in CURRENCIES)
    stated = [(name, rf"(?:{_L}|(?<={_L}t))(?:{pattern}){_R}") for name, pattern in CURRENCIES]
    scales = [(k, rf"(?:{_L}(?:{p}){_R}? ?(?:de |of )?(?:{units}){_R})|(?:{_L}(?:{units}) ?\(?(?:{p}){_R})") for k, p in SCALES]
    df = df.withColumns({"_told": _first(asked, stated, "", ""), "_told_scale": F.coalesce(_first(asked, scales, "", ""), F.lit("one"))})
    told, named = F.col("_told"), F.col("_named")
    scale = F.when(own.isNull() & (own_scale == "one") & told.isNotNull(), F.col("_told_scale")).otherwise(own_scale)
    null = F.col("original").isNull()
    # try_cast rounds to the scale; what isn't finite becomes null.
    amount = F.when(null, F.col("value").try_cast("decimal(24,6)")).otherwise(F.when(F.col("_negative"), -F.col("_value")).otherwise(F.col("_value")))
    currency = F.when(null, named).otherwise(F.coalesce(own, told, named))
    unit = F.when(currency.isNotNull(), F.concat_ws(":", currency, F.when(null, "one").otherwise(scale)))
    return df.withColumns({"amount": amount, "unit": unit}).select(*keep, "amount", "unit")


def conversions(spark: SparkSession, rates: list[tuple[str, Decimal]], target: str = TARGET) -> DataFrame:
    """unit, factor: what an amount in unit is multiplied by. rates: currency and its worth in BRL."""
    graph = UnitGraph()
    graph.add("BRL:one", "BRL:cent", 100)
    for currency, worth in rates:
        if worth:
            graph.add(f"{currency}:one", "BRL:one", worth)
            graph.add(f"{currency}:cent", f"{currency}:one", "0.01")
            for name, power in POWERS.items():
                graph.add(f"{currency}:{name}", f"{currency}:one", 10**power)
    rows = [(unit, Decimal(f.numerator) / Decimal(f.denominator), Decimal(o.numerator) / Decimal(o.denominator)) for unit, (f, o) in sorted(graph.to(target).items())]
    return spark.createDataFrame(rows, "unit string, factor decimal(20,6), offset decimal(20,6)")


def convert(money: DataFrame, rates: DataFrame) -> DataFrame:
    """money_id, brl_cents, unit: each readable amount in hundredths of BRL, halves away from zero.

    money: money_id, original, value, currency, context; rates: currency, brl_per_unit (a fixed list of at most
    MOST_RATES currencies; null or repeated rates are dropped). What original states wins; unit and scale it lacks come
    from context, then currency; with a null original value counts, in whole units of currency. Rows without a readable
    number or unit, or in a currency without rate, give none. Rows without money_id are left
    out, repeated ones count once; other columns are dropped; an empty table gives an empty one."""
    pairs = rates.select("currency", "brl_per_unit").where("currency is not null and brl_per_unit is not null").dropDuplicates(["currency"]).limit(MOST_RATES + 1).collect()
    if len(pairs) > MOST_RATES:
        raise ValueError(f"more than {MOST_RATES} currencies")
    table = conversions(money.sparkSession, [tuple(p) for p in pairs])
    once = money.select("money_id", "original", "value", "currency", "context").where("money_id is not null").dropDuplicates(["money_id"])
    known = settled(read(once).select("money_id", "amount", "unit")).where("amount is not null and unit is not null")
    exact = F.col("amount") * F.col("factor") + F.col("offset")
    return known.join(F.broadcast(table), "unit").select("money_id", F.round(exact, 0).cast("bigint").alias("brl_cents"), "unit")
