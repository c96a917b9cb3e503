"""Date mentions in many notations to one unambiguous form.

A mention is cut by two patterns into a date, a time and a zone. Numeric dates with the year last can be read with the
day or the month first; which one holds is settled per origin by expectation-maximisation over the two readings. All
of it is built-in expressions; nothing leaves the JVM.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import checkpointed, settled

# Month names and zone abbreviations with their offsets in minutes.
MONTHS = {
    1: ("january", "januar", "janeiro", "jan"),
    2: ("february", "februar", "fevereiro", "feb", "fev"),
    3: ("march", "märz", "maerz", "março", "marco", "mar", "mär"),
    4: ("april", "abril", "apr", "abr"),
    5: ("may", "mai", "maio"),
    6: ("june", "juni", "junho", "jun"),
    7: ("july", "juli", "julho", "jul"),
    8: ("august", "agosto", "aug", "ago"),
    9: ("september", "setembro", "sept", "sep", "set"),
    10: ("october", "oktober", "outubro", "oct", "okt", "out"),
    11: ("november", "novembro", "nov"),
    12: ("december", "dezember", "dezembro", "dec", "dez"),
}
ZONES = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "bst": 60, "ist": 330, "jst": 540,
    "brt": -180, "brst": -120, "art": -180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
}

#: Prior weight of the order that the origin's day_first names, and of the other one, in mentions.
PRIOR, OTHER = 50.0, 0.5
#: Steps of expectation-maximisation; the two-reading mixture converges within a few.
STEPS = 25
#: Origins whose zones and shares are broadcast.
ORIGINS = 10_000
#: Least posterior of a reading to be chosen; below it the mention stays ambiguous.
CERTAIN = 0.9

_MONTH = "|".join(sorted({n for names in MONTHS.values() for n in names}, key=len, reverse=True))
_ZONE = r"[a-z]{1,5}|\(?(?:utc|gmt) ?[+-]\d{1,2}(?::?\d{2})?\)?|[+-]\d{2}:?\d{2}"
_DATE = rf"(?:(\d{{4}})([-/.])(\d{{1,2}})\g2(\d{{1,2}})|(\d{{4}})-(\d{{3}})|(\d{{4}})(\d{{2}})(\d{{2}})|(\d{{1,2}})([-/.])(\d{{1,2}})\g11(\d{{4}}|\d{{2}})|(\d{{1,2}})[.º]?(?: de)? ({_MONTH})\.?(?: de|,)? (\d{{4}})|({_MONTH})\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}}))"
_TIME = rf"(\d{{1,2}})(?::(\d{{2}})(?::(\d{{2}})(?:[.,](\d{{1,6}}))?)?(?: ?h)?|h(\d{{2}})?)(?: ?([ap]\.?m)\.?)?(?: ?({_ZONE}))?"


def _java(p: str) -> str:
    """Backreferences as Java writes them."""
    return p.replace(r"\g2", r"\2").replace(r"\g11", r"\11")


# Date first, time after it or none; groups 1-19 are the date's, 20-26 the time's.
FULL = _java(rf"^(?:[a-zç]{{2,9}}\.?, )?{_DATE}(?:(?:t|,? ?(?:às|as|at|-) ?|,? ){_TIME})?$")
_N = 27
# "20:36 de 16 de fev. de 2019": the time stands before; compact stamps: 20250525T183907Z; counts since 1970.
BEFORE = r"^(\d{1,2}:\d{2}) (?:de|of|on) (.+)$"
COMPACT = rf"^(\d{{4}})(\d{{2}})(\d{{2}})t(\d{{2}})(\d{{2}})(\d{{2}})({_ZONE})?$"
EPOCH = r"^(\d{10}|\d{13})$"


def normal(original: Column) -> Column:
    """Lower case, one kind of space and minus, no blanks or marks at the ends."""
    t = F.regexp_replace(F.lower(original), r"[\s  -​ 　]+", " ")
    t = F.translate(t, "−–—", "---")
    t = F.regexp_replace(F.trim(t), r"[ .,;]+$", "")
    t = F.regexp_replace(t, BEFORE, "$2 $1")
    return F.regexp_replace(t, COMPACT, "$1-$2-$3t$4:$5:$6$7")


def _lookup(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _day(y: Column, m: Column, d: Column) -> Column:
    """The date, null where there is none such."""
    return F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")


def readings(df: DataFrame) -> DataFrame:
    """df with what each reading of `original` gives: `epoch_us`, `sure` (dates with one reading), `dmy`, `mdy` (numeric
    dates, null where that reading is no date), the time of day in microseconds `tod_us` and `zone_min`, minutes east."""
    df = df.withColumn("_t", normal(F.col("original")))  # a column of its own, so it is built once
    t = F.col("_t")
    # What the pattern does not match stays as it is and has no bars.
    parts = F.split(F.regexp_replace(t, FULL, "|".join(f"${i}" for i in range(1, _N))), r"\|")
    df = df.withColumn("_p", parts).withColumn("_p", F.when(F.size("_p") == _N - 1, F.col("_p")))
    g = lambda i: F.nullif(F.get(F.col("_p"), F.lit(i - 1)), F.lit(""))
    month = _lookup({n: str(k) for k, names in MONTHS.items() for n in names})
    year = lambda c: F.when(F.length(c) == 2, F.concat(F.lit("20"), c)).otherwise(c)
    doy = g(6).cast("int")
    first = F.concat(g(5), F.lit("-01-01")).try_cast("date")
    leap = F.dayofyear(F.concat(g(5), F.lit("-12-31")).try_cast("date"))
    ordinal = F.when((doy >= 1) & (doy <= leap), F.date_add(first, doy - 1))
    sure = F.coalesce(
        F.when(g(1).isNotNull(), _day(g(1), g(3), g(4))),
        F.when(g(5).isNotNull(), ordinal),
        F.when(g(7).isNotNull(), _day(g(7), g(8), g(9))),
        F.when(g(15).isNotNull(), _day(g(16), month[g(15)], g(14))),
        F.when(g(17).isNotNull(), _day(g(19), month[g(17)], g(18))),
    )
    hour, minute, second = (F.coalesce(g(i).cast("int"), F.lit(0)) for i in (20, 21, 22))
    minute = F.coalesce(g(24).cast("int"), minute)
    half = F.substring(g(25), 1, 1)
    ok = (minute < 60) & (second < 60) & F.when(half.isNull(), hour < 24).otherwise((hour >= 1) & (hour <= 12))
    hour = F.when(half.isNull(), hour).otherwise(hour % 12 + F.when(half == "p", 12).otherwise(0))
    micros = F.rpad(F.coalesce(g(23), F.lit("0")), 6, "0").cast("bigint")
    tod = F.when(g(20).isNotNull(), F.when(ok, ((hour * 60 + minute) * 60 + second).cast("bigint") * 1_000_000 + micros))
    return df.select(
        "*",
        F.when(F.col("_t").rlike(EPOCH), F.rpad(F.col("_t"), 16, "0").cast("bigint")).alias("epoch_us"),
        sure.alias("sure"),
        F.when(g(10).isNotNull(), _day(year(g(13)), g(12), g(10))).alias("dmy"),
        F.when(g(10).isNotNull(), _day(year(g(13)), g(10), g(12))).alias("mdy"),
        g(20).isNotNull().alias("timed"),
        tod.alias("tod_us"),
        F.get(F.col("_p"), F.lit(25)).alias("zone_text"),
    ).drop("_t", "_p")


def zone_minutes(zone: Column) -> Column:
    """Minutes east of UTC of `z`, `utc-2`, `(gmt+5:30)`, `-0330` or an abbreviation; null if none of these."""
    off = r"^\(?(?:utc|gmt)? ?([+-])(\d{1,2}):?(\d{2})?\)?$"
    sign = F.when(F.regexp_extract(zone, off, 1) == "-", -1).otherwise(1)
    minutes = F.regexp_extract(zone, off, 2).try_cast("int") * 60 + F.coalesce(F.regexp_extract(zone, off, 3).try_cast("int"), F.lit(0))
    return F.when(zone.rlike(off), sign * minutes).otherwise(_lookup(ZONES)[zone]).cast("bigint")


def _iso(us: Column) -> Column:
    """Microseconds since 1970 as text in UTC, whatever the session's time zone."""
    day = F.floor(us / F.lit(86_400_000_000).cast("decimal(20,0)")).cast("int")
    tod = us - day.cast("bigint") * 86_400_000_000
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    unit = lambda n: F.floor(tod / n).cast("bigint")
    return F.concat(
        F.date_from_unix_date(day).cast("string"), F.lit("T"), two(unit(3_600_000_000)), F.lit(":"), two(unit(60_000_000) % 60), F.lit(":"), two(unit(1_000_000) % 60), F.lit("."),
        F.lpad((tod % 1_000_000).cast("string"), 6, "0"), F.lit("Z"),
    )


_COUNTS = ("n_dmy", "n_mdy", "n_both")


def mixtures(read: DataFrame, zones: DataFrame) -> DataFrame:
    """origin, zone_name, pi of every origin in the data and in zones (null too): the share of day-first among its numeric
    dates, by expectation-maximisation: a date valid one way counts for that way, one valid both ways in parts as likely
    as the last share says. Three counts per origin are enough for it, so a hot origin is pre-aggregated and nothing is
    gathered. What zones says of an origin is a prior; an origin that it lacks has only its own dates."""
    both = F.col("dmy").isNotNull() & F.col("mdy").isNotNull()
    counts = read.groupBy("origin").agg(
        F.count_if(F.col("dmy").isNotNull() & F.col("mdy").isNull()).alias("n_dmy"), F.count_if(F.col("mdy").isNotNull() & F.col("dmy").isNull()).alias("n_mdy"), F.count_if(both).alias("n_both")
    )
    counts = counts.withColumnRenamed("origin", "_origin")
    known = zones.join(counts, F.col("origin").eqNullSafe(F.col("_origin")), "full").withColumn("origin", F.coalesce("origin", "_origin")).drop("_origin").fillna(0, list(_COUNTS))
    day = F.when(F.col("day_first"), PRIOR).when(~F.col("day_first"), OTHER).otherwise(1.0)
    month = F.when(F.col("day_first"), OTHER).when(~F.col("day_first"), PRIOR).otherwise(1.0)
    total = day + month + F.col("n_dmy") + F.col("n_mdy") + F.col("n_both")
    step = lambda pi, _: (day + F.col("n_dmy") + F.col("n_both") * pi) / total
    return known.withColumn("pi", F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.lit(0.5), step)).drop(*_COUNTS)


def normalise(mentions: DataFrame, zones: DataFrame) -> DataFrame:
    """One row per mention_id: `stamp`, `status` (`date`, `instant`, `ambiguous`, `no_zone`, `no_date`), `reading`,
    `posterior`.

    mentions: mention_id, original, origin; zones: origin, zone_name, day_first. One row per origin, with its zone and
    share, is broadcast if there are at most ORIGINS, else joined by key. A null or unreadable original, a date that does not
    exist and a vague one are `no_date`; a local time without zone and origin is `no_zone`; a numeric date that no
    reading wins is `ambiguous`; these have a null stamp. Local times that occur twice mean the earlier instant, skipped
    ones move forward by the gap. Rows without mention_id are left
    out, repeated ones count once; other columns are dropped; empty tables give empty ones."""
    once = mentions.select("mention_id", "original", "origin").where("mention_id is not null").dropDuplicates(["mention_id"])
    # Written once: the patterns are costly, and both the counts and the choice need what they find.
    read = checkpointed(settled(readings(once)))
    zones = zones.select("origin", "zone_name", "day_first").where("origin is not null").dropDuplicates(["origin"])
    mixed = checkpointed(mixtures(read, zones).withColumnRenamed("origin", "_origin"))
    few = mixed.limit(ORIGINS + 1).count() <= ORIGINS
    read = read.join(F.broadcast(mixed) if few else mixed, F.col("origin").eqNullSafe(F.col("_origin")), "left").drop("_origin")
    pi = F.coalesce("pi", F.lit(0.5))
    both = F.col("dmy").isNotNull() & F.col("mdy").isNotNull() & (F.col("dmy") != F.col("mdy"))
    posterior = F.when(both, F.greatest(pi, 1 - pi)).otherwise(F.lit(1.0))
    dmy_first = F.when(both, pi >= 0.5).otherwise(F.col("dmy").isNotNull())
    numeric = F.when(dmy_first, F.col("dmy")).otherwise(F.col("mdy"))
    day = F.coalesce("sure", numeric)
    reading = F.when(F.col("epoch_us").isNotNull(), "epoch").when(F.col("sure").isNotNull(), "fixed").when(numeric.isNotNull(), F.when(dmy_first, "day_first").otherwise("month_first"))
    has_zone = F.coalesce("zone_text", F.lit("")) != ""
    offset = zone_minutes(F.col("zone_text"))
    local = F.timestamp_micros(F.unix_date("day").cast("bigint") * 86_400_000_000 + F.col("tod_us"))
    instant = F.when(has_zone, F.timestamp_micros(F.unix_micros(local) - offset * F.lit(60_000_000).cast("bigint"))).otherwise(F.to_utc_timestamp(local, F.col("zone_name")))
    out = read.select("mention_id", "epoch_us", "timed", "tod_us", "zone_text", "zone_name", posterior.alias("posterior"), reading.alias("reading"), day.alias("day"))
    out = out.withColumn("at", F.when(F.col("epoch_us").isNotNull(), F.timestamp_micros("epoch_us")).when(F.col("timed"), instant))
    status = (
        F.when(F.col("epoch_us").isNotNull(), "instant")
        .when(F.col("day").isNull() | (F.col("timed") & F.col("tod_us").isNull()) | (has_zone & offset.isNull()), "no_date")
        .when(F.col("posterior") < CERTAIN, "ambiguous")
        .when(~F.col("timed"), "date")
        .when(F.col("at").isNull(), "no_zone")
        .otherwise("instant")
    )
    out = out.withColumn("status", status)
    stamp = F.when(F.col("status") == "date", F.col("day").cast("string")).when(F.col("status") == "instant", _iso(F.unix_micros("at")))
    return settled(out.select("mention_id", stamp.alias("stamp"), "status", "reading", "posterior"))
