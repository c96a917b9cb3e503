"""Texts that a field limit or a transfer cut off.

The corpus itself tells which words and word sequences exist and which of them end sentences. Its vocabulary is a trie
whose nodes are rows: every proper prefix of a word, alone and after a given word. A text whose last token is an unknown
proper prefix of known words broke inside a word; one whose last words always go on elsewhere broke inside a sentence;
lengths at which a source's unfinished texts pile up are field limits. Everything is counted over all texts and joined
by key, nothing is broadcast.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.runtime import checkpointed, settled

#: Different unfinished texts of one length that a source needs for a field limit, their least share of the source's
#: unfinished texts, and how many times the mean of the lengths within NEAR around it.
LIMIT_COUNT, LIMIT_SHARE, LIMIT_RATIO, NEAR = 3, 0.04, 6.0, 15
#: Uses that a context of two words (else of one) needs to judge the word that follows it.
CONTEXT = 5
#: A tail used so often that is followed by a sentence's end in less than this share of its uses goes on elsewhere.
USES, ENDING_SHARE = 2, 0.02
#: Texts that a tail must end, besides that share of its uses, to be a way to end a text.
CLOSING = 5

_CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー"
_TOKEN = rf"[{_CJK}]|\p{{L}}[\p{{L}}\p{{M}}'’]*|0|[.…]"
_BLANKS = " \t\n\r\x0b\x0c\x85\u00a0\u2028\u2029\u3000"
_END = r"[.!?。！？][\s\"'”’»)\]]*$"
_BROKEN = r"(�|&[a-zA-Z#0-9]{0,6}|<[a-zA-Z/]{0,5}|\\u?[0-9a-fA-F]{0,3})$"
_DOTS = r"(\.\.\.|…)$"
_OPEN = r"[,;:(\[¿¡–—«“/&+=-]$"


def _tokens(text: Column) -> Column:
    """Words in lower case, digits as 0, `.` for marks that end a sentence and `…` for dots; other marks are left out."""
    low = F.regexp_replace(F.regexp_replace(F.lower(text), r"\d+", "0"), r"\.\.+|…", " … ")
    return F.regexp_extract_all(F.translate(low, "!?。！？", "....."), F.lit(_TOKEN), F.lit(0))


def _is_end(t: Column) -> Column:
    return t.isin(".", "…")


def grams(docs: DataFrame) -> DataFrame:
    """Each token with the two before it (within the sentence) and what follows: prev2, prev1, word, next (`word`, `stop`
    or `end` of the text; dots, which may stand for a cut, count as that). docs: tokens."""
    t, edge = F.col("tokens"), F.lit("^")
    # The tokens beside themselves, shifted; what lies before a sentence's start becomes an edge afterwards.
    shifted = F.arrays_zip(F.concat(F.array(edge, edge), t).alias("p2"), F.concat(F.array(edge), t).alias("p1"), t.alias("word"), F.slice(t, 2, 1 << 30).alias("n"))
    rows = docs.where("size(tokens) > 0").select(F.inline(shifted)).where(F.col("word").isNotNull() & ~_is_end(F.col("word")))
    p1 = F.when(_is_end(F.col("p1")), edge).otherwise(F.col("p1"))
    p2 = F.when(_is_end(F.col("p2")) | (p1 == edge), edge).otherwise(F.col("p2"))
    n = F.col("n")
    return rows.select(p2.alias("prev2"), p1.alias("prev1"), "word", F.when(n.isNull() | (n == "…"), "end").when(n == ".", "stop").otherwise("word").alias("next"))


def limits(unfinished: DataFrame) -> DataFrame:
    """source, unit (`chars` or `bytes`), length: lengths at which unfinished texts pile up. unfinished: source, h (a hash of
    the text), length, octets of each such text."""
    units = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("length")), F.struct(F.lit("bytes").alias("unit"), F.col("octets").alias("length")))).alias("u")
    hist = unfinished.select("source", "h", units).select("source", "h", "u.*").distinct().groupBy("source", "unit", "length").agg(F.count("*").alias("n"))
    near = W.partitionBy("source", "unit").orderBy("length").rangeBetween(-NEAR, NEAR)
    around = (F.sum("n").over(near) - F.col("n")) / (2 * NEAR)
    share = F.col("n") / F.sum("n").over(W.partitionBy("source", "unit"))
    return hist.withColumns({"around": around, "share": share}).where((F.col("n") >= LIMIT_COUNT) & (F.col("share") >= LIMIT_SHARE) & (F.col("n") >= LIMIT_RATIO * F.col("around"))).select("source", "unit", "length")


def judge(documents: DataFrame) -> DataFrame:
    """doc_id, source, cut and why (`broken`, `word`, `phrase`, `limit`, `marker` or null) of every text.

    documents: doc_id, text, source; other columns are ignored. Null, empty and blank texts are not cut. A text that
    merely lacks its full stop is not cut; one that ends in dots is only cut if they stand in a broken word or at a field
    limit. A null source is a source of its own. doc_id must be unique; an empty table gives an empty table."""
    text = F.col("text")
    tail = F.rtrim(text, F.lit(_BLANKS))
    docs = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")
    docs = docs.withColumn("tail", F.right(tail, F.lit(400))).withColumn("last", F.right(F.col("tail"), F.lit(24)))
    ended = F.col("last").rlike(_END) & ~F.col("last").rlike(_DOTS)
    docs = docs.withColumn("open", F.coalesce(~ended & (F.length("tail") > 0), F.lit(False)))
    g = grams(docs.select(_tokens(text).alias("tokens")))
    # One pass over the tokens; all tables below come from these counts.
    counts = checkpointed(
        g.groupBy("prev2", "prev1", "word").agg(F.count_if(F.col("next") == "word").alias("mid"), F.count_if(F.col("next") == "stop").alias("stop"), F.count_if(F.col("next") == "end").alias("end"))
    )
    uses = F.col("mid") + F.col("stop")
    three = counts.withColumn("n", uses)
    two = three.groupBy("prev1", "word").agg(*[F.sum(c).alias(c) for c in ("mid", "stop", "end", "n")])
    one = two.groupBy("word").agg(F.sum("n").alias("n"))

    # Candidates: texts without an end mark; dots are taken off, they may stand for a cut.
    bare = F.regexp_replace(F.regexp_replace(F.col("tail"), _DOTS, ""), r"\s+$", "")
    cand = docs.where("open").select("doc_id", "source", F.xxhash64("text").alias("h"), F.length("text").alias("length"), F.octet_length("text").alias("octets"), bare.alias("bare"), F.col("last").rlike(_DOTS).alias("dots"), F.col("last").rlike(_BROKEN).alias("broken"))
    mine = _tokens(F.col("bare"))
    cand = cand.withColumn("t", F.slice(F.concat(F.array(F.lit("."), F.lit(".")), mine), -3, 3))
    x = lambda i: F.get("t", F.lit(i))
    p1 = F.when(_is_end(x(1)), F.lit("^")).otherwise(x(1))
    cand = cand.select(
        "doc_id", "source", "h", "length", "octets", "dots", "broken",
        x(2).alias("word"), p1.alias("prev1"), F.when(_is_end(x(1)) | _is_end(x(0)), F.lit("^")).otherwise(x(0)).alias("prev2"),
        F.col("bare").rlike(r"\p{L}\p{M}*$").alias("letter"), F.col("bare").rlike(_OPEN).alias("hanging"),
    )
    cand = checkpointed(settled(cand))  # short rows, read again below
    # Each distinct tail is looked up once, so that a tail shared by a third of all texts is one row.
    ends = tails = checkpointed(cand.select("prev2", "prev1", "word").distinct())
    def nodes(df: DataFrame, name: str, *by: str) -> DataFrame:
        """Inner nodes of the trie of words used after `by`: their proper prefixes. Only where a text ends after `by`."""
        known = df.where((F.col("n") > 0) & F.length("word").between(2, 60))
        known = known.join(ends.select(*by).distinct(), [*by], "left_semi") if by else known
        prefix = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), F.lit(1), i)))
        return known.select(*by, prefix.alias("word")).distinct().withColumn(name, F.lit(True))

    tails = tails.join(three.select("prev2", "prev1", "word", F.col("n").alias("n3"), F.col("stop").alias("stop3"), F.col("end").alias("end3")), ["prev2", "prev1", "word"], "left")
    tails = tails.join(three.groupBy("prev2", "prev1").agg(F.sum("n").alias("c3")), ["prev2", "prev1"], "left")
    tails = tails.join(nodes(three, "inner3", "prev2", "prev1"), ["prev2", "prev1", "word"], "left")
    tails = tails.join(two.select("prev1", "word", F.col("n").alias("n2"), F.col("stop").alias("stop2"), F.col("end").alias("end2")), ["prev1", "word"], "left")
    tails = tails.join(two.groupBy("prev1").agg(F.sum("n").alias("c2")), "prev1", "left")
    tails = tails.join(nodes(two, "inner2", "prev1"), ["prev1", "word"], "left")
    tails = tails.join(one.select("word", F.col("n").alias("n1")), "word", "left").join(nodes(one, "inner1"), "word", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    broke = lambda k: (n(f"n{k}") == 0) & F.col(f"inner{k}").isNotNull()
    # The longest context that the corpus knows well enough decides; a word it never saw there is odd, not cut.
    inside = F.when(n("c3") >= CONTEXT, broke(3)).when(n("c2") >= CONTEXT, broke(2)).otherwise(broke(1) & (n("end3") <= 2))
    # A cut falls on a given place of a given phrase very rarely; what ends texts more often is a way to end them.
    closes = lambda k: (n(f"end{k}") >= n(f"n{k}")) | (n(f"end{k}") >= CLOSING) & (n(f"end{k}") >= ENDING_SHARE * n(f"n{k}"))
    goes_on = lambda k: (n(f"stop{k}") < ENDING_SHARE * n(f"n{k}")) & ~closes(k)
    phrase = F.when(n("n3") >= USES, goes_on(3)).when(n("c3") >= CONTEXT, False).when(n("n2") >= USES, goes_on(2)).otherwise(False)
    closing = (n("n3") == 0) & ~inside  # as often as it may end texts, no text goes on after it
    tails = tails.select("prev2", "prev1", "word", inside.alias("inside"), phrase.alias("phrase"), closing.alias("closing"))
    cand = cand.join(tails, ["prev2", "prev1", "word"], "left")
    known = limits(cand)
    chars = known.where("unit = 'chars'").select("source", "length", F.lit(True).alias("at_chars"))
    octets = known.where("unit = 'bytes'").select("source", F.col("length").alias("octets"), F.lit(True).alias("at_bytes"))
    cand = cand.join(chars, ["source", "length"], "left").join(octets, ["source", "octets"], "left")
    at_limit = F.coalesce("at_chars", "at_bytes", F.lit(False))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    why = (
        F.when(F.col("broken"), "broken")
        .when(F.col("dots"), F.when(at_limit, "marker").when(yes("inside") & F.col("letter") & (F.length("word") > 0), "word"))
        .when(F.col("letter") & yes("inside"), "word")
        .when(F.col("hanging") & at_limit, "limit")
        .when(F.col("hanging") & F.col("word").isNotNull(), "phrase")
        .when(F.col("letter") & yes("phrase"), "phrase")
        .when(at_limit & ~yes("closing") & F.col("letter"), "limit")
    )
    found = cand.select("doc_id", why.alias("why")).where("why is not null")
    return docs.select("doc_id", "source").join(found, "doc_id", "left").withColumn("cut", F.col("why").isNotNull())


def shares(judged: DataFrame) -> DataFrame:
    """source, n_texts, n_cut, share: how often each source cuts."""
    return judged.groupBy("source").agg(F.count("*").alias("n_texts"), F.count_if("cut").alias("n_cut")).withColumn("share", F.col("n_cut") / F.col("n_texts"))
