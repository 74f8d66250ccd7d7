"""Benchmark decontamination (operator 8): a distributed positional inverted index, in DataFrame operations only.

The test texts are cut into windows of `size` words. Terms of the windows are counted over the whole corpus; each
window is anchored at its rarest terms, and the corpus' postings of these terms (document, position) are stored.
The lists of a window's anchors, moved by their offsets in the window, are intersected from the rarest on. A posting
of a window's rarest term carries the words around it, by which what is left is checked word for word: an exact
phrase, and with a `slop` a proximity match: all words of the window, each as often as the window has it, in any order
among as many consecutive words as the window has and `slop` more.

Hot terms: counts are aggregated before the shuffle; only anchors have postings, and joins on them are plain
equi-joins that adaptive execution splits. Test side tables are broadcast up to MAX_BROADCAST bytes and joined by
shuffle beyond; what is sent with a token then is the words around it, never its whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlog.session import materialize

#: What stands between words, before letters are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes (of the rows as text) of a table of the test side that may be broadcast.
MAX_BROADCAST = 48 << 20
#: Lists that are intersected for a window; more than 2 pay only for windows of frequent words throughout.
ANCHORS = 2


def raw_words(text: Column) -> Column:
    """Words in their own case; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def lower_ascii(word: Column) -> Column:
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def _is_small(df: DataFrame) -> bool:
    """Whether `df` (materialized) may be broadcast, by the bytes of its rows."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))) + 64)).first()[0]
    return (size or 0) <= MAX_BROADCAST


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if _is_small(df) else df


def windows(items: DataFrame, size: int = 10) -> tuple[DataFrame, DataFrame]:
    """(wid, words) of the distinct windows, and (wid, item_id) of the items they stand in."""
    own = items.select(F.col("item_id").cast("string").alias("item_id"), F.transform(raw_words(F.col("text")), lower_ascii).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    cut = own.where(F.size("w") > 0).select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words")).distinct()
    cut = materialize(cut, "windows")
    wins = materialize(cut.select("words").distinct().select(F.monotonically_increasing_id().alias("wid"), "words"), "windows")
    return wins, cut.join(wins, "words").select("wid", "item_id")


def _holds(words: Column, part: Column) -> Column:
    """Whether `part` has every one of `words`, as often as they do."""
    times = lambda a, w: F.size(F.filter(a, lambda x: x == w))
    return F.forall(F.array_distinct(words), lambda w: times(part, w) >= times(words, w))


def phrase_matches(docs: DataFrame, wins: DataFrame, size: int = 10, slop: int | None = None, anchors: int = ANCHORS) -> DataFrame:
    """(doc_id, h, wid, start, n, exact): where windows stand in documents; h is a hash of the text, start counts
    words from 0. Windows have at most `size` words; n is the window's.

    Without a `slop` the exact phrases. With one the proximity matches too, once for every word of the window from
    which the n + slop words on (fewer at the text's end) hold all of its words; `exact` tells whether the phrase
    itself starts there.
    """
    reach = size - 1 + (slop or 0)
    terms = wins.select("wid", F.size("words").alias("n"), F.posexplode("words").alias("off", "term"))
    vocabulary = _small(materialize(terms.select("term").distinct(), "terms"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), raw_words(F.col("text")).alias("w"))
    tokens = own.select(F.explode("w").alias("raw")).select(lower_ascii(F.col("raw")).alias("term"))
    counts = tokens.join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    counted = terms.join(materialize(counts, "counts"), "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    # Without windows that have a word which the corpus lacks.
    whole = F.min("df").over(W.partitionBy("wid")) > 0
    ranked = counted.withColumn("whole", whole).where("whole")
    ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("wid").orderBy("df", "off"))).where(F.col("rank") <= anchors)
    plan = materialize(ranked.select("wid", "n", "off", "term", "rank"), "anchors")
    keyed = materialize(plan.groupBy("term").agg((F.min("rank") == 1).alias("rarest")), "anchors")

    before = F.least(F.col("pos"), F.lit(reach))
    around = F.slice("w", F.col("pos") - before + 1, before + reach + 1)
    places = own.select("doc_id", "h", "w", F.posexplode("w").alias("pos", "raw")).select("doc_id", "h", "w", "pos", lower_ascii(F.col("raw")).alias("term"))
    if _is_small(keyed):
        places = places.join(F.broadcast(keyed), "term").withColumn("around", around)
    else:
        places = places.withColumn("around", around).drop("w").join(keyed, "term")
    postings = materialize(places.select("term", "doc_id", "h", "pos", F.when(F.col("rarest"), F.col("around")).alias("around")), "postings")

    first = materialize(plan.where("rank = 1").join(wins, "wid"), "anchors")
    found = postings.where("around is not null").join(_small(first), "term")
    found = found.select("wid", "n", "doc_id", "h", (F.col("pos") - F.col("off")).alias("start"), "words", "around", "off", "pos")
    if slop is None:
        found = found.where("start >= 0")
    # Without a slop the place is part of the key; with one the stretch of places that it is in, or the next.
    stretch = 2 * (reach + 1)
    slot = F.col("pos") if slop is None else F.floor(F.col("pos") / stretch)
    lists = postings.select(F.col("term").alias("t"), F.col("doc_id").alias("d"), F.col("h").alias("g"), F.col("pos").alias("p"), slot.alias("slot"))
    for rank in range(2, anchors + 1):
        nxt = materialize(plan.where(F.col("rank") == rank).select(F.col("wid").alias("w2"), F.col("term").alias("t2"), F.col("off").alias("o2")), "anchors")
        found = found.join(_small(nxt), F.col("wid") == F.col("w2"), "left")
        same = (F.col("t2") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")) & (F.col("at") == F.col("slot"))
        if slop is None:
            found = found.withColumn("at", F.col("start") + F.col("o2"))
        else:
            ends = F.array(*[F.floor((F.col("pos") + x) / stretch) for x in (-reach, reach)])
            found = found.withColumn("at", F.explode(F.array_distinct(ends)))
            same = same & (F.abs(F.col("pos") - F.col("p")) < F.col("n") + slop)
        alone = found.where("t2 is null").drop("w2", "t2", "o2", "at")  # fewer words than anchors
        found = found.where("t2 is not null").join(lists, same, "left_semi").drop("w2", "t2", "o2", "at").unionByName(alone)
    # `around` starts at word pos - least(pos, reach) of the document.
    origin = F.col("pos") - F.least(F.col("pos"), F.lit(reach))
    lowered = F.transform("around", lower_ascii)
    if slop is None:
        # The lower bound of 1 is for rows with a start below 0 only, which the filter above may meet after this expression.
        part = F.slice(lowered, F.greatest(F.col("start") - origin + 1, F.lit(1)).cast("int"), F.col("n"))
        found = found.where(part == F.col("words")).withColumn("exact", F.lit(True))
        return found.select("doc_id", "h", "wid", "start", "n", "exact").distinct()
    near = found.select("wid", "n", "doc_id", "h", "words", "pos", origin.alias("origin"), lowered.alias("seen")).where(F.size(F.array_except("words", "seen")) == 0)
    near = materialize(near, "near")  # few; and so that what follows reads `seen` instead of making it again for every place
    # A match holds this posting, so it starts at most n + slop - 1 words before it.
    lead = F.greatest(F.col("pos") - F.col("n") - slop + 1, F.lit(0)).cast("int")
    cut = lambda s: F.slice("seen", (s - F.col("origin") + 1).cast("int"), F.col("n") + slop)
    starts = F.explode(F.transform(F.sequence(lead, F.col("pos")), lambda s: F.struct(s.alias("start"), cut(s).alias("part"))))
    near = near.select("wid", "n", "doc_id", "h", "words", starts.alias("x")).select("wid", "n", "doc_id", "h", "words", "x.start", "x.part")
    near = near.where(F.array_contains("words", F.get("part", F.lit(0))) & (F.size(F.array_except("words", "part")) == 0) & _holds(F.col("words"), F.col("part")))
    return near.select("doc_id", "h", "wid", "start", "n", (F.slice("part", 1, F.col("n")) == F.col("words")).alias("exact")).distinct()


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, slop: int | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of `docs`; with a `slop` also n_near, the
    items with a window that has a proximity match (exact ones included).

    A document word inside an occurrence of a window is hit; texts and words may be of any length. Null and empty texts have no words; a repeated row gets
    the same result as its copy; items without an item_id hit but aren't listed; either table may be empty. Other
    columns of both tables are not read.
    """
    wins, members = windows(items, size)
    matches = materialize(phrase_matches(docs, wins, size, slop), "matches")
    hits = matches.where("exact").select("doc_id", "h", "wid", "start", "n")
    at = hits.select("doc_id", "h", "start", "n").distinct()
    spots = at.select("doc_id", "h", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("p")).distinct()
    n_hit = spots.groupBy("doc_id", "h").agg(F.count("*").alias("n_hit"))
    near = matches.groupBy("doc_id", "h", "wid").agg(F.bool_or("exact").alias("exact"))
    named = near.join(members, "wid").groupBy("doc_id", "h", "item_id").agg(F.bool_or("exact").alias("exact"))
    # Grouped, so that null ids meet like others.
    listed = named.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.when(F.col("exact"), F.col("item_id")))).alias("ids"), F.count("item_id").alias("n_near"))
    both = n_hit.select("doc_id", "h", "n_hit", F.lit(None).cast("array<string>").alias("ids"), F.lit(0).cast("long").alias("n_near"))
    both = both.unionByName(listed.select("doc_id", "h", F.lit(0).cast("long").alias("n_hit"), "ids", "n_near"))
    found = both.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g")).agg(F.max("n_hit").alias("n_hit"), F.first("ids", True).alias("ids"), F.max("n_near").alias("n_near"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.size(raw_words(F.col("text"))).cast("long").alias("n_words"))
    out = base.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    more = [] if slop is None else [F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")]
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), *more)
