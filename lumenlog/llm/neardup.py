"""Operator 4 with a similarity instead of a budget of bits: documents whose word shingles have a Jaccard similarity of
at least t.

SimHash alone can't keep that bound: at a similarity of 0.8 two fingerprints differ in about 10 of 64 bits, in up to
18 of some pairs, and so do unrelated texts of a large corpus. So links are found in three rounds, each among what
the rounds before it left apart, and every link is checked by the exact similarity of the shingles:

1. fingerprints within `max_bits` bits, by the trie self-join of `simhash`;
2. each set with the centre of each shingle of its prefix: of the sets that have it, the one whose leading shingles are
   the most frequent, which of edited copies is the text that they were made from;
3. all others that share a shingle of their prefixes.

Rounds 2 and 3 are an exact similarity self-join: with all sets in one order of the shingles, rare ones first, two
sets of similarity t or more have at least m = t (n_a + n_b) / (1 + t) shingles in common, so they share one within the
first n_a - m + 1 of one and the first n_b - m + 1 of the other. The join asks for that, so copies with more edits than
the bound allows don't meet on what all copies share. A large group of near copies is held together after round 1 or 2
and isn't compared pair by pair.

What meets is first compared by parities: a set has about as many bits as shingles, and each shingle flips the bit that
its hash names. Bits in which two sets differ are shingles that only one of them has, at least, which bounds what they
can have in common. So pairs of unlike sets never carry shingles with them, however many such pairs there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import lean, strings
from lumenlog.llm.simhash import links, majority, shingle_hashes
from lumenlog.operators.graph import connected_components
from lumenlog.session import discard, materialize

#: Documents (about) whose shingles are counted for the order, and shingles whose counts are broadcast. The order
#: decides how many pairs are compared, never the result.
SAMPLE, COMMON = 5_000, 1 << 16


def shingles(text: str, words: int = 5) -> np.ndarray:
    """The hashes of the distinct shingles, ascending."""
    return np.unique(shingle_hashes(text, words))


def parities(own: np.ndarray) -> np.ndarray:
    """For each residue of the hashes, modulo the power of two (64 at least) that their number reaches, whether an odd
    number of them has it; in words of 64 bits."""
    n = 1 << max(6, (len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(n - 1)).view(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def differing(a: str, b: str) -> Column:
    """In how many bits the parities in the columns `a` and `b` differ; the longer ones are folded to the shorter."""
    size = f"least(size({a}), size({b}))"
    fold = lambda x: f"if(size({x}) = {size}, {x}, transform(sequence(0, {size} - 1), j -> aggregate(sequence(0, size({x}) div {size} - 1), 0L, (v, k) -> v ^ {x}[j + k * {size}])))"
    return F.expr(f"aggregate(zip_with({fold(a)}, {fold(b)}, (x, y) -> bit_count(x ^ y)), 0, (v, x) -> v + x)")


def _common(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that repeat in a sample of the documents, ascending, and how often they do."""
    parts = max(1, docs.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in strings(b.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t, words).view(np.int64))], names=["s"])

    few = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == 0).select("text").mapInArrow(lean(run), "s long")
    top = few.groupBy("s").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "s").limit(COMMON).toPandas()
    s, n = top["s"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(s)
    return s[order], n[order]


def _lists(rows: list[np.ndarray]) -> pa.Array:
    """Lists of longs with the bits of the rows' numbers."""
    ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, rows), dtype=np.int64, count=len(rows)))])
    flat = np.concatenate([np.array([], dtype=np.uint64), *rows]).view(np.int64)
    return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(flat)).cast(pa.list_(pa.int64()))


def _sets(docs: DataFrame, words: int, **picks) -> DataFrame:
    """doc_id, class (a hash of the set), n, fingerprint and, for each of `picks`, what it makes of the shingles of every
    row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            classes, n, prints, kept = [], [], [], [[] for _ in picks]
            for t in strings(b.column("text")):
                every = shingle_hashes(t, words)
                own = np.unique(every)
                classes.append(xxhash.xxh64_intdigest(own.tobytes(), 42))
                n.append(len(own))
                prints.append(majority(every))
                for at, pick in zip(kept, picks.values(), strict=True):
                    at.append(pick(own))
            longs = (pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (classes, n, prints))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *longs, *map(_lists, kept)], names=["doc_id", "class", "n", "fingerprint", *picks])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, class long, n long, fingerprint long" + "".join(f", {k} array<long>" for k in picks))


def shingle_sets(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, class, n, fingerprint and items (all shingles) of every row."""
    return _sets(docs, words, items=lambda s: s)


def prefixes(docs: DataFrame, words: int = 5, least: tuple[int, int] = (4, 5)) -> DataFrame:
    """doc_id, class, n, fingerprint, lead (the first n - ceil(t n) + 1 shingles in the common order) and bits (parities)
    of every row."""
    known = docs.sparkSession.sparkContext.broadcast(_common(docs, words))
    p, q = least

    def pick(own: np.ndarray) -> np.ndarray:
        s, count = known.value
        if len(s) and len(own):
            at = np.minimum(np.searchsorted(s, own), len(s) - 1)
            own = own[np.argsort(np.where(s[at] == own, count[at], 0), kind="stable")]
        return own[: len(own) + (-p * len(own) // q) + 1]

    return _sets(docs, words, lead=pick, bits=parities)


def similar_documents(docs: DataFrame, words: int = 5, least: tuple[int, int] = (4, 5), max_bits: int = 4) -> DataFrame:
    """doc_id and component_id of every row of `docs`: rows are linked when the Jaccard similarity of their shingles is
    at least the fraction `least`, and component_id is the smallest doc_id that links reach (null only where no row of
    the component has a doc_id). `max_bits` decides what the first round finds, never the result. Null and blank texts
    are alike; repeated rows stay; an empty table gives no rows; further columns are not read."""
    p, q = least
    if not 0 < p <= q:
        raise ValueError("least has to be over 0 and at most 1")
    sets = materialize(prefixes(docs, words, least), "sets")
    # Round 1: of the sets with one fingerprint the smallest stands for it, and each other is compared with that.
    alone = materialize(sets.where("n > 0").select("fingerprint", "class").distinct(), "classes")
    prints = materialize(alone.groupBy("fingerprint").agg(F.min("class").alias("low")), "prints")
    by_trie = materialize(links(prints.select("fingerprint"), prints.count(), max_bits), "near")
    one = lambda k: prints.select(F.col("fingerprint").alias(k), F.col("low").alias(f"low_{k}"))
    near = by_trie.join(one("a"), "a").join(one("b"), "b").select(F.least("low_a", "low_b").alias("a"), F.greatest("low_a", "low_b").alias("b"))
    same = alone.join(prints, "fingerprint").where("low <> class").select(F.col("low").alias("a"), F.col("class").alias("b"))

    rows = sets.where("n > 0").select("class", "n", F.posexplode("lead").alias("i", "s"))
    # What is joined with a large table is written first: where it is small it is broadcast and the table stays in place.
    # Of all leading shingles only a count is sent; those that are repeated by copies of one set alone go after.
    twice = materialize(rows.groupBy("s").agg(F.count("*").alias("f")).where("f > 1").select("s"), "twice")
    met = materialize(rows.join(twice, "s").distinct(), "met")  # class, n, i, s
    shared = materialize(met.groupBy("s").agg(F.count("*").alias("f")).where("f > 1"), "shared")
    hits = materialize(met.join(shared, "s"), "hits")  # class, n, i, s, f
    discard(twice, met, shared)
    # The centre of a shingle is the set whose leading shingles are the most frequent: of copies of one text, the text.
    weight = hits.groupBy("class").agg(F.sum("f").alias("w"))
    centre = hits.join(weight, "class").groupBy("s").agg(F.max(F.struct("w", "class"))["class"].alias("centre"))
    counted, hits = hits, materialize(hits.drop("f").join(centre, "s"), "centred")  # s, class, n, i, centre
    discard(counted)

    def candidates(a: DataFrame, b: DataFrame, apart: Column) -> DataFrame:
        a, b = (x.select(*[F.col(c).alias(c + k) for c in x.columns if c != "s"], "s") for x, k in ((a, "_a"), (b, "_b")))
        # So many shingles must be common; then one is within the first n - need + 1 of either set.
        need = F.expr(f"({p} * (n_a + n_b) + {p + q - 1}) div {p + q}")
        fits = (F.col("i_a") <= F.col("n_a") - need) & (F.col("i_b") <= F.col("n_b") - need)
        pair = [F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b")]
        rest = F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b")) - 1
        found = a.join(b, "s").where(apart & fits).select(*pair, rest.alias("rest"), need.alias("need"))
        found = found.groupBy("a", "b").agg(F.count("*").alias("c"), F.min("rest").alias("rest"), F.first("need").alias("need"))
        # Beyond these, at most what follows the last of them can be common.
        return found.where("c + rest >= need").select("a", "b")

    def alike(pairs: DataFrame) -> DataFrame:
        met = materialize(pairs, "pairs")
        ends = lambda pairs: materialize(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "needed")
        asked = ends(met)
        # Of the shingles of both, at most those that make no difference are common, each counted twice.
        own = sets.join(asked, "class", "left_semi").select("class", "n", "bits").dropDuplicates(["class"])
        a, b = (own.select(F.col("class").alias(k), F.col("n").alias("n_" + k), F.col("bits").alias("bits_" + k)) for k in "ab")
        both = met.join(a, "a").join(b, "b").withColumn("apart", differing("bits_a", "bits_b"))
        both = both.where(f"{p} * greatest(n_a, n_b) <= {q} * least(n_a, n_b)")
        pairs = materialize(both.where(f"{p + q} * (n_a + n_b - apart) >= {2 * p} * (n_a + n_b)").select("a", "b"), "pairs")
        discard(met, asked)
        needed = ends(pairs)
        ids = materialize(sets.join(needed, "class", "left_semi").groupBy("class").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct(), "ids")
        own = docs.select(F.col("doc_id").cast("long"), "text")
        own = own.join(ids, "doc_id", "left_semi").unionByName(own.where("doc_id is null"))
        full = materialize(shingle_sets(own, words).drop("doc_id").join(needed, "class", "left_semi").dropDuplicates(["class"]), "full")
        a, b = (full.select(F.col("class").alias(k), F.col("n").alias("n_" + k), F.col("items").alias("items_" + k)) for k in "ab")
        both = pairs.join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("items_a", "items_b")))
        links = materialize(both.where(f"{q} * common >= {p} * (n_a + n_b - common)").select("a", "b"), "links")
        discard(pairs, needed, ids, full)
        return links

    def named(links: DataFrame) -> DataFrame:
        """The hits with the component that their set is in by the links so far."""
        known = connected_components(links, "a", "b")
        return hits.join(known, F.col("class") == F.col("node"), "left").select("class", "centre", "n", "i", "s", F.coalesce("component", "class").alias("part"))

    found = alike(near.unionByName(same).distinct())
    own = materialize(named(found), "named")
    star = candidates(own.where("class = centre"), own.where("class <> centre"), F.col("part_a") != F.col("part_b"))
    found = found.unionByName(alike(star))
    discard(own)
    own = materialize(named(found), "named")
    mixed = own.groupBy("s").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("s")
    whole, own = own, materialize(own.join(mixed, "s", "left_semi"), "named")
    discard(whole, hits)
    found = found.unionByName(alike(candidates(own, own, F.col("part_a") < F.col("part_b"))))
    discard(own)
    comps = connected_components(found, "a", "b")
    rows = materialize(sets.select("doc_id", "class"), "rows")
    discard(sets, alone, prints, by_trie)
    classes = rows.groupBy("class").agg(F.min("doc_id").alias("low"))
    linked = classes.join(comps, F.col("class") == F.col("node"), "left").select("class", "low", F.coalesce("component", "class").alias("component"))
    lows = linked.groupBy("component").agg(F.min("low").alias("component_id"))
    return rows.join(linked.join(lows, "component").select("class", "component_id"), "class").select("doc_id", "component_id")
