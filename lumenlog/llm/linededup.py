"""Line dedup (operator 9): sharded cuckoo filters over exact reference-count tables.

State. `refs` has a row for each document and line key (a 128-bit hash of the key) with the number of lines: the
exact reference counts. `filters` has a cuckoo filter per shard, which holds the keys that at least two documents
refer to; insertions add the keys that become shared, deletions take out those that no longer are, so a deleted
document leaves no trace. Applying the state screens the references by the filters, and only what they let through
is looked up in the exact counts: a filter's false positive costs a lookup and never a line.

References meet their shard's filter by a shuffle, a filter a part of at most about PART references (of one key too: parts are
dealt by doc_id), so neither the filters nor their number is bounded by what could be broadcast. Shards are doubled and
filters made anew when keys outgrow them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm.common import lean, strings
from lumenlog.session import materialize

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Keys of fewer code points are never dropped.
MIN_CHARS = 10
#: Keys a shard's filter holds on average (a filter has room for twice as many), and references that a copy of it screens.
SHARD, PART = 1 << 14, 1 << 15
#: A key that this share of all references has is hot: there are at most 1 / HOT_SHARE, and each is joined in SALTS parts.
HOT_SHARE, SALTS = 1 / 1000, 64


class Cuckoo:
    """Cuckoo filter with buckets of four 16-bit fingerprints, made for vectors of 64-bit hashes.

    `size` keys fit surely: a key that finds no place after `KICKS` moves goes to an overflow list, which is
    exact. Equal hashes may be added more than once and are taken out one at a time.
    """

    KICKS = 200

    def __init__(self, size: int, slots: np.ndarray | None = None, over: list[int] | None = None):
        n = 1 << max(2, int(np.ceil(np.log2(max(1, size) / 3.4))))
        self.slots = np.zeros((n, 4), dtype=np.uint16) if slots is None else slots
        self.over = Counter(over or [])

    @property
    def mask(self) -> np.uint64:
        return np.uint64(len(self.slots) - 1)

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tag = (h >> np.uint64(48)).astype(np.uint16)
        tag[tag == 0] = 1
        a = (h & self.mask).astype(np.int64)
        return tag, a, self._other(a, tag)

    def _other(self, at: np.ndarray, tag: np.ndarray) -> np.ndarray:
        return at ^ (tag.astype(np.uint64) * np.uint64(0x5BD1E995) & self.mask).astype(np.int64)

    def add(self, h: np.ndarray) -> None:
        tag, a, b = self._places(h)
        rng = np.random.default_rng(0)
        for t, i, j, k in zip(tag.tolist(), a.tolist(), b.tolist(), h.tolist(), strict=True):
            for at in (i, j):
                free = np.flatnonzero(self.slots[at] == 0)
                if len(free):
                    self.slots[at, free[0]] = t
                    break
            else:
                self._kick(t, i, rng, k)

    def _kick(self, t: int, at: int, rng: np.random.Generator, h: int) -> None:
        moves = []
        for s in rng.integers(0, 4, self.KICKS).tolist():
            moves.append((at, s))
            t, self.slots[at, s] = int(self.slots[at, s]), t
            at = int(self._other(np.array([at]), np.array([t], dtype=np.uint16))[0])
            free = np.flatnonzero(self.slots[at] == 0)
            if len(free):
                self.slots[at, free[0]] = t
                return
        for at, s in reversed(moves):
            t, self.slots[at, s] = int(self.slots[at, s]), t
        self.over[h] += 1

    def remove(self, h: np.ndarray) -> None:
        tag, a, b = self._places(h)
        for t, i, j, k in zip(tag.tolist(), a.tolist(), b.tolist(), h.tolist(), strict=True):
            if self.over[k] > 0:
                self.over[k] -= 1
                continue
            for at in (i, j):
                own = np.flatnonzero(self.slots[at] == t)
                if len(own):
                    self.slots[at, own[0]] = 0
                    break

    def has(self, h: np.ndarray) -> np.ndarray:
        tag, a, b = self._places(h)
        found = (self.slots[a] == tag[:, None]).any(1) | (self.slots[b] == tag[:, None]).any(1)
        return found | np.isin(h, np.array([*self.over.elements()], dtype=np.uint64)) if self.over else found

    def to_bytes(self) -> bytes:
        return len(self.slots).to_bytes(8, "little") + self.slots.astype("<u2").tobytes() + np.array([*self.over.elements()], dtype="<u8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Cuckoo:
        n = int.from_bytes(data[:8], "little")
        slots = np.frombuffer(data, dtype="<u2", count=4 * n, offset=8).reshape(n, 4).copy()
        return cls(0, slots, np.frombuffer(data, dtype="<u8", offset=8 + 8 * n).tolist())


def line_key(line: str) -> str:
    return line.strip(BLANK).translate(LOWER)


def key_hash(key: str) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"))
    return h >> 64, h & (1 << 64) - 1


def references(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, k1, k2, n_lines: each document's keys of at least `min_chars` code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, hi, lo, n = [], [], [], []
            for d, t in zip(b.column("doc_id").to_pylist(), strings(b.column("text")), strict=True):
                seen: dict[str, int] = {}
                for line in t.split("\n"):
                    k = line_key(line)
                    if len(k) >= min_chars:
                        seen[k] = seen.get(k, 0) + 1
                for k, c in seen.items():
                    x, y = key_hash(k)
                    own.append(d)
                    hi.append(x)
                    lo.append(y)
                    n.append(c)
            cols = [pa.array(own, pa.int64()), *(pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (hi, lo)), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "k1", "k2", "n_lines"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, k1 long, k2 long, n_lines long")


class LineIndex:
    """Incremental state of line dedup. Documents without a doc_id are never compared and keep all their lines."""

    def __init__(self, spark: SparkSession, refs: DataFrame | None = None, filters: DataFrame | None = None, shards: int = 0, min_chars: int = MIN_CHARS):
        self.spark, self.refs, self.filters, self.shards, self.min_chars = spark, refs, filters, shards, min_chars

    def _shared(self, refs: DataFrame) -> DataFrame:
        """Keys that at least two documents refer to, with the smallest of these: min and max of the doc_id tell,
        and both are aggregated before the shuffle."""
        both = refs.groupBy("k1", "k2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n_docs"))
        return both.where("low < high").drop("high")

    def insert(self, docs: DataFrame) -> LineIndex:
        """The state with `docs` added."""
        new = references(docs, self.min_chars).where("doc_id is not null")
        refs = materialize(new if self.refs is None else self.refs.unionByName(new), "refs")
        return self._moved(refs)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """The state without the documents whose `doc_id` is in `doc_ids`."""
        return self._moved(materialize(self.refs.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti"), "refs"))

    def _moved(self, refs: DataFrame) -> LineIndex:
        """The state for `refs`: each shard's filter gets what became shared and loses what no longer is."""
        now = materialize(self._shared(refs), "counts")
        shards, n = self.shards, now.count()
        if shards == 0 or n > 3 * SHARD * shards // 2:  # all filters anew
            shards, old, prior = 1 << max(0, (-(-n // SHARD) - 1).bit_length()), now.limit(0), None
        else:
            old, prior = self.counts, self.filters
        keys = now.select("k1", "k2", F.lit(1).alias("s")).unionByName(old.select("k1", "k2", F.lit(-1).alias("s")))
        moves = keys.groupBy("k1", "k2").agg(F.sum("s").alias("s")).where("s <> 0").select(F.pmod("k2", F.lit(shards)).alias("shard"), "k1", "s")
        prior = self.spark.createDataFrame([], "shard long, filter binary") if prior is None else prior

        def move(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            h, s = left.column("k1").to_numpy().view(np.uint64), left.column("s").to_numpy()
            f = Cuckoo.from_bytes(right.column("filter")[0].as_py()) if right.num_rows else Cuckoo(2 * max(SHARD, len(h)))
            f.remove(h[s < 0])
            f.add(h[s > 0])
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "filter": pa.array([f.to_bytes()], pa.binary())})

        filters = moves.groupBy("shard").cogroup(prior.groupBy("shard")).applyInArrow(move, "shard long, filter binary")
        out = LineIndex(self.spark, refs, materialize(filters, "filters"), shards, self.min_chars)
        out.counts = now
        return out

    def screened(self) -> DataFrame:
        """doc_id, k1, k2 of the references that the filters let through."""
        parts = max(1, -(-self.refs.count() // (PART * self.shards)))
        none = lambda kind: F.lit(None).cast(kind)
        shard = F.pmod("k2", F.lit(self.shards))
        own = self.refs.select(shard.alias("shard"), F.pmod(F.xxhash64("doc_id", "k1"), F.lit(parts)).alias("part"), none("binary").alias("filter"), "doc_id", "k1", "k2")
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
        filters = self.filters.select("shard", each.alias("part"), "filter", *[none("long").alias(c) for c in ("doc_id", "k1", "k2")])
        # A part's filter comes before its references.
        dealt = own.unionByName(filters).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("filter").isNull())

        def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, f = None, None
            for b in batches:
                place = np.stack([b.column("shard").to_numpy(), b.column("part").to_numpy()])
                edge = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
                for i, j in zip(edge[:-1], edge[1:], strict=True):
                    if i == j:
                        continue
                    if at != (own_place := tuple(place[:, i].tolist())):
                        at, f = own_place, None
                    if b.column("filter")[i].is_valid:
                        f, i = Cuckoo.from_bytes(b.column("filter")[i].as_py()), i + 1
                    if f is None or i == j:  # no key of the shard is shared
                        continue
                    refs = b.slice(i, j - i)
                    keep = pa.array(f.has(refs.column("k1").to_numpy().view(np.uint64)))
                    yield pa.RecordBatch.from_arrays([refs.column(c).filter(keep) for c in ("doc_id", "k1", "k2")], names=["doc_id", "k1", "k2"])

        return dealt.mapInArrow(lean(screen), "doc_id long, k1 long, k2 long")

    def dropped(self) -> DataFrame:
        """doc_id, k1, k2 of the lines to drop: shared keys, in all documents but the smallest."""
        refs = self.screened()
        # Hot keys are at most 1 / HOT_SHARE rows, whatever the input; their references are dealt by doc_id.
        hot = materialize(self.counts.where(F.col("n_docs") > F.lit(HOT_SHARE * self.refs.count())).select("k1", "k2", F.lit(True).alias("hot")), "hot")
        salt = lambda value, cold: F.when(F.col("hot"), value).otherwise(cold)
        refs = refs.join(F.broadcast(hot), ["k1", "k2"], "left").withColumn("salt", salt(F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)), F.lit(0)).cast("int"))
        each = salt(F.sequence(F.lit(0), F.lit(SALTS - 1)), F.array(F.lit(0)))
        counts = self.counts.join(F.broadcast(hot), ["k1", "k2"], "left").select("k1", "k2", "low", F.explode(each).alias("salt"))
        return refs.join(counts, ["k1", "k2", "salt"]).where("doc_id > low").select("doc_id", "k1", "k2")

    def apply(self, docs: DataFrame) -> DataFrame:
        """`docs` with text_kept, n_lines and n_dropped; columns of these names are replaced."""
        rest = [c for c in docs.columns if c not in ("text_kept", "n_lines", "n_dropped")]
        name = {c: f"c{i}" for i, c in enumerate(rest)}
        # Rows without a doc_id meet nothing; the second key keeps them from being sent to one task.
        spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
        base = docs.select(F.col("doc_id").cast("long").alias("join_id"), spread.alias("join_part"), F.col("text").alias("join_text"), *[F.col(f"`{c}`").alias(n) for c, n in name.items()])
        gone = self.dropped().distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("k1", "k2"))).alias("gone")).withColumnRenamed("doc_id", "join_id").withColumn("join_part", F.lit(0).cast("long"))
        joined = base.join(gone.hint("shuffle_hash"), ["join_id", "join_part"], "left").withColumn("his", F.col("gone.k1")).withColumn("los", F.col("gone.k2"))
        kinds = {f.name: f.dataType.simpleString() for f in base.schema}
        # A text that is kept as a column of `docs` too goes through once.
        name.pop("text", None)
        sent = joined.select("join_text", "his", "los", *name.values())
        schema = ", ".join(["text_kept string", "n_lines long", "n_dropped long", "join_text string", *(f"{n} {kinds[n]}" for n in name.values())])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                kept, n, lost = [], [], []
                for t, hi, lo in zip(strings(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    lines = t.split("\n")
                    n.append(len(lines))
                    if hi:
                        drop = set(zip(hi, lo, strict=True))
                        left = [x for x in lines if len(k := line_key(x)) < self_min or _signed(key_hash(k)) not in drop]
                        lost.append(len(lines) - len(left))
                        t = "\n".join(left)
                    else:
                        lost.append(0)
                    kept.append(t)
                yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), b.column(0), *b.columns[3:]], names=["text_kept", "n_lines", "n_dropped", "join_text", *name.values()])

        self_min = self.min_chars
        out = sent.mapInArrow(lean(cut), schema)
        back = [F.col("join_text" if c == "text" else name[c]).alias(c) for c in rest]
        return out.select(*back, "text_kept", "n_lines", "n_dropped")


def _signed(pair: tuple[int, int]) -> tuple[int, int]:
    return tuple(x - (1 << 64) if x >> 63 else x for x in pair)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """`docs` with text_kept, n_lines and n_dropped, over all of its rows.

    A null text is one empty line. Rows with one doc_id are one document; each row of it has its own lines. Rows
    without a doc_id keep their lines. A document whose lines are all dropped has the empty text; an empty table
    gives no rows.
    """
    return LineIndex(docs.sparkSession, min_chars=min_chars).insert(docs).apply(docs)
