"""SimHash near-duplicates (operator 4): binary trie self-join over the distinct fingerprints.

Each fingerprint is rotated by every multiple of 64/parts bits. If two fingerprints differ in at most `max_bits`
bits, then in one rotation the leading part has at most floor(max_bits/parts) of them: a trie of each rotation is
joined with itself, both nodes of a pair going down together while their differing bits are added up, and a pair is
dropped once it is over the budget of the leading part or of the whole. The upper levels of the tries are dealt to
tasks as blocks: the pairs of blocks within the budget are shuffled by key, the rest of the traversal is local.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import lean, strings
from lumenlog.operators.graph import connected_components
from lumenlog.session import materialize

#: Fingerprints a block holds on average; what a task reads is a few times this.
BLOCK = 4096
#: Fingerprints of a pair of blocks that one task may get; beyond that they are cut into chunks, and pairs of chunks dealt.
HOT = 1 << 17
#: Shingles whose bits are counted together.
CHUNK = 1 << 16
#: Node pairs followed together.
FRONT = 1 << 20


def shingle_hashes(text: str, words: int = 4) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, repeats included; a text of up to `words` words is one, a blank one none."""
    own = text.encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return np.array([], dtype=np.uint64)
    flat, h = b" ".join(own), xxhash.xxh64_intdigest
    if len(own) <= words:
        return np.array([h(flat, 42)], dtype=np.uint64)
    size = np.fromiter(map(len, own), dtype=np.int64, count=len(own)) + 1
    end = np.cumsum(size) - 1
    a, b = (end - size + 1)[: len(own) - words + 1].tolist(), end[words - 1 :].tolist()
    return np.fromiter((h(flat[i:j], 42) for i, j in zip(a, b, strict=True)), dtype="<u8", count=len(a))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; 0 without any."""
    bits = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), CHUNK):
        bits += np.unpackbits(hashes[k : k + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, words: int = 4) -> int:
    """64-bit SimHash: bit i is set if it is set in over half of the shingles' XXH64 (seed 42)."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every row; a null text has no words and so the fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint(t, words) for t in strings(b.column("text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got.view(np.int64))], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, fingerprint long")


def join_tries(x: np.ndarray, a: list[tuple[int, int]], b: list[tuple[int, int]], diff: list[int], depth: int, lead: int, lead_bits: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the sorted array `x` within `budget` bits, below the given pairs of trie nodes.

    A node is a range of `x` whose values share the first `depth` bits; `diff` has the bits in which the two nodes of
    a pair differ so far. A pair of small nodes is finished by comparing its values.
    """
    ones = {}

    def ranges(lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((x >> np.uint64(bit) & np.uint64(1)).astype(np.int64))])
        return hi - (ones[bit][hi] - ones[bit][lo])

    if not a:
        return
    stack = [(depth, np.array([(*p, *q, d) for p, q, d in zip(a, b, diff, strict=True)], dtype=np.int64))]
    while stack:
        d, f = stack.pop()
        if len(f) > FRONT:
            stack += [(d, f[k : k + FRONT]) for k in range(0, len(f), FRONT)]
            continue
        na, nb, same = f[:, 1] - f[:, 0], f[:, 3] - f[:, 2], f[:, 0] == f[:, 2]
        f = f[~(same & (na == 1))]
        na, nb = f[:, 1] - f[:, 0], f[:, 3] - f[:, 2]
        done = (na * nb <= 24) | (d == 64)
        if done.any():
            g = f[done]
            n, m = g[:, 1] - g[:, 0], g[:, 3] - g[:, 2]
            for k in range(0, len(g), FRONT // 4):
                own, nn, mm = g[k : k + FRONT // 4], n[k : k + FRONT // 4], m[k : k + FRONT // 4]
                row = np.repeat(np.arange(len(own)), nn * mm)
                at = np.arange(len(row)) - np.repeat(np.cumsum(nn * mm) - nn * mm, nn * mm)
                i, j = own[row, 0] + at // mm[row], own[row, 2] + at % mm[row]
                keep = (i < j) & (np.bitwise_count(x[i] ^ x[j]) <= budget)
                yield i[keep], j[keep]
            f = f[~done]
        if not len(f):
            continue
        bit = 63 - d
        ma, mb = ranges(f[:, 0], f[:, 1], bit), ranges(f[:, 2], f[:, 3], bit)
        same = f[:, 0] == f[:, 2]
        zero, one = (f[:, 0], ma), (ma, f[:, 1])
        zero_b, one_b = (f[:, 2], mb), (mb, f[:, 3])
        limit = lead if d < lead_bits else budget
        parts = [np.column_stack([*zero, *zero_b, f[:, 4]]), np.column_stack([*one, *one_b, f[:, 4]])]
        open_ = f[:, 4] + 1 <= limit
        parts.append(np.column_stack([*zero, *one_b, f[:, 4] + 1])[open_])
        parts.append(np.column_stack([*one, *zero_b, f[:, 4] + 1])[open_ & ~same])
        nxt = np.concatenate(parts)
        stack.append((d + 1, nxt[(nxt[:, 0] < nxt[:, 1]) & (nxt[:, 2] < nxt[:, 3])]))


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Links (index, smallest index of its tree) that connect what the pairs connect."""
    label = np.arange(n)
    for i, j in pairs:
        while len(i):
            a, b = label[i], label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if not len(i):
                break
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def links(classes: DataFrame, count: int, max_bits: int = 4, parts: int = 4) -> DataFrame:
    """(a, b): pairs of distinct fingerprints (column `fingerprint`, no row twice) within `max_bits` bits, as
    many as it takes to connect all that are."""
    width, lead = 64 // parts, max_bits // parts
    depth = max(0, min(width, math.ceil(math.log2(max(1, count) / BLOCK)))) if count > BLOCK else 0
    masks = [sum(1 << i for i in c) for k in range(1, lead + 1) for c in combinations(range(depth), k)]
    fp = F.col("fingerprint")
    turned = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), (F.shiftleft(fp, r * width).bitwiseOR(F.shiftrightunsigned(fp, 64 - r * width)) if r else fp).alias("x")) for r in range(parts)]))
    rows = classes.select(turned.alias("t")).select("t.r", "t.x")
    own = (F.shiftrightunsigned("x", 64 - depth) if depth else F.lit(0)).cast("long")
    rows = rows.withColumn("side", own)
    near = F.filter(F.array(*[F.col("side").bitwiseXOR(F.lit(m)) for m in masks]), lambda o: o < F.col("side")) if masks else F.array().cast("array<long>")
    rows = rows.select("r", "x", "side", F.explode(F.concat(F.array("side"), near)).alias("block"))
    # At most parts * 2 ** width rows (262,144 with four parts), whatever the input.
    sizes = rows.groupBy("r", "block").agg(F.count("*").alias("n")).where(F.col("n") > HOT)
    hot = materialize(sizes.select("r", "block", F.ceil(2 * F.col("n") / HOT).alias("chunks")), "hot")
    rows = rows.join(F.broadcast(hot), ["r", "block"], "left") if parts << width <= 1 << 20 else rows.join(hot, ["r", "block"], "left")
    rows = rows.withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("x"), F.col("chunks")))
    rows = rows.select("r", "x", "block", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
    rows = rows.select("r", "x", "block", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        r, block = key[0].as_py(), key[1].as_py()
        x = t.column("x").to_numpy().view(np.uint64)
        x = x[np.argsort(x, kind="stable")]
        side = (x >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(x), dtype=np.int64)
        first = np.flatnonzero(np.diff(side, prepend=-1))
        nodes = {int(side[a]): (int(a), int(b)) for a, b in zip(first, [*first[1:], len(x)], strict=True)}
        if block not in nodes:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        home = nodes[block]
        pairs = [(home, n, (block ^ s).bit_count()) for s, n in nodes.items()]
        got = join_tries(x, *map(list, zip(*pairs, strict=True)), depth, lead, width, max_bits)
        i, j = forest(len(x), got)
        back = lambda v: (v >> np.uint64(r * width) | v << np.uint64(64 - r * width)) if r else v
        return pa.table({"a": back(x[i]).view(np.int64), "b": back(x[j]).view(np.int64)})

    return rows.groupBy("r", "block", "low", "high").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, max_bits: int = 4, parts: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of `docs`.

    Rows with one fingerprint are one class; classes are linked when at most `max_bits` bits differ, and
    component_id is the smallest doc_id that links reach (null only where no row of the component has a doc_id).
    A null or blank text has the fingerprint 0 and is linked like any other. Repeated rows stay, an empty table
    gives no rows; further columns are not read.
    """
    if parts > max(1, max_bits) or 64 % parts:
        raise ValueError("parts has to divide 64 and be at most max_bits")
    fps = materialize(fingerprints(docs, words), "fingerprints")
    classes = materialize(fps.groupBy("fingerprint").agg(F.min("doc_id").alias("low")), "classes")
    comps = connected_components(links(classes, classes.count(), max_bits, parts), "a", "b")
    linked = classes.join(comps, F.col("fingerprint") == F.col("node"), "left")
    linked = linked.select("fingerprint", "low", F.coalesce("component", "fingerprint").alias("component"))
    lows = linked.groupBy("component").agg(F.min("low").alias("component_id"))
    named = linked.join(lows, "component").select("fingerprint", "component_id")
    return fps.join(named, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
