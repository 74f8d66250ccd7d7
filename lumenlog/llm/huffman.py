"""Token-ID files (operator 10): canonical length-limited Huffman coding of ids in independent blocks.

File format. A folder of two Parquet tables, which any Spark writer can commit and any reader can open:
`code` has one row with the code length of every id; `blocks` has a row per block: `part` and `seq` (their order is
the order of the documents), `n_ids` and `block`, whose bytes are

    magic "LTB1", n_docs u32, n_ids u64, every u32, n_bits u64   (little-endian)
    n_docs x i64 doc_id (the smallest for null), n_docs x u64 ids of each document
    a u64 bit offset for every `every`-th id
    the codes, first bit highest

A block holds whole documents and can be decoded alone; within it every checkpoint can.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlog.llm.bpe import load
from lumenlog.llm.common import lean, strings
from lumenlog.session import materialize, new_path

MAGIC = b"LTB1"
HEAD = struct.Struct("<4sIQIQ")
NO_ID = -(1 << 63)
#: Longest code, in bits: 2 ** MAX_BITS is the size of the decoding table, and the ids that occur must not be more.
MAX_BITS = 18
#: Pretokens a worker keeps here; about 200 MB.
CACHE = 900_000


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits by package-merge; 0 for ids that do not occur."""
    out = np.zeros(len(counts), dtype=np.uint8)
    ids = np.flatnonzero(counts)
    if not len(ids):
        return out
    if len(ids) > 1 << limit:
        raise ValueError(f"{len(ids)} different ids do not fit codes of {limit} bits")
    ids = ids[np.argsort(counts[ids], kind="stable")]
    weight = counts[ids].astype(np.float64)
    n = len(ids)
    if n == 1:
        out[ids] = 1
        return out
    leaf = np.ones(n, dtype=bool)
    kinds, merged, is_leaf = [], weight, leaf
    for _ in range(limit - 1):
        kinds.append(is_leaf)
        m = len(merged) // 2 * 2
        packs = merged[0:m:2] + merged[1:m:2]
        both = np.concatenate([weight, packs])
        order = np.argsort(both, kind="stable")
        merged, is_leaf = both[order], order < n
    kinds.append(is_leaf)
    take = 2 * n - 2
    length = np.zeros(n, dtype=np.int64)
    for is_leaf in reversed(kinds):
        own = int(is_leaf[:take].sum())
        length[:own] += 1
        take = 2 * (take - own)
    out[ids] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each id: by length, then id."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    ids = np.flatnonzero(lengths)
    ids = ids[np.argsort(lengths[ids], kind="stable")]
    code, last = 0, 0
    for size in np.unique(lengths[ids]):
        own = ids[lengths[ids] == size]
        code <<= int(size) - last
        codes[own] = np.arange(code, code + len(own), dtype=np.uint64)
        code, last = code + len(own), int(size)
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every value of the next `bits` bits the id and its length."""
    bits = int(lengths.max(initial=1))
    ids = np.flatnonzero(lengths)
    ids = ids[np.argsort(lengths[ids], kind="stable")]
    reps = 1 << (bits - lengths[ids].astype(np.int64))
    sym, size = np.zeros(1 << bits, dtype=np.uint32), np.ones(1 << bits, dtype=np.uint8)
    full = np.repeat(ids, reps)
    sym[: len(full)], size[: len(full)] = full, lengths[full]
    return sym, size, bits


def pack(doc_ids: list, sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, every: int) -> bytes:
    """One block."""
    size = lengths.astype(np.int64)[ids]
    end = np.cumsum(size)
    start = end - size
    n_bits = int(end[-1]) if len(end) else 0
    words = np.zeros((n_bits + 31) // 32 + 1, dtype=np.uint64)
    if len(ids):
        value = codes[ids] << (64 - size - (start & 31)).astype(np.uint64)
        word = start >> 5
        first = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
        at = word[first]
        words[at] += np.add.reduceat(value >> np.uint64(32), first)
        words[at + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    head = HEAD.pack(MAGIC, len(sizes), len(ids), every, n_bits)
    docs = np.array([NO_ID if d is None else d for d in doc_ids], dtype="<i8")
    return b"".join([head, docs.tobytes(), sizes.astype("<u8").tobytes(), start[::every].astype("<u8").tobytes(), words.astype(">u4").tobytes()])


def unpack(block: bytes, table: tuple[np.ndarray, np.ndarray, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc ids, ids of each document, and all ids of a block; its checkpoints are decoded side by side."""
    magic, n_docs, n_ids, every, n_bits = HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a token block")
    sym, size, bits = table
    at = HEAD.size
    docs = np.frombuffer(block, dtype="<i8", count=n_docs, offset=at)
    sizes = np.frombuffer(block, dtype="<u8", count=n_docs, offset=(at := at + 8 * n_docs)).astype(np.int64)
    n_marks = -(-n_ids // every)
    pos = np.frombuffer(block, dtype="<u8", count=n_marks, offset=(at := at + 8 * n_docs)).astype(np.int64)
    body = np.frombuffer(block[at + 8 * n_marks :] + bytes(8), dtype=np.uint8)
    view = np.ndarray((len(body) - 3,), dtype=">u4", buffer=body, strides=(1,))
    both = sym << np.uint32(8) | size
    out = np.zeros((every, n_marks), dtype=np.uint32)
    last = n_ids - (n_marks - 1) * every
    for k in range(min(every, n_ids)):
        if k == last:
            pos = pos[:-1]
        key = (view[pos >> 3].astype(np.uint32) << (pos & 7).astype(np.uint32)) >> np.uint32(32 - bits)
        out[k, : len(pos)] = got = both[key]
        pos = pos + (got & np.uint32(255))
    return docs, sizes, (out >> np.uint32(8)).T.reshape(-1)[:n_ids]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, block_ids: int = 1 << 18, every: int = 128) -> None:
    """Encode `text`, append `end_id` to each document and write the files to `path` in ascending doc_id order.

    A null text has the end id only; a null doc_id comes first; rows with one doc_id are kept, ordered by text.
    An empty table gives empty files. Ids are counted over all documents; the code has one length per vocabulary
    entry, so what the driver gathers is bounded by the vocabulary.
    """
    if max(end_id, load(tokenizer).size - 1) >= 1 << 16:
        wide = "<u4"
    else:
        wide = "<u2"
    n_vocab = max(end_id + 1, load(tokenizer).size)
    schema = "part long, seq long, n_ids long, doc_ids array<long>, sizes array<long>, ids binary, counts binary"
    names = [c.split()[0] for c in schema.split(", ")]
    stop = end_id.to_bytes(4, "little")

    def row(*values) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, seq = load(tokenizer), TaskContext.get().partitionId(), 0
        bpe.limit = CACHE
        counts, held, doc_ids, sizes, total = np.zeros(n_vocab, dtype="<i8"), [], [], [], 0
        for b in batches:
            own, texts = b.column("doc_id").to_pylist(), strings(b.column("text"))
            for d, x in zip(own, bpe.encode(texts), strict=True):
                held += [x, stop]
                doc_ids.append(d)
                sizes.append(len(x) // 4 + 1)
                total += sizes[-1]
                if total >= block_ids:
                    ids = np.frombuffer(b"".join(held), dtype="<u4")
                    counts += np.bincount(ids, minlength=n_vocab)
                    yield row(part, seq, total, doc_ids, sizes, ids.astype(wide).tobytes(), None)
                    seq, held, doc_ids, sizes, total = seq + 1, [], [], [], 0
        if doc_ids:
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            counts += np.bincount(ids, minlength=n_vocab)
            yield row(part, seq, total, doc_ids, sizes, ids.astype(wide).tobytes(), None)
        if counts.any():
            yield row(part, -1, 0, None, None, None, counts.tobytes())

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_vocab, dtype=np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                counts += np.frombuffer(x, dtype="<i8")
        ids = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts[ids])], names=["id", "n"])

    spark = docs.sparkSession
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    staged = materialize(ordered.mapInArrow(lean(stage, "bpe"), schema), "ids")
    rows = staged.where("counts is not null").select("counts").mapInArrow(lean(summed, "bpe"), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(n_vocab, dtype=np.int64)
    for r in rows.collect():  # at most the vocabulary
        counts[r.id] = r.n
    lengths = code_lengths(counts)
    codes = canonical(lengths)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                part, seq, n, own, sizes, ids = (b.column(c)[k].as_py() for c in range(6))
                data = pack(own, np.array(sizes), np.frombuffer(ids, dtype=wide), lengths, codes, every)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int64()), (seq, pa.int64()), (n, pa.int64()), (data, pa.binary()))], names=["part", "seq", "n_ids", "block"])

    staged.where("seq >= 0").drop("counts").mapInArrow(lean(code, "bpe"), "part long, seq long, n_ids long, block binary").write.parquet(f"{path}/blocks")
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/code")


def read_token_files(spark: SparkSession, path: str, summary: bool = True) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens and, with
    `summary`, ids_crc32, else `ids` as little-endian unsigned 32-bit integers."""
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/code").first().lengths), dtype=np.uint8)
    blocks = spark.read.schema("part long, seq long, n_ids long, block binary").parquet(f"{path}/blocks")
    value, kind = ("ids_crc32", pa.int64()) if summary else ("ids", pa.binary())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(lengths)
        for b in batches:
            for k in range(b.num_rows):
                docs, sizes, ids = unpack(b.column("block")[k].as_py(), table)
                end = np.cumsum(sizes)
                data = ids.astype("<u4").tobytes()
                cut = [data[4 * (e - n) : 4 * e] for e, n in zip(end.tolist(), sizes.tolist(), strict=True)]
                got = [zlib.crc32(x) for x in cut] if summary else cut
                n = len(docs)
                own = pa.array([None if d == NO_ID else d for d in docs.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([b.column("part")[k].as_py()] * n, pa.int64()), pa.array([b.column("seq")[k].as_py()] * n, pa.int64()), own, pa.array(end - sizes), pa.array(sizes), pa.array(got, kind)], names=["part", "seq", "doc_id", "offset", "n_tokens", value])

    rows = blocks.select("part", "seq", "block").mapInArrow(lean(decode, "bpe"), f"part long, seq long, doc_id long, offset long, n_tokens long, {value} {'long' if summary else 'binary'}")
    # Offsets of parts (as many rows as files), then of blocks within a part: metadata columns only.
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("part_start"))
    starts = blocks.select("part", "seq", (F.sum("n_ids").over(W.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("block_start"))
    starts = starts.join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("block_start")).alias("block_start"))
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("block_start") + F.col("offset")).alias("start"), "n_tokens", value)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the token files of `docs` to the shared folder and return what reading them back gives."""
    at = new_path(docs.sparkSession, "tokens")
    write_token_files(docs, at, tokenizer, end_id)
    return read_token_files(docs.sparkSession, at)
