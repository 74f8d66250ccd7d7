"""Reading and batching helpers of this subpackage."""

from __future__ import annotations

import ctypes
import sys
from itertools import chain
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose texts have about `limit` characters (one longer text is a range)."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def strings(column: pa.Array) -> list[str]:
    """The values, null as the empty string."""
    return ["" if x is None else x for x in column.to_pylist()]


#: Bytes of a batch that a worker takes up at a time, and that Spark sends at a time.
TAKEN = 4 << 20
SENT = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Have the session send batches of about TAKEN bytes (at least a row), unless a bound was set. The executor holds a
    batch outside of its heap, twice while it grows, and Spark's own bound is 64 MB for every task."""
    if SENT not in spark.conf.getAll:
        spark.conf.set(SENT, f"{TAKEN}b")


def portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about TAKEN bytes."""
    n = max(1, batch.num_rows * TAKEN // max(1, batch.nbytes))
    return (batch.slice(i, n) for i in range(0, batch.num_rows, n))


#: What a worker holds from one task to the next, by the operator that it is for.
_HELD: dict[str, dict] = {}


def held(operator: str) -> dict:
    """The dictionary of what this worker holds for the operator."""
    return _HELD.setdefault(operator, {})


def release(but: str = "") -> None:
    """Drop what this worker holds for operators other than `but`."""
    for k, v in _HELD.items():
        if k != but:
            v.clear()


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], operator: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`f` for mapInArrow, over portions of the batches, in a worker that gives memory back: large arrays when they are
    freed, all else at the end of the partition. Workers outlive their tasks, and what an idle one keeps is lost to the
    executor; so what it holds for operators other than `operator` goes before anything is read. Called on the driver while
    a plan is made, it bounds the session's batches too."""
    if spark := SparkSession.getActiveSession():
        bound_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(operator)
        libc = ctypes.CDLL(None) if sys.platform == "linux" else None
        if hasattr(libc, "mallopt"):
            libc.mallopt(-3, 1 << 24)  # M_MMAP_THRESHOLD
            libc.mallopt(-1, 1 << 26)  # M_TRIM_THRESHOLD
        try:
            yield from f(chain.from_iterable(map(portions, batches)))
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return run
