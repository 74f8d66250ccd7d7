"""Volume reduction before costly analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Levels that are always kept, and sampling rates of others.
PRIORITY = ("ERROR", "CRITICAL")
RATES = {"INFO": 0.1, "DEBUG": 0.05, "WARNING": 0.5}
DEFAULT_RATE, MIN_SAMPLES, MAX_DUPLICATES = 0.1, 10, 5


def _draw(seed: int) -> Column:
    """An order of the rows that is fixed by the seed."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("log_id").cast("string")))


def stratified_sample(logs: DataFrame, seed: int = 42, rates: dict[str, float] | None = None, min_samples: int = MIN_SAMPLES, priority: tuple[str, ...] = PRIORITY) -> DataFrame:
    """All rows of priority levels; of every other level min(N, max(min_samples, floor(N * rate))) rows."""
    rates = RATES if rates is None else rates
    rate = F.coalesce(F.create_map(*[x for k, v in rates.items() for x in (F.lit(k), F.lit(v))])[F.col("level")], F.lit(DEFAULT_RATE)) if rates else F.lit(DEFAULT_RATE)
    sizes = logs.groupBy("level").agg(F.count("*").alias("level_n"))  # one row per level
    want = F.greatest(F.lit(min_samples), F.floor(F.col("level_n") * rate))
    kept = logs.where(F.col("level").isin(*priority))
    rest = logs.where(~F.col("level").isin(*priority) | F.col("level").isNull())
    # A hash bound first: it keeps a little more than is wanted, so a level isn't sorted whole in one task.
    bound = F.least(F.lit(1.0), (want + 6 * F.sqrt(want) + 20) / F.col("level_n"))
    thin = rest.join(F.broadcast(sizes.withColumnRenamed("level", "lv")), F.col("level").eqNullSafe(F.col("lv"))).drop("lv")
    draw = F.conv(F.substring(_draw(seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    thin = thin.where(draw <= bound)
    rank = F.row_number().over(W.partitionBy("level").orderBy(_draw(seed), "log_id"))
    return kept.unionByName(thin.withColumn("k", rank).where(F.col("k") <= want).select(logs.columns))


def dedupe_capped(logs: DataFrame, cap: int = MAX_DUPLICATES, seed: int = 42) -> DataFrame:
    """Of a message with more than `cap` rows the first, the last and cap - 2 others (by hash); first and last are by
    (timestamp, log_id)."""
    key = F.struct("timestamp", "log_id")
    ends = logs.groupBy("message").agg(F.count("*").alias("n"), F.min(key).alias("first"), F.max(key).alias("last"))
    over = ends.where(F.col("n") > cap)
    own = logs.join(over, "message", "left")
    plain = own.where(F.col("n").isNull()).select(logs.columns)
    many = own.where(F.col("n").isNotNull())
    edge = many.where((key == F.col("first")) | (key == F.col("last"))).select(logs.columns)
    middle = many.where((key != F.col("first")) & (key != F.col("last")))
    rank = F.row_number().over(W.partitionBy("message").orderBy(_draw(seed), "log_id"))
    drawn = middle.withColumn("k", rank).where(F.col("k") <= max(0, cap - 2)).select(logs.columns)
    return plain.unionByName(edge).unionByName(drawn)


def prefilter(logs: DataFrame, cap: int = MAX_DUPLICATES, seed: int = 42) -> DataFrame:
    """Sample, then capped dedupe."""
    return dedupe_capped(stratified_sample(logs, seed), cap, seed)


def reduction(before: DataFrame, after: DataFrame) -> DataFrame:
    a, b = before.agg(F.count("*").alias("n_before")), after.agg(F.count("*").alias("n_after"))
    return a.crossJoin(b).withColumn("reduction_pct", F.coalesce(F.try_divide(100.0 * (F.col("n_before") - F.col("n_after")), F.col("n_before")), F.lit(0.0)))


def prefilter_or_all(logs: DataFrame, min_rows: int, cap: int = MAX_DUPLICATES, seed: int = 42) -> DataFrame:
    """The reduced rows, or all if fewer than `min_rows` are left."""
    out = prefilter(logs, cap, seed)
    return out if len(out.select("log_id").take(max(1, min_rows))) >= max(1, min_rows) else logs
