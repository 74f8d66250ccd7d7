"""Numeric anomalies per field, group and cluster."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlog.functions.tokens import number
from lumenlog.session import materialize

#: Rows of a group whose distinct values an aggregation buffer may hold.
MAX_BUFFER = 1_000_000


def numeric_fields(logs: DataFrame, sample: int = 100, share: float = 0.8) -> DataFrame:
    """field: parameters that are numbers in at least `share` of the first `sample` rows (by log_id) that have any."""
    some = logs.where(F.col("parameters").isNotNull()).orderBy("log_id").limit(sample).select("log_id", "parameters")
    n = some.agg(F.count("*").alias("n"))
    long = some.select(F.explode("parameters").alias("field", "v")).groupBy("field").agg(F.count_if(number(F.col("v")).isNotNull()).alias("c"))
    return long.crossJoin(n).where(F.col("c") >= share * F.col("n")).select("field")  # n is one row


def numeric_columns(df: DataFrame, skip: tuple[str, ...] = ("message", "component", "level", "timestamp")) -> list[str]:
    """Columns of which every value is a number."""
    names = [f.name for f in df.schema if f.name not in skip and f.dataType.typeName() not in ("map", "array", "struct", "binary")]
    if not names:
        return []
    row = df.agg(*[F.min(number(F.col(f"`{c}`").cast("string")).isNotNull()).alias(c) for c in names]).first()
    return [c for c in names if row[c]]


def long_values(df: DataFrame, fields: list[str], keys: list[str]) -> DataFrame:
    """keys, field, value: a row for each field of each row."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), number(F.col(f"`{c}`").cast("string")).alias("value")) for c in fields])
    return df.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.field", "x.value")


def parameter_values(logs: DataFrame, keys: list[str], fields: DataFrame | None = None) -> DataFrame:
    """keys, field, value of the numeric parameters."""
    long = logs.select(*keys, F.explode("parameters").alias("field", "v")).select(*keys, "field", number(F.col("v")).alias("value"))
    return long if fields is None else long.join(F.broadcast(fields), "field", "left_semi").select(*keys, "field", "value")


def quantiles(long: DataFrame, keys: list[str], probs: list[float], value: str = "value") -> DataFrame:
    """keys, q (exact quantiles, interpolated linearly; null values don't count), rows (null values included).

    Groups of up to MAX_BUFFER rows are aggregated in memory. If one is larger, so that its values might not fit
    there, values are counted before the shuffle and ranks are found by sums over ranges of distinct values, then in the
    few ranges that hold a wanted rank."""
    most = long.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if most <= MAX_BUFFER:
        q = F.percentile(value, F.array(*map(F.lit, probs)))
        return long.groupBy(*keys).agg(q.alias("q"), F.count(F.lit(1)).alias("rows"))
    return _ranked_quantiles(long, keys, probs, value)


def _ranked_quantiles(long: DataFrame, keys: list[str], probs: list[float], value: str) -> DataFrame:
    k = [f"k{i}" for i in range(len(keys))]
    own = long.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keys, k, strict=True)], F.col(value).cast("double").alias("v"))
    sizes = own.groupBy(*k).agg(F.count(F.lit(1)).alias("rows"), F.count("v").alias("n"))

    def meet(left: DataFrame, right: DataFrame, *on: Column, how: str = "inner") -> DataFrame:
        """Rows of one group (null keys are equal); the right side's keys go."""
        named = right.withColumnsRenamed({c: f"{c}_r" for c in k})
        on = [*[F.col(c).eqNullSafe(F.col(f"{c}_r")) for c in k], *on]
        return left.join(named, reduce(and_, on, F.lit(True)), how).drop(*[f"{c}_r" for c in k])

    counts = own.where("v is not null").groupBy(*k, "v").agg(F.count(F.lit(1)).alias("c"))
    # The parts of a range partitioning follow the order of the values, and hold about as many of them each.
    counts = materialize(counts.repartitionByRange(*k, "v").withColumn("part", F.spark_partition_id()), "counts")
    parts = counts.groupBy(*k, "part").agg(F.sum("c").alias("c"))
    parts = parts.withColumn("end", F.sum("c").over(W.partitionBy(*k).orderBy("part")))
    # Ranks from 0: those at either side of each quantile.
    at = [F.lit(p) * (F.col("n") - 1) for p in probs]
    want = F.array(*[F.struct(F.lit(i).alias("i"), x.alias("at"), F.floor(x).alias("a"), F.ceil(x).alias("b")) for i, x in enumerate(at)])
    asked = materialize(sizes.select(*k, "rows", "n", want.alias("want")), "asked")
    marks = asked.where("n > 0").select(*k, F.explode(F.array_distinct(F.flatten(F.transform("want", lambda w: F.array(w["a"], w["b"]))))).alias("rank"))

    def holding(runs: DataFrame, marks: DataFrame, *rest: str | Column) -> DataFrame:
        """The runs of ranks (end - c up to end) that hold a mark of their group."""
        return meet(runs, marks, (F.col("rank") >= F.col("end") - F.col("c")) & (F.col("rank") < F.col("end"))).select(*k, *rest)

    held = holding(parts, marks, F.col("part").alias("held"), (F.col("end") - F.col("c")).alias("before")).distinct()
    few = meet(counts, held, F.col("part") == F.col("held"))
    few = few.withColumn("end", F.col("before") + F.sum("c").over(W.partitionBy(*k, "part").orderBy("v")))
    found = holding(few, marks, "rank", "v").groupBy(*k).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("got"))
    out = meet(asked, found, how="left")

    def between(w: Column) -> Column:
        low, high = F.col("got")[w["a"]], F.col("got")[w["b"]]
        return F.when(low == high, low).otherwise((w["b"] - w["at"]) * low + (w["at"] - w["a"]) * high)

    q = F.when(F.col("n") > 0, F.transform("want", between))
    return out.select(*[F.col(n).alias(c) for c, n in zip(keys, k, strict=True)], q.alias("q"), "rows")


def outliers(long: DataFrame, robust: bool = True, group: str | None = None, factor: float = 1.5, sigmas: float = 3.0, min_samples: int = 10, ddof: int = 1) -> DataFrame:
    """`long` with is_outlier. robust: beyond the quartiles by more than factor * IQR (none if it is 0); else more
    than `sigmas` deviations from the mean (none if it is 0). With `group`, per group; group -1 and groups of fewer
    than `min_samples` rows (null values included) have none. One aggregation and a join, which adaptive execution
    broadcasts or splits."""
    keys = ["field", *([group] if group else [])]
    if robust:
        stats = quantiles(long, keys, [0.25, 0.75])
        iqr = F.col("q")[1] - F.col("q")[0]
        hit = (iqr > 0) & ((F.col("value") < F.col("q")[0] - factor * iqr) | (F.col("value") > F.col("q")[1] + factor * iqr))
    else:
        sd = F.stddev_samp("value") if ddof else F.stddev_pop("value")
        stats = long.groupBy(*keys).agg(F.avg("value").alias("m"), sd.alias("s"), F.count(F.lit(1)).alias("rows"))
        hit = (F.col("s") > 0) & (F.abs(F.col("value") - F.col("m")) / F.col("s") > sigmas)
    if group:
        hit = hit & (F.col(group).cast("string") != "-1") & (F.col("rows") >= min_samples)
    out = long.join(stats, keys, "left")
    return out.select(*long.columns, F.coalesce(hit, F.lit(False)).alias("is_outlier"))


def any_outlier(flags: DataFrame, key: str) -> DataFrame:
    return flags.groupBy(key).agg(F.bool_or("is_outlier").alias("is_outlier"))


def cluster_deviations(long: DataFrame, cluster: str, key: str = "log_id", sigmas: float = 2.5) -> DataFrame:
    """key, field, deviation: values more than `sigmas` sample deviations from the mean of their cluster (of at least
    two values)."""
    stats = long.groupBy(cluster, "field").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    z = F.abs(F.col("value") - F.col("m")) / F.col("s")
    return long.join(stats, [cluster, "field"]).where((F.col("s") > 0) & (z > sigmas)).select(key, "field", z.alias("deviation"))
