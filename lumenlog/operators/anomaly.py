"""Incident and trend anomalies."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlog.operators import cluster, numeric, prefilter, query
from lumenlog.session import materialize

BAD_LEVELS = ("ERROR", "CRITICAL")


def explain(message: Column, embedding_flag: Column, size: Column, label: Column, fields: Column, deviations: Column) -> Column:
    """Reasons in one text, the message cut at 200 characters."""
    short = F.when(F.length(message) > 200, F.concat(F.substring(message, 1, 200), F.lit("..."))).otherwise(message)
    values = F.array_join(F.zip_with(fields, deviations, lambda f, d: F.concat(F.lit("field "), f, F.lit(" is "), F.format_number(d, 2), F.lit(" deviations from its cluster"))), "; ")
    noise = F.when(embedding_flag & (label == -1), F.lit("unlike any group of messages"))
    small = F.when(embedding_flag & (label != -1), F.concat(F.lit("in a small group of "), size.cast("string")))
    return F.concat(short, F.lit(" : "), F.concat_ws("; ", noise, small, F.when(F.size(fields) > 0, values)))


def detect(logs: DataFrame, start=None, end=None, eps: float = 0.3, min_samples: int = 3, sigmas: float = 2.5, reduce: bool = False, max_explanations: int = 100, level=None, component: str | None = None, explainer: Callable[..., Column] = explain) -> DataFrame:
    """The anomalous rows of a window, latest first: cluster_label, flags, deviations of numeric fields within the
    row's cluster, and for the first `max_explanations` an explanation. With `reduce`, only the pre-filtered rows are
    looked at (all, if fewer than min_samples are left). Rows without an embedding are noise. `explainer` makes the
    explanation of the columns that `explain` takes (a pandas UDF will do)."""
    own = query.filter_logs(logs, start, end, level, component)
    if reduce:
        own = prefilter.prefilter_or_all(own, min_samples)
    own = materialize(own, "window")
    labels = materialize(cluster.embedding_anomalies(cluster.dbscan(own, eps=eps, min_samples=min_samples), min_samples), "labels")
    tagged = own.join(labels, "log_id")
    fields = materialize(numeric.numeric_fields(own), "fields")
    long = numeric.parameter_values(tagged, ["log_id", "cluster_label"], fields)
    devs = numeric.cluster_deviations(long, "cluster_label", sigmas=sigmas)
    per = devs.groupBy("log_id").agg(F.sort_array(F.collect_list(F.struct("field", "deviation"))).alias("d"))
    empty = F.array().cast("array<struct<field:string,deviation:double>>")
    out = tagged.join(per, "log_id", "left").withColumn("d", F.coalesce("d", empty))
    out = out.withColumn("is_numeric_anomaly", F.size("d") > 0).withColumn("numeric_fields", F.transform("d", lambda x: x["field"])).withColumn("numeric_deviations", F.transform("d", lambda x: x["deviation"])).drop("d")
    out = out.withColumn("is_anomaly", F.col("is_embedding_anomaly") | F.col("is_numeric_anomaly")).where("is_anomaly")
    out = materialize(out, "anomalies")
    first = out.select("log_id", "timestamp").orderBy(F.desc("timestamp"), F.desc("log_id")).limit(max_explanations).select("log_id", F.lit(True).alias("told"))
    text = explainer(F.col("message"), F.col("is_embedding_anomaly"), F.col("cluster_size"), F.col("cluster_label"), F.col("numeric_fields"), F.col("numeric_deviations"))
    out = out.join(F.broadcast(first), "log_id", "left").withColumn("explanation", F.when(F.col("told"), text)).drop("told")
    meta = {"detection_time": F.current_timestamp()}
    if start is not None and end is not None:
        meta["detection_window_hours"] = F.round((F.unix_timestamp(F.lit(end).cast("timestamp")) - F.unix_timestamp(F.lit(start).cast("timestamp"))) / 3600).cast("int")
    return out.withColumns(meta).orderBy(F.desc("timestamp"), F.desc("log_id"))


def summary(rows: DataFrame) -> DataFrame:
    """One row: total, embedding and numeric anomalies, components, share of bad levels."""
    flag = lambda c: F.count_if(F.col(c)) if c in rows.columns else F.lit(None).cast("long")
    return rows.agg(F.count("*").alias("total"), flag("is_embedding_anomaly").alias("embedding"), flag("is_numeric_anomaly").alias("numeric"), F.count_distinct("component").alias("components"), F.avg(F.col("level").isin(*BAD_LEVELS).cast("double")).alias("error_ratio"))


def history_windows(rows: DataFrame, as_of: datetime | str, hours: int = 4, days: int = 7) -> DataFrame:
    """window (0: the latest), total, components, error_ratio of the back-to-back half-open windows of `hours` that
    end at `as_of`, `days` long in all; windows without rows are absent. One pass."""
    end = F.lit(as_of).cast("timestamp_ntz")
    age = F.unix_micros(end.cast("timestamp")) - F.unix_micros(F.col("timestamp").cast("timestamp"))
    k = F.floor((age - 1) / (hours * 3_600_000_000)).cast("long")
    own = rows.withColumn("window", k).where((F.col("window") >= 0) & (F.col("window") < days * 24 // hours) & (age > 0))
    return own.groupBy("window").agg(F.count("*").alias("total"), F.count_distinct("component").alias("components"), F.avg(F.col("level").isin(*BAD_LEVELS).cast("double")).alias("error_ratio"))


def detection_history(logs: DataFrame, as_of: datetime | str, hours: int = 4, days: int = 7, **options) -> DataFrame:
    """history_windows of what `detect` finds in each window on its own."""
    end = datetime.fromisoformat(str(as_of))
    from datetime import timedelta

    from functools import reduce as fold

    parts = []
    for k in range(days * 24 // hours):
        b = end - timedelta(hours=hours * k)
        found = detect(logs.where(F.col("timestamp") < F.lit(b).cast("timestamp_ntz")), start=b - timedelta(hours=hours), **options)
        parts.append(summary(found).withColumn("window", F.lit(k).cast("long")).where("total > 0"))
    return fold(DataFrame.unionByName, parts)


def history_stats(windows: DataFrame) -> DataFrame:
    """One row: mean, sample deviation and 95th percentile of totals, mean error ratio."""
    return windows.agg(F.avg("total").alias("mean_total"), F.stddev_samp("total").alias("std_total"), F.percentile("total", F.lit(0.95)).alias("p95_total"), F.avg("error_ratio").alias("mean_error_ratio"))


def current_vs_history(current: DataFrame, windows: DataFrame) -> DataFrame:
    """One row: z of the current total (null without spread), share of windows with at least as many, ratio to the
    mean (infinite for a mean of 0) and the difference of error ratios."""
    cur = current.select(F.col("total").alias("now_total"), F.col("error_ratio").alias("now_ratio"))
    both = windows.crossJoin(F.broadcast(cur))  # one row
    agg = both.agg(F.avg("total").alias("m"), F.stddev_samp("total").alias("s"), F.avg("error_ratio").alias("r"), F.avg((F.col("total") >= F.col("now_total")).cast("double")).alias("at_least"), F.first("now_total").alias("t"), F.first("now_ratio").alias("q"))
    ratio = F.when(F.col("m") == 0, float("inf")).otherwise(F.col("t") / F.nullif("m", F.lit(0.0)))
    return agg.select(((F.col("t") - F.col("m")) / F.nullif("s", F.lit(0.0))).alias("z"), (100 * F.col("at_least")).alias("percentile"), ratio.alias("ratio"), (F.col("q") - F.col("r")).alias("error_ratio_delta"))


def split_by_time(rows: DataFrame, share: float = 0.7, order: str = "bucket") -> DataFrame:
    """Few, already aggregated rows with is_train: the first floor(n * share) in order."""
    rank = F.row_number().over(W.orderBy(order))
    n = F.count("*").over(W.partitionBy())
    return rows.withColumn("is_train", rank <= F.floor(n * share))


def timeseries_anomalies(logs: DataFrame, width: str = "1 hour", method: str = "deviation", sigmas: float = 3.0, share: float = 0.7) -> DataFrame:
    """bucket, n, score of the later buckets whose count is unlike the earlier: beyond `sigmas` sample deviations of
    the earlier mean, or with an isolation score over 0.6."""
    counts = split_by_time(query.counts_by_time(logs, width=width), share)
    train, test = counts.where("is_train"), counts.where("not is_train")
    if method == "isolation_forest":
        scored = cluster.isolation_scores(train, test, ["n"], ["bucket"])
        return test.select("bucket", "n").join(scored, "bucket").where("score > 0.6")
    stats = train.agg(F.avg("n").alias("m"), F.stddev_samp("n").alias("s"))
    scored = test.crossJoin(stats).withColumn("score", F.abs(F.col("n") - F.col("m")) / F.nullif("s", F.lit(0.0)))  # one row
    return scored.where(F.col("score") > sigmas).select("bucket", "n", "score")


def semantic_anomalies(parsed: DataFrame, threshold: float = 0.6, share: float = 0.7) -> DataFrame:
    """log_id, score of rows of the later part whose message vector is isolated among the earlier part's; the parts
    are split at the timestamp quantile `share`."""
    from pyspark.ml.functions import vector_to_array

    vectors = cluster.message_vectors(parsed, size=8)
    cut = parsed.agg(F.percentile_approx(F.unix_micros(F.col("timestamp").cast("timestamp")), share).alias("c")).first().c or 0
    wide = materialize(vectors.select("log_id", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("us"), *[vector_to_array("features")[i].alias(f"f{i}") for i in range(9)]), "vectors")
    cols = [f"f{i}" for i in range(9)]
    return cluster.isolation_scores(wide.where(F.col("us") <= cut), wide.where(F.col("us") > cut), cols, ["log_id"]).where(F.col("score") > threshold)
