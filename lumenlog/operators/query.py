"""Filters and the standard aggregates over log rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def filter_logs(logs: DataFrame, start=None, end=None, level=None, component: str | None = None, template_pattern: str | None = None, parameters: dict | None = None, limit: int | None = None, column: str = "template") -> DataFrame:
    """Rows in [start, end], of a level (or one of a list), of a component, with `template_pattern` somewhere in
    `column` (% and _ stay wildcards) and with all of `parameters`; the latest `limit` rows, latest first. None is
    no filter."""
    if start is not None:
        logs = logs.where(F.col("timestamp") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        logs = logs.where(F.col("timestamp") <= F.lit(end).cast("timestamp_ntz"))
    if level is not None:
        logs = logs.where(F.col("level").isin(*([level] if isinstance(level, str) else level)))
    if component is not None:
        logs = logs.where(F.col("component") == component)
    if template_pattern is not None:
        logs = logs.where(F.col(column).like(f"%{template_pattern}%"))
    for k, v in (parameters or {}).items():
        logs = logs.where(F.col("parameters")[k] == str(v))
    return logs if limit is None else logs.orderBy(F.desc("timestamp"), F.desc("log_id")).limit(limit)


def recent(logs: DataFrame, hours: float, as_of: datetime | str | None = None, limit: int | None = None) -> DataFrame:
    """Rows of the last `hours` up to `as_of` (default: now)."""
    end = (F.current_timestamp() if as_of is None else F.lit(as_of)).cast("timestamp_ntz")
    own = logs.where((F.col("timestamp") >= end - F.make_dt_interval(secs=F.lit(hours * 3600.0))) & (F.col("timestamp") <= end))
    return own if limit is None else own.orderBy(F.desc("timestamp"), F.desc("log_id")).limit(limit)


def bucket(width: str = "1 hour", ts: str = "timestamp") -> Column:
    return F.window(F.col(ts), width)["start"]


def counts_by_time(logs: DataFrame, *keys: str, width: str = "1 hour", levels: list[str] | None = None) -> DataFrame:
    """bucket, keys and n."""
    own = logs if levels is None else logs.where(F.col("level").isin(*levels))
    return own.groupBy(bucket(width).alias("bucket"), *keys).agg(F.count("*").alias("n"))


def top(logs: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The k most frequent values; ties by the value."""
    return logs.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def template_registry(parsed: DataFrame) -> DataFrame:
    """template_id (E1, E2, ... in the order of first sight), template, n, first_id."""
    seen = parsed.groupBy("template").agg(F.count("*").alias("n"), F.min("log_id").alias("first_id"))
    return seen.select(F.concat(F.lit("E"), F.row_number().over(W.orderBy("first_id"))).alias("template_id"), "template", "n", "first_id")


def logs_of_template(parsed: DataFrame, registry: DataFrame, template_id: str) -> DataFrame:
    return parsed.join(F.broadcast(registry.where(F.col("template_id") == template_id).select("template", "template_id")), "template")


def prepare(raw: DataFrame) -> DataFrame:
    """Log rows of a structured file's Time, Level and Content; what is absent is null, component is the second word."""
    get = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    words = F.split(F.trim(get("Content")), r"\s+")
    return raw.select(
        F.col("LineId").cast("long").alias("log_id"), get("Time").try_cast("timestamp_ntz").alias("timestamp"), get("Level").alias("level"),
        F.coalesce(F.get(words, 1), F.lit("")).alias("component"), F.lit("").alias("template"), F.create_map().cast("map<string,string>").alias("parameters"), get("Content").alias("message"),
    )


def with_results(prepared: DataFrame, parsed: DataFrame) -> DataFrame:
    return prepared.drop("template", "parameters").join(parsed.select("log_id", "template", "parameters"), "log_id", "left")


def with_defaults(parsed: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Missing timestamp, level and component filled."""
    fill = {"timestamp": as_of if as_of is not None else F.current_timestamp().cast("timestamp_ntz"), "level": F.lit("INFO"), "component": F.lit("unknown")}
    return parsed.withColumns({c: F.coalesce(c, v) for c, v in fill.items()})


def run_metrics(parsed: DataFrame, kind: str = "event_type", ms: str | None = None) -> DataFrame:
    """One row: totals by event type (in any case), errors, templates and, with `ms`, parse times."""
    k = F.upper(kind)
    aggs = [F.count("*").alias("total"), *[F.count_if(k == x).alias(f"n_{x.lower()}") for x in ("ERROR", "WARNING", "INFO", "DEBUG")], F.count_if(~k.isin("ERROR", "WARNING", "INFO", "DEBUG") | k.isNull()).alias("n_unknown"), F.count_distinct("template").alias("n_templates")]
    if ms:
        aggs += [F.avg(ms).alias("avg_ms"), F.max(ms).alias("max_ms"), F.min(ms).alias("min_ms")]
    return parsed.agg(*aggs)


def counter_vector(logs: DataFrame, width: str = "15 minutes", keys: tuple[str, ...] = ("template", "level", "component")) -> DataFrame:
    return counts_by_time(logs, *keys, width=width)


def pivot_parameters(logs: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """log_id and a column for each parameter; `fields` saves the pass that finds them."""
    long = logs.select("log_id", F.explode("parameters").alias("field", "v"))
    return long.groupBy("log_id").pivot("field", fields).agg(F.first("v"))
