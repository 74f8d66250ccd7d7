"""Log sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.schema import LOGS


def _flat(df: DataFrame) -> DataFrame:
    """Maps, arrays and structs as JSON."""
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("map", "array", "struct")]
    return df.select(*[F.to_json(c).alias(c) if c in nested else F.col(f"`{c}`") for c in df.columns])


def create_logs_table(spark: SparkSession, table: str, schema: str = LOGS) -> None:
    """A Parquet table of log rows by date; an existing one stays."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({schema}, date date) USING parquet PARTITIONED BY (date)")


def append_logs(df: DataFrame, table: str) -> None:
    """Append log rows; the write is committed as a whole. Missing columns are null."""
    schema = df.sparkSession.table(table).schema
    own = df.withColumn("date", F.to_date("timestamp"))
    own.select(*[(F.col(f.name) if f.name in own.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]).write.insertInto(table)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    _flat(df).write.csv(path, header=True, mode=mode, escape='"')


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.json(path, mode=mode)


def template_file(parsed: DataFrame, examples: int = 5) -> DataFrame:
    """event_id, template, n and up to `examples` messages (smallest ids) of each normalised template, E1, E2, ...
    by frequency."""
    from pyspark.sql import Window as W

    from lumenlog.functions.tokens import normalize_template

    own = parsed.select(normalize_template(F.col("template")).alias("template"), "log_id", "message")
    counts = own.groupBy("template").agg(F.count("*").alias("n"), F.min("log_id").alias("first"))
    few = own.withColumn("k", F.row_number().over(W.partitionBy("template").orderBy("log_id"))).where(F.col("k") <= examples)
    shown = few.groupBy("template").agg(F.transform(F.sort_array(F.collect_list(F.struct("log_id", "message"))), lambda e: e["message"]).alias("examples"))
    rank = F.row_number().over(W.orderBy(F.desc("n"), "first"))  # one row per template
    return counts.join(shown, "template").select(F.concat(F.lit("E"), rank).alias("event_id"), "template", "n", "examples")


def write_template_files(parsed: DataFrame, path: str, mode: str = "error") -> None:
    write_csv(template_file(parsed), path, mode)


def write_report(spark: SparkSession, path: str, title: str, metrics: dict[str, object], top: DataFrame | None = None) -> str:
    """A Markdown report of a few figures and of a small table's rows; returns its text."""
    lines = [f"# {title}", "", *(f"- {k}: {v}" for k, v in metrics.items())]
    if top is not None:
        lines += ["", f"| {' | '.join(top.columns)} |", "|" + " --- |" * len(top.columns), *(f"| {' | '.join(map(str, r))} |" for r in top.limit(100).collect())]
    text = "\n".join(lines) + "\n"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return text
