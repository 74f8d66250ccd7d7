"""Streams of log rows (timestamps with a zone, as watermarks need)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.functions.tokens import event_type, extract_parameters, extract_template


def parse_stream(logs: DataFrame, message: str = "message") -> DataFrame:
    """Template, parameters and event type; stateless."""
    t = logs.withColumn("template", extract_template(F.col(message)))
    return t.withColumn("parameters", extract_parameters(F.col("template"), F.col(message))).withColumn("event_type", event_type(F.col("template")))


def tumbling_counts(logs: DataFrame, *keys: str, width: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """bucket, keys, n per tumbling window; rows later than `late` are dropped, and state is kept no longer."""
    own = logs.withColumn("event_time", F.col("timestamp").cast("timestamp")).withWatermark("event_time", late)
    return own.groupBy(F.window("event_time", width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("bucket"), *keys, "n")


def new_templates(parsed: DataFrame, late: str = "1 day") -> DataFrame:
    """The first row of each template within the watermark."""
    own = parsed.withColumn("event_time", F.col("timestamp").cast("timestamp")).withWatermark("event_time", late)
    return own.dropDuplicatesWithinWatermark(["template"])


def upsert_counts(counts: DataFrame, path: str, checkpoint: str) -> None:
    """Run a counting stream over what is there now; each batch's changed counts are appended with its number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.parquet(f"{path}/batch={number}", mode="overwrite")

    q = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()


def read_counts(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """The last count of every bucket."""
    rows = spark.read.parquet(path)
    return rows.groupBy("bucket", *keys).agg(F.max_by("n", "batch").alias("n"))
