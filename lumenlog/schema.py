"""The log data model: schemas, the log view of an event stream, and its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stored log rows. `timestamp` has no time zone; parameters are a flat map, JSON at the edges.
LOGS = "log_id long, timestamp timestamp_ntz, level string, component string, template string, parameters map<string,string>, message string, embedding array<float>"
#: Kinds of variables in templates.
VARIABLES = ("OID", "LOI", "OBN", "TID", "SID", "TDA", "CRS", "OBA", "STC", "OTHER_PARAMS", "OTP")


def logs_view(events: DataFrame) -> DataFrame:
    """events (event_id, ts, user_id, event_type, value, props) as log rows."""
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARNING").when(F.col("event_type") == "click", "DEBUG").otherwise("INFO")
    s = lambda c: F.col(c).cast("string")
    net = F.concat(F.lit("10.0."), (F.col("user_id") % 7).cast("string"), F.lit("."), (F.col("user_id") % 250).cast("string"))
    message = F.concat(F.lit("User u"), s("user_id"), F.lit(" from "), net, F.lit(" did "), F.col("event_type"), F.lit(" size "), F.floor("value").cast("string"))
    return events.select(
        F.col("event_id").alias("log_id"), F.col("ts").alias("timestamp"), level.alias("level"), F.concat(F.lit("svc-"), (F.col("user_id") % 10).cast("string")).alias("component"),
        message.alias("message"), F.from_json("props", "map<string,string>").alias("parameters"), "value", "event_type", "user_id",
    )


LOGS_SQL = """logs AS (
  SELECT event_id AS log_id, ts, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING' WHEN 'click' THEN 'DEBUG' ELSE 'INFO' END AS level,
         'svc-' || (user_id % 10) AS component, props, value, event_type, user_id,
         'User u' || user_id || ' from 10.0.' || (user_id % 7) || '.' || (user_id % 250) || ' did ' || event_type || ' size ' || CAST(floor(value) AS BIGINT) AS message
  FROM events)"""
