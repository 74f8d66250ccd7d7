"""Registered queries over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog import streaming
from lumenlog.functions import tokens as T
from lumenlog.operators import anomaly, cluster, evaluate, numeric, prefilter, query, templates
from lumenlog.schema import LOGS_SQL, logs_view
from lumenlog.session import new_path
from lumenlog.sources import readers, sinks

AS_OF = "2024-01-31 00:00:00"
#: Neighbours in `embeddings` are at about this distance.
EPS, MIN_SAMPLES = 0.65, 3
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

TPL = (
    "array_to_string(list_transform(string_split(trim(message), ' '), lambda t: CASE"
    " WHEN regexp_full_match(t, '\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}') THEN '<LOI>' WHEN regexp_full_match(t, '\\d+') THEN '<OBA>'"
    " WHEN regexp_full_match(t, '0x[0-9a-fA-F]+') THEN '<OID>' WHEN regexp_full_match(t, '[a-zA-Z0-9_-]+\\d+') THEN '<OID>' ELSE t END), ' ')"
)
PARSED = f"parsed AS (SELECT *, {TPL} AS template FROM logs)"
EVAL = "ev AS (SELECT log_id, template AS pred, CASE WHEN user_id % 3 = 0 THEN replace(template, '<OBA>', '<*>') ELSE template END AS truth FROM parsed)"


def register(name: str, sql: str | None = None, ctes: str = "logs"):
    """Register a function of (spark, logs); `ctes`: which of logs, parsed and ev the SQL needs before it."""
    chain = {"logs": [LOGS_SQL], "parsed": [LOGS_SQL, PARSED], "ev": [LOGS_SQL, PARSED, EVAL], "": []}[ctes]

    def add(f: Callable[[SparkSession, DataFrame, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(spark, logs_view(spark.read.parquet(f"{sf_dir}/events.parquet")), sf_dir)
        if sql is not None:
            head = ("WITH RECURSIVE " if "RECURSIVE" in sql else "WITH ") + ", ".join(chain) if chain else ""
            body = sql.replace("RECURSIVE", "")
            ORACLE[name] = f"{head}{', ' if head and body.lstrip().startswith('+') else ' '}{body.replace('+', '', 1) if body.lstrip().startswith('+') else body}"
        return f

    return add


def parsed(logs: DataFrame) -> DataFrame:
    return templates.parse_logs(logs, None)


def scored(logs: DataFrame) -> DataFrame:
    t = T.extract_template(F.col("message"))
    return logs.select("log_id", t.alias("pred"), F.when(F.col("user_id") % 3 == 0, F.replace(t, F.lit("<OBA>"), F.lit("<*>"))).otherwise(t).alias("truth"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Time-bucket, frequency and top-k queries.


@register("error_count_by_time", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, count(*) AS n FROM logs WHERE level = 'ERROR' GROUP BY 1")
def _(spark, logs, d):
    return query.counts_by_time(logs, levels=["ERROR"])


@register("component_activity", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, component, count(*) AS n FROM logs GROUP BY 1, 2")
def _(spark, logs, d):
    return query.counts_by_time(logs, "component").orderBy("bucket", F.desc("n"))


@register("template_frequency", "SELECT template, count(*) AS n FROM parsed GROUP BY 1 ORDER BY n DESC, template LIMIT 10", "parsed")
def _(spark, logs, d):
    return query.top(parsed(logs), "template")


@register("level_trends", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, level, count(*) AS n FROM logs WHERE level IN ('ERROR', 'WARNING', 'INFO') GROUP BY 1, 2")
def _(spark, logs, d):
    return query.counts_by_time(logs, "level", levels=["ERROR", "WARNING", "INFO"])


@register("top_components", "SELECT component, count(*) AS n FROM logs GROUP BY 1 ORDER BY n DESC, component LIMIT 10")
def _(spark, logs, d):
    return query.top(logs, "component")


@register("component_15min", "SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS bucket, component, count(*) AS n FROM logs GROUP BY 1, 2")
def _(spark, logs, d):
    return query.counts_by_time(logs, "component", width="15 minutes")


@register("value_counts", "SELECT level, event_type, count(*) AS n FROM logs GROUP BY 1, 2")
def _(spark, logs, d):
    return logs.groupBy("level", "event_type").agg(F.count("*").alias("n"))


# Filters.


@register("filter_logs", "SELECT log_id, ts AS timestamp, level, component, message FROM logs WHERE ts BETWEEN '2024-01-05' AND '2024-01-25' AND level = 'ERROR' AND component = 'svc-3' AND message LIKE '%size 1%' ORDER BY ts DESC, log_id DESC LIMIT 50")
def _(spark, logs, d):
    return query.filter_logs(logs, "2024-01-05", "2024-01-25", "ERROR", "svc-3", "size 1", limit=50, column="message").select("log_id", "timestamp", "level", "component", "message")


@register("recent_window", f"SELECT log_id, level FROM logs WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 72 HOUR AND ts <= TIMESTAMP '{AS_OF}'")
def _(spark, logs, d):
    return query.recent(logs, 72, AS_OF).select("log_id", "level")


@register("json_contains", "SELECT log_id, component FROM logs WHERE json_extract_string(props, '$.k') = '7'")
def _(spark, logs, d):
    return query.filter_logs(logs, parameters={"k": 7}).select("log_id", "component")


@register("like_template", "SELECT log_id, template FROM parsed WHERE template LIKE '%did %urchase%'", "parsed")
def _(spark, logs, d):
    return query.filter_logs(parsed(logs), template_pattern="did %urchase").select("log_id", "template")


@register("level_in_list", "SELECT level, count(*) AS n FROM logs WHERE level IN ('ERROR', 'WARNING') GROUP BY 1")
def _(spark, logs, d):
    return query.filter_logs(logs, level=["ERROR", "WARNING"]).groupBy("level").agg(F.count("*").alias("n"))


@register("logs_of_template", "+one AS (SELECT template, min(log_id) AS f FROM parsed GROUP BY 1 ORDER BY f LIMIT 1 OFFSET 1) SELECT log_id, 'E2' AS template_id FROM parsed WHERE template = (SELECT template FROM one)", "parsed")
def _(spark, logs, d):
    rows = parsed(logs)
    return query.logs_of_template(rows, query.template_registry(rows), "E2").select("log_id", "template_id")


# Tokens and templates.


@register("tokenize_counts", "SELECT CAST(len(string_split(trim(message), ' ')) AS INTEGER) AS n_tokens, count(*) AS n FROM logs GROUP BY 1")
def _(spark, logs, d):
    return logs.groupBy(F.size(T.tokenize(F.col("message"))).alias("n_tokens")).agg(F.count("*").alias("n"))


@register("extract_template", "SELECT template, count(*) AS n FROM parsed GROUP BY 1", "parsed")
def _(spark, logs, d):
    return logs.groupBy(T.extract_template(F.col("message")).alias("template")).agg(F.count("*").alias("n"))


@register("fallback_template", "SELECT array_to_string(list_transform(string_split(trim(message), ' '), lambda t: CASE WHEN regexp_matches(t, '^[A-Za-z]') THEN regexp_replace(t, '^u\\d+$', 'u') ELSE '<OTHER_PARAMS>' END), ' ') AS template, count(*) AS n FROM logs GROUP BY 1")
def _(spark, logs, d):
    t = T.fallback_template(F.regexp_replace("message", r" u\d+ ", " u "))
    return logs.groupBy(t.alias("template")).agg(F.count("*").alias("n"))


@register("extract_parameters", "SELECT log_id, string_split(message, ' ')[2] AS oid, string_split(message, ' ')[4] AS loi, string_split(message, ' ')[8] AS oba FROM logs")
def _(spark, logs, d):
    p = F.col("parameters")
    return parsed(logs).select("log_id", p["param_1_OID"].alias("oid"), p["param_3_LOI"].alias("loi"), p["param_7_OBA"].alias("oba"))


@register("normalize_template", "SELECT regexp_replace(template, '<[^>]+>', '<*>', 'g') AS template, count(*) AS n FROM parsed GROUP BY 1", "parsed")
def _(spark, logs, d):
    return parsed(logs).groupBy(T.normalize_template(F.col("template")).alias("template")).agg(F.count("*").alias("n"))


@register("mask_tokens", "SELECT regexp_replace(regexp_replace(message, '\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}', '<IP>', 'g'), '\\d+', '<NUM>', 'g') AS masked, count(*) AS n FROM logs GROUP BY 1")
def _(spark, logs, d):
    return logs.groupBy(T.mask(F.col("message")).alias("masked")).agg(F.count("*").alias("n"))


@register("structural_key", "SELECT array_to_string(list_filter(string_split(message, ' '), lambda t: regexp_matches(t, '[\\[\\]{}()=:/]') OR NOT regexp_matches(t, '[a-z]') OR t = 'error'), ' ') AS k, count(*) AS n FROM logs GROUP BY 1")
def _(spark, logs, d):
    return logs.groupBy(T.structural_key(F.col("message")).alias("k")).agg(F.count("*").alias("n"))


@register("event_type", "SELECT CASE WHEN contains(upper(template), 'ERROR') OR contains(upper(template), 'FAIL') THEN 'ERROR' WHEN contains(upper(template), 'WARN') THEN 'WARNING' WHEN contains(upper(template), 'DEBUG') THEN 'DEBUG' WHEN contains(upper(template), 'INFO') THEN 'INFO' ELSE 'UNKNOWN' END AS event_type, count(*) AS n FROM parsed GROUP BY 1", "parsed")
def _(spark, logs, d):
    return parsed(logs).groupBy("event_type").agg(F.count("*").alias("n"))


@register("template_registry", "SELECT 'E' || row_number() OVER (ORDER BY min(log_id)) AS template_id, template, count(*) AS n, min(log_id) AS first_id FROM parsed GROUP BY template", "parsed")
def _(spark, logs, d):
    return query.template_registry(parsed(logs))


_PAIRS = "+t AS (SELECT DISTINCT template FROM parsed), p AS (SELECT a.template AS first, b.template AS second, string_split(a.template, ' ') AS x, string_split(b.template, ' ') AS y FROM t a JOIN t b ON a.template < b.template)"
_SIM = "2.0 * len(list_filter(list_filter(y, lambda v: NOT contains(v, '<')), lambda v: list_contains(list_filter(x, lambda w: NOT contains(w, '<')), v))) / (len(list_filter(x, lambda w: NOT contains(w, '<'))) + len(list_filter(y, lambda v: NOT contains(v, '<'))))"


def template_pairs(logs: DataFrame) -> DataFrame:
    return templates.pair_matches(parsed(logs).select("template").distinct(), 0.8)


@register("token_similarity", f"{_PAIRS} SELECT first, second, round(0.7 * (coalesce(list_filter(range(0, 8), lambda i: list_reverse(x)[i + 1] <> list_reverse(y)[i + 1])[1], 8)) / 8 + 0.3 * len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS similarity FROM p", "parsed")
def _(spark, logs, d):
    s = T.token_similarity(T.tokenize(F.col("first")), T.tokenize(F.col("second")))
    return rounded(template_pairs(logs).select("first", "second", s.alias("similarity")))


@register("template_match_dice", f"{_PAIRS} SELECT first, second, round({_SIM}, 6) AS score, CASE WHEN {_SIM} >= 0.8 THEN 'SIMILAR' ELSE 'VARIABLE_ONLY' END AS type FROM p", "parsed")
def _(spark, logs, d):
    return rounded(template_pairs(logs).select("first", "second", "score", "type"))


@register("template_merge", f"{_PAIRS} SELECT first, second, CASE WHEN {_SIM} >= 0.8 THEN first END AS merged FROM p", "parsed")
def _(spark, logs, d):
    return template_pairs(logs).select("first", "second", "merged")


@register("mine_templates", "SELECT template, count(*) AS n FROM parsed GROUP BY 1", "parsed")
def _(spark, logs, d):
    return templates.parse_logs(logs, 0.9).groupBy("template").agg(F.count("*").alias("n"))


@register("template_clusters", "SELECT template, count(*) AS frequency, array_to_string((list(message ORDER BY log_id))[1:5], '|') AS examples FROM parsed GROUP BY 1", "parsed")
def _(spark, logs, d):
    return templates.clusters(parsed(logs)).select("template", "frequency", F.array_join("examples", "|").alias("examples"))


@register("prefix_match", "+pre(p, k) AS (VALUES ('User', 1), ('User <OID> from <LOI>', 4), ('User <OID> from <LOI> did view', 6)), m AS (SELECT log_id, max_by(p, k) AS template FROM parsed JOIN pre ON starts_with(template || ' ', p || ' ') GROUP BY 1) SELECT template, count(*) AS n FROM m GROUP BY 1", "parsed")
def _(spark, logs, d):
    pre = spark.createDataFrame([("User",), ("User <OID> from <LOI>",), ("User <OID> from <LOI> did view",)], "template string")
    return templates.prefix_matches(logs, pre).groupBy("template").agg(F.count("*").alias("n"))


@register("drain_templates")
def _(spark, logs, d):
    return templates.drain(logs).groupBy("template").agg(F.count("*").alias("n"))


@register("regex_fields", "SELECT log_id, regexp_extract(message, '^User u(\\d+) from (\\S+)', 1) AS usr, regexp_extract(message, '^User u(\\d+) from (\\S+)', 2) AS ip FROM logs")
def _(spark, logs, d):
    return templates.regex_fields(logs, r"User u(?P<usr>\d+) from (?P<ip>\S+)").select("log_id", F.col("fields")["usr"].alias("usr"), F.col("fields")["ip"].alias("ip"))


@register("template_file", "SELECT 'E' || row_number() OVER (ORDER BY count(*) DESC, min(log_id)) AS event_id, regexp_replace(template, '<[^>]+>', '<*>', 'g') AS template, count(*) AS n FROM parsed GROUP BY 2", "parsed")
def _(spark, logs, d):
    return sinks.template_file(parsed(logs)).select("event_id", "template", "n")


# Sources and sinks.


@register("delimited_logs", "SELECT level, component, count(*) AS n, sum(length(message)) AS chars FROM logs GROUP BY 1, 2")
def _(spark, logs, d):
    line = F.concat_ws(" ", F.date_format(F.col("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), "level", "component", F.lit("7"), "message")
    rows = readers.read_delimited_logs(logs.select(line.alias("value")))
    return rows.groupBy("level", "component").agg(F.count("*").alias("n"), F.sum(F.length("content")).cast("decimal(38,0)").alias("chars"))


@register("chunk_lines", "SELECT log_id // 1000 AS chunk, count(*) AS n FROM logs GROUP BY 1")
def _(spark, logs, d):
    chunks = readers.chunk_lines(logs.select(F.col("message").alias("value"), "log_id"), 1000, "log_id")
    return chunks.select("chunk", F.size("lines").cast("long").alias("n"))


@register("csv_round_trip", "SELECT level, count(*) AS n, count(DISTINCT json_extract_string(props, '$.k')) AS n_k FROM logs GROUP BY 1")
def _(spark, logs, d):
    at = new_path(spark, "csv")
    sinks.write_csv(logs.select("log_id", "level", "message", "parameters"), at)
    back = spark.read.csv(at, header=True, escape='"')
    return back.groupBy("level").agg(F.count("*").alias("n"), F.count_distinct(F.from_json("parameters", "map<string,string>")["k"]).alias("n_k"))


@register("json_round_trip", "SELECT component, count(*) AS n, round(sum(value), 4) AS total FROM logs GROUP BY 1")
def _(spark, logs, d):
    at = new_path(spark, "json")
    sinks.write_json(logs.select("log_id", "component", "value"), at)
    back = spark.read.schema("log_id long, component string, value double").json(at)
    return rounded(back.groupBy("component").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 4)


@register("prepare_logs", "SELECT log_id, string_split(message, ' ')[2] AS component, message FROM logs")
def _(spark, logs, d):
    return query.prepare(logs.select(F.col("log_id").alias("LineId"), F.col("message").alias("Content"), F.col("level").alias("Level"))).select("log_id", "component", "message")


@register("run_metrics", "SELECT count(*) AS total, count(*) FILTER (event_type = 'error') AS n_error, 0 AS n_warning, 0 AS n_info, 0 AS n_debug, count(*) FILTER (event_type <> 'error') AS n_unknown, count(DISTINCT template) AS n_templates FROM parsed", "parsed")
def _(spark, logs, d):
    return query.run_metrics(parsed(logs))


@register("pivot_parameters", "SELECT log_id, json_extract_string(props, '$.k') AS k FROM logs")
def _(spark, logs, d):
    return query.pivot_parameters(logs, ["k"])


# Pre-filter.

_SAMPLE = """+sized AS (SELECT log_id, ts, level, template AS message, count(*) OVER (PARTITION BY level) AS c,
  row_number() OVER (PARTITION BY level ORDER BY md5('42:' || log_id), log_id) AS k FROM parsed),
sampled AS (SELECT * FROM sized WHERE level IN ('ERROR', 'CRITICAL') OR k <= greatest(10, floor(c * CAST(CASE level WHEN 'INFO' THEN 0.1 WHEN 'DEBUG' THEN 0.05 WHEN 'WARNING' THEN 0.5 ELSE 0.1 END AS DOUBLE))))"""
_CAP = """ranked AS (SELECT log_id, level, message, count(*) OVER w AS n, row_number() OVER (PARTITION BY message ORDER BY ts, log_id) AS a, row_number() OVER (PARTITION BY message ORDER BY ts DESC, log_id DESC) AS z FROM {} WINDOW w AS (PARTITION BY message)),
mid AS (SELECT *, row_number() OVER (PARTITION BY message ORDER BY CASE WHEN a = 1 OR z = 1 THEN 1 ELSE 0 END, md5('42:' || log_id), log_id) AS m FROM ranked)
SELECT log_id, level FROM mid WHERE n <= 5 OR a = 1 OR z = 1 OR m <= 3"""


def by_template(logs: DataFrame) -> DataFrame:
    return parsed(logs).select("log_id", "timestamp", "level", F.col("template").alias("message"))


@register("prefilter_sample", f"{_SAMPLE} SELECT log_id, level FROM sampled", "parsed")
def _(spark, logs, d):
    return prefilter.stratified_sample(by_template(logs)).select("log_id", "level")


@register("dedupe_capped", "+src AS (SELECT log_id, ts, level, template AS message FROM parsed), " + _CAP.format("src"), "parsed")
def _(spark, logs, d):
    return prefilter.dedupe_capped(by_template(logs)).select("log_id", "level")


@register("prefilter_logs", f"{_SAMPLE}, " + _CAP.format("sampled"), "parsed")
def _(spark, logs, d):
    return prefilter.prefilter(by_template(logs)).select("log_id", "level")


# Numeric anomalies.


@register("iqr_anomalies", "+q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM logs) SELECT log_id FROM logs, q WHERE b > a AND (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a))")
def _(spark, logs, d):
    return numeric.outliers(numeric.long_values(logs, ["value"], ["log_id"])).where("is_outlier").select("log_id")


@register("zscore_anomalies", "+q AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM logs) SELECT log_id FROM logs, q WHERE s > 0 AND abs(value - m) / s > 3")
def _(spark, logs, d):
    return numeric.outliers(numeric.long_values(logs, ["value"], ["log_id"]), robust=False).where("is_outlier").select("log_id")


@register("grouped_anomalies", "+q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b, count(*) AS c FROM logs GROUP BY 1) SELECT log_id, event_type FROM logs JOIN q USING (event_type) WHERE c >= 10 AND b > a AND (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a))")
def _(spark, logs, d):
    long = numeric.long_values(logs, ["value"], ["log_id", "event_type"])
    return numeric.outliers(long, group="event_type").where("is_outlier").select("log_id", "event_type")


_LONG = "+v AS (SELECT log_id, event_type AS c, 'value' AS field, value AS x FROM logs UNION ALL SELECT log_id, event_type, 'k', CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM logs), st AS (SELECT c, field, avg(x) AS m, stddev_samp(x) AS s FROM v GROUP BY 1, 2), dv AS (SELECT log_id, v.field, abs(x - m) / s AS z FROM v JOIN st ON v.c = st.c AND v.field = st.field WHERE s > 0 AND abs(x - m) / s > 2.5)"


def deviations(logs: DataFrame) -> DataFrame:
    keys = ["log_id", "event_type"]
    long = numeric.long_values(logs, ["value"], keys).unionByName(numeric.parameter_values(logs, keys))
    return numeric.cluster_deviations(long, "event_type")


@register("incident_numeric", f"{_LONG} SELECT log_id, field, round(z, 4) AS deviation FROM dv")
def _(spark, logs, d):
    return rounded(deviations(logs), 4)


@register("numeric_deviations", f"{_LONG} SELECT log_id, count(*) AS n_fields, round(max(z), 4) AS most FROM dv GROUP BY 1")
def _(spark, logs, d):
    return rounded(deviations(logs).groupBy("log_id").agg(F.count("*").alias("n_fields"), F.max("deviation").alias("most")), 4)


@register("numeric_fields", "SELECT 'k' AS field")
def _(spark, logs, d):
    return numeric.numeric_fields(logs)


@register("field_statistics", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(quantile_cont(value, 0.5), 6) AS median FROM logs GROUP BY 1")
def _(spark, logs, d):
    stats = logs.groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    middle = numeric.quantiles(logs, ["event_type"], [0.5]).select(F.col("event_type").alias("kind"), F.get("q", 0).alias("median"))
    return rounded(stats.join(middle, F.col("event_type").eqNullSafe(F.col("kind"))).select("event_type", "mean", "sd", "median"))


# Density clusters and incidents.

_EDGES = f"""e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND 1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) <= {EPS}),
core AS (SELECT a AS v FROM e GROUP BY a HAVING count(*) >= {MIN_SAMPLES - 1})"""
_LABELS = f"""{_EDGES},
ce AS (SELECT a, b FROM e WHERE a IN (SELECT v FROM core) AND b IN (SELECT v FROM core)),
reach(v, l) AS (SELECT v, v FROM core UNION SELECT ce.b, l FROM reach JOIN ce ON reach.v = ce.a),
comp AS (SELECT v, min(l) AS l FROM reach GROUP BY 1),
lab AS (SELECT vec_id, coalesce(c.l, bd.l, -1) AS cluster_label, c.v IS NOT NULL AS is_core FROM embeddings LEFT JOIN comp c ON c.v = vec_id
  LEFT JOIN (SELECT e.b AS v, min(comp.l) AS l FROM e JOIN comp ON e.a = comp.v GROUP BY 1) bd ON bd.v = vec_id)"""


def vector_labels(spark: SparkSession, d: str) -> DataFrame:
    return cluster.dbscan(spark.read.parquet(f"{d}/embeddings.parquet"), "vec_id", "embedding", EPS, MIN_SAMPLES)


@register("dbscan_noise", f"WITH {_EDGES} SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT v FROM core) AND vec_id NOT IN (SELECT e.b FROM e JOIN core ON e.a = core.v)", "")
def _(spark, logs, d):
    return vector_labels(spark, d).where("cluster_label = -1").select("vec_id")


@register("dbscan_labels", f"WITH RECURSIVE {_LABELS} SELECT vec_id, cluster_label, is_core FROM lab".replace("RECURSIVE", "REC"), "")
def _(spark, logs, d):
    return vector_labels(spark, d).select("vec_id", "cluster_label", "is_core")


@register("small_clusters", f"WITH REC {_LABELS} SELECT cluster_label, count(*) AS cluster_size FROM lab GROUP BY 1 HAVING count(*) < 10", "")
def _(spark, logs, d):
    return vector_labels(spark, d).where("cluster_size < 10").select("cluster_label", "cluster_size").distinct()


def with_vectors(spark: SparkSession, logs: DataFrame, d: str) -> DataFrame:
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("log_id"), "embedding")
    return logs.join(v, "log_id")


@register("incident_anomalies", f"WITH REC {LOGS_SQL}, {_LABELS}, sz AS (SELECT cluster_label, count(*) AS c FROM lab GROUP BY 1), x AS (SELECT log_id, lab.cluster_label AS l, cluster_label = -1 OR c < {MIN_SAMPLES} AS emb, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM logs JOIN lab ON log_id = vec_id JOIN sz USING (cluster_label)), st AS (SELECT l, avg(k) AS m, stddev_samp(k) AS s FROM x GROUP BY 1), r AS (SELECT log_id, x.l AS cluster_label, emb AS is_embedding_anomaly, coalesce(s > 0 AND abs(k - m) / s > 2.5, false) AS is_numeric_anomaly FROM x JOIN st ON x.l = st.l) SELECT * FROM r WHERE is_embedding_anomaly OR is_numeric_anomaly", "")
def _(spark, logs, d):
    found = anomaly.detect(with_vectors(spark, logs, d), eps=EPS, min_samples=MIN_SAMPLES)
    return found.select("log_id", "cluster_label", "is_embedding_anomaly", "is_numeric_anomaly")


@register("explain_reasons")
def _(spark, logs, d):
    return anomaly.detect(with_vectors(spark, logs, d), eps=EPS, min_samples=MIN_SAMPLES).where("explanation is not null").select("log_id", "explanation")


@register("kmeans_clusters")
def _(spark, logs, d):
    rows, sizes, score = cluster.kmeans(cluster.message_vectors(parsed(logs)), 5)
    return sizes.withColumn("silhouette", F.lit(score)).withColumn("structure", F.lit(cluster.silhouette_text(score)))


@register("semantic_anomalies")
def _(spark, logs, d):
    return anomaly.semantic_anomalies(parsed(logs))


# Scores.


@register("grouping_accuracy", "+c AS (SELECT pred, truth, count(*) AS n FROM ev GROUP BY 1, 2), s AS (SELECT (SELECT sum(n) FROM c) AS n, (SELECT sum(n * (n - 1) / 2.0) FROM c) AS b, (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(n) AS n FROM c GROUP BY pred)) AS p, (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(n) AS n FROM c GROUP BY truth)) AS t) SELECT round(CAST((n * (n - 1) / 2.0 + 2 * b - p - t) / (n * (n - 1) / 2.0) AS DOUBLE), 6) AS grouping_accuracy FROM s", "ev")
def _(spark, logs, d):
    return rounded(evaluate.grouping_scores(scored(logs)).select("grouping_accuracy"))


@register("pair_f1", "+c AS (SELECT pred, truth, count(*) AS n FROM ev GROUP BY 1, 2) SELECT round(CAST(2 * (SELECT sum(n * (n - 1) / 2.0) FROM c) / ((SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(n) AS n FROM c GROUP BY pred)) + (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(n) AS n FROM c GROUP BY truth))) AS DOUBLE), 6) AS pair_f1", "ev")
def _(spark, logs, d):
    return rounded(evaluate.grouping_scores(scored(logs)).select("pair_f1"))


@register("parsing_accuracy", "SELECT round(avg(CASE WHEN pred = truth THEN 1.0 ELSE 0.0 END), 6) AS exact FROM ev", "ev")
def _(spark, logs, d):
    return rounded(evaluate.parsing_accuracy(scored(logs)).select("exact"))


@register("structural_accuracy", "SELECT round(avg(CASE WHEN list_transform(string_split(pred, '<*>'), lambda s: trim(s)) = list_transform(string_split(truth, '<*>'), lambda s: trim(s)) THEN 1.0 ELSE 0.0 END), 6) AS structural FROM ev", "ev")
def _(spark, logs, d):
    return rounded(evaluate.parsing_accuracy(scored(logs)).select("structural"))


@register("template_similarity", "SELECT round(avg(1 - levenshtein(pred, truth) / CAST(greatest(length(pred), length(truth)) AS DOUBLE)), 6) AS mean_similarity FROM ev", "ev")
def _(spark, logs, d):
    return rounded(evaluate.parsing_accuracy(scored(logs)).select("mean_similarity"))


@register("template_set_f1", "+p AS (SELECT DISTINCT pred AS x FROM ev), t AS (SELECT DISTINCT truth AS x FROM ev), b AS (SELECT (SELECT count(*) FROM p JOIN t USING (x)) AS b, (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM t) AS nt) SELECT round(b / np, 6) AS precision, round(b / nt, 6) AS recall, round(2.0 * b / (np + nt), 6) AS f1 FROM b", "ev")
def _(spark, logs, d):
    return rounded(evaluate.template_set_f1(scored(logs)))


_F1 = "per AS (SELECT x, sum(np) AS np, sum(nt) AS nt, sum(tp) AS tp FROM (SELECT p AS x, count(*) AS np, 0 AS nt, count(*) FILTER (p = t) AS tp FROM lab GROUP BY 1 UNION ALL SELECT t, 0, count(*), 0 FROM lab GROUP BY 1) GROUP BY 1) SELECT round(CAST(sum(tp) / sum(np) AS DOUBLE), 6) AS fga, round(avg(2.0 * tp / (np + nt)), 6) AS fta FROM per"


@register("label_f1", f"+lab AS (SELECT pred AS p, truth AS t FROM ev), {_F1}", "ev")
def _(spark, logs, d):
    return rounded(evaluate.label_f1(scored(logs)))


@register("label_f1_compat", f"+lab AS (SELECT dense_rank() OVER (ORDER BY pred) AS p, dense_rank() OVER (ORDER BY truth) AS t FROM ev), {_F1}", "ev")
def _(spark, logs, d):
    return rounded(evaluate.label_f1(scored(logs), compat=True))


@register("granularity", "+p AS (SELECT avg(n) AS m, stddev_pop(n) AS s FROM (SELECT count(*) AS n FROM ev GROUP BY pred)), t AS (SELECT avg(n) AS m, stddev_pop(n) AS s FROM (SELECT count(*) AS n FROM ev GROUP BY truth)) SELECT round(abs(t.m - p.m) / greatest(t.m, p.m), 6) AS ggd, round(abs(t.s - p.s) / greatest(t.s, p.s), 6) AS pgd FROM p, t", "ev")
def _(spark, logs, d):
    return rounded(evaluate.granularity(scored(logs)))


@register("distinct_templates", "SELECT count(DISTINCT pred) AS n_pred_templates, count(DISTINCT truth) AS n_true_templates FROM ev", "ev")
def _(spark, logs, d):
    return evaluate.evaluate(scored(logs)).select("n_pred_templates", "n_true_templates")


# History and trends.

_HIST = f"hw AS (SELECT CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts) - 1) / 14400000000.0) AS BIGINT) AS win, component, level FROM logs WHERE ts < TIMESTAMP '{AS_OF}'), hist AS (SELECT win, count(*) AS total, count(DISTINCT component) AS components, avg(CASE WHEN level IN ('ERROR', 'CRITICAL') THEN 1.0 ELSE 0.0 END) AS error_ratio FROM hw WHERE win BETWEEN 0 AND 41 GROUP BY 1)"


@register("history_windows", f'+{_HIST} SELECT win AS "window", total, components, round(error_ratio, 6) AS error_ratio FROM hist')
def _(spark, logs, d):
    return rounded(anomaly.history_windows(logs, AS_OF))


@register("history_stats", f"+{_HIST} SELECT round(avg(total), 6) AS mean_total, round(stddev_samp(total), 6) AS std_total, round(quantile_cont(total, 0.95), 6) AS p95_total, round(avg(error_ratio), 6) AS mean_error_ratio FROM hist")
def _(spark, logs, d):
    return rounded(anomaly.history_stats(anomaly.history_windows(logs, AS_OF)))


_NOW = "TIMESTAMP '2024-01-28 12:00:00'"


@register("current_vs_history", f"+{_HIST}, cur AS (SELECT count(*) AS t, avg(CASE WHEN level IN ('ERROR', 'CRITICAL') THEN 1.0 ELSE 0.0 END) AS q FROM logs WHERE ts BETWEEN {_NOW} - INTERVAL 4 HOUR AND {_NOW}) SELECT round((t - m) / nullif(s, 0), 4) AS z, round(p, 4) AS percentile, round(t / m, 4) AS ratio, round(q - r, 4) AS error_ratio_delta FROM cur, (SELECT avg(total) AS m, stddev_samp(total) AS s, avg(error_ratio) AS r, 100 * avg(CASE WHEN total >= (SELECT t FROM cur) THEN 1.0 ELSE 0.0 END) AS p FROM hist)")
def _(spark, logs, d):
    now = anomaly.summary(query.recent(logs, 4, "2024-01-28 12:00:00"))
    return rounded(anomaly.current_vs_history(now, anomaly.history_windows(logs, AS_OF)), 4)


@register("anomaly_summary", "SELECT count(*) AS total, count(*) FILTER (value > 100) AS embedding, count(*) FILTER (value < 1) AS numeric, count(DISTINCT component) AS components, round(avg(CASE WHEN level IN ('ERROR', 'CRITICAL') THEN 1.0 ELSE 0.0 END), 6) AS error_ratio FROM logs")
def _(spark, logs, d):
    flagged = logs.withColumn("is_embedding_anomaly", F.col("value") > 100).withColumn("is_numeric_anomaly", F.col("value") < 1)
    return rounded(anomaly.summary(flagged))


@register("counter_vector", "SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS bucket, template, level, component, count(*) AS n FROM parsed GROUP BY 1, 2, 3, 4", "parsed")
def _(spark, logs, d):
    return query.counter_vector(parsed(logs))


@register("timeseries_anomaly", "+b AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, count(*) AS n FROM logs GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY bucket) AS k, count(*) OVER () AS c FROM b), st AS (SELECT avg(n) AS m, stddev_samp(n) AS s FROM r WHERE k <= floor(c * CAST(0.7 AS DOUBLE))) SELECT bucket, n, round(abs(n - m) / s, 4) AS score FROM r, st WHERE k > floor(c * CAST(0.7 AS DOUBLE)) AND s > 0 AND abs(n - m) / s > 1.5")
def _(spark, logs, d):
    return rounded(anomaly.timeseries_anomalies(logs, sigmas=1.5), 4)


@register("timeseries_isolation")
def _(spark, logs, d):
    return anomaly.timeseries_anomalies(logs, method="isolation_forest")


@register("stream_tumbling_counts", "SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS bucket, level, count(*) AS n FROM logs GROUP BY 1, 2")
def _(spark, logs, d):
    """The stream of the table's rows, run to its end; equal to the batch counts."""
    from lumenlog.streaming.flows import read_counts

    schema = spark.read.parquet(f"{d}/events.parquet").schema
    rows = logs_view(spark.readStream.schema(schema).parquet(f"{d}/events*.parquet"))
    at = new_path(spark, "stream")
    streaming.upsert_counts(streaming.tumbling_counts(rows, "level", late="3650 days"), f"{at}/counts", f"{at}/checkpoint")
    return read_counts(spark, f"{at}/counts", "level").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


# Readers and writers, each over a file that the query writes first.


def written(df: DataFrame, name: str, header: bool = True) -> str:
    at = new_path(df.sparkSession, name)
    df.write.csv(at, header=header, escape='"')
    return at


@register("read_logs", "SELECT component, count(*) AS n, CAST(sum(length(message)) AS BIGINT) AS chars FROM logs GROUP BY 1")
def _(spark, logs, d):
    rows = readers.read_logs(spark, written(logs.select(F.concat(F.lit("  "), "message").alias("Content"), "component"), "logs"))
    return rows.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


@register("read_headerless", "SELECT count(*) AS n, count(DISTINCT message) AS n_messages FROM logs")
def _(spark, logs, d):
    return readers.read_headerless(spark, written(logs.select("message"), "lines", False)).agg(F.count("*").alias("n"), F.count_distinct("Content").alias("n_messages"))


def structured(logs: DataFrame) -> DataFrame:
    return parsed(logs).select(F.col("log_id").alias("LineId"), F.col("message").alias("Content"), F.col("template").alias("EventTemplate"), F.col("component").alias("ParameterList.c"), F.when(F.col("log_id") % 2 == 0, F.col("level")).alias("ParameterList.l"))


@register("read_structured", "SELECT log_id AS \"LineId\", template AS \"EventTemplate\", component AS c, CASE WHEN log_id % 2 = 0 THEN level END AS l FROM parsed", "parsed")
def _(spark, logs, d):
    rows = readers.read_structured(spark, written(structured(logs), "structured"))
    return rows.select("LineId", "EventTemplate", F.col("parameters")["param_c"].alias("c"), F.col("parameters")["param_l"].alias("l"))


@register("read_templates", "SELECT DISTINCT 'E' || length(template) AS \"EventId\", template AS \"EventTemplate\" FROM parsed", "parsed")
def _(spark, logs, d):
    names = parsed(logs).select(F.concat(F.lit("E"), F.length("template").cast("string")).alias("EventId"), F.col("template").alias("EventTemplate"), F.lit("x").alias("more")).distinct()
    return readers.read_templates(spark, written(names, "templates"))


@register("list_datasets", "SELECT * FROM (VALUES ('full', 'svc'), ('two', 'app'), ('two', 'svc')) t(kind, system)", "")
def _(spark, logs, d):
    at = new_path(spark, "sets")
    for kind, system in (("two", "svc"), ("two", "app"), ("full", "svc")):
        structured(logs).limit(2).write.csv(f"{at}/{kind}/{system}/{system}_2k.log_structured.csv", header=True)
    return spark.createDataFrame(readers.list_datasets(spark, at), "kind string, system string")


@register("validate_dataset", "SELECT count(*) AS n_logs, count(*) FILTER (log_id % 3 > 0) AS n_templates, count(*) FILTER (log_id % 3 > 0 AND level = 'ERROR') AS n_blank, count(*) FILTER (log_id % 3 = 0) AS n_missing FROM logs")
def _(spark, logs, d):
    names = logs.where("log_id % 3 > 0").select("log_id", F.when(F.col("level") != "ERROR", F.col("message")).alias("EventTemplate"))
    return readers.validate_dataset(logs, names, "log_id")


@register("stream_lines", "SELECT count(*) AS n, count(DISTINCT message) AS n_messages FROM logs WHERE level <> 'DEBUG'")
def _(spark, logs, d):
    at = new_path(spark, "lines")
    logs.select(F.when(F.col("level") == "DEBUG", F.lit("  ")).otherwise(F.col("message")).alias("value")).write.text(f"{at}/in")
    readers.stream_lines(spark, f"{at}/in").writeStream.format("parquet").option("checkpointLocation", f"{at}/c").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    return spark.read.parquet(f"{at}/out").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_messages"))


@register("sql_query", "SELECT level, count(*) AS n FROM logs WHERE component = 'svc-4' GROUP BY 1")
def _(spark, logs, d):
    logs.createOrReplaceTempView("lumenlog_sql_query")
    return readers.query(spark, "SELECT level, count(*) AS n FROM lumenlog_sql_query WHERE component = :c GROUP BY level", c="svc-4")


@register("markdown_report", "+c AS (SELECT count(*) AS n FROM logs), t AS (SELECT component, count(*) AS n FROM logs GROUP BY 1 ORDER BY n DESC, component LIMIT 2) SELECT '# Run' AS value UNION ALL SELECT '' UNION ALL SELECT '- rows: ' || n FROM c UNION ALL SELECT '' UNION ALL SELECT '| component | n |' UNION ALL SELECT '| --- | --- |' UNION ALL SELECT '| ' || component || ' | ' || n || ' |' FROM t")
def _(spark, logs, d):
    at = new_path(spark, "report")
    sinks.write_report(spark, at, "Run", {"rows": logs.count()}, query.top(logs, "component", 2))
    return spark.read.text(at).where(F.col("value") != "").unionByName(spark.read.text(at).where(F.col("value") == "").limit(2))


# Preparation.


@register("attach_results", "SELECT log_id, CASE WHEN level = 'ERROR' THEN template END AS template FROM parsed", "parsed")
def _(spark, logs, d):
    rows = parsed(logs)
    return query.with_results(rows, rows.where("level = 'ERROR'")).select("log_id", "template")


@register("fill_defaults", "SELECT log_id, CASE WHEN level = 'ERROR' THEN 'INFO' ELSE level END AS level, CASE WHEN user_id % 2 = 0 THEN 'unknown' ELSE component END AS component FROM logs")
def _(spark, logs, d):
    some = logs.withColumn("level", F.when(F.col("level") != "ERROR", F.col("level"))).withColumn("component", F.when(F.col("user_id") % 2 != 0, F.col("component")))
    return query.with_defaults(some).select("log_id", "level", "component")


@register("column_names", "SELECT DISTINCT message, lower(regexp_replace(message, '[^A-Za-z0-9]', '_', 'g')) AS name, 'f_' || lower(regexp_replace(log_id || message, '[^A-Za-z0-9]', '_', 'g')) AS numbered FROM logs")
def _(spark, logs, d):
    return logs.select("message", T.column_name(F.col("message")).alias("name"), T.column_name(F.concat(F.col("log_id").cast("string"), "message")).alias("numbered")).distinct()


@register("parse_times", "SELECT count(*) AS total, round(avg(value), 6) AS avg_ms, max(value) AS max_ms, min(value) AS min_ms FROM logs")
def _(spark, logs, d):
    return rounded(query.run_metrics(parsed(logs), ms="value").select("total", "avg_ms", "max_ms", "min_ms"))


@register("variable_positions", "SELECT array_to_string(list_filter(range(0, len(string_split(template, ' '))), lambda i: contains(string_split(template, ' ')[i + 1], '<')), ',') AS places, count(*) AS n FROM parsed GROUP BY 1", "parsed")
def _(spark, logs, d):
    return parsed(logs).groupBy(F.array_join(T.variable_positions(T.tokenize(F.col("template"))).cast("array<string>"), ",").alias("places")).agg(F.count("*").alias("n"))


@register("merge_clusters", "+r AS (SELECT template, message, log_id, user_id % 2 AS side, row_number() OVER (PARTITION BY template, user_id % 2 ORDER BY log_id) AS k FROM parsed), u AS (SELECT template, message, min(side * 10 + k) AS o FROM r WHERE k <= 5 GROUP BY 1, 2), f AS (SELECT template, count(*) AS frequency FROM parsed GROUP BY 1) SELECT template, frequency, array_to_string((list(message ORDER BY o))[1:5], '|') AS examples FROM u JOIN f USING (template) GROUP BY 1, 2", "parsed")
def _(spark, logs, d):
    rows = parsed(logs)
    a, b = (templates.clusters(rows.where(F.col("user_id") % 2 == k)) for k in (0, 1))
    return templates.merge_clusters(a, b).select("template", "frequency", F.array_join("examples", "|").alias("examples"))


@register("cosine_distances", "SELECT a.vec_id AS first, b.vec_id AS second, round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1", "")
def _(spark, logs, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    a, b = v.select(F.col("vec_id").alias("first"), F.col("embedding").alias("x")), v.select(F.col("vec_id").alias("second"), F.col("embedding").alias("y"))
    return rounded(a.join(b, F.col("second") == F.col("first") + 1).select("first", "second", cluster.cosine_distance(F.col("x"), F.col("y")).alias("distance")))


@register("numeric_columns", "SELECT * FROM (VALUES ('log_id'), ('user_id'), ('value')) t(field)", "")
def _(spark, logs, d):
    return spark.createDataFrame([(c,) for c in numeric.numeric_columns(logs)], "field string")


@register("prefilter_or_all", "SELECT log_id FROM logs")
def _(spark, logs, d):
    return prefilter.prefilter_or_all(logs, 10**9).select("log_id")


@register("stream_parse", "SELECT template, count(*) AS n FROM parsed GROUP BY 1", "parsed")
def _(spark, logs, d):
    return streamed(spark, d, streaming.parse_stream).groupBy("template").agg(F.count("*").alias("n"))


@register("stream_new_templates", "SELECT DISTINCT template FROM parsed", "parsed")
def _(spark, logs, d):
    return streamed(spark, d, lambda rows: streaming.new_templates(streaming.parse_stream(rows), "3650 days")).select("template")


def streamed(spark: SparkSession, d: str, flow: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `flow` makes of the stream of the table's rows, run to its end."""
    at = new_path(spark, "stream")
    rows = logs_view(spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events*.parquet"))
    flow(rows).select("log_id", "template").writeStream.format("parquet").option("checkpointLocation", f"{at}/c").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    return spark.read.parquet(f"{at}/out")


# Anomalies of earlier windows, each detected on its own.

_PAST = f"""WITH REC {LOGS_SQL}, w AS (SELECT log_id, component, level, embedding, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts) - 1) / 864000000000.0) AS BIGINT) AS win FROM logs JOIN embeddings ON vec_id = log_id WHERE ts < TIMESTAMP '{AS_OF}'),
e AS (SELECT a.log_id AS a, b.log_id AS b FROM w a JOIN w b ON a.win = b.win AND a.log_id <> b.log_id AND 1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) <= {EPS}),
core AS (SELECT a AS v FROM e GROUP BY a HAVING count(*) >= {MIN_SAMPLES - 1}), ce AS (SELECT a, b FROM e WHERE a IN (SELECT v FROM core) AND b IN (SELECT v FROM core)),
reach(v, l) AS (SELECT v, v FROM core UNION SELECT ce.b, l FROM reach JOIN ce ON reach.v = ce.a), comp AS (SELECT v, min(l) AS l FROM reach GROUP BY 1),
lab AS (SELECT w.*, coalesce(c.l, bd.l, -1) AS cl FROM w LEFT JOIN comp c ON c.v = log_id LEFT JOIN (SELECT e.b AS v, min(comp.l) AS l FROM e JOIN comp ON e.a = comp.v GROUP BY 1) bd ON bd.v = log_id),
st AS (SELECT win, cl, count(*) AS c, avg(k) AS m, stddev_samp(k) AS s FROM lab GROUP BY 1, 2),
r AS (SELECT lab.win, component, level, lab.cl = -1 OR c < {MIN_SAMPLES} AS emb, coalesce(s > 0 AND abs(k - m) / s > 2.5, false) AS num FROM lab JOIN st ON lab.win = st.win AND lab.cl = st.cl)
SELECT win AS "window", count(*) AS total, count(*) FILTER (emb) AS embedding, count(*) FILTER (num) AS numeric, count(DISTINCT component) AS components, round(avg(CASE WHEN level IN ('ERROR', 'CRITICAL') THEN 1.0 ELSE 0.0 END), 6) AS error_ratio FROM r WHERE win < 3 AND (emb OR num) GROUP BY 1"""


@register("detection_history", _PAST, "")
def _(spark, logs, d):
    return rounded(anomaly.detection_history(with_vectors(spark, logs, d), AS_OF, 240, 30, eps=EPS, min_samples=MIN_SAMPLES))


# Drain over messages of three formats, which differ in their number of words or in their first ones.


@register("drain_formats", "SELECT template, n FROM (SELECT CASE WHEN event_type = 'error' THEN 'disk d<NUM> of svc-<NUM> is full' WHEN event_type = 'click' THEN 'session opened for DEBUG' ELSE 'session closed for <*>' END AS template, count(*) AS n FROM logs GROUP BY 1)")
def _(spark, logs, d):
    m = F.when(F.col("event_type") == "error", F.concat(F.lit("disk d"), F.col("user_id").cast("string"), F.lit(" of "), "component", F.lit(" is full"))).when(F.col("event_type") == "click", F.concat(F.lit("session opened for "), "level")).otherwise(F.concat(F.lit("session closed for "), F.translate("component", "0123456789-", "abcdefghij")))
    return templates.drain(logs.withColumn("message", m)).groupBy("template").agg(F.count("*").alias("n"))


ORACLE.update({k: v.replace("WITH REC ", "WITH RECURSIVE ") for k, v in ORACLE.items()})
