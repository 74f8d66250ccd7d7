"""Command-line jobs: python -m lumenlog.plans.jobs {analyze,incidents,parse,evaluate} ..."""

from __future__ import annotations

import argparse
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lumenlog.functions.tokens import normalize_template
from lumenlog.operators import anomaly, evaluate, query, templates
from lumenlog.session import get_spark, materialize
from lumenlog.sources import readers, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lumenlog")
    sub = p.add_subparsers(dest="job", required=True)
    for name in ("analyze", "incidents"):
        s = sub.add_parser(name)
        s.add_argument("--hours", type=int, default=4)
        s.add_argument("--table", default="logs", required=name == "incidents")
        s.add_argument("--as-of", help="ISO time; default: now")
        s.add_argument("--eps", type=float, default=0.3)
        s.add_argument("--min-samples", type=int, default=3)
        s.add_argument("--level")
        s.add_argument("--component")
        s.add_argument("--no-history", action="store_true")
        s.add_argument("--history-days", type=int, default=7)
        s.add_argument("--output-dir")
    s = sub.add_parser("parse")
    s.add_argument("input")
    s.add_argument("--threshold", type=float, default=0.8)
    s.add_argument("--output-dir", required=True)
    s = sub.add_parser("evaluate")
    s.add_argument("--base", required=True)
    s.add_argument("--system", required=True)
    s.add_argument("--dataset-type", default="loghub_2k")
    s.add_argument("--output-dir")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = get_spark(a.job)
    if a.job in ("analyze", "incidents"):
        end = datetime.fromisoformat(a.as_of) if a.as_of else datetime.now()
        logs = spark.table(a.table)
        found = anomaly.detect(logs, end - timedelta(hours=a.hours), end, a.eps, a.min_samples, level=a.level, component=a.component)
        anomaly.summary(found).show(truncate=False)
        found.select("timestamp", "level", "component", "message", "explanation").show(5, truncate=False)
        if a.job == "analyze" and not a.no_history:
            before = end - timedelta(hours=a.hours)
            past = materialize(anomaly.detection_history(logs, before, a.hours, a.history_days, eps=a.eps, min_samples=a.min_samples, level=a.level, component=a.component), "history")
            anomaly.history_stats(past).show(truncate=False)
            anomaly.current_vs_history(anomaly.summary(found), past).show(truncate=False)
        if a.output_dir:
            sinks.write_csv(found, f"{a.output_dir}/anomalies", "overwrite")
    elif a.job == "parse":
        raw = readers.read_logs(spark, a.input).where(F.trim("content") != "")
        logs = raw.select(F.monotonically_increasing_id().alias("log_id"), F.col("content").alias("message"))
        parsed = templates.parse_logs(logs, a.threshold)
        sinks.write_csv(parsed, f"{a.output_dir}/parsed_logs", "overwrite")
        registry = query.template_registry(parsed)
        sinks.write_csv(registry, f"{a.output_dir}/templates", "overwrite")
        sinks.write_json(query.run_metrics(parsed), f"{a.output_dir}/metrics", "overwrite")
        sinks.write_report(spark, f"{a.output_dir}/report", "Parsing", query.run_metrics(parsed).first().asDict(), registry.orderBy(F.desc("n"), "first_id").limit(10))
    else:
        at = f"{a.base}/{a.dataset_type}/{a.system}/{a.system}_2k.log_structured.csv"
        logs = readers.read_structured(spark, at)
        parsed = templates.parse_logs(logs.select(F.col("LineId").alias("log_id"), F.col("Content").alias("message"), "EventTemplate"), 0.8)
        both = parsed.select(normalize_template(F.coalesce("template", F.lit(""))).alias("pred"), normalize_template(F.col("EventTemplate")).alias("truth"))
        scores = evaluate.evaluate(both)
        scores.show(vertical=True)
        if a.output_dir:
            sinks.write_json(scores, f"{a.output_dir}/metrics", "overwrite")
            sinks.write_template_files(parsed, f"{a.output_dir}/templates", "overwrite")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
