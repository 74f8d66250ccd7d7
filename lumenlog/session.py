"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the engine is tuned for; anything already set on the builder or by spark-submit wins.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "lumenlog", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS; `conf` entries (full keys) override them."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or a folder of this machine where that is
    unset (local mode and tests; a cluster has to name one)."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="lumenlog-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/lumenlog/{os.getpid()}-{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write `df` to the shared folder and read it back: computed once, lineage cut, and no part of it
    lives on one executor only. `clear(spark)` removes what was written."""
    spark = df.sparkSession
    at = new_path(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def discard(*tables: DataFrame) -> None:
    """Delete tables as `materialize` returned them, before the end: what still reads them ends here."""
    for t in tables:
        path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path
        for at in {f.rpartition("/")[0] for f in t.inputFiles()}:
            path(at).getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path(at), True)


def clear(spark: SparkSession) -> None:
    """Delete every table that this driver process materialized; results that still read them end here."""
    jvm, root = spark.sparkContext._jvm, f"{shared_dir(spark)}/lumenlog"
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{root}/{os.getpid()}-*")) or []:
        fs.delete(s.getPath(), True)
