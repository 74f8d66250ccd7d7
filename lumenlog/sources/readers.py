"""Log sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.errors import DataError


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """`content` of a CSV file (its column of that name, else the first); of a file that is no CSV, its lines."""
    head = [r.value for r in spark.read.text(path).limit(1).collect()]
    if head and "," in head[0] or head and head[0].strip().lower() == "content":
        df = spark.read.csv(path, header=True, multiLine=False, escape='"')
        names = {c.lower(): c for c in df.columns}
        return df.select(F.trim(F.col(f"`{names.get('content', df.columns[0])}`")).alias("content"), *[c for c in df.columns if c != names.get("content", df.columns[0])])
    return spark.read.text(path).select(F.trim("value").alias("content"))


def read_headerless(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("Content string").csv(path)


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise DataError(f"missing columns: {', '.join(missing)}")
    return df


def read_structured(spark: SparkSession, path: str) -> DataFrame:
    """LineId, Content, EventTemplate and the rest of a structured log file, with `parameters`: the ParameterList
    columns that have a value, as param_<suffix>."""
    df = require(spark.read.csv(path, header=True, escape='"'), "LineId", "Content", "EventTemplate")
    lists = [c for c in df.columns if c.startswith("ParameterList")]
    pairs = [F.struct(F.lit(f"param_{c.rsplit('.', 1)[-1]}").alias("key"), F.col(f"`{c}`").alias("value")) for c in lists]
    params = F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["value"].isNotNull())) if pairs else F.create_map().cast("map<string,string>")
    return df.withColumn("LineId", F.col("LineId").cast("long")).withColumn("parameters", params)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    df = require(spark.read.csv(path, header=True, escape='"'), "EventId", "EventTemplate").select("EventId", "EventTemplate")
    if not df.where("EventTemplate is null or trim(EventTemplate) = ''").isEmpty():
        raise DataError("a template is blank")
    return df


def list_datasets(spark: SparkSession, base: str) -> list[tuple[str, str]]:
    """(kind, system) of {base}/{kind}/{system}/{system}_2k.log_structured.csv, by the file system Spark reads."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{base}/*/*/*_2k.log_structured.csv")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(tuple(s.getPath().toString().split("/")[-3:-1]) for s in found)


def validate_dataset(logs: DataFrame, templates: DataFrame, key: str = "LineId") -> DataFrame:
    """One row: n_logs, n_templates, n_missing (logs without a template), n_blank (blank templates)."""
    missing = logs.join(templates.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("n_missing"))
    counts = templates.agg(F.count("*").alias("n_templates"), F.count_if(F.trim(F.coalesce("EventTemplate", F.lit(""))) == "").alias("n_blank"))
    return logs.agg(F.count("*").alias("n_logs")).crossJoin(counts).crossJoin(missing)  # single rows


def chunk_lines(lines: DataFrame, n: int, order: str) -> DataFrame:
    """chunk, lines: stripped lines in lists of n by the number in `order` (0, 1, ...); the last may be short."""
    own = lines.select((F.col(order) / n).cast("long").alias("chunk"), F.struct(F.col(order).alias("k"), F.trim("value").alias("v")).alias("x"))
    return own.groupBy("chunk").agg(F.transform(F.sort_array(F.collect_list("x")), lambda e: e["v"]).alias("lines"))


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines of the files in a folder, as they arrive."""
    return spark.readStream.text(path).where(F.trim("value") != "")


def read_delimited_logs(lines: DataFrame, column: str = "value") -> DataFrame:
    """timestamp, level, component, pid and content of "<timestamp> <level> <component> <pid> <content>"."""
    p = F.split(F.trim(column), r"\s+", 5)
    return lines.select(*[F.get(p, i).alias(n) for i, n in enumerate(("timestamp", "level", "component", "pid", "content"))])


def query(spark: SparkSession, sql: str, **args) -> DataFrame:
    return spark.sql(sql, args=args)
