"""Density clustering by cosine distance (C1-C3) and k-means over message vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.operators.graph import connected_components
from lumenlog.session import materialize

#: Rows per block side; a task compares two blocks.
BLOCK = 2048


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, between 0 and 2; 1 for empty, zero or unequally long vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0)
    return F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - dot(a, b) / norm))).otherwise(1.0)


def neighbours(df: DataFrame, key: str = "log_id", vector: str = "embedding", eps: float = 0.3) -> DataFrame:
    """(a, b): ordered pairs of different keys within `eps`. Every pair of blocks is one task's matrix product; the
    search is exact and so quadratic in the rows, which a window and the pre-filter keep few."""
    n = df.count()
    side = max(1, -(-n // BLOCK))
    own = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(side)).cast("int").alias("b"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda j: F.struct(F.least("b", j).alias("i"), F.greatest("b", j).alias("j")))
    dealt = own.select("k", "v", "b", F.explode(cells).alias("c")).select("k", "v", "b", "c.i", "c.j")

    def run(t: pa.Table) -> pa.Table:
        k, b = t.column("k").to_numpy(), t.column("b").to_numpy()
        vs = t.column("v").to_pylist()
        width = max((len(v) for v in vs), default=0)
        ok = np.array([len(v) == width for v in vs], dtype=bool)
        x = np.array([v if len(v) == width else [0.0] * width for v in vs], dtype=np.float64).reshape(len(vs), width)
        norm = np.linalg.norm(x, axis=1)
        ok &= norm > 0
        x /= np.maximum(norm, 1e-300)[:, None]
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        left, right = np.flatnonzero(ok & (b == i)), np.flatnonzero(ok & (b == j))
        p, q = np.nonzero(np.clip(1 - x[left] @ x[right].T, 0, 2) <= eps)
        a, c = k[left[p]], k[right[q]]
        keep = a != c
        a, c = a[keep], c[keep]
        if i != j:
            a, c = np.concatenate([a, c]), np.concatenate([c, a])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(c, pa.int64())})

    return dealt.groupBy("i", "j").applyInArrow(run, "a long, b long")


def dbscan(df: DataFrame, key: str = "log_id", vector: str = "embedding", eps: float = 0.3, min_samples: int = 3) -> DataFrame:
    """key, cluster_label, is_core, cluster_size: label is the smallest core key of the cluster, -1 for noise; a
    border point goes to the smallest cluster that reaches it. min_samples counts the point itself."""
    edges = materialize(neighbours(df, key, vector, eps), "neighbours")
    core = materialize(edges.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= min_samples - 1).select(F.col("a").alias("core")), "core")
    if min_samples <= 1:
        core = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("core"))
    from_core = edges.join(core, F.col("a") == F.col("core"), "left_semi")
    inner = from_core.join(core, F.col("b") == F.col("core"), "left_semi")
    comp = connected_components(inner, "a", "b")
    comp = materialize(core.join(comp, F.col("core") == F.col("node"), "left").select("core", F.coalesce("component", "core").alias("component")), "components")
    border = from_core.join(core, F.col("b") == F.col("core"), "left_anti").join(comp, F.col("a") == F.col("core")).groupBy(F.col("b").alias("node")).agg(F.min("component").alias("label"))
    labels = comp.select(F.col("core").alias("node"), F.col("component").alias("label"), F.lit(True).alias("is_core")).unionByName(border.withColumn("is_core", F.lit(False)))
    out = df.select(F.col(key).cast("long").alias(key)).join(labels, F.col(key) == F.col("node"), "left")
    out = out.select(key, F.coalesce("label", F.lit(-1)).cast("long").alias("cluster_label"), F.coalesce("is_core", F.lit(False)).alias("is_core"))
    sizes = out.groupBy(F.col("cluster_label").alias("l")).agg(F.count("*").alias("cluster_size"))
    return out.join(sizes, F.col("cluster_label") == F.col("l")).drop("l")


def embedding_anomalies(labels: DataFrame, min_samples: int = 3) -> DataFrame:
    """`labels` with is_embedding_anomaly: noise, or in a cluster of fewer than min_samples rows."""
    return labels.withColumn("is_embedding_anomaly", (F.col("cluster_label") == -1) | (F.col("cluster_size") < min_samples))


def message_vectors(parsed: DataFrame, size: int = 32, text: str = "template", attributes: tuple[str, ...] = ("level",), seed: int = 42) -> DataFrame:
    """`parsed` with `features`: word2vec of the text and indexed attributes."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StringIndexer, Tokenizer, VectorAssembler, Word2Vec

    own = parsed.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    index = [StringIndexer(inputCol=a, outputCol=f"_{a}_index", handleInvalid="keep") for a in attributes]
    steps = [Tokenizer(inputCol="_text", outputCol="_words"), Word2Vec(vectorSize=size, minCount=1, seed=seed, inputCol="_words", outputCol="_vector"), *index]
    steps.append(VectorAssembler(inputCols=["_vector", *(f"_{a}_index" for a in attributes)], outputCol="features"))
    return Pipeline(stages=steps).fit(own).transform(own).drop("_text", "_words", "_vector", *(f"_{a}_index" for a in attributes))


def kmeans(vectors: DataFrame, k: int = 10, seed: int = 42) -> tuple[DataFrame, DataFrame, float]:
    """(rows with `cluster`, cluster and n, silhouette)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    out = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(vectors).transform(vectors)
    sizes = out.groupBy("cluster").agg(F.count("*").alias("n"))
    score = ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(out) if sizes.count() > 1 else 0.0
    return out, sizes, score


def silhouette_text(score: float) -> str:
    """Fixed bands."""
    return "strong" if score > 0.7 else "reasonable" if score > 0.5 else "weak" if score > 0.3 else "no clear"


class IsolationForest:
    """Random splits over a bounded sample; points that few splits isolate score high (0.5 is ordinary)."""

    def __init__(self, x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.sample = min(sample, len(x))
        self.limit = int(np.ceil(np.log2(max(2, self.sample))))
        self.trees = [self._grow(x[rng.choice(len(x), self.sample, replace=False)], 0, rng) for _ in range(trees)] if len(x) else []

    @staticmethod
    def _mean_depth(n: int) -> float:
        return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, x: np.ndarray, depth: int, rng: np.random.Generator):
        spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) else []
        if depth >= self.limit or len(x) <= 1 or not len(spread):
            return depth + self._mean_depth(len(x))
        f = int(rng.choice(spread))
        cut = rng.uniform(x[:, f].min(), x[:, f].max())
        low = x[:, f] < cut
        return f, cut, self._grow(x[low], depth + 1, rng), self._grow(x[~low], depth + 1, rng)

    def _depth(self, node, x: np.ndarray, out: np.ndarray, at: np.ndarray) -> None:
        if not isinstance(node, tuple):
            out[at] += node
            return
        f, cut, a, b = node
        low = x[at, f] < cut
        self._depth(a, x, out, at[low])
        self._depth(b, x, out, at[~low])

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        if not self.trees:
            return out
        for t in self.trees:
            self._depth(t, x, out, np.arange(len(x)))
        return 2.0 ** (-(out / len(self.trees)) / max(self._mean_depth(self.sample), 1e-9))


def isolation_scores(train: DataFrame, rows: DataFrame, columns: list[str], keys: list[str], max_train: int = 10_000, seed: int = 42) -> DataFrame:
    """keys and score of `rows` by a forest of at most `max_train` rows of `train`, drawn by a hash of
    the keys: equal rows have different keys, so each row has the same chance whatever its features."""
    own = train.select(F.xxhash64(F.lit(seed), *keys).alias("_draw"), *[F.col(c).cast("double").alias(c) for c in columns]).na.drop(subset=columns)
    few = own.orderBy("_draw", *columns).limit(max_train).drop("_draw").toPandas()
    forest = train.sparkSession.sparkContext.broadcast(IsolationForest(few.to_numpy(), seed=seed))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[keys].assign(score=forest.value.score(f[columns].fillna(0.0).to_numpy(dtype=float)))

    typed = rows.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in typed.schema if f.name in keys) + ", score double"
    return typed.mapInPandas(run, schema)
