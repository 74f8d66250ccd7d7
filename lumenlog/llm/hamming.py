"""Exact top-k search over binary codes (operator 2): incremental multi-index hashing.

A vector's code has a bit per component (1 if positive), cut into segments of SEG bits. An index row stands for each
segment of each distinct code. In round r every open query looks up all segment values at exactly r bits from its
own, verifies the Hamming distances of the codes it meets, and is closed once its k-th verified distance is at most
m * (r + 1) - 1 (m: segments): any code that near has a segment within r bits and has been met.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlog.session import materialize

SEG = 16


def binary_codes(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id, dim, segs: the bits of each vector as integers of SEG bits; rows without components have no code."""
    get = lambda j, i: F.when(F.get(F.col(vector), j * SEG + i) > 0, 1).otherwise(0)
    seg = lambda j: F.aggregate(F.sequence(F.lit(0), F.lit(SEG - 1)), F.lit(0), lambda a, i: a * 2 + get(j, i))
    last = F.floor((F.size(vector) - 1) / SEG).cast("int")
    some = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.col(id_col).isNotNull())
    return some.select(F.col(id_col).cast("long").alias("id"), F.size(vector).alias("dim"), F.transform(F.sequence(F.lit(0), last), seg).alias("segs"))


def top_k(base: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, neighbor_id, distance, rank: the k nearest other ids of each query among `base`; both have
    (id, dim, segs) of binary_codes. Ties go to the smaller id; codes of another dimension are never neighbours;
    with fewer than k other rows all are returned. An id that is repeated in `base` counts once for each distinct code.
    """
    # Of equal codes only the k + 1 smallest ids matter; the limit is applied before the shuffle and after it.
    own = W.partitionBy("dim", "segs").orderBy("id")
    few = base.distinct().withColumn("n", F.row_number().over(own)).where(F.col("n") <= k + 1)
    codes = materialize(few.groupBy("dim", "segs").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    codes = materialize(codes.withColumn("cid", F.monotonically_increasing_id()), "codes")
    index = materialize(codes.select("dim", "cid", F.posexplode("segs").alias("j", "v")), "index")
    code_count = codes.count()
    asked_codes = queries.select(F.col("dim").alias("qd"), F.col("segs").alias("q")).distinct()
    own_codes = materialize(asked_codes.withColumn("qid", F.monotonically_increasing_id()), "queries")
    open_ = own_codes
    closed, found = [], None
    # Exploded rows outgrow what the planner expects, so these joins are told not to broadcast.
    for r in range(SEG + 1):
        masks = F.expr(f"filter(sequence(0, {2**SEG - 1}), x -> bit_count(x) = {r})")
        probes = open_.select("qd", "qid", "q", F.explode(masks).alias("mask")).select("qd", "qid", "mask", F.posexplode("q").alias("j", "own"))
        probes = probes.select("qid", F.col("qd").alias("dim"), "j", F.col("own").bitwiseXOR(F.col("mask")).alias("v"))
        met = probes.join(index.hint("merge"), ["dim", "j", "v"]).select("qid", "cid").distinct()
        if found is not None:  # of the codes met before, the k + 1 nearest are enough
            met = met.unionByName(found.join(open_, "qid", "left_semi").select("qid", "cid")).distinct()
        far = F.aggregate(F.zip_with("q", "segs", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, x: a + x)
        both = met.join(codes.select("cid", "segs", "ids").hint("merge"), "cid").join(open_.select("qid", "q").hint("merge"), "qid")
        near = W.partitionBy("qid").orderBy("distance", F.col("ids")[0])
        rows = both.select("qid", "cid", "ids", F.size("q").alias("m"), far.alias("distance"))
        found = materialize(rows.withColumn("n", F.row_number().over(near)).where(F.col("n") <= k + 1).drop("n"), "found")
        sure = F.col("distance") <= F.col("m") * (r + 1) - 1
        have = found.groupBy("qid").agg(F.sum(F.when(sure, F.size("ids")).otherwise(0)).alias("n"), F.count("*").alias("c"))
        done = materialize(have.where((F.col("n") > k) | (F.col("c") >= code_count)).select("qid"), "done")
        closed.append(found.join(done, "qid", "left_semi"))
        open_ = materialize(open_.join(done, "qid", "left_anti"), "queries")
        if open_.isEmpty():
            break
        if r == SEG:
            closed.append(found.join(open_, "qid", "left_semi"))
    pairs = reduce(DataFrame.unionByName, closed).join(own_codes, "qid").select("qd", "q", "distance", F.explode("ids").alias("neighbor_id"))
    asked = queries.select(F.col("id").alias("query_id"), F.col("dim").alias("qd"), F.col("segs").alias("q")).distinct()
    got = asked.join(pairs, ["qd", "q"]).where("query_id <> neighbor_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    return got.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "neighbor_id", F.col("distance").cast("int").alias("distance"), F.col("rank").cast("int").alias("rank"))
