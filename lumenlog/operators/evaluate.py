"""Scores of a parser's templates against the truth (A9-A18), from counts per pair of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlog.functions.tokens import levenshtein_similarity


def _pairs(n: Column) -> Column:
    return n.cast("double") * (n - 1) / 2


def contingency(df: DataFrame, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """p, t, n: rows with each pair of groups; all the scores that compare groups come from these few rows."""
    return df.groupBy(F.col(pred).alias("p"), F.col(truth).alias("t")).agg(F.count("*").alias("n"))


def grouping_scores(df: DataFrame, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """One row: n, grouping_accuracy (pairs of rows on which both groupings agree, of all pairs; 0 without pairs) and
    pair_f1 (of pairs put together)."""
    c = contingency(df, pred, truth)
    one = lambda x, name: x.agg(F.coalesce(F.sum(_pairs(F.col("n"))), F.lit(0.0)).alias(name))
    both, p, t = one(c, "both"), one(c.groupBy("p").agg(F.sum("n").alias("n")), "a"), one(c.groupBy("t").agg(F.sum("n").alias("n")), "b")
    total = c.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    row = total.crossJoin(both).crossJoin(p).crossJoin(t)  # single rows
    every = _pairs(F.col("n"))
    ga = F.when(every > 0, (every + 2 * F.col("both") - F.col("a") - F.col("b")) / every).otherwise(0.0)
    f1 = F.when(F.col("a") + F.col("b") > 0, 2 * F.col("both") / (F.col("a") + F.col("b"))).otherwise(0.0)
    return row.select("n", ga.alias("grouping_accuracy"), f1.alias("pair_f1"))


def parsing_accuracy(df: DataFrame, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """One row: exact (share of equal templates), structural (equal parts between <*>) and mean_similarity."""
    parts = lambda c: F.transform(F.split(F.col(c), r"<\*>"), F.trim)
    return df.agg(
        F.avg((F.col(pred) == F.col(truth)).cast("double")).alias("exact"), F.avg((parts(pred) == parts(truth)).cast("double")).alias("structural"),
        F.avg(levenshtein_similarity(F.col(pred), F.col(truth))).alias("mean_similarity"),
    )


def template_set_f1(df: DataFrame, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """One row: precision, recall and f1 of the set of templates."""
    names = df.select(F.col(pred).alias("x"), F.lit(1).alias("p"), F.lit(0).alias("t")).union(df.select(F.col(truth), F.lit(0), F.lit(1)))
    sides = names.groupBy("x").agg(F.max("p").alias("p"), F.max("t").alias("t")).agg(F.sum(F.col("p") * F.col("t")).alias("both"), F.sum("p").alias("np"), F.sum("t").alias("nt"))
    ratio = lambda d: F.coalesce(F.try_divide(F.col("both").cast("double"), d), F.lit(0.0))
    return sides.select(ratio(F.col("np")).alias("precision"), ratio(F.col("nt")).alias("recall"), F.coalesce(F.try_divide(2.0 * F.col("both"), F.col("np") + F.col("nt")), F.lit(0.0)).alias("f1"))


def label_f1(df: DataFrame, pred: str = "pred", truth: str = "truth", compat: bool = False) -> DataFrame:
    """One row: fga (micro F1 = share of equal labels) and fta (mean F1 of all labels of either side). `compat`
    compares the alphabetical ranks of the labels within their own side instead of the labels."""
    c = contingency(df, pred, truth)
    if compat:  # few rows: one per pair of groups
        c = c.select(F.dense_rank().over(W.orderBy("p")).alias("p"), F.dense_rank().over(W.orderBy("t")).alias("t"), "n")
    hit = F.when(F.col("p") == F.col("t"), F.col("n")).otherwise(0)
    sides = c.select(F.col("p").alias("x"), F.col("n").alias("np"), F.lit(0).alias("nt"), hit.alias("tp")).union(c.select("t", F.lit(0), "n", F.lit(0)))
    per = sides.groupBy("x").agg(F.sum("np").alias("np"), F.sum("nt").alias("nt"), F.sum("tp").alias("tp"))
    return per.agg(F.try_divide(F.sum("tp").cast("double"), F.sum("np")).alias("fga"), F.avg(2.0 * F.col("tp") / (F.col("np") + F.col("nt"))).alias("fta"))


def granularity(df: DataFrame, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """One row: ggd and pgd, the relative distance of the means and of the population deviations of group sizes."""
    sizes = lambda c, s: df.groupBy(c).agg(F.count("*").alias("n")).agg(F.avg("n").alias(f"m{s}"), F.stddev_pop("n").alias(f"s{s}"))
    row = sizes(pred, "p").crossJoin(sizes(truth, "t"))  # single rows
    far = lambda x: F.coalesce(F.try_divide(F.abs(F.col(f"{x}t") - F.col(f"{x}p")), F.greatest(f"{x}t", f"{x}p")), F.lit(0.0))
    return row.select(far("m").alias("ggd"), far("s").alias("pgd"))


def evaluate(df: DataFrame, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """All scores in one row."""
    counts = df.agg(F.count_distinct(pred).alias("n_pred_templates"), F.count_distinct(truth).alias("n_true_templates"))
    out = grouping_scores(df, pred, truth).crossJoin(parsing_accuracy(df, pred, truth)).crossJoin(template_set_f1(df, pred, truth))
    return out.crossJoin(label_f1(df, pred, truth)).crossJoin(granularity(df, pred, truth)).crossJoin(counts)  # single rows
