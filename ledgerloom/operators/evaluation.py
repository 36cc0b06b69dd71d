"""Scores held against labels: ranks, areas, precision, pair-aware tests. Everything is by fold where a fold is given."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mid_rank(by: Sequence[str], score: str) -> Column:
    """Average rank of ties."""
    w = Window.partitionBy(*by).orderBy(score)
    ties = Window.partitionBy(*by, score)
    return F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def rank_norm(df: DataFrame, by: Sequence[str], score: str, out: str = "rank_norm") -> DataFrame:
    """Average rank over (n + 1) within `by`; null scores stay null and do not count."""
    w = Window.partitionBy(*by)
    known = df.where(F.col(score).isNotNull()).withColumn(out, mid_rank(by, score) / (F.count(F.lit(1)).over(w) + 1))
    return known.unionByName(df.where(F.col(score).isNull()).withColumn(out, F.lit(None).cast("double")))


def percentile_against(queries: DataFrame, reference: DataFrame, key: str, score: str) -> DataFrame:
    """key, percentile: share of the reference below each query's score, ties as half.

    Reference scores are counted by value first, then met in one ordered union."""
    counted = reference.where(F.col(score).isNotNull()).groupBy(score).agg(F.count(F.lit(1)).alias("__n"))
    total = counted.agg(F.sum("__n").alias("__all"))
    below = Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    asked = queries.where(F.col(score).isNotNull()).select(score).distinct()
    marks = asked.join(counted, score, "full").withColumn("__below", F.coalesce(F.sum("__n").over(below), F.lit(0)))
    marks = marks.join(F.broadcast(total)).select(score, ((F.col("__below") + F.coalesce("__n", F.lit(0)) / 2.0) / F.col("__all")).alias("percentile"))
    return queries.join(marks, score, "left").select(key, "percentile")


def roc_auc(df: DataFrame, by: Sequence[str], label: str, score: str) -> DataFrame:
    """By rank sums; null with one class only. Scores are counted by value first, so the window sees distinct scores."""
    c = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, score).agg(F.sum(F.col(label).cast("double")).alias("pos"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = c.withColumn("__r", F.coalesce(F.sum("rows").over(before), F.lit(0)) + (F.col("rows") + 1) / 2.0)
    n1, n = F.sum("pos"), F.sum("rows")
    area = (F.sum(F.col("pos") * F.col("__r")) - n1 * (n1 + 1) / 2.0) / (n1 * (n - n1))
    return ranked.groupBy(*by).agg(F.when((n1 > 0) & (n1 < n), area).alias("roc_auc"), n.alias("n"))


def _curve(df: DataFrame, by: Sequence[str], label: str, score: str) -> DataFrame:
    """Cumulative hits and rows at each distinct score, best first, with totals."""
    steps = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("rows"))
    w = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    return steps.withColumns({"tp": F.sum("pos").over(w), "seen": F.sum("rows").over(w), "all_pos": F.sum("pos").over(whole), "all": F.sum("rows").over(whole)})


def average_precision(df: DataFrame, by: Sequence[str], label: str, score: str, prevalence: float | None = None) -> DataFrame:
    """Sum of precision times gain in recall over distinct scores; negatives weighted to a prevalence if given."""
    c = _curve(df, by, label, score)
    w = F.lit(1.0) if prevalence is None else F.col("all_pos") / (F.col("all") - F.col("all_pos")) * (1 - prevalence) / prevalence
    precision = F.col("tp") / (F.col("tp") + w * (F.col("seen") - F.col("tp")))
    return c.groupBy(*by).agg(F.sum(F.when(F.col("pos") > 0, precision * F.col("pos") / F.col("all_pos"))).alias("average_precision"))


def tpr_at_fpr(df: DataFrame, by: Sequence[str], label: str, score: str, target: float = 0.1) -> DataFrame:
    """True-positive rate at a false-positive rate, between the curve's points by straight lines."""
    c = _curve(df, by, label, score)
    c = c.select(*by, score, (F.col("tp") / F.col("all_pos")).alias("tpr"), ((F.col("seen") - F.col("tp")) / (F.col("all") - F.col("all_pos"))).alias("fpr"))
    w = Window.partitionBy(*by).orderBy(F.desc(score))
    c = c.withColumns({"t0": F.coalesce(F.lag("tpr").over(w), F.lit(0.0)), "f0": F.coalesce(F.lag("fpr").over(w), F.lit(0.0))})
    inside = F.when(F.col("fpr") <= target, F.col("tpr")).when(F.col("f0") <= target, F.col("t0") + (target - F.col("f0")) / (F.col("fpr") - F.col("f0")) * (F.col("tpr") - F.col("t0")))
    return c.groupBy(*by).agg(F.max(inside).alias("tpr_at_fpr"))


def brier(df: DataFrame, by: Sequence[str], label: str, score: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(score) - F.col(label), F.lit(2.0))).alias("brier"))


def over_folds(per_fold: DataFrame, metric: str) -> DataFrame:
    """Mean and sample deviation of a metric over folds, and their number; folds without one do not count."""
    return per_fold.agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"), F.count(metric).alias("n_folds"))


def paired_difference(a: DataFrame, b: DataFrame, fold: str, metric: str) -> DataFrame:
    """Per-fold differences summed up: mean, t statistic and wins."""
    d = a.select(fold, F.col(metric).alias("a")).join(b.select(fold, F.col(metric).alias("b")), fold).withColumn("d", F.col("a") - F.col("b"))
    n, sd = F.count("d"), F.stddev_samp("d")
    return d.agg(n.alias("n_folds"), F.avg("d").alias("mean_difference"), F.when(sd > 0, F.avg("d") / (sd / F.sqrt(n))).alias("t"), F.count_if(F.col("d") > 0).alias("wins"))


def delong(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area and its variance by mid-ranks within and across the classes."""
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.col(label).cast("int").alias("y"), F.col(score).alias("s"))
    r = known.withColumns({"all_r": mid_rank([F.lit(1)], "s"), "own_r": mid_rank(["y"], "s"), "n1": F.sum("y").over(Window.partitionBy()), "n": F.count(F.lit(1)).over(Window.partitionBy())})
    v = F.when(F.col("y") == 1, (F.col("all_r") - F.col("own_r")) / (F.col("n") - F.col("n1"))).otherwise(1 - (F.col("all_r") - F.col("own_r")) / F.col("n1"))
    g = r.withColumn("v", v)
    one, none = F.when(F.col("y") == 1, F.col("v")), F.when(F.col("y") == 0, F.col("v"))
    return g.agg(F.avg(one).alias("auc"), (F.var_samp(one) / F.count(one) + F.var_samp(none) / F.count(none)).alias("variance"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
