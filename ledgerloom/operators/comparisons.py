"""Paired tests of two scores: t, signed ranks, rank sums, areas by DeLong, and a bootstrap by pairs."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.evaluation import average_precision, mid_rank, rank_norm

ROWS = 2_000_000  # scored rows that each replicate may hold in memory; beyond it replicates are rows of one plan
EXACT = 50  # differences up to which signed ranks are counted, not approximated


def normal_tail(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def t_tail(t: float, df: int) -> float:
    """Two-sided tail of Student's t, a finite sum of cosines for whole degrees of freedom."""
    angle = math.atan(abs(t) / math.sqrt(df))
    c2, total, term = math.cos(angle) ** 2, 0.0, 1.0
    if df % 2:
        term = math.cos(angle)
        for k in range(3, df + 2, 2):
            total += term
            term *= c2 * (k - 1) / k
        inside = 2 / math.pi * (angle + (math.sin(angle) * total if df > 1 else 0.0))
    else:
        for k in range(2, df + 2, 2):
            total += term
            term *= c2 * (k - 1) / k
        inside = math.sin(angle) * total
    return max(0.0, 1 - inside)


def signed_rank_tail(d: np.ndarray) -> float | None:
    """Wilcoxon's signed ranks, two-sided; zeros are left out. Few differences without ties are counted exactly."""
    d = d[d != 0]
    n = len(d)
    if not n:
        return None
    size, inverse, count = np.unique(np.abs(d), return_inverse=True, return_counts=True)
    ranks = (np.cumsum(count) - (count - 1) / 2)[inverse]
    plus = float(ranks[d > 0].sum())
    least = min(plus, n * (n + 1) / 2 - plus)
    if n <= EXACT and count.max() == 1:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] += ways[:-k].copy()
        return float(min(1.0, 2 * ways[: int(least) + 1].sum() / 2**n))
    spread = n * (n + 1) * (2 * n + 1) / 24 - ((count**3 - count).sum()) / 48
    return normal_tail((plus - n * (n + 1) / 4) / math.sqrt(spread))


def paired_folds(a: DataFrame, b: DataFrame, fold: str, metric: str) -> DataFrame:
    """n_folds, mean_difference, t, t_p, wilcoxon_p, wins of two metrics by fold (a row a fold). Folds where one is null do not count."""
    d = a.select(fold, F.col(metric).alias("a")).join(b.select(fold, F.col(metric).alias("b")), fold).select((F.col("a") - F.col("b")).alias("d")).where("d IS NOT NULL")

    def test(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(frame["d"].to_numpy())
        n, sd = len(x), x.std(ddof=1) if len(x) > 1 else 0.0
        t = x.mean() / (sd / math.sqrt(n)) if sd > 0 else None
        return pd.DataFrame({"n_folds": [n], "mean_difference": [x.mean()], "t": [t], "t_p": [None if t is None else t_tail(t, n - 1)], "wilcoxon_p": [signed_rank_tail(x)], "wins": [int((x > 0).sum())]})

    return d.groupBy().applyInPandas(test, "n_folds int, mean_difference double, t double, t_p double, wilcoxon_p double, wins int")  # a row a fold


def _tail(z):
    return F.pandas_udf(lambda s: s.map(lambda v: None if pd.isna(v) else normal_tail(v)), "double")(z)


def rank_sums(df: DataFrame, by: Sequence[str], label: str, value: str) -> DataFrame:
    """by, n1, n0, means, area and Mann-Whitney's z (ties and continuity taken into account) of a value between two classes.

    Values are counted first, so a window sees distinct values and not rows."""
    counted = df.where(F.col(value).isNotNull() & F.col(label).isNotNull()).groupBy(*by, value).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("rank", F.coalesce(F.sum("n").over(before), F.lit(0)) + (F.col("n") + 1) / 2.0)
    s = ranked.groupBy(*by).agg(F.sum("pos").alias("n1"), F.sum("n").alias("n"), F.sum(F.col("pos") * F.col("rank")).alias("r"), F.sum(F.pow(F.col("n"), F.lit(3)) - F.col("n")).alias("ties"), F.sum(F.col("pos") * F.col(value)).alias("s1"), F.sum((F.col("n") - F.col("pos")) * F.col(value)).alias("s0"))
    n1, n = F.col("n1"), F.col("n")
    n0 = n - n1
    u = F.col("r") - n1 * (n1 + 1) / 2.0
    spread = n1 * n0 / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    off = u - n1 * n0 / 2.0
    z = F.try_divide(F.signum(off) * F.greatest(F.abs(off) - 0.5, F.lit(0.0)), F.sqrt(spread))
    return s.select(*by, "n1", n0.alias("n0"), F.try_divide("s1", n1).alias("mean_1"), F.try_divide("s0", n0).alias("mean_0"), F.try_divide(u, n1 * n0).alias("auc"), z.alias("z"))


def with_tail(df: DataFrame, z: str = "z", out: str = "p") -> DataFrame:
    return df.withColumn(out, _tail(F.col(z)))


def delong_paired(df: DataFrame, fold: str, label: str, a: str, b: str) -> DataFrame:
    """fold, difference of the two scores' areas and its variance, by DeLong's placements; rows where a score is null do not count."""
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(label).isNotNull()).select(fold, F.col(label).cast("int").alias("y"), F.col(a).alias("a"), F.col(b).alias("b"))
    sizes = known.groupBy(fold).agg(F.sum("y").alias("n1"), F.count(F.lit(1)).alias("n")).where("n1 > 0 AND n1 < n")
    r = known.join(F.broadcast(sizes), fold)  # a row a fold
    for s in ("a", "b"):
        gap = mid_rank([fold], s) - mid_rank([fold, "y"], s)
        r = r.withColumn(f"v_{s}", F.when(F.col("y") == 1, gap / (F.col("n") - F.col("n1"))).otherwise(1 - gap / F.col("n1")))
    d = r.withColumn("d", F.col("v_a") - F.col("v_b"))
    one, none = F.when(F.col("y") == 1, F.col("d")), F.when(F.col("y") == 0, F.col("d"))
    return d.groupBy(fold).agg(F.avg(one).alias("difference"), (F.var_samp(one) / F.count(one) + F.var_samp(none) / F.count(none)).alias("variance"))


def delong_stratified(df: DataFrame, fold: str, label: str, a: str, b: str) -> DataFrame:
    """difference, z: areas compared fold by fold, folds taken as independent."""
    f = delong_paired(df, fold, label, a, b)
    return f.agg(F.avg("difference").alias("difference"), F.try_divide(F.avg("difference"), F.sqrt(F.sum("variance")) / F.count(F.lit(1))).alias("z"))


def _precision(y: np.ndarray, s: np.ndarray, w: np.ndarray) -> float:
    order = np.argsort(-s, kind="stable")
    y, s, w = y[order], s[order], w[order]
    last = np.append(s[1:] != s[:-1], True)
    hits, seen = np.cumsum(w * y)[last], np.cumsum(w)[last]
    with np.errstate(invalid="ignore", divide="ignore"):
        steps = np.diff(hits, prepend=0) * np.where(seen > 0, hits / seen, 0)
    return float(steps.sum() / hits[-1])


def pair_bootstrap(df: DataFrame, pair: str, fold: str, label: str, a: str, b: str, n_boot: int = 2000, seed: int = 0, rows: int = ROWS) -> DataFrame:
    """point, low, high, share_above: difference of the scores' average precisions on their ranks within folds, whole pairs drawn anew n_boot times.

    Each replicate draws as many pairs as there are, with replacement. Up to `rows` scored rows the replicates are shared out
    among tasks that hold the scores; beyond, draws and curves are one distributed plan. Replicates of one class do not count."""
    spark = df.sparkSession
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(label).isNotNull()).withColumn("__row", F.xxhash64(pair, fold, a, b, label))
    ranked = rank_norm(rank_norm(known, [fold], a, "__a"), [fold], b, "__b").select(F.col(pair).alias("pair"), F.col(label).cast("int").alias("y"), F.col("__a").alias("a"), F.col("__b").alias("b"))
    n = ranked.count()
    if n <= rows:
        table = ranked.orderBy("pair", "y", "a", "b").toPandas()  # `rows` at most
        code = pd.factorize(table["pair"])[0]
        sent = spark.sparkContext.broadcast((code, *(table[c].to_numpy() for c in ("y", "a", "b"))))

        def draw(frames):
            code, y, x, z = sent.value
            pairs = int(code.max(initial=-1)) + 1
            for frame in frames:
                out = []
                for rep in frame["id"]:
                    w = np.ones(len(code)) if rep < 0 else np.bincount(np.random.default_rng([seed, int(rep)]).integers(0, pairs, pairs), minlength=pairs)[code].astype(float)
                    if 0 < (w * y).sum() < w.sum():
                        out.append((int(rep), _precision(y, x, w) - _precision(y, z, w)))
                yield pd.DataFrame(out, columns=["rep", "d"])

        parts = max(1, min(200, n_boot // 50))
        d = spark.range(-1, n_boot, 1, parts).mapInPandas(draw, "rep long, d double")
    else:
        names = ranked.select("pair").distinct().withColumn("slot", F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("pair"), F.lit(4096)).alias("bin")).orderBy("pair")) - 1).withColumn("bin", F.pmod(F.xxhash64("pair"), F.lit(4096)))
        sizes = names.groupBy("bin").agg(F.count(F.lit(1)).alias("size"))
        ends = sizes.withColumn("start", F.sum("size").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)))  # 4096 rows
        number = names.join(F.broadcast(ends), "bin").select("pair", (F.coalesce("start", F.lit(0)) + F.col("slot")).alias("at"))
        pairs = number.count()
        drawn = spark.range(n_boot * pairs).select(F.floor(F.col("id") / pairs).alias("rep"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(pairs)).alias("at")).groupBy("rep", "at").agg(F.count(F.lit(1)).alias("w"))
        drawn = drawn.unionByName(number.select(F.lit(-1).cast("long").alias("rep"), "at", F.lit(1).cast("long").alias("w")))
        weighed = drawn.join(number, "at").join(ranked, "pair")
        one = [average_precision_weighted(weighed, s).withColumnRenamed("ap", s) for s in ("a", "b")]
        d = one[0].join(one[1], "rep").select("rep", (F.col("a") - F.col("b")).alias("d"))
    return d.agg(F.max(F.when(F.col("rep") < 0, F.col("d"))).alias("point"), *[F.percentile(F.when(F.col("rep") >= 0, F.col("d")), q).alias(name) for name, q in (("low", 0.025), ("high", 0.975))], F.avg(F.when(F.col("rep") >= 0, (F.col("d") > 0).cast("double"))).alias("share_above"))


def average_precision_weighted(df: DataFrame, score: str) -> DataFrame:
    """rep, ap: average precision of weighted rows (rep, y, w) by replicate; one with a single class has none."""
    steps = df.groupBy("rep", score).agg(F.sum(F.col("w") * F.col("y")).alias("pos"), F.sum("w").alias("n"))
    w = Window.partitionBy("rep").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    c = steps.withColumns({"hits": F.sum("pos").over(w), "seen": F.sum("n").over(w)})
    return c.groupBy("rep").agg(F.sum("pos").alias("p"), F.sum("n").alias("all"), F.sum(F.col("pos") * F.col("hits") / F.col("seen")).alias("s")).where("p > 0 AND p < all").select("rep", (F.col("s") / F.col("p")).alias("ap"))


def balanced_folds(df: DataFrame, group: str, k: int = 5, bins: int = 4096) -> DataFrame:
    """group, fold: whole groups, folds of like numbers of rows. Groups are dealt into bins by hash; the largest bin goes to the lightest fold, and so on."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn("__bin", F.pmod(F.xxhash64(group), F.lit(bins)).cast("int"))
    weight, place = [0] * k, {}
    for r in sorted(sizes.groupBy("__bin").agg(F.sum("n").alias("n")).collect(), key=lambda r: (-r["n"], r["__bin"])):  # `bins` rows
        place[r["__bin"]] = at = weight.index(min(weight))
        weight[at] += r["n"]
    told = df.sparkSession.createDataFrame(list(place.items()), "__bin int, fold int")
    return sizes.join(F.broadcast(told), "__bin").select(group, "fold")


def ap_differences(df: DataFrame, fold: str, label: str, a: str, b: str) -> DataFrame:
    return paired_folds(average_precision(df, [fold], label, a), average_precision(df, [fold], label, b), fold, "average_precision")
