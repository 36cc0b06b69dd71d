"""Reviewing tables: agreement, accuracy, samples, folds, checksums, summaries, importance, evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.quantiles import quantiles


def agreement(pairs: DataFrame, by: Sequence[str], a: str, b: str, near: float = 0.01, far: float = 0.05) -> DataFrame:
    """Shares of rows with both values that agree within `near` and `far` of the second, and counts of the first class of disagreement."""
    gap = F.try_divide(F.abs(F.col(a) - F.col(b)), F.abs(F.col(b)))
    kind = F.when(gap <= near, "agree").when(F.col(a) == -F.col(b), "sign").when(F.abs(F.log10(F.abs(F.try_divide(F.col(a), F.col(b)))) - F.round(F.log10(F.abs(F.try_divide(F.col(a), F.col(b)))))) <= 0.005, "scale").otherwise("other")
    both = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumns({"__gap": gap, "__kind": kind})
    share = lambda cond: F.avg(F.coalesce(cond, F.lit(False)).cast("double"))
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), share(F.col("__gap") <= near).alias("within_near"), share(F.col("__gap") <= far).alias("within_far"), *[F.count_if(F.col("__kind") == k).alias(f"n_{k}") for k in ("sign", "scale", "other")])


def accuracy(sheet: DataFrame, by: Sequence[str], mark: str) -> DataFrame:
    """Share of Y among Y and N; null where neither was marked."""
    m = F.upper(F.trim(mark))
    return sheet.groupBy(*by).agg(F.avg(F.when(m.isin("Y", "N"), (m == "Y").cast("double"))).alias("accuracy"), F.count_if(m.isin("Y", "N")).alias("n_marked"))


def hashed_order(seed: int, *keys: str) -> Column:
    """An order that looks random and depends on nothing but the keys: no two runs differ."""
    return F.xxhash64(F.lit(seed), *keys)


def stratified(df: DataFrame, group: str, key: str, per_group: int, seed: int = 42) -> DataFrame:
    """`per_group` rows of each group in hashed order: the feature is the limit."""
    w = Window.partitionBy(group).orderBy(hashed_order(seed, key), key)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= per_group).drop("__n")


def share_of_keys(df: DataFrame, keys: Sequence[str], share: float, seed: int = 42) -> DataFrame:
    """All rows of a share of the keys, chosen by hash, in one pass."""
    return df.where(F.pmod(hashed_order(seed, *keys), F.lit(1 << 20)) < int(share * (1 << 20)))


def group_folds(df: DataFrame, group: str, folds: int = 5, out: str = "fold") -> DataFrame:
    """Whole groups to folds by hash: the same fold on any cluster, and no group in two."""
    return df.withColumn(out, F.pmod(F.xxhash64(group), F.lit(folds)).cast("int"))


def checksum(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows and a sum of row hashes, which does not depend on their order."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string").alias("checksum"))


def split_groups(df: DataFrame, group: str, fold: str) -> DataFrame:
    """Groups that stand in more than one fold: there should be none."""
    return df.groupBy(group).agg(F.count_distinct(fold).alias("n_folds")).where("n_folds > 1")


def class_summary(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """feature, label: count, mean, median and the share above zero, over values that are there."""
    long = df.select(label, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("s")).select(label, "s.*").where("x IS NOT NULL")
    return long.groupBy("feature", label).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.percentile("x", 0.5).alias("median"), F.avg((F.col("x") > 0).cast("double")).alias("share_positive"))


def quantile_table(df: DataFrame, features: Sequence[str], points: Sequence[float] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """feature, point, value: linear quantiles of each feature."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("s")).select("s.*")
    told = quantiles(long, "feature", "x", points)
    return df.sparkSession.createDataFrame([(f, float(p), v) for f, values in told.items() for p, v in zip(points, values, strict=True)], "feature string, point double, value double")


def pick(df: DataFrame, *candidates: str) -> Column:
    """The first of the candidate columns, their case aside, that is there and not blank."""
    there = {c.lower(): c for c in df.columns}
    found = [F.nullif(F.trim(F.col(f"`{there[c.lower()]}`").cast("string")), F.lit("")) for c in candidates if c.lower() in there]
    return F.coalesce(*found, F.lit(None).cast("string"))


def top_parts(df: DataFrame, key: str, parts: str, weight, k: int = 3) -> DataFrame:
    """The k parts of each row's array of most weight, earlier ones first on ties."""
    long = df.select(key, F.posexplode(parts).alias("pos", "part")).withColumn("weight", weight(F.col("part")))
    w = Window.partitionBy(key).orderBy(F.desc("weight"), "pos")
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(key, "rank", "pos", "part", "weight")


def grid(*tables: DataFrame) -> DataFrame:
    """All combinations of small tables of settings."""
    out = tables[0]
    for t in tables[1:]:
        out = out.crossJoin(F.broadcast(t))
    return out


def permuted(df: DataFrame, key: str, columns: Sequence[str], seed: int = 0) -> DataFrame:
    """`df` with the columns' values dealt to other rows, together: both sides are numbered in hashed orders and joined."""
    a = df.withColumn("__n", F.row_number().over(Window.orderBy(hashed_order(seed, key), key)))
    b = df.select(*columns, F.row_number().over(Window.orderBy(hashed_order(seed + 1, key), key)).alias("__n"))
    return a.drop(*columns).join(b, "__n").drop("__n")


def importance(df: DataFrame, key: str, label: str, score, families: dict[str, Sequence[str]], seed: int = 0) -> DataFrame:
    """Loss of ROC area when a family of features is permuted. score: features of a frame to a Column."""
    from ledgerloom.operators.evaluation import roc_auc

    area = lambda d: roc_auc(d.withColumn("__s", score(d)), [], label, "__s").select("roc_auc")
    base = area(df).withColumnRenamed("roc_auc", "base")
    out = None
    for name, columns in families.items():
        one = area(permuted(df, key, columns, seed)).select(F.lit(name).alias("family"), "roc_auc")
        out = one if out is None else out.unionByName(one)
    return out.crossJoin(F.broadcast(base)).select("family", (F.col("base") - F.col("roc_auc")).alias("loss"))


def blend_percentiles(queries: DataFrame, reference: DataFrame, key: str, scores: Sequence[str], bands: Sequence[tuple[str, float]]) -> DataFrame:
    """Mean percentile of each row's scores against a reference, and the first band, from the top, whose threshold it reaches."""
    from ledgerloom.operators.evaluation import percentile_against

    out = queries.select(key)
    for s in scores:
        out = out.join(percentile_against(queries, reference, key, s).withColumnRenamed("percentile", s), key)
    blend = sum((F.col(s) for s in scores), F.lit(0.0)) / len(scores)
    band = F.coalesce(*[F.when(F.col("blend") >= t, F.lit(n)) for n, t in bands])
    return out.withColumn("blend", blend).withColumn("band", band)


def quotes(text: Column, pattern: str, width: int = 200) -> Column:
    """Clauses that match, cut to a width around the match: the evidence for a flag."""
    clauses = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[.;]+"), lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))), lambda c: c.rlike(f"(?i){pattern}"))
    return F.transform(clauses, lambda c: F.substring(c, F.greatest(F.lit(1), F.regexp_instr(c, F.lit(f"(?i){pattern}")) - width // 2), F.lit(width)))
