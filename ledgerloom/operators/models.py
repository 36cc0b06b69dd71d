"""Models fitted on the other folds and scored on the held-out one. What is learned never sees the fold it scores."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.quantiles import quantiles


def prepared(train: DataFrame, other: DataFrame, features: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both frames winsorised, filled with medians, marked where missing and standardised, by the training frame's figures."""
    long = train.select(F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("double").alias("x")) for f in features])).alias("s")).select("s.*")
    row = quantiles(long, "f", "x", (0.01, 0.5, 0.99))
    bounds = {f: row.get(f) or [0.0, 0.0, 0.0] for f in features}

    def fill(df: DataFrame) -> DataFrame:
        for f, (low, mid, high) in bounds.items():
            df = df.withColumns({f"{f}__gone": F.col(f).isNull().cast("double"), f: F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(f, F.lit(mid))))})
        return df

    train, other = fill(train), fill(other)
    stats = train.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    scale = lambda df: df.withColumns({f: (F.col(f) - F.lit(stats[f"m_{f}"] or 0.0)) / F.lit(stats[f"s_{f}"] or 1.0) for f in features})
    return scale(train), scale(other), [*features, *[f"{f}__gone" for f in features]]


def _oof(df: DataFrame, key: str, fold: str, label: str, features: list[str], make) -> DataFrame:
    done = []
    for k in [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]:  # folds are few
        train, test, names = prepared(df.where(F.col(fold) != k), df.where(F.col(fold) == k), features)
        vector = VectorAssembler(inputCols=names, outputCol="__x")
        model = make(label).fit(vector.transform(train))
        p = model.transform(vector.transform(test)).select(key, fold, label, vector_to_array("probability")[1].alias("score"))
        done.append(p)
    return reduce(DataFrame.unionByName, done)


def logistic_oof(df: DataFrame, key: str, fold: str, label: str, features: list[str], c: float = 1.0) -> DataFrame:
    return _oof(df, key, fold, label, features, lambda y: LogisticRegression(featuresCol="__x", labelCol=y, regParam=1e-3 / c, maxIter=50))


def boosted_oof(df: DataFrame, key: str, fold: str, label: str, features: list[str], rounds: int = 10) -> DataFrame:
    """Missing values have no branch of their own in Spark's trees: they are filled and marked."""
    return _oof(df, key, fold, label, features, lambda y: GBTClassifier(featuresCol="__x", labelCol=y, maxIter=rounds, maxDepth=3, seed=7))


def median_filled(df: DataFrame, fold: str, score: str, out: str) -> DataFrame:
    """A missing score takes the median of the other folds."""
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
    mids = quantiles(df, fold, score, (0.5,), {f: [g for g in folds if g is not None and g != f] for f in folds if f is not None})
    fill = F.coalesce(*[F.when(F.col(fold) == f, F.lit((mids.get(f) or [None])[0])) for f in folds])
    return df.withColumn(out, F.coalesce(F.col(score), fill))


def lexicon_oof(df: DataFrame, top: int = 100, min_firms: int = 10) -> DataFrame:
    """doc_id, fold, label, score = (hits of good terms - hits of bad) / top, terms mined on the other folds by log-odds.

    df: doc_id, fold, label, source, tokens. Terms need three documents and `min_firms` sources."""
    terms = df.select("doc_id", "fold", "label", "source", F.explode(F.array_distinct("tokens")).alias("term"))
    done = []
    for k in [r[0] for r in df.select("fold").distinct().orderBy("fold").collect()]:
        t = terms.where(F.col("fold") != k).groupBy("term").agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b"), F.count_distinct("source").alias("firms"))
        t = t.where((F.col("a") + F.col("b") >= 3) & (F.col("firms") >= min_firms))
        n = t.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
        p = F.col("a") + F.col("b")
        odds = F.ln((F.col("a") + p) / (2 * F.col("na") + F.col("nb") - F.col("a") - p)) - F.ln((F.col("b") + p) / (2 * F.col("nb") + F.col("na") - F.col("b") - p))
        z = t.join(F.broadcast(n)).withColumn("z", odds / F.sqrt(F.lit(1.0) / (F.col("a") + p) + F.lit(1.0) / (F.col("b") + p)))
        best = z.orderBy(F.desc("z"), "term").limit(top).select("term", F.lit(1).alias("side")).unionByName(z.orderBy("z", "term").limit(top).select("term", F.lit(-1).alias("side")))
        hits = terms.where(F.col("fold") == k).join(F.broadcast(best), "term").groupBy("doc_id").agg((F.sum("side") / F.lit(top)).alias("hits"))  # 2 * top rows
        done.append(df.where(F.col("fold") == k).select("doc_id", "fold", "label").join(hits, "doc_id", "left").select("doc_id", "fold", "label", F.coalesce("hits", F.lit(0.0)).alias("score")))
    return reduce(DataFrame.unionByName, done)


def blended(df: DataFrame, key: str, fold: str, scores: list[str], out: str = "blend") -> DataFrame:
    """Mean of the scores' ranks within each fold."""
    from ledgerloom.operators.evaluation import mid_rank

    n = F.count(F.lit(1)).over(Window.partitionBy(fold))
    return df.withColumn(out, sum((mid_rank([fold], s) / (n + 1) for s in scores), F.lit(0.0)) / len(scores))
