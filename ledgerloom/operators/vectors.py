"""Documents as weighted terms, and a text model on the other folds."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ledgerloom.functions.text import let
from ledgerloom.operators.tables import shuffled


def terms(docs: DataFrame, key: str, words: str) -> DataFrame:
    """key, term, tf of a document's words and pairs of neighbouring words."""

    def both(w):
        pairs = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))
        return F.concat(w, F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<string>")))

    every = let(F.col(words), both)
    return docs.select(key, F.explode(every).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counted: DataFrame, key: str, firms: DataFrame, firm: str, least: int = 3, least_firms: int = 5) -> DataFrame:
    """term, df of terms in at least `least` documents, of at least `least_firms` firms. Firms are counted by term and firm first."""
    per = counted.join(shuffled(firms.select(key, firm)), key).groupBy("term", firm).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("term").agg(F.sum("n").alias("df"), F.count(F.lit(1)).alias("firms")).where((F.col("df") >= least) & (F.col("firms") >= least_firms)).select("term", "df")


def weights(counted: DataFrame, known: DataFrame, n_docs: DataFrame, key: str) -> DataFrame:
    """key, term, weight: (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), each document of length one. n_docs: one row, n."""
    w = (1 + F.ln("tf")) * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    raw = counted.join(shuffled(known), "term").join(F.broadcast(n_docs)).select(key, "term", w.alias("w"))
    length = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l"))
    return raw.join(shuffled(length), key).select(key, "term", (F.col("w") / F.col("l")).alias("weight"))


def tfidf_oof(docs: DataFrame, key: str = "doc_id", fold: str = "fold", label: str = "label", firm: str = "source", words: str = "tokens", size: int = 1 << 18, least_firms: int = 5, least: int = 3) -> DataFrame:
    """key, fold, label, score: logistic regression on weighted terms whose vocabulary and weights come from the other folds.

    Terms are known by a 64-bit hash and dealt to `size` places by it, so no vocabulary is held in one place; documents without a known
    term have no places. Terms are counted once for all folds: what the other folds have is told by sums over folds, and the weights
    under each fold's vocabulary stand side by side in a row of the document, which is kept."""
    folds = [r[0] for r in docs.select(fold).distinct().orderBy(fold).collect()]  # folds are few
    counted = terms(docs, key, words).select(key, F.xxhash64("term").alias("h"), "tf")
    about = docs.select(key, firm, fold, F.col(label).cast("double").alias(label))
    per = counted.join(shuffled(about.select(key, firm, fold)), key).groupBy("h", firm).agg(*[F.count_if(F.col(fold) != k).alias(f"d{i}") for i, k in enumerate(folds)])
    both = per.groupBy("h").agg(*[F.when((F.sum(f"d{i}") >= least) & (F.count_if(F.col(f"d{i}") > 0) >= least_firms), F.sum(f"d{i}")).alias(f"d{i}") for i in range(len(folds))])
    known = both.where(F.coalesce(*[F.col(f"d{i}") for i in range(len(folds))]).isNotNull())
    n = docs.agg(*[F.count_if(F.col(fold) != k).alias(f"n{i}") for i, k in enumerate(folds)]).first()
    weight = lambda i: (1 + F.ln("tf")) * (F.ln((1 + n[i]) / (1 + F.col(f"d{i}"))) + 1)
    at = F.pmod("h", F.lit(size)).cast("int").alias("at")
    raw = counted.join(shuffled(known), "h").select(key, at, *[weight(i).alias(f"w{i}") for i in range(len(folds))]).repartition(key)
    placed = raw.groupBy(key, "at").agg(*[F.sum(f"w{i}").alias(f"w{i}") for i in range(len(folds))], *[F.sum(F.col(f"w{i}") * F.col(f"w{i}")).alias(f"q{i}") for i in range(len(folds))])
    packed = placed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", *[f"w{i}" for i in range(len(folds))]))).alias("f"), *[F.sqrt(F.sum(f"q{i}")).alias(f"l{i}") for i in range(len(folds))])
    kept = about.drop(firm).join(shuffled(packed), key, "left").persist(StorageLevel.DISK_ONLY)
    vector = F.udf(lambda at, x: SparseVector(size, at or [], x or []), VectorUDT())
    cores = 2 * docs.sparkSession.sparkContext.defaultParallelism
    done = []
    for i, k in enumerate(folds):
        f = F.filter("f", lambda p: p[f"w{i}"].isNotNull())
        rows = kept.select(key, fold, label, f.alias("f"), f"l{i}").select(key, fold, label, vector(F.col("f.at"), F.transform("f", lambda p: p[f"w{i}"] / F.col(f"l{i}"))).alias("__x"))
        train = rows.where(F.col(fold) != k).coalesce(cores).persist(StorageLevel.DISK_ONLY)  # each part sends a gradient of `size` numbers at each step
        model = LogisticRegression(featuresCol="__x", labelCol=label, regParam=1e-3, maxIter=100, standardization=False).fit(train)
        train.unpersist()
        done.append(model.transform(rows.where(F.col(fold) == k)).select(key, fold, label, vector_to_array("probability")[1].alias("score")))
    return reduce(DataFrame.unionByName, done)


def masked_mean(tokens: DataFrame, key: str, vector: str, mask: str) -> DataFrame:
    """key and the mean of the vectors of its rows where the mask is 1; null where it never is. Sums are by place, before any vector is made whole."""
    places = tokens.where(F.col(mask) == 1).select(key, F.posexplode(vector).alias("at", "x")).groupBy(key, "at").agg(F.avg("x").alias("x"))
    whole = places.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("mean"))
    return tokens.select(key).distinct().join(whole, key, "left")


def previous_cosine(vectors: DataFrame, firm: str, year: str, vector: str) -> DataFrame:
    """firm, year, cosine of a firm's vector with that of its year before, where both are there."""
    from ledgerloom.operators.evaluation import cosine

    before = vectors.select(firm, (F.col(year) + 1).alias(year), F.col(vector).alias("__before"))
    return vectors.join(before, [firm, year]).select(firm, year, cosine(F.col(vector), F.col("__before")).alias("cosine"))


