"""Queries that hold scores against labels, and vectors against vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import evaluation as V
from ledgerloom.plans.base import Book, table

book = Book()
# Quality labels against a score from the documents' lengths, with ties, in five folds.
_S = "WITH s AS (SELECT d.doc_id, lang, quality, CAST(d.doc_id % 5 AS INTEGER) AS fold, CASE WHEN d.doc_id % 17 = 0 THEN NULL ELSE round(n_chars / 250.0) END AS score, CAST(n_chars % 97 AS DOUBLE) AS other FROM documents d JOIN labels l ON l.doc_id = d.doc_id), k AS (SELECT * FROM s WHERE score IS NOT NULL)"


def _scored(s, d):
    doc = table(s, d, "documents").drop("text").join(table(s, d, "labels"), "doc_id")
    return doc.select("doc_id", "lang", "quality", (F.col("doc_id") % 5).cast("int").alias("fold"), F.when(F.col("doc_id") % 17 != 0, F.round(F.col("n_chars") / 250.0)).alias("score"), (F.col("n_chars") % 97).cast("double").alias("other"))


@book.add(_S + ", r AS (SELECT doc_id, rank() OVER (PARTITION BY fold ORDER BY score) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY fold) AS n FROM k) SELECT s.doc_id, s.fold, round(r / (n + 1), 8) AS rank_norm FROM s LEFT JOIN r ON r.doc_id = s.doc_id")
def rank_norm_fold(s, d):
    return V.rank_norm(_scored(s, d), ["fold"], "score").select("doc_id", "fold", F.round("rank_norm", 8).alias("rank_norm"))


@book.add(_S + ", ref AS (SELECT score FROM k WHERE quality = 1) SELECT doc_id, CASE WHEN score IS NOT NULL THEN round(((SELECT count(*) FROM ref WHERE ref.score < s.score) + 0.5 * (SELECT count(*) FROM ref WHERE ref.score = s.score)) / (SELECT count(*) FROM ref), 8) END AS percentile FROM s")
def percentile_against(s, d):
    q = _scored(s, d)
    return V.percentile_against(q, q.where("quality = 1"), "doc_id", "score").withColumn("percentile", F.round("percentile", 8))


_AUC = ", r AS (SELECT fold, quality, rank() OVER (PARTITION BY fold ORDER BY score) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0 AS r FROM k), a AS (SELECT fold, (sum(quality * r) - sum(quality) * (sum(quality) + 1) / 2.0) / (sum(quality) * (count(*) - sum(quality))) AS auc, count(*) AS n FROM r GROUP BY 1)"


@book.add(_S + _AUC + " SELECT fold, round(auc, 8) AS roc_auc, n FROM a")
def roc_auc(s, d):
    return V.roc_auc(_scored(s, d), ["fold"], "quality", "score").withColumn("roc_auc", F.round("roc_auc", 8))


@book.add(_S + _AUC + " SELECT round(avg(auc), 8) AS mean, round(stddev_samp(auc), 8) AS sd, count(auc) AS n_folds FROM a")
def auc_over_folds(s, d):
    return V.over_folds(V.roc_auc(_scored(s, d), ["fold"], "quality", "score"), "roc_auc").select(F.round("mean", 8).alias("mean"), F.round("sd", 8).alias("sd"), "n_folds")


_CURVE = ", st AS (SELECT fold, score, sum(quality) AS pos, count(*) AS n FROM k GROUP BY 1, 2), c AS (SELECT fold, score, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY fold) AS ap, sum(n) OVER (PARTITION BY fold) AS al FROM st WINDOW w AS (PARTITION BY fold ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"


@book.add(_S + _CURVE + " SELECT fold, round(sum(CASE WHEN pos > 0 THEN tp / seen * pos / ap END), 8) AS average_precision FROM c GROUP BY 1")
def average_precision(s, d):
    return V.average_precision(_scored(s, d), ["fold"], "quality", "score").withColumn("average_precision", F.round("average_precision", 8))


@book.add(_S + _CURVE + " SELECT fold, round(sum(CASE WHEN pos > 0 THEN tp / (tp + ap / (al - ap) * 10.0 * (seen - tp)) * pos / ap END), 7) AS average_precision FROM c GROUP BY 1")
def precision_at_prevalence(s, d):
    return V.average_precision(_scored(s, d), ["fold"], "quality", "score", 1 / 11).withColumn("average_precision", F.round("average_precision", 7))


@book.add(_S + _CURVE + """, p AS (SELECT fold, score, tp / ap AS tpr, (seen - tp) / (al - ap) AS fpr FROM c), q AS (SELECT *, coalesce(lag(tpr) OVER w, 0) AS t0, coalesce(lag(fpr) OVER w, 0) AS f0 FROM p WINDOW w AS (PARTITION BY fold ORDER BY score DESC))
SELECT fold, round(max(CASE WHEN fpr <= 0.1 THEN tpr WHEN f0 <= 0.1 THEN t0 + (0.1 - f0) / (fpr - f0) * (tpr - t0) END), 8) AS tpr_at_fpr FROM q GROUP BY 1""")
def tpr_at_fpr(s, d):
    return V.tpr_at_fpr(_scored(s, d), ["fold"], "quality", "score").withColumn("tpr_at_fpr", F.round("tpr_at_fpr", 8))


@book.add(_S + " SELECT fold, round(avg((other / 97.0 - quality) ** 2), 8) AS brier FROM s GROUP BY 1")
def brier(s, d):
    return V.brier(_scored(s, d).withColumn("p", F.col("other") / 97.0), ["fold"], "quality", "p").withColumn("brier", F.round("brier", 8))


@book.add(_S + _AUC + ", r2 AS (SELECT fold, quality, rank() OVER (PARTITION BY fold ORDER BY other) + (count(*) OVER (PARTITION BY fold, other) - 1) / 2.0 AS r FROM k), b AS (SELECT fold, (sum(quality * r) - sum(quality) * (sum(quality) + 1) / 2.0) / (sum(quality) * (count(*) - sum(quality))) AS auc FROM r2 GROUP BY 1), df AS (SELECT a.auc - b.auc AS d FROM a JOIN b USING (fold)) SELECT count(d) AS n_folds, round(avg(d), 8) AS mean_difference, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) AS t, count(CASE WHEN d > 0 THEN 1 END) AS wins FROM df")
def paired_folds(s, d):
    q = _scored(s, d).where("score IS NOT NULL")
    a, b = (V.roc_auc(q, ["fold"], "quality", c) for c in ("score", "other"))
    return V.paired_difference(a, b, "fold", "roc_auc").select("n_folds", F.round("mean_difference", 8).alias("mean_difference"), F.round("t", 6).alias("t"), "wins")


@book.add(_S + ", r AS (SELECT quality AS y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS a, rank() OVER (PARTITION BY quality ORDER BY score) + (count(*) OVER (PARTITION BY quality, score) - 1) / 2.0 AS o, sum(quality) OVER () AS n1, count(*) OVER () AS n FROM k), v AS (SELECT y, CASE WHEN y = 1 THEN (a - o) / (n - n1) ELSE 1 - (a - o) / n1 END AS v FROM r) SELECT round(avg(v) FILTER (WHERE y = 1), 8) AS auc, round(var_samp(v) FILTER (WHERE y = 1) / count(*) FILTER (WHERE y = 1) + var_samp(v) FILTER (WHERE y = 0) / count(*) FILTER (WHERE y = 0), 9) AS variance FROM v")
def delong_variance(s, d):
    return V.delong(_scored(s, d), "quality", "score").select(F.round("auc", 8).alias("auc"), F.round("variance", 9).alias("variance"))


@book.add("WITH p AS (SELECT o_custkey - o_custkey % 2 AS pair, year(o_orderdate) AS fy, o_custkey % 2 AS side, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2, 3), w AS (SELECT pair, fy, max(v) FILTER (WHERE side = 1) AS a, max(v) FILTER (WHERE side = 0) AS b FROM p GROUP BY 1, 2) SELECT fy, count(*) AS n_pairs, round(avg(a - b), 4) AS mean_difference, round(avg(CASE WHEN a > b THEN 1.0 ELSE 0.0 END), 6) AS share_positive FROM w WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1", fy="INTEGER")
def pair_difference(s, d):
    o = table(s, d, "orders")
    p = o.groupBy((F.col("o_custkey") - F.col("o_custkey") % 2).alias("pair"), F.year("o_orderdate").alias("fy")).agg(*[F.avg(F.when(F.col("o_custkey") % 2 == k, F.col("o_totalprice"))).alias(n) for k, n in ((1, "a"), (0, "b"))])
    p = p.where("a IS NOT NULL AND b IS NOT NULL")
    return p.groupBy("fy").agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg(F.col("a") - F.col("b")), 4).alias("mean_difference"), F.round(F.avg((F.col("a") > F.col("b")).cast("double")), 6).alias("share_positive"))


@book.add("SELECT label, i AS dim, round(avg(x), 6) AS mean FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY 1, 2")
def masked_mean_pool(s, d):
    e = table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return e.groupBy("label", (F.col("i") + 1).cast("long").alias("dim")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@book.add("WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings) SELECT a.vec_id, b.vec_id AS next_id, round(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(a.v, lambda x: x * x))) * sqrt(list_sum(list_transform(b.v, lambda x: x * x)))), 6) AS cosine FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def neighbour_cosine(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    n = e.select(F.col("vec_id").alias("next_id"), (F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(n, "vec_id").select("vec_id", "next_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@book.add("SELECT event_type, count(*) AS n, round(avg(value), 5) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def latency_table(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 5).alias("mean"), F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


@book.add(_S + ", h AS (SELECT quantile_cont(score, 0.8) AS b80, quantile_cont(score, 0.9) AS b90 FROM k WHERE quality = 1) SELECT lang, count(*) AS n, round(avg(CASE WHEN score >= b80 THEN 1.0 ELSE 0.0 END), 6) AS caught_80, round(avg(CASE WHEN score >= b90 THEN 1.0 ELSE 0.0 END), 6) AS caught_90 FROM k, h WHERE quality = 0 GROUP BY 1")
def band_thresholds(s, d):
    k = _scored(s, d).where("score IS NOT NULL")
    h = k.where("quality = 1").agg(F.percentile("score", 0.8).alias("b80"), F.percentile("score", 0.9).alias("b90"))
    bad = k.where("quality = 0").join(F.broadcast(h))  # one row is broadcast
    return bad.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg((F.col("score") >= F.col(f"b{p}")).cast("double")), 6).alias(f"caught_{p}") for p in (80, 90)])


QUERIES, ORACLES = book.queries, book.oracles
