"""Queries that review tables: agreement, accuracy, folds, quantiles, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import review as R
from ledgerloom.plans.base import Book, table
from ledgerloom.plans.text import sql_sentences, sql_words

book = Book()
_A = "WITH a AS (SELECT l_returnflag AS f, l_extendedprice AS b, CASE l_orderkey % 9 WHEN 0 THEN -l_extendedprice WHEN 1 THEN l_extendedprice * 100 WHEN 2 THEN l_extendedprice * 1.03 WHEN 3 THEN l_extendedprice * 1.3 WHEN 4 THEN NULL ELSE l_extendedprice END AS a FROM lineitem), g AS (SELECT *, abs(a - b) / abs(b) AS gap FROM a WHERE a IS NOT NULL)"


@book.add(_A + " SELECT f, count(*) AS n, round(avg(CASE WHEN gap <= 0.01 THEN 1.0 ELSE 0.0 END), 6) AS within_near, round(avg(CASE WHEN gap <= 0.05 THEN 1.0 ELSE 0.0 END), 6) AS within_far, count(CASE WHEN gap > 0.01 AND a = -b THEN 1 END) AS n_sign, count(CASE WHEN gap > 50 THEN 1 END) AS n_scale, count(CASE WHEN gap > 0.01 AND gap < 1 THEN 1 END) AS n_other FROM g GROUP BY 1")
def agreement_rates(s, d):
    k, p = F.col("l_orderkey") % 9, F.col("l_extendedprice")
    a = table(s, d, "lineitem").select(F.col("l_returnflag").alias("f"), p.alias("b"), F.when(k == 0, -p).when(k == 1, p * 100).when(k == 2, p * 1.03).when(k == 3, p * 1.3).when(k != 4, p).alias("a"))
    r = R.agreement(a, ["f"], "a", "b")
    return r.withColumns({c: F.round(c, 6) for c in ("within_near", "within_far")})


@book.add("SELECT o_orderstatus, round(avg(CASE o_orderpriority[1:1] WHEN '1' THEN 1.0 WHEN '2' THEN 0.0 END), 6) AS accuracy, count(CASE WHEN o_orderpriority[1:1] IN ('1', '2') THEN 1 END) AS n_marked FROM orders GROUP BY 1")
def accuracy_by_group(s, d):
    p = F.substring("o_orderpriority", 1, 1)
    o = table(s, d, "orders").select("o_orderstatus", F.when(p == "1", " y ").when(p == "2", "N").otherwise("?").alias("mark"))
    return R.accuracy(o, ["o_orderstatus"], "mark").withColumn("accuracy", F.round("accuracy", 6))


@book.add("SELECT feature, quality, count(*) AS n, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median, round(avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END), 6) AS share_positive FROM (SELECT quality, unnest(['n_chars', 'toxic']) AS feature, unnest([CAST(n_chars AS DOUBLE), CAST(toxic AS DOUBLE)]) AS x FROM documents d JOIN labels l ON l.doc_id = d.doc_id) WHERE x IS NOT NULL GROUP BY 1, 2")
def class_summary(s, d):
    r = R.class_summary(table(s, d, "documents").drop("text").join(table(s, d, "labels"), "doc_id"), "quality", ["n_chars", "toxic"])
    return r.select("feature", "quality", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "share_positive")])


@book.add("SELECT feature, point, round(quantile_cont(x, 0.01) * CASE WHEN point = 0.01 THEN 1 ELSE 0 END + quantile_cont(x, 0.5) * CASE WHEN point = 0.5 THEN 1 ELSE 0 END + quantile_cont(x, 0.99) * CASE WHEN point = 0.99 THEN 1 ELSE 0 END, 4) AS value FROM (SELECT unnest(['l_quantity', 'l_extendedprice']) AS feature, unnest([l_quantity, l_extendedprice]) AS x FROM lineitem), (SELECT unnest([CAST(0.01 AS DOUBLE), 0.5, 0.99]) AS point) GROUP BY 1, 2")
def quantile_table(s, d):
    return R.quantile_table(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice"], (0.01, 0.5, 0.99)).withColumn("value", F.round("value", 4))


@book.add(f"WITH x AS (SELECT conv_id, turn, unnest({sql_sentences()}) AS part, unnest(range(len({sql_sentences()}))) AS pos FROM conversations), r AS (SELECT conv_id * 1000 + turn AS k, CAST(pos AS INTEGER) AS pos, len({sql_words('part')}) AS weight, row_number() OVER (PARTITION BY conv_id, turn ORDER BY len({sql_words('part')}) DESC, pos) AS rank FROM x) SELECT k, rank, pos, weight FROM r WHERE rank <= 3", rank="INTEGER")
def top_sentences(s, d):
    c = table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), X.sentences(X.as_text("text")).alias("parts"))
    return R.top_parts(c, "k", "parts", lambda p: F.size(X.words(p)).cast("long")).select("k", "rank", "pos", "weight")


@book.add("SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_groups, 0 AS n_split FROM orders", n_split="BIGINT")
def group_folds(s, d):
    o = R.group_folds(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey")
    split = R.split_groups(o, "o_custkey", "fold").agg(F.count(F.lit(1)).alias("n_split"))
    return o.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("o_custkey").alias("n_groups")).crossJoin(split)


@book.add("SELECT c_mktsegment, least(count(*), 20) AS n FROM customer GROUP BY 1")
def stratified_sample(s, d):
    return R.stratified(table(s, d, "customer"), "c_mktsegment", "c_custkey", 20).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@book.add("SELECT e.n AS encoder, s.n AS seeds, b AS blend FROM (SELECT unnest(['a', 'b', 'c']) AS n) e, (SELECT CAST(unnest([1, 3, 7]) AS BIGINT) AS n) s, (SELECT unnest([true, false]) AS b)")
def configuration_grid(s, d):
    return R.grid(s.createDataFrame([("a",), ("b",), ("c",)], "encoder string"), s.createDataFrame([(1,), (3,), (7,)], "seeds long"), s.createDataFrame([(True,), (False,)], "blend boolean"))


@book.add(r"SELECT conv_id, turn, len(list_filter(list_transform(regexp_split_to_array(text, '[.;]+'), lambda c: trim(regexp_replace(c, '[ \t\r\n\f\v]+', ' ', 'g'))), lambda c: regexp_matches(c, '(?i)the [a-z]+'))) AS n_quotes FROM conversations")
def evidence_quotes(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.size(R.quotes(F.col("text"), "the [a-z]+")).cast("long").alias("n_quotes"))


@book.add(None)
def table_checksum(s, d):
    return R.checksum(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_extendedprice"])


@book.add(None)
def permutation_importance(s, d):
    rows = table(s, d, "documents").drop("text").join(table(s, d, "labels"), "doc_id").select("doc_id", "quality", "n_chars", "toxic")
    return R.importance(rows, "doc_id", "quality", lambda df: F.col("n_chars") - 500 * F.col("toxic"), {"length": ["n_chars"], "flags": ["toxic"]})


@book.add(None)
def percentile_bands(s, d):
    rows = table(s, d, "documents").drop("text").join(table(s, d, "labels"), "doc_id").select("doc_id", "quality", F.col("n_chars").cast("double").alias("a"), (F.col("n_chars") % 97).cast("double").alias("b"))
    return R.blend_percentiles(rows, rows.where("quality = 1"), "doc_id", ["a", "b"], [("high", 0.75), ("middle", 0.4), ("low", 0.0)])


QUERIES, ORACLES = book.queries, book.oracles
