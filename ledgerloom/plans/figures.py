"""Queries on pseudo-statements made of orders: ratios, checks, totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import ratios as R
from ledgerloom.plans.base import Book, table

book = Book()
# A pseudo-statement of each customer: sums of its orders by priority, some of them missing or negative.
_SQL = """WITH s AS (SELECT o_custkey AS k, sum(o_totalprice) AS total_assets, sum(CASE WHEN o_orderpriority LIKE '1%' THEN o_totalprice END) AS current_assets, sum(CASE WHEN o_orderpriority LIKE '2%' THEN o_totalprice END) AS current_liabilities,
 sum(CASE WHEN o_orderpriority LIKE '3%' THEN o_totalprice END) AS inventories, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) - sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS pbt, sum(CASE WHEN o_orderpriority LIKE '4%' THEN o_totalprice END) / 10 AS finance_costs,
 sum(CASE WHEN o_orderpriority LIKE '5%' THEN o_totalprice END) AS depreciation, sum(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE -o_totalprice END) AS total_equity, sum(CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice END) AS other_equity, sum(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END) AS borrowings_long_term FROM orders GROUP BY 1)"""


def _statement(s, d):
    price = F.col("o_totalprice")
    of = lambda cond: F.sum(F.when(cond, price))
    level = lambda n: F.col("o_orderpriority").startswith(n)
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("k"))
    return o.agg(F.sum(price).alias("total_assets"), of(level("1")).alias("current_assets"), of(level("2")).alias("current_liabilities"), of(level("3")).alias("inventories"), (of(F.col("o_orderstatus") == "F") - of(F.col("o_orderstatus") == "O")).alias("pbt"), (of(level("4")) / 10).alias("finance_costs"), of(level("5")).alias("depreciation"), F.sum(F.when(F.col("o_orderkey") % 2 == 0, price).otherwise(-price)).alias("total_equity"), of(F.col("o_orderkey") % 5 == 0).alias("other_equity"), of(F.col("o_orderkey") % 3 == 0).alias("borrowings_long_term"))


_DERIVED = _SQL + """, d AS (SELECT *, pbt + finance_costs AS ebit, pbt + finance_costs + depreciation AS ebitda, current_assets - current_liabilities AS wc, total_assets - total_equity AS tl, total_assets - current_liabilities AS ce FROM s)"""


def _ratio(a, b, name):
    return f"CASE WHEN {b} > 0 THEN round(({a}) / ({b}), 6) END AS {name}, CASE WHEN ({a}) IS NULL AND {b} IS NULL THEN 'both_missing' WHEN ({a}) IS NULL THEN 'numerator_missing' WHEN {b} IS NULL THEN 'denominator_missing' WHEN {b} = 0 THEN 'denominator_zero' WHEN {b} < 0 THEN 'denominator_negative' ELSE '' END AS {name}_why"


_PARTS = {"current_ratio": ("current_assets", "current_liabilities"), "quick_ratio": ("current_assets - inventories", "current_liabilities"), "roce": ("ebit", "ce"), "debt_to_equity": ("borrowings_long_term", "total_equity"), "interest_coverage": ("ebit", "finance_costs"), "retained_earnings_to_assets": ("other_equity", "total_assets")}


@book.add(_DERIVED + " SELECT k, " + ", ".join(_ratio(a, b, n) for n, (a, b) in _PARTS.items()) + ", borrowings_long_term IS NOT NULL AS borrowings_partial, total_equity < 0 AS negative_equity, ebitda < 0 AS negative_ebitda FROM d")
def ratio_guarded(s, d):
    r = R.ratios(_statement(s, d), ["k"])
    both = [x for n in _PARTS for x in (F.round(n, 6).alias(n), F.coalesce(F.try_element_at("reasons", F.lit(n)), F.lit("")).alias(f"{n}_why"))]
    return r.select("k", *both, "borrowings_partial", "negative_equity", "negative_ebitda")


@book.add(_DERIVED + """, z AS (SELECT k, CASE WHEN wc IS NOT NULL AND other_equity IS NOT NULL AND ebit IS NOT NULL AND tl <> 0 AND total_assets > 0 THEN 6.56 * wc / total_assets + 3.26 * other_equity / total_assets + 6.72 * ebit / total_assets + 1.05 * total_equity / tl + 3.25 END AS z,
 array_to_string(list_filter([CASE WHEN wc IS NULL THEN 'x1_missing' END, CASE WHEN other_equity IS NULL THEN 'x2_missing' END, CASE WHEN ebit IS NULL THEN 'x3_missing' END, CASE WHEN tl IS NULL THEN 'x4_missing' WHEN tl = 0 THEN 'x4_denominator_zero' END], lambda x: x IS NOT NULL), ',') AS why FROM d)
SELECT k, round(z, 5) AS altman_z_em, why, CASE WHEN z - 3.25 > 2.60 THEN 'safe' WHEN z - 3.25 < 1.10 THEN 'distress' WHEN z IS NOT NULL THEN 'grey' END AS altman_zone FROM z
""")
def altman_like(s, d):
    r = R.ratios(_statement(s, d), ["k"])
    return r.select("k", F.round("altman_z_em", 5).alias("altman_z_em"), F.coalesce(F.try_element_at("reasons", F.lit("altman_z_em")), F.lit("")).alias("why"), "altman_zone")


@book.add(_SQL + """, t AS (SELECT k, CASE WHEN k % 3 = 0 THEN NULL ELSE total_assets END AS ta, current_assets AS ca, CASE WHEN k % 2 = 0 THEN total_assets - current_assets END AS nca, CASE WHEN k % 5 = 0 THEN NULL ELSE total_equity END AS te FROM s),
a AS (SELECT k, ca, te, coalesce(ta, ca + nca) AS ta, nca FROM t), b AS (SELECT k, ta, te, coalesce(nca, ta - ca) AS nca, coalesce(ca, ta - nca) AS ca FROM a), c AS (SELECT *, CAST(NULL AS DOUBLE) AS tl0 FROM b)
SELECT k, round(ta, 2) AS total_assets, round(ca, 2) AS current_assets, round(nca, 2) AS noncurrent_assets, round(te, 2) AS total_equity, round(ta - te, 2) AS total_liabilities FROM c
""")
def derive_totals(s, d):
    t = _statement(s, d).select("k", F.when(F.col("k") % 3 != 0, F.col("total_assets")).alias("total_assets"), "current_assets", F.when(F.col("k") % 2 == 0, F.col("total_assets") - F.col("current_assets")).alias("noncurrent_assets"), F.when(F.col("k") % 5 != 0, F.col("total_equity")).alias("total_equity"), F.lit(None).cast("double").alias("total_liabilities"))
    f = R.fill_totals(t)
    return f.select("k", *[F.round(c, 2).alias(c) for c in ("total_assets", "current_assets", "noncurrent_assets", "total_equity", "total_liabilities")])


@book.add(_SQL + """, p AS (SELECT *, total_assets * CASE WHEN k % 7 = 0 THEN 100 ELSE 1 END AS prev, total_assets * 0.9 AS tl, total_assets - current_assets AS nca FROM s)
SELECT k, array_to_string(list_filter([CASE WHEN abs(total_assets - (tl + total_equity)) > 0.05 * abs(total_assets) THEN 'balance_gap' END, CASE WHEN abs(total_assets - (current_assets + nca)) > 0.05 * abs(total_assets) THEN 'components_gap' END, CASE WHEN inventories > current_assets THEN 'part_exceeds_whole' END, CASE WHEN current_assets > total_assets THEN 'current_exceeds_total' END, CASE WHEN total_assets < 0 THEN 'negative_assets' END, CASE WHEN k % 7 = 0 THEN 'possible_unit_confusion' END], lambda x: x IS NOT NULL), ';') AS flags FROM p
""")
def validate_flags(s, d):
    p = _statement(s, d).withColumns({"previous_assets": F.col("total_assets") * F.when(F.col("k") % 7 == 0, 100).otherwise(1), "total_liabilities": F.col("total_assets") * 0.9, "noncurrent_assets": F.col("total_assets") - F.col("current_assets")})
    return p.select("k", R.checks().alias("flags"))


@book.add("""
WITH f AS (SELECT l_orderkey % 5 AS fold, l_extendedprice AS x FROM lineitem), b AS (SELECT g.fold, quantile_cont(f.x, 0.01) AS lo, quantile_cont(f.x, 0.99) AS hi FROM (SELECT DISTINCT fold FROM f) g JOIN f ON f.fold <> g.fold GROUP BY 1)
SELECT f.fold, count(*) AS n, count(CASE WHEN x < lo OR x > hi THEN 1 END) AS n_clipped, round(min(greatest(lo, least(hi, x))), 4) AS low, round(max(greatest(lo, least(hi, x))), 4) AS high FROM f JOIN b USING (fold) GROUP BY 1
""")
def winsorise_by_fold(s, d):
    f = table(s, d, "lineitem").select((F.col("l_orderkey") % 5).alias("fold"), F.col("l_extendedprice").alias("x"))
    w = R.winsorised(f, "fold", "x")
    return w.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") != F.col("x_w")).alias("n_clipped"), F.round(F.min("x_w"), 4).alias("low"), F.round(F.max("x_w"), 4).alias("high"))


@book.add("""
SELECT o_orderkey, CAST(round_even(greatest(0.0, least(1.0, CASE WHEN o_orderstatus = 'P' THEN 0.7 ELSE 1.0 END * CASE WHEN o_orderpriority LIKE '1%' THEN 0.9 ELSE 1.0 END * coalesce(CASE WHEN o_totalprice > 100000 THEN 0.85 END, 1.0))), 4) AS DOUBLE) AS confidence FROM orders
""")
def field_confidence(s, d):
    return table(s, d, "orders").select("o_orderkey", R.confidence(F.when(F.col("o_orderstatus") == "P", 0.7).otherwise(1.0), F.when(F.col("o_orderpriority").startswith("1"), 0.9).otherwise(1.0), F.when(F.col("o_totalprice") > 100000, 0.85)).alias("confidence"))


QUERIES, ORACLES = book.queries, book.oracles
