"""Queries of identity, scale, publication and labels: operators of cohorts and documents on figures made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import cohort as K
from ledgerloom.operators import documents as D
from ledgerloom.operators import evaluation as V
from ledgerloom.operators import models
from ledgerloom.plans.base import Book, table
from ledgerloom.plans.scores import _S, _scored
from ledgerloom.sources import readers

book = Book()
_ID = "lpad(CAST(c_nationkey AS VARCHAR), 5, '0')"


@book.add(f"""
WITH f AS (SELECT c_custkey, 'L' || {_ID} || 'MH2001PLC' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS e FROM customer)
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'state_moved' WHEN 2 THEN 'same_registration' WHEN 3 THEN 'mismatch' ELSE 'none_printed' END AS status,
 CASE c_custkey % 5 WHEN 0 THEN e WHEN 1 THEN e[:6] || 'KA' || e[9:] WHEN 2 THEN 'U99999' || 'MH1990PLC' || e[16:] WHEN 3 THEN 'U99999MH1990PLC999999' END AS found FROM f
""")
def printed_ids(s, d):
    k = F.col("c_custkey")
    e = F.concat(F.lit("L"), F.lpad(F.col("c_nationkey").cast("string"), 5, "0"), F.lit("MH2001PLC"), F.lpad(k.cast("string"), 6, "0"))
    f = table(s, d, "customer").select(k, e.alias("e"))
    other = F.when(k % 5 == 0, F.col("e")).when(k % 5 == 1, F.concat(F.substring("e", 1, 6), F.lit("KA"), F.substring("e", 9, 20))).when(k % 5 == 2, F.concat(F.lit("U99999MH1990PLC"), F.substring("e", 16, 6))).when(k % 5 == 3, "U99999MH1990PLC999999").otherwise("no number")
    got = f.select(k, K.id_status(F.col("e"), F.concat(F.lit("Reg. "), F.lower(other), F.lit("; again "), other)).alias("r"))
    return got.select("c_custkey", "r.status", "r.found")


@book.add("""
WITH n AS (SELECT s_suppkey AS code, 'Firm ' || s_nationkey AS norm, CASE WHEN s_suppkey % 9 = 0 THEN 'IN9' ELSE 'INE' END AS i FROM supplier WHERE s_suppkey % 4 <> 0)
SELECT DISTINCT * FROM (SELECT a.code, b.code AS other FROM n a JOIN n b ON a.norm = b.norm AND a.code <> b.code UNION ALL SELECT code, code FROM n WHERE i = 'IN9')
""")
def other_listings(s, d):
    k = F.col("s_suppkey")
    name = F.concat(F.lit("The Firm "), F.col("s_nationkey").cast("string"), F.when(k % 2 == 0, " Ltd.").otherwise(" Limited (DVR)"))
    return K.other_listings(table(s, d, "supplier").where(k % 4 != 0).select(k.alias("code"), F.when(k % 9 == 0, "IN9").otherwise("INE").alias("isin"), name.alias("name")))


@book.add("""
WITH f AS (SELECT o_custkey AS firm_id, year(o_orderdate) AS fy, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2), g AS (SELECT firm_id, fy, v * CASE WHEN (firm_id + fy) % 11 = 0 THEN 100 ELSE 1 END AS a, v * CASE WHEN (firm_id + fy) % 13 = 0 THEN 0.01 ELSE 1 END AS b FROM f),
s AS (SELECT * FROM g WHERE abs(round(log10(a / b))) >= 1 AND abs(log10(a / b) - round(log10(a / b))) <= 0.15), p AS (SELECT firm_id, fy AS y, a AS v FROM g UNION ALL SELECT firm_id, fy, b FROM g),
m AS (SELECT s.firm_id, s.fy, list_sort(list(abs(log10(v / a)))) AS da, list_sort(list(abs(log10(v / b)))) AS db FROM s JOIN p ON p.firm_id = s.firm_id AND y <> fy GROUP BY 1, 2), u AS (SELECT firm_id, fy, da[len(da) // 2 + 1] AS da, db[len(db) // 2 + 1] AS db FROM m)
SELECT firm_id, fy, CASE WHEN da > db THEN 'figures' WHEN db > da THEN 'rivals' ELSE 'unclear' END AS side FROM u
""", fy="INTEGER")
def unit_suspects(s, d):
    f = table(s, d, "orders").groupBy(F.col("o_custkey").alias("firm_id"), F.year("o_orderdate").alias("fy")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    k = F.col("firm_id") + F.col("fy")
    return K.unit_suspects(f.select("firm_id", "fy", (F.col("v") * F.when(k % 11 == 0, 100).otherwise(1)).alias("value")), f.select("firm_id", "fy", (F.col("v") * F.when(k % 13 == 0, 0.01).otherwise(1)).alias("value")))


@book.add("""
WITH f AS (SELECT o_custkey AS firm_id, year(o_orderdate) AS fy, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2), g AS (SELECT firm_id, fy, v AS own, NULL AS later FROM f WHERE firm_id % 3 <> 0 UNION ALL SELECT firm_id, fy - 1, NULL, v FROM f), h AS (SELECT firm_id, fy, max(own) AS own, max(later) AS later FROM g GROUP BY 1, 2)
SELECT firm_id, fy, coalesce(own, later) AS value, CASE WHEN own IS NOT NULL THEN 'own_report' ELSE 'next_report' END AS source, later, coalesce(abs(own - later) / greatest(abs(own), abs(later)) > 0.01, false) AS restated FROM h
""", fy="INTEGER")
def first_published(s, d):
    f = table(s, d, "orders").groupBy(F.col("o_custkey").alias("firm_id"), F.year("o_orderdate").alias("fy")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    rest = [F.lit("total_assets").alias("field"), F.lit(0.9).alias("confidence"), F.lit("d").alias("doc_id")]
    own = f.where("firm_id % 3 <> 0").select("firm_id", "fy", "value", *rest, F.lit(True).alias("own_year"))
    later = f.select("firm_id", (F.col("fy") - 1).alias("fy"), "value", *rest, F.lit(False).alias("own_year"))
    return D.first_published(own.unionByName(later)).drop("field")


@book.add("SELECT o_orderkey, year(o_orderdate) AS fy, CASE WHEN o_orderkey % 4 >= 2 THEN year(o_orderdate) + CASE WHEN o_orderkey % 4 = 3 THEN 1 ELSE 0 END END AS report_fy, o_orderkey % 4 = 3 AS mismatch FROM orders", fy="INTEGER", report_fy="INTEGER")
def year_mentions(s, d):
    """Texts name a year four times; the check wants three mentions, of which those of every second order are too few."""
    k, y = F.col("o_orderkey"), F.year("o_orderdate")
    named = F.concat(F.lit("as at 31 March, "), (y + F.when(k % 4 == 3, 1).otherwise(0)).cast("string"), F.lit(". "))
    text = F.when(k % 4 >= 2, F.repeat(named, F.lit(4))).otherwise(F.repeat(named, F.lit(2)))
    return D.year_check(table(s, d, "orders").select(k, y.alias("fy"), text.alias("text")), "o_orderkey", "text", "fy")


@book.add("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN 2005 ELSE year(o_orderdate) + CASE o_orderkey % 4 WHEN 1 THEN -1 ELSE 0 END END AS first_year, CASE o_orderkey % 4 WHEN 3 THEN 2004 WHEN 1 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS second_year, CASE o_orderkey % 4 WHEN 3 THEN 0.4 WHEN 1 THEN 0.5 ELSE 0.95 END AS confidence FROM orders", first_year="INTEGER", second_year="INTEGER", confidence="DOUBLE")
def period_columns(s, d):
    k, y = F.col("o_orderkey"), F.year("o_orderdate")
    year = lambda c: c.cast("string")
    head = F.when(k % 4 == 3, "no years here").when(k % 4 == 1, F.concat(F.lit("Year ended "), year(y - 1), F.lit(" "), year(y))).otherwise(F.concat(F.lit("As at 31 March "), year(y), F.lit(" As at 31 March "), year(y - 1), F.lit(" 1 April "), year(y - 2)))
    text = F.concat(F.lit("Balance sheet\nprevious year figures as at 31 March 1991 and 1990 regrouped\n"), head, F.lit("\nTotal 1 2"))
    got = table(s, d, "orders").select(k, D.period_columns(text, F.lit(2005)).alias("p"))
    return got.select(k, F.get("p.years", F.lit(0)).alias("first_year"), F.get("p.years", F.lit(1)).alias("second_year"), F.col("p.confidence").cast("double").alias("confidence"))


@book.add("""
WITH f AS (SELECT o_custkey AS firm_id, year(o_orderdate) AS fy, floor(sum(o_totalprice)) AS a, floor(sum(o_totalprice) / 3) AS c FROM orders GROUP BY 1, 2), x AS (SELECT *, firm_id % 4 = 0 AS bad FROM f)
SELECT firm_id, fy, unnest(['current', 'noncurrent', 'total']) AS field, unnest([c, a - c, a]) AS value, unnest([false, false, bad]) AS swapped FROM x
""", fy="INTEGER", value="DOUBLE")
def arbitrated_figures(s, d):
    """The total of every fourth firm is wrong by a half and its rival right: the identity picks the rival."""
    f = table(s, d, "orders").groupBy(F.col("o_custkey").alias("firm_id"), F.year("o_orderdate").alias("fy")).agg(F.floor(F.sum("o_totalprice")).cast("double").alias("a"), F.floor(F.sum("o_totalprice") / 3).cast("double").alias("c"))
    bad = F.col("firm_id") % 4 == 0
    rows = [("total", F.when(bad, F.col("a") / 2).otherwise(F.col("a")), F.when(bad, F.col("a")).otherwise(F.col("a") / 2)), ("current", F.col("c"), F.lit(None).cast("double")), ("noncurrent", F.col("a") - F.col("c"), F.lit(None).cast("double"))]
    long = f.select("firm_id", "fy", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), v.alias("value"), o.alias("other_value")) for n, v, o in rows])).alias("x")).select("firm_id", "fy", "x.*")
    return D.arbitrate(long, [("total", "current", "noncurrent")])


@book.add("""
WITH r AS (SELECT CAST(c_custkey AS VARCHAR) AS pair_id, c_custkey, r AS role, CASE r WHEN 'distressed' THEN 1 ELSE 0 END AS label, y, 2019 - y AS fy FROM customer, (SELECT unnest(['distressed', 'healthy']) AS r), (SELECT unnest([0, 1, 2, 3]) AS y)),
d AS (SELECT *, NOT ((c_custkey + fy + label) % 7 = 0) AS have, make_date(fy + 0, 3, 31) + 60 AS pub FROM r), w AS (SELECT *, date_diff('day', pub, DATE '2019-08-14') AS db FROM d),
e AS (SELECT *, CASE WHEN NOT have THEN 'missing_document' WHEN db < 90 THEN 'published_within_90d_of_admission' WHEN pub >= DATE '2019-06-01' THEN 'published_after_petition' ELSE '' END AS why FROM w),
p AS (SELECT e.*, CASE WHEN e.why = '' AND e.role = 'healthy' AND x.why <> '' THEN 'pair_partner_excluded' ELSE e.why END AS w2 FROM e LEFT JOIN e x ON x.pair_id = e.pair_id AND x.fy = e.fy AND x.role = 'distressed'),
h AS (SELECT pair_id, fy, dense_rank() OVER (PARTITION BY pair_id ORDER BY fy DESC) AS k FROM (SELECT DISTINCT pair_id, fy FROM p WHERE role = 'distressed' AND w2 = ''))
SELECT p.pair_id, role, p.fy, CASE WHEN w2 = '' AND (k IS NULL OR k > 3) THEN 'beyond_n_years_before' ELSE w2 END AS exclude_reason, CASE WHEN w2 = '' AND k <= 3 THEN 't-' || k END AS horizon, label = 1 AND round_even(db / 30.44, 1) <= 12 AS within_12m FROM p LEFT JOIN h ON h.pair_id = p.pair_id AND h.fy = p.fy
""", fy="INTEGER")
def labelled_sample(s, d):
    c = table(s, d, "customer")
    k = F.col("c_custkey")
    role = F.explode(F.array(F.struct(F.lit("distressed").alias("role"), F.lit(1).alias("label")), F.struct(F.lit("healthy").alias("role"), F.lit(0).alias("label")))).alias("x")
    cohort = c.select(k.cast("string").alias("pair_id"), k, role).select("pair_id", F.concat(F.col("pair_id"), F.lit("-"), F.col("x.role")).alias("firm_id"), "x.role", "x.label", F.lit("2019-08-14").cast("date").alias("reference_date"))
    frame = K.sample_frame(cohort)
    docs = frame.where((F.col("pair_id").cast("long") + F.col("fy") + F.col("label")) % 7 != 0).select("doc_id", F.lit("x").alias("local_path"), F.lit(None).cast("date").alias("pub_date"), F.lit(False).alias("wrong_year"))
    petitions = cohort.select("pair_id", F.lit("2019-06-01").cast("date").alias("petition_date"))
    return K.assign_labels(frame, docs, petitions).select("pair_id", "role", "fy", "exclude_reason", "horizon", "within_12m")


@book.add("SELECT s_suppkey AS firm_id, CAST(2019 AS BIGINT) AS fy, unnest(['revenue', 'total_assets', 'pbt']) AS field, round(unnest([s_acctbal + 2000.0, s_acctbal + 5000.0, s_suppkey * -1.0]), 6) AS value_cr FROM supplier WHERE s_suppkey % 10 <> 0")
def xbrl_filings(s, d):
    """Filings printed from suppliers: a quarter and a part of the firm stand beside the year; every tenth cannot be read."""
    ctx = "<context id='Y'><period><startDate>2018-04-01</startDate><endDate>2019-03-31</endDate></period></context><context id='Q'><period><startDate>2019-01-01</startDate><endDate>2019-03-31</endDate></period></context><context id='I'><period><instant>2019-03-31</instant></period></context><context id='P'><period><instant>2019-03-31</instant></period><scenario><explicitMember>x</explicitMember></scenario></context><unit id='R'><measure>iso4217:INR</measure></unit>"
    fact = lambda tag, c, v: F.concat(F.lit(f"<{tag} contextRef='{c}' unitRef='R'>"), F.format_string("%.2f", v), F.lit(f"</{tag}>"))
    crore = lambda v: (v * 1e7).cast("double")
    a, k = F.col("s_acctbal"), F.col("s_suppkey")
    xml = F.concat(F.lit("<xbrl>" + ctx), fact("RevenueFromOperations", "Y", crore(a + 2000)), fact("RevenueFromOperations", "Q", crore(a)), fact("TotalAssets", "I", crore(a + 5000)), fact("TotalAssets", "P", crore(a)), fact("ProfitLossBeforeTax", "Y", crore(-k)), F.when(k % 10 != 0, "</xbrl>").otherwise("<broken"))
    got = readers.read_xbrl(table(s, d, "supplier").select(k.alias("firm_id"), F.lit(2019).alias("fy"), xml.alias("xml")))
    return got.where("error IS NULL").select("firm_id", "fy", "field", F.round("value_cr", 6).alias("value_cr"))


@book.add(_S + ", r AS (SELECT doc_id, fold, rank() OVER (PARTITION BY fold ORDER BY score) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY fold ORDER BY other) + (count(*) OVER (PARTITION BY fold, other) - 1) / 2.0 AS rb, count(*) OVER (PARTITION BY fold) AS n FROM k) SELECT doc_id, fold, round((ra + rb) / (2.0 * (n + 1)), 8) AS blend FROM r")
def blended_scores(s, d):
    return models.blended(_scored(s, d).where("score IS NOT NULL"), "doc_id", "fold", ["score", "other"]).select("doc_id", "fold", F.round("blend", 8).alias("blend"))


@book.add(_S + ", m AS (SELECT f.fold, median(k.score) AS mid FROM (SELECT DISTINCT fold FROM s) f JOIN k ON k.fold <> f.fold GROUP BY 1) SELECT doc_id, coalesce(score, mid) AS filled FROM s JOIN m ON m.fold = s.fold")
def median_filled(s, d):
    return models.median_filled(_scored(s, d), "fold", "score", "filled").select("doc_id", "filled")


@book.add(_S + " SELECT fold, round(avg((score / 100 - quality) * (score / 100 - quality)), 8) AS brier FROM k GROUP BY 1")
def brier_by_fold(s, d):
    return V.brier(_scored(s, d).where("score IS NOT NULL").withColumn("p", F.col("score") / 100), ["fold"], "quality", "p").withColumn("brier", F.round("brier", 8))


@book.add(None)
def capped_draw(s, d):
    return K.capped_round_robin(table(s, d, "orders").withColumn("fy", F.year("o_orderdate")), 30, "fy", "o_orderpriority", "o_orderkey", cap=8)


QUERIES, ORACLES = book.queries, book.oracles
