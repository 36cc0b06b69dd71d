"""Queries of cohort amendments, repaired text, score comparisons, term weights and log bodies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import repair, text as X
from ledgerloom.operators import amendments as A
from ledgerloom.operators import comparisons as C
from ledgerloom.operators import vectors as T
from ledgerloom.plans.base import Book, table
from ledgerloom.plans.scores import _S, _scored
from ledgerloom.plans.text import sql_words
from ledgerloom.sources import listings as L

book = Book()
# Customers stand for firms: their id has an L where the key is even, and none where it is divisible by 7.
_FIRM = "CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'L' || c_custkey ELSE 'U' || c_custkey END"


def _firms(s, d):
    k = F.col("c_custkey")
    cin = F.when(k % 7 != 0, F.concat(F.when(k % 2 == 0, "L").otherwise("U"), k.cast("string")))
    return table(s, d, "customer").select(k, cin.alias("cin"), (k % 3 == 0).alias("private_by_name"))


@book.add(f"WITH f AS (SELECT c_custkey, {_FIRM} AS cin, c_custkey % 3 = 0 AS private_by_name FROM customer) SELECT *, CASE WHEN cin LIKE 'L%' THEN 'cin_L' ELSE 'no_cin' END AS listing_evidence FROM f WHERE cin LIKE 'L%' OR (cin IS NULL AND NOT private_by_name)")
def possibly_listed(s, d):
    return A.possibly_listed(_firms(s, d))


_MATCH = "WITH m AS (SELECT o_custkey AS firm_id, o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN ' y' WHEN '2-HIGH' THEN 'N' ELSE '' END AS accept, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END AS v, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 11 AS INTEGER) AS a, CASE o_orderstatus WHEN 'F' THEN 'auto_accepted' WHEN 'O' THEN 'needs_review' ELSE 'no_match' END AS match_status FROM orders)"


def _matches(s, d):
    o = table(s, d, "orders")
    day = F.col("o_orderdate").cast("date")
    accept = F.when(F.col("o_orderpriority") == "1-URGENT", " y").when(F.col("o_orderpriority") == "2-HIGH", "N").otherwise("")
    status = F.when(F.col("o_orderstatus") == "F", "auto_accepted").when(F.col("o_orderstatus") == "O", "needs_review").otherwise("no_match")
    return o.select(F.col("o_custkey").alias("firm_id"), "o_orderkey", accept.alias("accept"), F.when(F.col("o_orderkey") % 3 == 0, day).alias("admission_date_verified"), F.date_add(day, (F.col("o_orderkey") % 11).cast("int")).alias("announcement_date"), status.alias("match_status"))


@book.add(_MATCH + ", k AS (SELECT firm_id, coalesce(v, a) AS admission_date, CASE WHEN v IS NOT NULL THEN 'verified' ELSE 'announced' END AS admission_date_source, row_number() OVER (PARTITION BY firm_id ORDER BY coalesce(v, a), a, CASE WHEN v IS NOT NULL THEN 'verified' ELSE 'announced' END) AS n FROM m WHERE upper(trim(accept)) = 'Y') SELECT firm_id, admission_date, admission_date_source FROM k WHERE n = 1")
def accepted_matches(s, d):
    return A.accepted(_matches(s, d)).select("firm_id", "admission_date", "admission_date_source")


@book.add(_MATCH + " SELECT DISTINCT firm_id FROM m GROUP BY firm_id HAVING bool_or(upper(trim(accept)) = 'Y') OR (bool_or(match_status IN ('auto_accepted', 'needs_review')) AND NOT bool_or(upper(trim(accept)) = 'N'))")
def excluded_firms(s, d):
    m = _matches(s, d)
    return A.excluded_ids(m, m)


_FACTS = "WITH f AS (SELECT o_custkey AS firm_id, year(o_orderdate) AS fy, unnest(['total_assets', 'revenue', 'pbt']) AS field, unnest([round(sum(o_totalprice), 2), round(max(o_totalprice), 2), round(min(o_totalprice), 2)]) AS value FROM orders GROUP BY 1, 2)"


def _facts(s, d):
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("firm_id"), F.year("o_orderdate").alias("fy")).agg(F.round(F.sum("o_totalprice"), 2).alias("total_assets"), F.round(F.max("o_totalprice"), 2).alias("revenue"), F.round(F.min("o_totalprice"), 2).alias("pbt"))
    return o.unpivot(["firm_id", "fy"], ["total_assets", "revenue", "pbt"], "field", "value")


@book.add(_FACTS + " SELECT * FROM f WHERE NOT (firm_id % 13 = 0) AND NOT (firm_id % 5 = 0 AND fy % 2 = 0 AND field IN ('revenue', 'pbt'))", fy="INTEGER")
def facts_without_suspects(s, d):
    f = _facts(s, d)
    return A.without_suspects(f, f.where("firm_id % 13 = 0"), f.where("firm_id % 5 = 0 AND fy % 2 = 0"), ["revenue", "pbt"]).select("firm_id", "fy", "field", "value")


@book.add("""
WITH r AS (SELECT doc_id, quality, CASE doc_id % 3 WHEN 0 THEN 't-1' WHEN 1 THEN 't-2' ELSE 't-3' END AS h, CASE WHEN doc_id % 11 <> 0 THEN (doc_id % 97) / 16.0 - 1 END AS z, (doc_id % 89) / 88.0 AS rk FROM labels), m AS (SELECT median(z) AS mid FROM r)
SELECT subset, count(*) AS n, count(CASE WHEN quality = 1 THEN 1 END) AS n_good FROM (SELECT quality, unnest([CASE WHEN true THEN 'all' END, CASE WHEN doc_id % 4 <> 0 THEN 'strict' END, h, CASE WHEN z > mid THEN 'z_above_median' END, CASE WHEN z > 2.6 THEN 'z_safe_zone' END, CASE WHEN rk <= 0.5 THEN 'ratio_model_low_risk' END]) AS subset FROM r, m) WHERE subset IS NOT NULL GROUP BY 1
""")
def subset_sizes(s, d):
    k = F.col("doc_id")
    r = table(s, d, "labels").select(k, "quality", (k % 4 != 0).alias("strict"), F.when(k % 3 == 0, "t-1").when(k % 3 == 1, "t-2").otherwise("t-3").alias("h"), F.when(k % 11 != 0, (k % 97) / 16.0 - 1).alias("z"), ((k % 89) / 88.0).alias("rk"))
    return A.subsets(r, "strict", "h", "z", "rk").groupBy("subset").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("n_good"))


@book.add("""
WITH w AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS total, round(max(o_totalprice) * (1 + o_custkey % 3), 2) AS part, (o_custkey % 4) / 200.0 AS bal FROM orders GROUP BY o_custkey), x AS (SELECT *, total > 0 AND bal <= 0.01 AND part > total * 1.05 AS over FROM w)
SELECT o_custkey, total, CASE WHEN NOT over THEN part END AS part, CASE WHEN over THEN 'seen;part_exceeds_total_dropped' ELSE 'seen' END AS flags FROM x
""")
def impossible_components(s, d):
    w = table(s, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.max("o_totalprice") * (1 + F.first(F.col("o_custkey") % 3)), 2).alias("part"))
    w = w.withColumns({"bal": (F.col("o_custkey") % 4) / 200.0, "flags": F.lit("seen")})
    return A.without_impossible(w, "total", ["part"], "bal", "flags").select("o_custkey", "total", "part", "flags")


@book.add("SELECT c_custkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def carried_metadata(s, d):
    return A.carried(table(s, d, "customer").select("c_custkey"), table(s, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", ["o_orderpriority", "o_orderstatus"], F.col("o_orderkey"))


@book.add("WITH k AS (SELECT DISTINCT o_custkey AS firm_id, year(o_orderdate) AS fy FROM orders), w AS (SELECT DISTINCT firm_id, CAST(y AS BIGINT) AS fy FROM k, (SELECT unnest([1995, 1996]) AS y)) SELECT w.firm_id, w.fy, k.fy IS NOT NULL AS found FROM w LEFT JOIN k ON k.firm_id = w.firm_id AND k.fy = w.fy", fy="INTEGER")
def expected_years(s, d):
    k = table(s, d, "orders").select(F.col("o_custkey").alias("firm_id"), F.year("o_orderdate").alias("fy")).distinct()
    want = k.select("firm_id").distinct().withColumn("fy", F.explode(F.array(F.lit(1995), F.lit(1996))))
    return A.expected(want, k.withColumn("found", F.lit(True)), ["firm_id", "fy"]).select("firm_id", "fy", F.coalesce("found", F.lit(False)).alias("found"))


@book.add("""
WITH f AS (SELECT o_custkey AS firm_id, year(o_orderdate) AS fy, count(*) AS n FROM orders GROUP BY 1, 2), l AS (SELECT d.doc_id, d.doc_id % 150 AS firm_id, CAST(1992 + d.doc_id % 7 AS BIGINT) AS fy, CASE WHEN d.doc_id % 5 = 0 THEN 'late' ELSE '' END AS reason, lang, CASE WHEN d.doc_id % 2 = 0 THEN coalesce(text, '') ELSE '' END AS text FROM documents d)
SELECT doc_id, l.firm_id, l.fy, n AS n_orders, CASE WHEN doc_id % 3 <> 0 THEN lang END AS lang, md5(text) AS text_md5, reason = '' AS strict FROM l LEFT JOIN f ON f.firm_id = l.firm_id AND f.fy = l.fy
""", fy="INTEGER")
def modelling_table(s, d):
    k = F.col("doc_id")
    docs = table(s, d, "documents")
    labels = docs.select(k, (k % 150).alias("firm_id"), (1992 + k % 7).cast("int").alias("fy"), F.when(k % 5 == 0, "late").otherwise("").alias("exclude_reason"))
    language = labels.select("doc_id", "firm_id", "fy").where("doc_id % 3 <> 0").join(docs.select("doc_id", "lang"), "doc_id")
    ratios = table(s, d, "orders").groupBy(F.col("o_custkey").alias("firm_id"), F.year("o_orderdate").alias("fy")).agg(F.count(F.lit(1)).alias("n_orders"))
    m = A.modelling_table(labels, language, ratios, docs.where("doc_id % 2 = 0").select("doc_id", "text"), ["text"])
    return m.select("doc_id", "firm_id", "fy", "n_orders", "lang", F.md5("text").alias("text_md5"), "strict")


@book.add(_MATCH + ", x AS (SELECT DISTINCT firm_id FROM m WHERE upper(trim(accept)) = 'Y') SELECT o_custkey AS firm_id, array_to_string(list_sort(list_distinct(list(year(o_orderdate)))), ',') AS years FROM orders WHERE o_custkey NOT IN (SELECT firm_id FROM x) GROUP BY 1")
def healthy_pool(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("firm_id"), F.year("o_orderdate").alias("fy"))
    return A.healthy_pool(o, A.accepted(_matches(s, d))).select("firm_id", F.array_join("years", ",").alias("years"))


@book.add("""
WITH f AS (SELECT s_suppkey AS firm, 'GROUP' || lpad(CAST(s_nationkey AS VARCHAR), 3, '0') || CASE WHEN s_suppkey % 2 = 0 THEN 'A' ELSE 'B' END || (s_suppkey % 3) AS g FROM supplier), p AS (SELECT s_suppkey AS candidate, 'GROUP' || lpad(CAST(s_nationkey AS VARCHAR), 3, '0') || 'A' || (s_suppkey % 3) AS grp FROM supplier)
SELECT firm, candidate, CASE WHEN g IN (SELECT grp FROM p) THEN 'exact_industry' ELSE 'industry_prefix_8' END AS match_quality FROM f JOIN p ON (g IN (SELECT grp FROM p) AND g = grp) OR (g NOT IN (SELECT grp FROM p) AND g[:8] = grp[:8]) WHERE firm <> candidate AND NOT (firm % 10 = 0 AND candidate = firm + 1)
""")
def group_candidates(s, d):
    sup = table(s, d, "supplier")
    base = F.concat(F.lit("GROUP"), F.lpad(F.col("s_nationkey").cast("string"), 3, "0"))
    last = (F.col("s_suppkey") % 3).cast("string")
    firms = sup.select(F.col("s_suppkey").alias("firm"), F.concat(base, F.when(F.col("s_suppkey") % 2 == 0, "A").otherwise("B"), last).alias("group"))
    pool = sup.select(F.col("s_suppkey").alias("candidate"), F.concat(base, F.lit("A"), last).alias("grp"))
    others = sup.where("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("firm"), (F.col("s_suppkey") + 1).alias("other"))
    return A.group_candidates(firms, pool, others)


@book.add("""
WITH f AS (SELECT o_custkey AS firm_id, year(o_orderdate) AS fy, o_orderkey AS doc, CASE o_orderkey % 3 WHEN 0 THEN 'own' WHEN 1 THEN 'next' ELSE 'other' END AS src FROM orders), s AS (SELECT DISTINCT firm_id, fy FROM f WHERE firm_id % 2 = 0)
SELECT firm_id, fy, arg_min(doc, CASE src WHEN 'own' THEN 0 ELSE 1000000000 END + doc) AS doc_id FROM f JOIN s USING (firm_id, fy) WHERE src IN ('own', 'next') GROUP BY 1, 2
""", fy="INTEGER")
def checked_documents(s, d):
    k = F.col("o_orderkey")
    f = table(s, d, "orders").select(F.col("o_custkey").alias("firm_id"), F.year("o_orderdate").alias("fy"), k.alias("source_doc_id"), F.when(k % 3 == 0, "own").when(k % 3 == 1, "next").otherwise("other").alias("source"), F.lit("total_assets").alias("field"))
    return A.checked_documents(f.where("firm_id % 2 = 0"), f, "total_assets", ["own", "next"])


@book.add("WITH k AS (SELECT DISTINCT o_custkey AS firm_id, year(o_orderdate) AS fy FROM orders), f AS (SELECT c_custkey AS firm_id, CAST(1993 + c_custkey % 7 AS BIGINT) AS reference_fy FROM customer) SELECT f.firm_id, reference_fy, max(fy) AS size_fy FROM f LEFT JOIN k ON k.firm_id = f.firm_id AND fy IN (reference_fy, reference_fy - 1) GROUP BY 1, 2", reference_fy="INTEGER", size_fy="INTEGER")
def size_years(s, d):
    f = table(s, d, "customer").select(F.col("c_custkey").alias("firm_id"), (1993 + F.col("c_custkey") % 7).cast("int").alias("reference_fy"))
    k = table(s, d, "orders").select(F.col("o_custkey").alias("firm_id"), F.year("o_orderdate").alias("fy"), F.col("o_totalprice").alias("total_assets"))
    return A.size_year(f, k).select("firm_id", "reference_fy", "size_fy")


@book.add("""
WITH a AS (SELECT c_custkey AS firm, c_acctbal + 2000 AS total FROM customer), p AS (SELECT 'P' || lpad(CAST(c_custkey AS VARCHAR), 4, '0') AS pair_id, c_custkey AS dd, c_custkey + 1 AS hh FROM customer WHERE c_custkey % 2 = 0),
w AS (SELECT pair_id, CASE WHEN dd % 6 = 0 THEN 'another_debtor' END AS r1, CASE WHEN dd % 10 = 0 THEN 'id_mismatch' END AS r2, CASE WHEN dd % 14 = 0 THEN 'same_company' END AS r3, CASE WHEN y.total <> 0 AND x.total <> 0 AND NOT (y.total / x.total BETWEEN 0.7 AND 1.3) THEN 'size_match_fails' END AS r4 FROM p LEFT JOIN a x ON x.firm = dd LEFT JOIN a y ON y.firm = hh)
SELECT pair_id, array_to_string(list_filter([r1, r2, r3, r4], lambda v: v IS NOT NULL), '; ') AS reason FROM w WHERE coalesce(r1, r2, r3, r4) IS NOT NULL
""")
def retired_pairs(s, d):
    c = table(s, d, "customer")
    k = F.col("c_custkey")
    pairs = c.where(k % 2 == 0).select(F.concat(F.lit("P"), F.lpad(k.cast("string"), 4, "0")).alias("pair_id"), k.alias("distressed"), (k + 1).alias("healthy"), F.lit(2000).alias("size_fy"))
    assets = c.select(k.alias("firm"), F.lit(2000).alias("fy"), (F.col("c_acctbal") + 2000).alias("total"))
    status = c.select(k.alias("firm"), F.when(k % 10 == 0, "mismatch").otherwise("same").alias("status"))
    return A.retired_pairs(pairs, c.where(k % 6 != 0).select(k.alias("firm_id")), status, c.where(k % 14 == 0).select(k.alias("firm"), (k + 1).alias("other")), assets)


@book.add("WITH o AS (SELECT max(c_custkey) AS top FROM customer) SELECT s_suppkey, 'P' || lpad(CAST(row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) + top AS VARCHAR), 6, '0') AS pair_id FROM supplier, o")
def continued_ids(s, d):
    old = table(s, d, "customer").select(F.concat(F.lit("P"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("pair_id"))
    return A.next_ids(table(s, d, "supplier").select("s_suppkey", "s_acctbal"), old, "pair_id", F.desc("s_acctbal"), F.col("s_suppkey"), width=6).select("s_suppkey", "pair_id")


@book.add("""
WITH a AS (SELECT event_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE 'L' || user_id END AS cin, 'U' || user_id AS name_norm, event_type || ' ' || user_id AS nm, CAST(ts AS DATE) AS dt FROM events WHERE event_type <> 'click'), k AS (SELECT *, coalesce(cin, 'NAME:' || name_norm) AS dk FROM a), n AS (SELECT dk, nm, min(dt) AS d0, arg_min(event_id, (dt, event_id)) AS e0 FROM k GROUP BY 1, 2),
g AS (SELECT dk, string_agg(nm, ' | ' ORDER BY d0, e0) AS all_names FROM n GROUP BY 1)
SELECT k.dk AS debtor_key, arg_min(nm, (dt, event_id)) AS corporate_debtor, min(dt) AS first_date, max(dt) AS last_date, count(*) AS n_announcements, any_value(all_names) AS all_names FROM k JOIN g ON g.dk = k.dk GROUP BY 1
""")
def debtors(s, d):
    e = table(s, d, "events")
    u = F.col("user_id").cast("string")
    a = e.select(F.col("event_id").alias("row_id"), F.when(F.col("event_type") != "click", "Corporate Insolvency Resolution").otherwise("other").alias("pa_type"), F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("L"), u)).alias("cin"), F.concat(F.lit("U"), u).alias("name_norm"), F.concat_ws(" ", "event_type", u).alias("corporate_debtor"), F.col("ts").cast("date").alias("announcement_date"), F.lit("x").alias("applicant"))
    return A.debtors(a).select("debtor_key", "corporate_debtor", "first_date", "last_date", "n_announcements", "all_names")


@book.add("WITH p AS (SELECT user_id, avg(value) AS v FROM events GROUP BY 1), k AS (SELECT v, CAST(user_id % 2 AS VARCHAR) AS level FROM p) SELECT level, count(*) AS n, round(avg(v), 6) AS value FROM (SELECT * FROM k UNION ALL SELECT v, 'all' FROM k) GROUP BY 1")
def mean_by_levels(s, d):
    e = table(s, d, "events")
    classes = e.select("user_id").distinct().withColumn("label", (F.col("user_id") % 2).cast("int"))
    return A.mean_by_levels(e, "user_id", ["value"], classes, "label").withColumn("value", F.round("value", 6))


@book.add("WITH r AS (SELECT CASE WHEN event_type LIKE 'p%' THEN 'p' WHEN event_type LIKE 'c%' THEN 'c' END AS prefix, sum(value) AS kwh FROM events GROUP BY 1) SELECT prefix, round(kwh, 4) AS kwh, round(kwh * 0.5, 4) AS co2, round((SELECT kwh FROM r WHERE prefix = 'p') / kwh, 6) AS times_less FROM r WHERE prefix IS NOT NULL")
def stage_totals(s, d):
    t = A.stage_totals(table(s, d, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("kwh")), ["p", "c"], "p", 0.5)
    return t.select("prefix", F.round("kwh", 4).alias("kwh"), F.round("co2", 4).alias("co2"), F.round("times_less", 6).alias("times_less"))


@book.add("WITH k AS (SELECT DISTINCT o_custkey AS firm_id, year(o_orderdate) AS fy FROM orders WHERE year(o_orderdate) <= 1996 + o_custkey % 3), n AS (SELECT *, row_number() OVER (PARTITION BY firm_id ORDER BY fy DESC) AS back FROM k), l AS (SELECT * FROM n WHERE back <= 3) SELECT firm_id, fy, back FROM l WHERE firm_id IN (SELECT firm_id FROM l WHERE back = 3)", fy="INTEGER", back="INTEGER")
def last_years(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("firm_id"), F.year("o_orderdate").alias("fy"))
    firms = o.select("firm_id").distinct().withColumn("reference_fy", (1996 + F.col("firm_id") % 3).cast("int"))
    return A.last_years(o, firms, 3).select("firm_id", "fy", "back")


@book.add("WITH c AS (SELECT l_orderkey, l_shipmode, count(*) AS n FROM (SELECT l_orderkey, l_returnflag AS l_shipmode FROM lineitem) GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY l_orderkey) AS al, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, l_shipmode) AS k FROM c) SELECT l_orderkey, CASE WHEN n >= 3 AND n >= 0.8 * al THEN l_shipmode END AS majority FROM r WHERE k = 1")
def majority_vote(s, d):
    return A.majority(table(s, d, "lineitem"), "l_orderkey", "l_returnflag", 3, 0.8)


@book.add("SELECT unnest(['part', 'region', 'missing']) AS name, unnest([true, true, false]) AS there, unnest([(SELECT count(*) FROM part), (SELECT count(*) FROM region), NULL]) AS n_rows")
def table_counts(s, d):
    return A.table_counts({"part": table(s, d, "part"), "region": table(s, d, "region"), "missing": None})


_SIGN = "translate(replace(replace(replace(replace(replace(coalesce(text, ''), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), '’‘“”–— ­', '''''\"\"-- ')"


@book.add("SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(" + _SIGN + r", '[ \t]+', ' ', 'g'), '\n\s*\n+', E'\n\n', 'g'), '^\s+|\s+$', '', 'g')) AS page_md5 FROM documents")
def plain_pages(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(repair.plain_signs(F.coalesce("text", F.lit("")))).alias("page_md5"))


@book.add("SELECT doc_id, md5(regexp_replace(lower(coalesce(text, '')), '[0-9][0-9,.]*', ' 0 ', 'g')) AS zeros_md5, substring(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z ]', '', 'g')), 1, 120) AS sentence_key, doc_id % 9 || '_FY' || 2000 + doc_id % 20 AS document_key, CAST(doc_id AS VARCHAR) AS code, CASE WHEN doc_id % 2 = 0 THEN 'BSE' || doc_id WHEN doc_id % 3 = 0 THEN 'NSE_x' ELSE 'ISIN_' || lang END AS firm_id FROM documents")
def keys_and_forms(s, d):
    k = F.col("doc_id")
    t = F.coalesce("text", F.lit(""))
    firm = repair.prefixed_id(("BSE", F.when(k % 2 == 0, k)), ("NSE_", F.when(k % 3 == 0, "x").otherwise(" ")), ("ISIN_", F.col("lang")))
    return table(s, d, "documents").select(k, F.md5(repair.numbers_as_zero(F.col("text"))).alias("zeros_md5"), repair.sentence_key(t).alias("sentence_key"), repair.document_key(k % 9, 2000 + k % 20).alias("document_key"), repair.code_text(k.cast("double").cast("decimal(20,1)")).alias("code"), firm.alias("firm_id"))


_RANKS = ", v AS (SELECT lang, score, sum(quality) AS pos, count(*) AS n FROM k GROUP BY 1, 2), r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS rk FROM v), s1 AS (SELECT lang, sum(pos) AS n1, sum(n) AS n, sum(pos * rk) AS r, sum(n * n * n - n) AS ties, sum(pos * score) AS a, sum((n - pos) * score) AS b FROM r GROUP BY 1), u AS (SELECT *, n - n1 AS n0, r - n1 * (n1 + 1) / 2.0 AS u FROM s1)"


@book.add(_S + _RANKS + " SELECT lang, CAST(n1 AS BIGINT) AS n1, CAST(n0 AS BIGINT) AS n0, CASE WHEN n1 > 0 THEN round(a / n1, 6) END AS mean_1, CASE WHEN n0 > 0 THEN round(b / n0, 6) END AS mean_0, CASE WHEN n1 * n0 > 0 THEN round(u / (n1 * n0), 8) END AS auc, CASE WHEN n1 * n0 > 0 THEN round(sign(u - n1 * n0 / 2.0) * greatest(abs(u - n1 * n0 / 2.0) - 0.5, 0) / sqrt(n1 * n0 / 12.0 * ((n + 1) - ties / (n * (n - 1)))), 6) END AS z FROM u")
def rank_sums(s, d):
    r = C.rank_sums(_scored(s, d), ["lang"], "quality", "score")
    return r.select("lang", "n1", "n0", F.round("mean_1", 6).alias("mean_1"), F.round("mean_0", 6).alias("mean_0"), F.round("auc", 8).alias("auc"), F.round("z", 6).alias("z"))


_DELONG = """, b AS (SELECT fold, quality AS y, score AS a, other AS o FROM k WHERE other IS NOT NULL), c AS (SELECT *, sum(y) OVER (PARTITION BY fold) AS n1, count(*) OVER (PARTITION BY fold) AS n,
 rank() OVER (PARTITION BY fold ORDER BY a) + (count(*) OVER (PARTITION BY fold, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY fold, y ORDER BY a) + (count(*) OVER (PARTITION BY fold, y, a) - 1) / 2.0 AS oa,
 rank() OVER (PARTITION BY fold ORDER BY o) + (count(*) OVER (PARTITION BY fold, o) - 1) / 2.0 AS rb, rank() OVER (PARTITION BY fold, y ORDER BY o) + (count(*) OVER (PARTITION BY fold, y, o) - 1) / 2.0 AS ob FROM b),
e AS (SELECT fold, y, CASE WHEN y = 1 THEN (ra - oa - rb + ob) / (n - n1) ELSE -(ra - oa - rb + ob) / n1 END AS dd FROM c), f AS (SELECT fold, avg(dd) FILTER (y = 1) AS difference, var_samp(dd) FILTER (y = 1) / count(*) FILTER (y = 1) + var_samp(dd) FILTER (y = 0) / count(*) FILTER (y = 0) AS variance FROM e GROUP BY 1)"""


@book.add(_S + _DELONG + " SELECT fold, round(difference, 8) AS difference, round(variance, 9) AS variance FROM f")
def delong_paired(s, d):
    return C.delong_paired(_scored(s, d), "fold", "quality", "score", "other").select("fold", F.round("difference", 8).alias("difference"), F.round("variance", 9).alias("variance"))


@book.add(_S + _DELONG + " SELECT round(avg(difference), 8) AS difference, round(avg(difference) / (sqrt(sum(variance)) / count(*)), 6) AS z FROM f")
def delong_stratified(s, d):
    return C.delong_stratified(_scored(s, d), "fold", "quality", "score", "other").select(F.round("difference", 8).alias("difference"), F.round("z", 6).alias("z"))


@book.add(None)
def paired_precision(s, d):
    return C.ap_differences(_scored(s, d), "fold", "quality", "score", "other")


@book.add(None)
def pair_bootstrap(s, d):
    return C.pair_bootstrap(_scored(s, d).withColumn("pair", F.floor(F.col("doc_id") / 2)), "pair", "fold", "quality", "score", "other")


@book.add("WITH g AS (SELECT count(DISTINCT source) AS n_groups, count(*) AS n FROM documents) SELECT n_groups, n, true AS whole_groups FROM g")
def balanced_folds(s, d):
    """That every group is in one fold, and no row is lost."""
    docs = table(s, d, "documents").select("doc_id", "source")
    f = C.balanced_folds(docs, "source").withColumnRenamed("source", "of")
    per = docs.join(f, F.col("source").eqNullSafe(F.col("of")), "left").groupBy("source").agg(F.count_distinct("fold").alias("folds"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n"), (F.max("folds") == 1).alias("whole_groups"))


@book.add(f"""
WITH d AS (SELECT conv_id, role, {sql_words()} AS w FROM conversations), g AS (SELECT conv_id, role, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END)) AS term FROM d),
c AS (SELECT conv_id, term, count(*) AS tf FROM g GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM c GROUP BY 1 HAVING count(*) >= 3), n AS (SELECT count(DISTINCT conv_id) AS n FROM conversations),
x AS (SELECT conv_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM c JOIN f USING (term), n), l AS (SELECT conv_id, sqrt(sum(w * w)) AS l FROM x GROUP BY 1) SELECT conv_id, term, round(w / l, 6) AS weight FROM x JOIN l USING (conv_id)
""")
def term_weights(s, d):
    t = table(s, d, "conversations").select("conv_id", X.words(X.as_text("text")).alias("tokens"))
    counted = T.terms(t, "conv_id", "tokens").groupBy("conv_id", "term").agg(F.sum("tf").alias("tf"))
    ids = t.select("conv_id").distinct()
    known = T.vocabulary(counted, "conv_id", ids.withColumn("firm", F.col("conv_id")), "firm", 3, 1)
    return T.weights(counted, known, ids.agg(F.count(F.lit(1)).alias("n")), "conv_id").withColumn("weight", F.round("weight", 6))


@book.add(None)
def tfidf_out_of_fold(s, d):
    docs = table(s, d, "documents").join(table(s, d, "labels"), "doc_id").where("quality IS NOT NULL")
    rows = docs.select("doc_id", (F.col("doc_id") % 5).cast("int").alias("fold"), F.col("quality").alias("label"), "source", X.words(repair.numbers_as_zero(F.col("text"))).alias("tokens"))
    return T.tfidf_oof(rows, least_firms=2)


@book.add("WITH t AS (SELECT label, vec_id % 3 <> 0 AS m, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings), p AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM t WHERE m GROUP BY 1, 2) SELECT label, count(*) AS width, round(sum(x), 6) AS total FROM p GROUP BY 1")
def masked_means(s, d):
    e = table(s, d, "embeddings").select("label", (F.col("vec_id") % 3 != 0).cast("int").alias("mask"), F.col("embedding").cast("array<double>").alias("v"))
    m = T.masked_mean(e, "label", "v", "mask")
    return m.select("label", F.size("mean").cast("long").alias("width"), F.round(F.aggregate("mean", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


_LOG = "WITH o AS (SELECT o_custkey, o_orderkey, year(o_orderdate) AS y FROM orders)"


def _log(s, d, body):
    return table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.lit(200).alias("http"), body.alias("body"))


@book.add(_LOG + " SELECT CAST(o_custkey AS VARCHAR) AS bse_code, y AS fy, 'https://x.example/r/' || o_orderkey || '.pdf' AS url FROM o WHERE o_orderkey % 2 = 0", fy="INTEGER")
def report_links(s, d):
    file = F.concat(F.lit("https://x.example\\\\r//"), F.col("o_orderkey"), F.when(F.col("o_orderkey") % 2 == 0, ".pdf").otherwise(".htm"))
    body = F.concat(F.lit('{"Table":[{"PDFDownload":"'), file, F.lit('","Year":"'), F.year("o_orderdate"), F.lit('"}]}'))
    return L.report_links(_log(s, d, F.replace(body, F.lit("\\\\r"), F.lit("\\\\r")))).select("bse_code", "fy", "url")


@book.add(_LOG + " , q AS (SELECT CAST(o_custkey AS VARCHAR) AS bse_code, y + 1 AS fy, min(o_orderkey) AS k FROM o WHERE o_orderkey % 3 <> 0 GROUP BY 1, 2) SELECT bse_code, fy, 'https://x.example/f/' || k AS url FROM q", fy="INTEGER")
def full_year_filings(s, d):
    y = F.year("o_orderdate")
    label = F.concat(F.when(F.col("o_orderkey") % 3 != 0, "Standalone").otherwise("Consolidated"), F.lit("-Mar-"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"), F.lit(";MC"), y.cast("string"), F.lit("-"), (y + 1).cast("string"), F.lit(";101.50;A"))
    at = F.date_format(F.timestamp_seconds(F.col("o_orderkey")), "yyyy-MM-dd'T'HH:mm:ss")
    body = F.concat(F.lit('[{"Quarter":"'), label, F.lit('","stand_xbrl_link":"/f/'), F.col("o_orderkey"), F.lit('","Filing_Date_Time":"'), at, F.lit('"}]'))
    return L.full_year_filings(L.result_archive(_log(s, d, body), "https://x.example")).select("bse_code", "fy", "url")


@book.add("SELECT DISTINCT CAST(p_size AS VARCHAR) AS isubgroup_code, 'S' || p_partkey AS symbol, CAST(p_partkey AS VARCHAR) AS bse_code FROM part WHERE p_partkey % 4 <> 0")
def traded_members(s, d):
    k = F.col("p_partkey").cast("string")
    one = F.concat(F.lit("S"), k, F.lit(",1,2,3,4,5,6,7"), F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit(","), k, F.lit(",9"))).otherwise(""))
    log = table(s, d, "part").select(F.col("p_size").cast("string").alias("key"), F.lit(200).alias("http"), F.concat(F.lit('"x$#$'), one, F.lit("|"), one, F.lit('"')).alias("body"))
    return L.traded_members(log)


@book.add("SELECT CAST(s_suppkey AS VARCHAR) AS bse_code, 'IN' || s_suppkey AS isin, CASE WHEN s_suppkey % 2 = 0 THEN n_name END AS isubgroup, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS isubgroup_code FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 5 <> 0")
def company_headers(s, d):
    sup = table(s, d, "supplier").join(F.broadcast(table(s, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # nations are 25
    k = F.col("s_suppkey")
    body = F.concat(F.lit('{"ISIN":" IN'), k, F.lit('","Group":"--","ISubGroup":"'), F.when(k % 2 == 0, F.col("n_name")).otherwise("-"), F.lit('"}'))
    log = sup.select(k.cast("string").alias("key"), F.when(k % 5 != 0, 200).otherwise(404).alias("http"), body.alias("body"))
    codes = table(s, d, "nation").select(F.concat(F.lower("n_name"), F.lit(" ")).alias("isubgroup"), F.col("n_nationkey").alias("isubgroup_code"))
    return L.company_headers(log, codes).select("bse_code", "isin", "isubgroup", "isubgroup_code")


@book.add("SELECT o_orderkey AS key, CAST(year(o_orderdate) AS INTEGER) AS fy, 'b/' || o_orderkey || '/f' || o_orderkey || '.pdf' AS url, CAST(o_orderdate AS DATE) AS pub_date FROM orders WHERE o_orderkey % 2 = 0")
def any_listing(s, d):
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    item = F.create_map(F.lit("attach"), F.concat(F.lit("f"), k.cast("string"), F.when(k % 2 == 0, ".pdf").otherwise(".doc")), F.lit("YearOf"), F.year("o_orderdate").cast("string"), F.lit("pub_dt"), day)
    return L.any_listing(table(s, d, "orders").select(k.alias("key"), item.alias("item")), "b")


QUERIES, ORACLES = book.queries, book.oracles
