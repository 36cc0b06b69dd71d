"""Queries that read documents: printed money, statements, sections, tables, drifting vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import fiscal, money
from ledgerloom.operators import documents as D
from ledgerloom.plans.base import Book, table
from ledgerloom.sources import readers

book = Book()


@book.add("""
WITH o AS (SELECT o_orderkey, round(o_totalprice, 2) AS p FROM orders)
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE round_even(CASE o_orderkey % 6 WHEN 1 THEN -p ELSE p END * CASE o_orderkey % 6 WHEN 2 THEN 0.01 WHEN 3 THEN 1e-7 ELSE 1.0 END, 9) END AS value,
 o_orderkey % 6 = 4 AS is_nil, CASE o_orderkey % 6 WHEN 5 THEN 'multiple_numbers_in_cell' ELSE '' END AS flags FROM o
""")
def money_cells(s, d):
    p = F.round("o_totalprice", 2)
    plain = F.format_number(p, 2)
    k = (F.col("o_orderkey") % 6).cast("int")
    cell = F.when(k == 1, F.concat(F.lit("("), plain, F.lit(")"))).when(k == 2, F.concat(F.lit("₹ "), plain)).when(k == 4, "Nil").when(k == 5, F.concat(plain, F.lit(" "), plain)).otherwise(plain)
    unit = F.when(k == 2, "lakh").when(k == 3, "rupee").otherwise("crore")
    n = table(s, d, "orders").select("o_orderkey", money.parse(cell, unit).alias("n"))
    return n.select("o_orderkey", "n.value", "n.is_nil", F.array_join("n.flags", ",").alias("flags"))


@book.add("""
WITH y AS (SELECT o_custkey, year(o_orderdate) AS fy, round(sum(o_totalprice), 2) AS ta, floor(sum(o_totalprice) / 3) AS inv, floor(avg(o_totalprice)) AS pbt FROM orders GROUP BY 1, 2),
f AS (SELECT *, unnest([0, 0, 0, 1, 1]) AS back, unnest(['total_assets', 'inventories', 'pbt', 'total_assets', 'pbt']) AS field, unnest([ta, inv, -pbt, inv, ta]) AS v FROM y)
SELECT o_custkey || '_FY' || fy AS doc_id, CAST(fy - back AS INTEGER) AS fy, field, round_even(v * CASE WHEN o_custkey % 2 = 0 THEN 0.01 ELSE 1.0 END, 9) AS value, CASE WHEN o_custkey % 2 = 0 THEN 'lakh' ELSE 'crore' END AS unit, CAST(0.95 AS DOUBLE) AS confidence, back = 0 AS own_year FROM f
""")
def statement_facts(s, d):
    """Statements of each customer and year are printed to text, then read back."""
    o = table(s, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("fy")).agg(F.round(F.sum("o_totalprice"), 2).alias("ta"), F.floor(F.sum("o_totalprice") / 3).alias("inv"), F.floor(F.avg("o_totalprice")).alias("pbt"))
    cell = lambda c: F.format_number(c, 2)
    caption = F.when(F.col("o_custkey") % 2 == 0, "(All amounts in Rs. lakhs)").otherwise("(Rs. in crores)")
    text = F.concat_ws("\n", F.lit("Balance Sheet as at 31 March"), caption, F.concat(F.lit("Total assets 12 "), cell("ta"), F.lit(" "), cell("inv")), F.concat(F.lit("Inventories 4 "), cell("inv"), F.lit(" -")), F.concat(F.lit("(iii) Profit before tax ("), cell("pbt"), F.lit(") "), cell("ta")))
    pages = o.select(F.concat_ws("_FY", "o_custkey", "fy").alias("doc_id"), "fy", F.lit(1).alias("page"), text.alias("text"))
    return D.statement_facts(pages).select("doc_id", "fy", "field", "value", "unit", "confidence", "own_year")


@book.add(None)
def sections_of_documents(s, d):
    docs = table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.array(F.struct(F.lit(1).alias("page"), F.concat(F.lit("Directors' Report\n"), "text").alias("text")), F.struct(F.lit(2).alias("page"), F.concat(F.lit("Independent Auditors' Report\nIn our opinion, true and fair view.\n"), "text").alias("text"))).alias("pages"))
    got = D.segment(docs)
    return got.select("doc_id", "n_pages", F.transform("sections", lambda x: x["section"]).alias("sections"), D.opinion(F.try_element_at("texts", F.lit("auditor_report"))).alias("opinion"))


@book.add("SELECT page_id, 0 AS row, url AS host, 'see' AS label, 'https://example.org/x/' || page_id AS link FROM pages", row="INTEGER")
def html_table_rows(s, d):
    """The pages have no tables: one is put into each, after the page's own html."""
    cell = F.concat(F.lit("<table><tr><th>Host name</th><th>Link</th></tr><tr><td>"), "url", F.lit("</td><td><a href='/x/"), F.col("page_id"), F.lit("'>see</a></td></tr></table>"))
    p = table(s, d, "pages").select("page_id", F.concat(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", ""), cell).alias("html"))
    got = readers.html_rows(p, {"host": "host", "link": "link"}, "https://example.org")
    return got.select("page_id", "row", F.col("cells")["host"].alias("host"), F.col("cells")["link"].alias("label"), F.col("links")["link"].alias("link"))


@book.add("SELECT o_orderkey, CASE WHEN month(o_orderdate) > 3 THEN year(o_orderdate) + 1 ELSE year(o_orderdate) END AS fy, CASE WHEN month(o_orderdate) > 3 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS reference_fy, round_even(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') / 30.44, 1) AS months FROM orders", fy="INTEGER", reference_fy="INTEGER")
def fiscal_years(s, d):
    day = F.col("o_orderdate").cast("date")
    return table(s, d, "orders").select("o_orderkey", fiscal.fy_of(day).alias("fy"), fiscal.reference_fy(day).alias("reference_fy"), fiscal.months_between_days(F.datediff(F.lit("2002-01-01").cast("date"), day)).alias("months"))


@book.add("SELECT o_orderkey, CAST(CASE o_orderkey % 3 WHEN 2 THEN NULL WHEN 1 THEN year(o_orderdate) ELSE CASE year(o_orderdate) WHEN 1999 THEN 1900 ELSE year(o_orderdate) + 1 END END AS INTEGER) AS fy FROM orders")
def fiscal_labels(s, d):
    y = F.year("o_orderdate")
    label = F.when(F.col("o_orderkey") % 3 == 0, F.concat(y.cast("string"), F.lit("-"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Year "), y.cast("string"))).otherwise("none")
    # A span into 2000 takes the first year's century, 1999-00 gives 1900: the rule is kept as it is.
    return table(s, d, "orders").select("o_orderkey", fiscal.parse_fy(label).alias("fy"))


QUERIES, ORACLES = book.queries, book.oracles
