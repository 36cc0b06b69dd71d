import gzip
import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import documents as D
from ledgerloom.operators import evaluation as V
from ledgerloom.operators import fuzzy, models
from ledgerloom.plans import language
from ledgerloom.operators import ratios as R
from ledgerloom.sources import readers as S
from ledgerloom.streaming import keyed


def test_short_runs_between_equal_ones_are_absorbed():
    hits = [("a", 0, "A"), ("b", 500, "B"), ("a", 520, "A2"), ("b", 600, "B2"), ("a", 610, "A3"), ("c", 900, "C")]
    assert D.merged(hits, 2000, 100) == [("a", 0, 900, "A"), ("c", 900, 2000, "C")]
    assert D.merged([], 10, 5) == []


def test_segments(spark):
    body = "text " * 100
    pages = [{"page": 1, "text": "Contents\nDirectors' Report ... 4\nIndependent Auditor's Report 9"}, {"page": 2, "text": "Directors' Report\n" + body}, {"page": 3, "text": "The auditor's report forms part of this.\nIndependent Auditor's Report\nwe give a true and fair view\n" + body}]
    df = spark.createDataFrame([("d1", pages), ("d2", [])], "doc_id string, pages array<struct<page:int,text:string>>")
    got = {r["doc_id"]: r for r in D.segment(df).collect()}
    assert [(s["section"], s["page"]) for s in got["d1"]["sections"]] == [("directors_report", 2), ("auditor_report", 3)] and got["d2"]["sections"] == []
    assert D.segment(df).where("doc_id = 'd1'").select(D.opinion(F.col("texts")["auditor_report"]).alias("o")).first()["o"] == "unmodified"


def test_year_check(spark):
    df = spark.createDataFrame([(1, "31 March 2019 " * 3 + "31st March, 2020", 2020), (2, None, 2019)], "doc_id int, t string, fy int")
    assert sorted(map(tuple, D.year_check(df, "doc_id", "t", "fy").collect())) == [(1, 2020, 2019, True), (2, 2019, None, False)]


def test_facts_are_kept_as_first_published(spark):
    def page(doc, fy, this, last):
        return (doc, "f", fy, 1, f"(Rs. in lakhs)\nTotal assets 3 {this} {last}\nInventories -")

    df = spark.createDataFrame([page("f_2019", 2019, "1,000.00", "900.00"), page("f_2020", 2020, "1,200.00", "1,100.00")], "doc_id string, firm_id string, fy int, page int, text string")
    facts = D.statement_facts(df).withColumn("firm_id", F.lit("f"))
    got = {r["fy"]: (r["value"], r["source"], r["restated"]) for r in D.first_published(facts).collect()}
    assert got == {2018: (9.0, "next_report", False), 2019: (10.0, "own_report", True), 2020: (12.0, "own_report", False)}


def test_arbitration_by_identities(spark):
    rows = [("f", 2019, "assets", 100.0, None), ("f", 2019, "equity", 4.0, 40.0), ("f", 2019, "debt", 60.0, None)]
    got = {r["field"]: (r["value"], r["swapped"]) for r in D.arbitrate(spark.createDataFrame(rows, "firm_id string, fy int, field string, value double, other_value double"), [("assets", "equity", "debt")]).collect()}
    assert got == {"assets": (100.0, False), "equity": (40.0, True), "debt": (60.0, False)}


def test_ratios_refuse_and_say_why(spark):
    df = spark.createDataFrame([(1, 10.0, 5.0, 100.0, 40.0, 8.0, 2.0, 20.0, None), (2, 10.0, 0.0, -1.0, None, None, 2.0, None, 3.0)], "k int, current_assets double, current_liabilities double, total_assets double, total_equity double, pbt double, finance_costs double, other_equity double, borrowings_long_term double")
    a, b = R.ratios(df, ["k"]).orderBy("k").collect()
    assert a["current_ratio"] == 2.0 and a["altman_z_em"] == pytest.approx(6.56 * 0.05 + 3.26 * 0.2 + 6.72 * 0.1 + 1.05 * 40 / 60 + 3.25) and a["altman_zone"] == "grey"
    assert b["current_ratio"] is None and b["reasons"]["current_ratio"] == "denominator_zero" and b["reasons"]["altman_z_em"] == "total_assets_missing_or_nonpositive"
    assert b["borrowings_partial"] and a["reasons"]["promoter_pledge"] == "pending_shareholding_filings" and b["negative_equity"] is None
    f = R.fill_totals(spark.createDataFrame([(None, 3.0, 4.0, None, 2.0)], "total_assets double, current_assets double, noncurrent_assets double, total_liabilities double, total_equity double")).first()
    assert f["total_assets"] == 7.0 and f["total_liabilities"] == 5.0 and f["derived_fields"] == ["total_assets", "total_liabilities"]


def test_evaluation_by_hand(spark):
    df = spark.createDataFrame([(0, 1, 0.9, 0), (0, 0, 0.8, 1), (0, 1, 0.7, 2), (0, 0, 0.1, 3), (0, 1, None, 4)], "fold int, y int, s double, id int")
    assert V.roc_auc(df, ["fold"], "y", "s").first()["roc_auc"] == 0.75
    assert V.average_precision(df, ["fold"], "y", "s").first()["average_precision"] == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert sorted(r["rank_norm"] for r in V.rank_norm(df, ["fold"], "s").collect() if r["rank_norm"]) == [0.2, 0.4, 0.6, 0.8]
    assert V.delong(df, "y", "s").first()["auc"] == 0.75
    assert models.median_filled(df, "fold", "s", "f").count() == 5


def test_fuzzy_name_topk_matches_every_part(spark, tmp_path):
    names = ["almond antique", "blush khaki", "cornflower drab", "dodger firebrick", "ghost honeydew", "ivory lavender", "magenta navajo", "olive peru"]
    spark.createDataFrame(list(enumerate(names, 1)), "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = language.fuzzy_name_topk(spark, str(tmp_path)).where("rank = 1").collect()
    assert sorted((r["left_id"], r["right_id"]) for r in got) == [(k, k) for k in range(1, 9)]


def test_fuzzy_match(spark):
    left = spark.createDataFrame([(1, "JAYPEE INFRATECH"), (2, "JAYPE INFRATECH"), (3, "QQQQ")], "left_id int, name string")
    right = spark.createDataFrame([(10, "INFRATECH JAYPEE"), (11, "JAYPEE CEMENT"), (12, "OTHER")], "right_id int, name string")
    got = {(r["left_id"], r["rank"]): (r["right_id"], r["status"]) for r in fuzzy.match(left, right).collect()}
    assert got[1, 1] == (10, "auto_accepted") and got[2, 1] == (10, "needs_review") and (3, 1) not in got


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n")
    assert S.read_csv(spark, str(tmp_path / "a.csv"), ["id"]).count() == 1
    with pytest.raises(ValueError, match="missing required columns"):
        S.read_csv(spark, str(tmp_path / "a.csv"), ["gone"])
    (tmp_path / "p1.jsonl").write_text('{"key":"k","http":404,"fetched_at":"1","body":""}\nnot json\n{"key":"j","http":200,"fetched_at":"1","body":"{\\"a\\":1}"}\n')
    (tmp_path / "p2.jsonl").write_text('{"key":"k","http":200,"fetched_at":"2","body":"{\\"a\\":2}"}\n')
    log = {r["key"]: r["data"]["a"] for r in S.read_log(spark, str(tmp_path / "p*.jsonl"), "a int").collect()}
    assert log == {"k": 2, "j": 1}
    (tmp_path / "t.tsv").write_text("Name\tDebtor Date\nA &amp; B &lt;x\t14-08-2019\n")
    r = S.read_tsv_export(spark, str(tmp_path / "t.tsv"), {"Debtor Date": "debtor_date"}).first()
    assert r["name"] == "A & B <x" and str(r["debtor_date"]) == "2019-08-14"
    c = spark.createDataFrame([("l12345mh2001plc123456",), ("bad",)], "c string").select(S.cin_parts(F.col("c")).alias("p")).collect()
    assert c[0]["p"]["listed"] and c[0]["p"]["year"] == 2001 and c[1]["p"] is None
    (tmp_path / "wide.csv").write_text("Word,Negative,Strong Modal\nLOSS,2009,0\nMUST,0,2011\n")
    assert sorted(map(tuple, S.read_lexicon(spark, str(tmp_path / "wide.csv")).collect())) == [("loss", "negative"), ("must", "strong_modal")]
    (tmp_path / "files" / "BSE1").mkdir(parents=True)
    (tmp_path / "files" / "BSE1" / "FY2019.pdf").write_bytes(b"%PDF")
    f = S.read_files(spark, str(tmp_path / "files")).first()
    assert (f["firm_id"], f["fy"], f["size"]) == ("BSE1", 2019, 4) and len(f["sha256"]) == 64
    df = spark.createDataFrame([(i, "t") for i in range(10)], "doc_id int, text string")
    S.write_text_parts(df, str(tmp_path / "out"), "doc_id")
    lines = [json.loads(x) for p in (tmp_path / "out").glob("*.gz") for x in gzip.open(p, "rt")]
    assert sorted(x["doc_id"] for x in lines) == list(range(10))
    assert S.write_table(df, str(tmp_path / "tab")) == 10 and S.write_table(df, str(tmp_path / "tab2"), "csv") == 10
    assert S.union_all([df, df.select("doc_id")]).count() == 20


XBRL = """<x xmlns:i="u"><i:unit id="r"><i:measure>iso4217:INR</i:measure></i:unit>
<i:context id="y"><p><startDate>2018-04-01</startDate><endDate>2019-03-31</endDate></p></i:context><i:context id="q"><p><startDate>2019-01-01</startDate><endDate>2019-03-31</endDate></p></i:context>
<i:context id="e"><p><instant>2019-03-31</instant></p></i:context><i:context id="d"><p><instant>2019-03-31</instant></p><explicitMember/></i:context>
<i:RevenueFromOperations contextRef="y" unitRef="r">35479800000</i:RevenueFromOperations><i:RevenueFromOperations contextRef="q" unitRef="r">1</i:RevenueFromOperations>
<i:Assets contextRef="e" unitRef="r">397598600000</i:Assets><i:Equity contextRef="d" unitRef="r">5</i:Equity></x>"""


def test_xbrl_and_html(spark):
    df = spark.createDataFrame([("f", 2019, XBRL), ("g", 2019, "<broken"), ("h", 2019, None)], "firm_id string, fy int, xml string")
    got = S.read_xbrl(df).collect()
    assert {(r["field"], r["value_cr"]) for r in got if not r["error"]} == {("revenue", 3547.98), ("total_assets", 39759.86)}
    assert {r["firm_id"] for r in got if r["error"]} == {"g", "h"}
    html = "<table><tr><td>no</td></tr></table><table><tr><th>Name of Debtor</th><th>Date</th></tr><tr><td><a href='x.pdf'>A  B</a></td><td>1</td></tr></table>"
    r = S.html_rows(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string"), {"debtor": "debtor", "date": "date"}, "https://e.org/d/").collect()
    assert [(x["page_id"], x["cells"], x["links"]) for x in r] == [(1, {"debtor": "A B", "date": "1"}, {"debtor": "https://e.org/d/x.pdf"})]


def test_streams(spark, tmp_path):
    src, schema = tmp_path / "in", "k int, t int, v string"
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], schema).coalesce(1).write.parquet(str(src))
    args = (str(tmp_path / "state"), ["k"], ["t"], str(tmp_path / "cp"))
    read = lambda: spark.readStream.schema(schema).parquet(str(src))
    keyed.upsert_latest(read(), *args).awaitTermination()
    spark.createDataFrame([(1, 2, "c"), (2, 0, "old")], schema).coalesce(1).write.mode("append").parquet(str(src))
    keyed.upsert_latest(read(), *args).awaitTermination()
    assert sorted(map(tuple, keyed.current(spark, args[0]).collect())) == [(1, 2, "c"), (2, 1, "b")]
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.unionByName(events).coalesce(1).write.parquet(str(tmp_path / "events"))
    ev = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    for name, df in (("w", keyed.windowed(ev(), "ts", ["event_type"], "1 day", "value")), ("o", keyed.each_once(ev(), ["event_id"], "ts"))):
        df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("w").count() > 0 and spark.table("o").count() == events.select("event_id").distinct().count()
    p = keyed.published(spark.createDataFrame([(None, "2019-03-31")], "d string, e string").selectExpr("date(d) AS d", "date(e) AS e"), "d", "e").first()
    assert str(p["d"]) == "2019-05-30" and p["d_source"] == "assumed"
