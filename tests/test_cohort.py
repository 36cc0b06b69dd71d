import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.operators import cohort as C
from ledgerloom.operators import review as R


def frame(spark, reference=dt.date(2019, 8, 14)):
    rows = [("P1", "A", "distressed", 1, reference), ("P1", "B", "healthy", 0, reference)]
    return C.sample_frame(spark.createDataFrame(rows, "pair_id string, firm_id string, role string, label int, reference_date date"))


def test_sample_frame(spark):
    assert sorted((r["firm_id"], r["fy"], r["fy_rank_before_reference"]) for r in frame(spark).collect()) == [(f, 2019 - k, k + 1) for f in "AB" for k in (3, 2, 1, 0)]


def labelled(spark, missing=(), dates=None, wrong=(), petition=None, review=None):
    docs = [(f"{f}_FY{y}", "x", (dates or {}).get((f, y)), (f, y) in wrong) for f in "AB" for y in range(2016, 2020) if (f, y) not in missing]
    d = spark.createDataFrame(docs, "doc_id string, local_path string, pub_date date, wrong_year boolean")
    p = spark.createDataFrame([("P1", petition)], "pair_id string, petition_date date")
    rv = spark.createDataFrame(review, "doc_id string, decision string") if review else None
    return {(r["firm_id"], r["fy"]): r for r in C.assign_labels(frame(spark), d, p, rv).collect()}


def test_a_late_report_goes_for_both_and_horizons_shift(spark):
    got = labelled(spark, dates={("A", 2019): dt.date(2019, 8, 1), ("B", 2019): dt.date(2019, 5, 1)})
    assert got["A", 2019]["exclude_reason"] == "published_within_90d_of_admission" and got["B", 2019]["exclude_reason"] == "pair_partner_excluded"
    assert [got["A", y]["horizon"] for y in (2018, 2017, 2016)] == ["t-1", "t-2", "t-3"] and got["B", 2018]["horizon"] == "t-1"
    assert got["A", 2018]["included"] and got["A", 2018]["pub_date_source"] == "assumed" and got["A", 2018]["pub_date"] == dt.date(2018, 5, 30)


def test_rules_in_order(spark):
    got = labelled(spark, missing=[("A", 2018)], wrong=[("A", 2017)], petition=dt.date(2018, 1, 1), review=[("B_FY2016", "Exclude")])
    assert got["A", 2018]["exclude_reason"] == "missing_document" and got["B", 2018]["exclude_reason"] != ""
    assert got["A", 2017]["exclude_reason"] == "report_is_for_another_year"
    assert got["A", 2019]["exclude_reason"] == "published_within_90d_of_admission"
    assert got["B", 2016]["exclude_reason"] == "leakage_review_excluded" and got["A", 2016]["exclude_reason"] == ""


def test_years_beyond_are_excluded(spark):
    early = {(f, y): dt.date(y, 5, 1) for f in "AB" for y in range(2016, 2020)}
    got = labelled(spark, dates=early)
    assert got["A", 2016]["exclude_reason"] == "beyond_n_years_before" and got["A", 2019]["horizon"] == "t-1" and got["A", 2019]["within_12m"]


def test_ids_listings_and_suspects(spark):
    e = "L12345MH2001PLC123456"
    rows = [(e, f"x {e}."), (e, "L12345DL2001PLC123456"), (e, "U99999DL1999PLC123456"), (e, "L12345MH2001PLC999999 L12345MH2001PLC999999"), (e, None)]
    got = [r["s"]["status"] for r in spark.createDataFrame(rows, "e string, t string").select(C.id_status(F.col("e"), F.col("t")).alias("s")).collect()]
    assert got == ["exact", "state_moved", "same_registration", "mismatch", "none_printed"]
    listed = spark.createDataFrame([("1", "IN1", "Foo Ltd"), ("2", "IN2", "Foo Limited"), ("3", "IN9X", "Bar")], "code string, isin string, name string")
    assert sorted(map(tuple, C.other_listings(listed).collect())) == [("1", "2"), ("2", "1"), ("3", "3")]
    a = spark.createDataFrame([("f", y, 100.0 + y) for y in range(4)] + [("f", 4, 1e4)], "firm_id string, fy int, value double")
    b = spark.createDataFrame([("f", y, 100.0 + y) for y in range(5)], "firm_id string, fy int, value double")
    assert list(map(tuple, C.unit_suspects(a, b).collect())) == [("f", 4, "figures")]


def test_capped_round_robin(spark):
    df = spark.createDataFrame([(i, 2015 + i % 3, "x" if i < 20 else f"i{i % 4}") for i in range(60)], "id int, fy int, ind string")
    got = C.capped_round_robin(df, 9, "fy", "ind", "id").collect()
    assert len(got) == 9 and max(sum(r["ind"] == i for r in got) for i in {r["ind"] for r in got}) <= 2
    assert [r["fy"] for r in sorted(got, key=lambda r: r["draw"])][:3] == [2015, 2016, 2017]


def test_review_parts(spark):
    df = spark.createDataFrame([(1, None, " x "), (2, "b", "y")], "id int, Name string, alt string")
    assert [r[0] for r in df.select(R.pick(df, "NAME", "alt", "gone")).collect()] == ["x", "b"]
    p = R.permuted(df, "id", ["alt"], 3)
    assert sorted(r["alt"] for r in p.collect()) == [" x ", "y"]
    assert R.checksum(df, ["id"]).collect() == R.checksum(df.repartition(2), ["id"]).collect()
    assert R.share_of_keys(spark.range(1000), ["id"], 0.1).count() < 200
