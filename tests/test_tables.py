import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import tables as T


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect() if cols else df.collect()), key=str)


def test_latest_and_first(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, None, 5)], "k int, v string, t int")
    assert rows(T.latest_per_key(df, ["k"], "t")) == [(1, "b", 2), (2, None, 5)]
    assert rows(T.first_per_key(df, ["k"], F.col("t"), n=1)) == [(1, "a", 1), (2, None, 5)]


def test_cascade_takes_the_first_rule_and_partners_follow_one_way(spark):
    df = spark.createDataFrame([("p", 1, "distressed", None, 9), ("p", 1, "healthy", "x", 1), ("p", 2, "healthy", "x", 9), ("p", 2, "distressed", "x", 1), ("p", 3, "healthy", None, 1), ("p", 3, "distressed", "x", 1)], "pair string, fy int, role string, doc string, days int")
    r = df.withColumn("exclude_reason", T.cascade(("missing", F.col("doc").isNull()), ("late", F.col("days") > 5)))
    got = {(x["fy"], x["role"]): x["exclude_reason"] for x in T.exclude_partners(r, ["pair", "fy"], "role", "distressed", "healthy").collect()}
    assert got == {(1, "distressed"): "missing", (1, "healthy"): "pair_partner_excluded", (2, "healthy"): "late", (2, "distressed"): "", (3, "healthy"): "missing", (3, "distressed"): ""}


def test_previous_year_does_not_bridge_gaps(spark):
    df = spark.createDataFrame([(1, 2018, 5.0), (1, 2020, 7.0), (1, 2021, 9.0)], "k int, fy int, v double")
    assert rows(T.previous_year(df, ["k"], "fy", ["v"]), "fy", "previous_v") == [(2018, None), (2020, None), (2021, 7.0)]


@pytest.mark.parametrize("strict,want", [(True, 1), (False, 2)])
def test_as_of(spark, strict, want):
    left = spark.createDataFrame([(1, 5, "x"), (2, 5, "y")], "k int, t int, tag string")
    right = spark.createDataFrame([(1, 3, 1), (1, 5, 2), (1, 6, 3)], "k int, at int, v int")
    got = {r["k"]: r["v"] for r in T.as_of(left, right, ["k"], "t", "at", ["v"], strict).collect()}
    assert got == {1: want, 2: None}


def test_resolution_keeps_the_loser_and_the_gap(spark):
    df = spark.createDataFrame([(1, "b", 110.0, 1), (1, "a", 100.0, 2), (1, "a", 90.0, 3), (2, "b", 5.0, 1), (3, "c", 1.0, 1)], "k int, src string, v double, o int")
    got = {r["k"]: r for r in T.resolve(df, ["k"], "src", ["a", "b"], "v", ["o"]).collect()}
    assert (got[1]["v"], got[1]["src"], got[1]["other_value"], round(got[1]["gap"], 6)) == (100.0, "a", 110.0, round(10 / 110, 6))
    assert got[2]["v"] == 5.0 and got[2]["other_value"] is None and 3 not in got


def test_first_valid_skips_blanks(spark):
    df = spark.createDataFrame([(1, " ", "s", 0), (1, "x", "r", 1), (2, None, "s", 0)], "k int, name string, src string, o int")
    assert rows(T.first_valid(df, ["k"], ["name"], ["o"], "src")) == [(1, "x", "r|s"), (2, None, "s")]


def test_band_peers_equal_the_plain_range(spark):
    import random

    random.seed(3)
    data = [(i, i % 3, 10 ** random.uniform(0, 3)) for i in range(300)]
    df = spark.createDataFrame(data, "id int, ind int, size double")
    got = {(r["case_id"], r["peer_id"]) for r in T.band_peers(df.where("id < 30"), df.where("id >= 30"), ["ind"], "size", 0.3, "id", "id").collect()}
    assert got == {(a, b) for a, x, s in data for b, y, t in data if a < 30 <= b and x == y and 0.7 * s <= t <= 1.3 * s}


def test_greedy_takes_the_scarcest_first(spark):
    pairs = spark.createDataFrame([("g", 1, 10, 0.1), ("g", 1, 11, 0.2), ("g", 2, 10, 0.3)], "g string, case_id int, peer_id int, distance double")
    assert rows(T.greedy_pairs(pairs, "g"), "case_id", "peer_id") == [(1, 11), (2, 10)]


def test_runs_and_trapezoid(spark):
    e = spark.createDataFrame([("u", 1, "a"), ("u", 2, "a"), ("u", 3, "b"), ("u", 4, "a")], "k string, t int, v string")
    assert rows(T.runs(e, ["k"], "v", ["t"]), "run", "v", "run_start", "run_end", "n") == [(1, "a", 1, 2, 2), (2, "b", 3, 3, 1), (3, "a", 4, 4, 1)]
    w = spark.createDataFrame([("u", 0.0, 100.0), ("u", 1.0, 100.0), ("u", 3.0, 100.0), ("x", 0.0, 5.0)], "k string, t double, w double")
    assert rows(T.trapezoid(w, ["k"], "t", "w", ["t"])) == [("u", 300.0, 3), ("x", 0.0, 1)]


def test_pareto_and_choice(spark):
    df = spark.createDataFrame([("a", 1.0, 0.5), ("b", 2.0, 0.7), ("c", 2.0, 0.6), ("d", 3.0, 0.7), ("e", 1.0, 0.5)], "n string, cost double, score double")
    assert {r["n"] for r in T.pareto(df, "cost", "score").collect()} == {"a", "b", "e"}
    assert T.lowest_cost(df, "cost", "score", 0.7, 0.15, 0.05, "n").first()["n"] == "b"


def test_unit_slips(spark):
    data = [("x", y, 100.0 + y) for y in range(4)] + [("x", 4, 1.05e7), ("y", 0, 50.0), ("y", 1, 5e6), ("z", 0, None)]
    got = {(r["k"], r["fy"]): (r["power"], r["fixed"]) for r in T.unit_slips(spark.createDataFrame(data, "k string, fy int, v double"), "k", "fy", "v").collect()}
    assert got["x", 4] == (5, 105.0) and got["x", 0] == (0, 100.0) and got["y", 1] == (0, 5e6) and got["z", 0] == (0, None)


def test_horizon_upsert_and_columns(spark):
    df = spark.createDataFrame([(1, y, r) for y in (2016, 2017, 2018, 2019) for r in ("d", "h")], "pair int, fy int, role string")
    got = {(r["fy"], r["horizon"]) for r in T.horizon(df, ["pair"], "fy", F.col("role") == "d", 3).collect()}
    assert got == {(2019, "t-1"), (2018, "t-2"), (2017, "t-3"), (2016, None)}
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert rows(T.upsert(old, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert T.live_columns(spark.createDataFrame([(1, 5, None), (2, 5, None)], "a int, b int, c int")) == ["a"]
