"""Operators whose first form made too many rows, or held too much in one place: the same answers, from plans that do not."""

import random

from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import amendments as A
from ledgerloom.operators import cohort as K
from ledgerloom.operators import documents as D
from ledgerloom.operators import fuzzy as Z
from ledgerloom.operators import ratios as R
from ledgerloom.operators import shingles as S
from ledgerloom.operators import tables as T
from ledgerloom.operators import vectors as V
from ledgerloom.operators.quantiles import quantiles


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect() if cols else df.collect()), key=str)


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def sized(spark):
    """Sizes that often repeat, and some that cannot be compared."""
    random.seed(5)
    data = [(i, random.choice("xyz"), float(random.choice([100, 110, 120, 130, 1000, 1300, 77 + i % 40]))) for i in range(400)]
    odd = [(1000, None, 100.0), (1001, "x", None), (1002, "x", -5.0), (1003, "x", float("nan")), (1004, "q", 50.0)]
    df = spark.createDataFrame(data + odd, "id int, ind string, size double")
    return df.where("id % 4 = 0"), df.where("id % 4 <> 0")


def test_nearest_in_band_without_pairs(spark):
    cases, pool = sized(spark)
    pairs = T.band_peers(cases.where("NOT isnan(size)"), pool.where("NOT isnan(size)"), ["ind"], "size", 0.3, "id", "id")
    got = T.nearest_in_band(cases, pool, ["ind"], "size", 0.3, "id", "id", 3)
    assert "Join" not in plan(got)
    first = T.first_per_key(pairs, ["case_id"], F.col("distance"), F.col("peer_id"), n=3, rank="rank")
    told = got.select("case_id", F.posexplode("peers").alias("at", "p")).select("case_id", (F.col("at") + 1).alias("rank"), "p.peer_id")
    assert rows(told) == rows(first, "case_id", "rank", "peer_id")
    assert rows(got, "case_id", "n_peers") == rows(pairs.groupBy("case_id").count())


def test_greedy_band_is_greedy_pairs(spark):
    cases, pool = sized(spark)
    cases, pool = cases.where("NOT isnan(size)"), pool.where("NOT isnan(size) AND id % 3 = 0")
    pairs = T.band_peers(cases, pool, ["ind"], "size", 0.3, "id", "id")
    for k in (1, 2):
        got = T.greedy_band(cases, pool, "ind", "size", 0.3, "id", "id", k)
        assert "Join" not in plan(got)
        assert rows(got) == rows(T.greedy_pairs(pairs, "ind", k))


def test_exact_sums_do_not_depend_on_the_order(spark):
    data = [("a", 0.1), ("a", 0.2), ("a", 0.3), ("b", 0.3), ("b", 0.2), ("b", 0.1), ("c", 1e300), ("c", 1.0), ("d", 1e-20), ("e", None), ("f", float("nan"))]
    got = {r["k"]: r["s"] for r in spark.createDataFrame(data, "k string, v double").coalesce(1).groupBy("k").agg(T.exact_sum("v").alias("s")).collect()}
    assert got["a"] == got["b"] == 0.6 and got["c"] == 1e300 and got["d"] == 1e-20 and got["e"] is None and got["f"] != got["f"]


def test_arbitration_reads_groups_in_batches(spark):
    """Groups that batches cut are settled whole, and no group costs a frame of its own."""
    data = []
    for i in range(1000):
        data += [(i, 2000, "total", 50.0 if i % 4 == 0 else 100.0, 100.0 if i % 4 == 0 else 50.0), (i, 2000, "current", 30.0, None), (i, 2000, "noncurrent", 70.0, float("nan"))]
    df = spark.createDataFrame(data, "firm_id int, fy int, field string, value double, other_value double")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = D.arbitrate(df, [("total", "current", "noncurrent")])
        assert "FlatMapGroups" not in plan(got)
        assert rows(got) == sorted([(i, 2000, f, v, f == "total" and i % 4 == 0) for i in range(1000) for f, v in (("total", 100.0), ("current", 30.0), ("noncurrent", 70.0))], key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_grown_sides_are_not_sent_whole(spark):
    """Keys made of few stored bytes: every join side that grows with them is shuffled."""
    days = spark.range(50).select(F.col("id").cast("string").alias("pair_id"), F.explode(F.array(*map(F.lit, ("distressed", "healthy")))).alias("role"))
    cohort = days.select("pair_id", F.concat("pair_id", "role").alias("firm_id"), "role", (F.col("role") == "distressed").cast("int").alias("label"), F.lit("2019-08-14").cast("date").alias("reference_date"))
    frame = K.sample_frame(cohort)
    docs = frame.select("doc_id", F.lit("x").alias("local_path"), F.lit(None).cast("date").alias("pub_date"), F.lit(False).alias("wrong_year"))
    labels = K.assign_labels(frame, docs, cohort.select("pair_id", F.lit("2019-06-01").cast("date").alias("petition_date")))
    names = spark.createDataFrame([(1, "LARGE RING"), (2, "SMALL RING"), (3, "LARGE RING")], "left_id int, name string")
    right = names.select(F.col("left_id").alias("right_id"), "name").where("left_id < 3")
    for df in (labels, Z.shortlist(names, right)):
        joins = [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "BroadcastHashJoin" in x]
        assert not joins


def test_equal_names_share_a_list(spark):
    left = spark.createDataFrame([(i, ("LARGE RING", "SMALL RING", "OLD NAIL")[i % 3]) for i in range(30)], "left_id int, name string")
    right = spark.createDataFrame([(1, "LARGE RING"), (2, "SMALL RINGS"), (3, "NAIL")], "right_id int, name string")
    lists = Z.named_shortlist(left, right)
    assert lists.select("name").distinct().count() == 3
    got = rows(Z.shortlist(left, right))
    assert got == rows(left.join(lists, "name").select("left_id", "right_id", "weight")) and len({r[0] for r in got}) == 30
    best = [(r["left_id"], r["right_id"], r["rank"]) for r in Z.match(left, right, k=1).orderBy("left_id").collect()]
    assert best == [(i, i % 3 + 1, 1) for i in range(30)]


def test_wide_shares_send_a_run_once_for_a_document(spark):
    docs = [(1, "a", "x y z"), (2, "b", "x y z x y z"), (3, "c", "x y q"), (4, None, "x y"), (5, "c", "x"), (6, "d", "p x y")]
    df = spark.createDataFrame(docs, "k int, src string, t string")
    got = S.wide_shares(df, "k", "src", F.split("t", " "), 2, 4)
    assert plan(got).count("RepartitionByExpression") == 1 and "Join" not in plan(got) and "gram#" not in plan(got)
    assert sorted((r["k"], r["n_grams"], round(r["share"], 6)) for r in got.collect()) == [(1, 2, 0.5), (2, 5, 0.4), (3, 2, 0.5), (4, 1, 1.0), (6, 2, 0.5)]


def test_word_overlap_keeps_words_packed(spark):
    docs = [(1, "a", "x y x"), (2, "a", "x z"), (3, "b", "q"), (4, "a", ""), (5, "a", "z z")]
    got = S.word_overlap(spark.createDataFrame(docs, "k int, src string, t string"), "k", "src", F.filter(F.split("t", " "), lambda w: w != ""))
    assert "Generate" not in plan(got)
    assert {r["k"]: tuple(r)[1:] for r in got.collect()} == {1: (None,) * 8, 2: (2, 3, 1, 2, 3, 2, 2, 5), 3: (None,) * 8, 4: (0, 2, 0, 0, 2, 0, 0, 2), 5: (2, 0, 0, 1, 1, 0, 4, 0)}


def test_quantiles_are_exact_by_cells(spark):
    random.seed(7)
    data = [(i % 3, random.choice([random.gauss(0, 1), random.lognormvariate(0, 9), -random.lognormvariate(5, 3), 0.0, -0.0, 7.5])) for i in range(3000)]
    data += [(0, None), (4, float("nan")), (4, 1e300), (4, float("inf")), (4, float("-inf")), (4, 5e-324), (5, 2.0), (6, None)]
    df = spark.createDataFrame(data, "g int, x double")
    points = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    want = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, points))).alias("q")).collect() if r["q"]}
    said = lambda values: [str(v + 0.0) for v in values]  # noqa: E731  # zeros without a sign
    assert {g: said(q) for g, q in quantiles(df, "g", "x", points).items()} == {g: said(q) for g, q in want.items()} and len(want) == 5
    others = quantiles(df, "g", "x", points, {g: [h for h in range(6) if h != g] for g in range(3)})
    for g, got in others.items():
        assert said(got) == said(df.where(F.col("g") != g).agg(F.percentile("x", F.array(*map(F.lit, points)))).first()[0])
    w = R.winsorised(df.where("g < 3"), "g", "x")
    assert "percentile" not in plan(w).lower()


def test_other_listings_hold_no_pairs(spark):
    data = [(i, "INE", f"Firm {i % 2} Ltd") for i in range(40)] + [(0, "IN9", "Twin"), (2, "INE", "Twin Ltd"), (0, "INE", "Firm 0"), (50, "INE", ""), (51, "IN9", "Lone")]
    got = K.other_listings(spark.createDataFrame(data, "code int, isin string, name string"))
    want = {(a, b) for a in range(40) for b in range(40) if a != b and a % 2 == b % 2} | {(0, 0), (51, 51)}
    assert rows(got) == sorted(want, key=str)
    left = spark.range(5000).select(F.lit("k").alias("g"), F.col("id").alias("a"))
    dealt = T.dealt_join(left, left.select("g", F.col("a").alias("b")).where("b < 3"), "g", 100)
    assert dealt.count() == 15000 == dealt.distinct().count()


def test_group_candidates_shuffle_no_pairs(spark):
    firms = spark.createDataFrame([(i, f"GROUP00{i % 2}{'AB'[i % 3 == 0]}") for i in range(60)], "firm int, group string")
    pool = spark.createDataFrame([(i, f"GROUP00{i % 2}A") for i in range(60)], "candidate int, grp string")
    others = spark.createDataFrame([(i, j) for i in range(0, 60, 6) for j in range(i)], "firm int, other int")
    grp = lambda i: f"GROUP00{i % 2}"
    want = sorted([(i, j, "industry_prefix_8" if i % 3 == 0 else "exact_industry") for i in range(60) for j in range(60) if i != j and grp(i) == grp(j) and not (i % 6 == 0 and j < i)], key=str)
    for few in (32, 0):
        got = A.group_candidates(firms, pool, others, few=few)
        assert rows(got) == want
    easy = A.group_candidates(firms, pool, others.where("other < 5"))
    assert plan(easy).index("Union") < plan(easy).index("Join") and "__few" in plan(easy)


def test_tokens_are_worked_out_once_for_all_runs(spark):
    df = spark.createDataFrame([("a b c d",), ("a b",), (None,)], "text string")
    words = X.words(X.as_text("text"))
    got = df.select(X.grams(words, 3).alias("g"))
    assert plan(got).count("regexp_extract_all") == 1
    assert [r["g"] for r in got.collect()] == [["a b c", "b c d"], [], []]


def test_text_model_counts_terms_once_for_all_folds(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def split(text):
        seen.add(1)
        return text.split(" ")

    data = [(i, i % 3, i % 2, f"s{i % 4}", ("good fine day" if i % 2 else "bad poor day") + f" n{i}") for i in range(60)]
    docs = spark.createDataFrame(data, "doc_id int, fold int, label int, source string, text string").select("doc_id", "fold", "label", "source", split.asNondeterministic()("text").alias("tokens"))
    got = V.tfidf_oof(docs, size=64, least_firms=2).collect()
    assert len(got) == 60 and all((r["score"] > 0.5) == (r["label"] == 1) for r in got)
    assert seen.value <= 4 * 60
