import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import repair
from ledgerloom.operators import amendments as A
from ledgerloom.operators import comparisons as C
from ledgerloom.operators import fuzzy
from ledgerloom.operators import vectors as T
from ledgerloom.sources import listings as L


def test_tails():
    def area(t, df):  # Student's density summed up
        x = np.linspace(-abs(t), abs(t), 400_001)
        dens = math.gamma((df + 1) / 2) / (math.sqrt(df * math.pi) * math.gamma(df / 2)) * (1 + x * x / df) ** (-(df + 1) / 2)
        return 1 - float(((dens[1:] + dens[:-1]) / 2).sum() * (x[1] - x[0]))

    for t in (0.3, 1.7, 4.0):
        for df in (1, 2, 3, 4, 7, 10):
            assert C.t_tail(t, df) == pytest.approx(area(t, df), abs=1e-6)
    assert C.normal_tail(1.959964) == pytest.approx(0.05, abs=1e-6)


def test_signed_ranks_equal_all_signs():
    d = np.array([0.4, -1.5, 2.5, 3.1, -0.2, 0.0])
    size = np.sort(np.abs(d[d != 0]))
    ranks = {v: i + 1 for i, v in enumerate(size)}
    plus = sum(ranks[abs(v)] for v in d if v > 0)
    n, total = len(size), len(size) * (len(size) + 1) / 2
    sums = [sum(r for k, r in enumerate(range(1, n + 1)) if m >> k & 1) for m in range(2**n)]
    least = min(plus, total - plus)
    assert C.signed_rank_tail(d) == pytest.approx(min(1.0, 2 * sum(s <= least for s in sums) / 2**n))
    assert C.signed_rank_tail(np.zeros(3)) is None and 0 < C.signed_rank_tail(np.array([1.0, 1.0, -1.0, 2.0])) <= 1


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i // 2, i % 5, int(rng.random() < 0.3), float(rng.integers(0, 40)), float(rng.integers(0, 40))) for i in range(200)]
    rows = [(i, p, f, y, a + 15 * y, b + 3 * y) for i, p, f, y, a, b in rows] + [(900, 900, 0, 1, None, 1.0)]
    return spark.createDataFrame(rows, "id int, pair int, fold int, y int, a double, b double")


def test_bootstrap_by_pairs(scored):
    one = C.pair_bootstrap(scored, "pair", "fold", "y", "a", "b", 400).first()
    assert one == C.pair_bootstrap(scored.repartition(7), "pair", "fold", "y", "a", "b", 400).first()
    other = C.pair_bootstrap(scored, "pair", "fold", "y", "a", "b", 400, rows=0).first()
    assert one["point"] == pytest.approx(other["point"], abs=1e-12) and one["low"] < one["point"] < one["high"]
    assert abs(one["low"] - other["low"]) < 0.08 and abs(one["high"] - other["high"]) < 0.08 and one["share_above"] > 0.9


def test_paired_folds_and_balanced_folds(spark, scored):
    a = spark.createDataFrame([(0, 0.9), (1, 0.8), (2, 0.7), (3, None)], "fold int, m double")
    b = spark.createDataFrame([(0, 0.5), (1, 0.6), (2, 0.6), (3, 0.1)], "fold int, m double")
    r = C.paired_folds(a, b, "fold", "m").first()
    d = np.array([0.4, 0.2, 0.1])
    t = d.mean() / (d.std(ddof=1) / math.sqrt(3))
    assert (r["n_folds"], r["wins"]) == (3, 3) and r["t"] == pytest.approx(t) and r["t_p"] == pytest.approx(C.t_tail(t, 2)) and r["wilcoxon_p"] == 0.25
    sizes = {}
    for row in scored.join(C.balanced_folds(scored, "pair").withColumnRenamed("fold", "own"), "pair").groupBy("own").count().collect():
        sizes[row["own"]] = row["count"]
    assert len(sizes) == 5 and max(sizes.values()) - min(sizes.values()) <= 6
    assert C.with_tail(C.rank_sums(scored, ["fold"], "y", "a")).where("p < 0 OR p > 1").count() == 0


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "c string").select(column.alias("r")).first()["r"]


def test_repaired_text(spark):
    c = F.col("c")
    assert one(spark, repair.page_text(c), " ﬁne­ly “said” —  so\n \n\n\nend ") == 'finely "said" - so\n\nend'
    assert one(spark, repair.plain_signs(c), None) is None
    assert one(spark, repair.rejoined(c), "the modi fied certifi cation of fi nes") == "the modi fied certification of fi nes"
    assert one(spark, repair.undoubled(c), "Result Result: result of trade of trade!") == "result of trade"
    assert one(spark, repair.numbers_as_zero(c), "Rose 1,234.50 in 2019") == "rose  0  in  0 "
    assert one(spark, repair.sentence_key(c), " In 2019, sales ROSE. ") == "in  sales rose"
    assert one(spark, repair.code_text(c), "4321.0") == "4321" and one(spark, repair.code_text(c), "4310") == "4310"


def test_log_bodies(spark):
    log = spark.createDataFrame([("7", 200, '[{"Quarter":"Standalone-Mar-19;MC2018-2019;101.50;A","stand_xbrl_link":"/x.xml","Filing_Date_Time":"2019-05-01T10:00:00"},{"Quarter":"odd","conso_xbrl_link":"/dir/","Revised_Date_Time":"--"}]'), ("8", 404, "[{}]"), ("9", 200, None), ("9", 200, "{broken")], "key string, http int, body string")
    got = sorted(L.result_archive(log, "https://b.example").collect(), key=str)
    assert len(got) == 2
    first = next(r for r in got if r["fy"])
    assert (first["nature"], first["month"], first["period_kind"], first["fy"], first["url"]) == ("standalone", "Mar", "MC", 2019, "https://b.example/x.xml") and first["filed_at"].day == 1
    assert next(r for r in got if r["fy"] is None)["url"] is None
    assert L.full_year_filings(L.result_archive(log, "")).count() == 1
    links = spark.createDataFrame([("1", 200, '{"Table":[{"PDFDownload":"https:\\\\\\\\h//a//b.PDF","Year":"2018"},{"PDFDownload":"c.htm","Year":"x"}]}')], "key string, http int, body string")
    assert [(r["url"], r["fy"]) for r in L.report_links(links).collect()] == [("https://h/a/b.PDF", 2018)]


def test_stores_and_folders(spark, tmp_path):
    calls = []

    def work(df):
        calls.append(sorted(r["k"] for r in df.collect()))
        return df.withColumn("done", F.lit(True))

    path = f"file://{tmp_path}/store"
    L.resumed(spark, path, spark.createDataFrame([(1,), (2,)], "k int"), "k", work)
    assert L.resumed(spark, path, spark.createDataFrame([(2,), (3,)], "k int"), "k", work).count() == 3 and calls == [[1, 2], [3]]
    (tmp_path / "b.csv").write_text("a,v\n1,x\n2,y\n")
    (tmp_path / "a.csv").write_text("a,v\n1,x\n")
    got = sorted(map(tuple, L.with_file_stem(spark, f"file://{tmp_path}/*.csv", ["a", "v"]).collect()))
    assert got == [("1", "x", "a"), ("2", "y", "b")]
    assert L.optional_facts(spark, f"file://{tmp_path}/none.csv", "k string, value double").count() == 0
    (tmp_path / "f.txt").write_text("k,value\na,1.5\nb,none\n")
    assert L.optional_facts(spark, f"file://{tmp_path}/f.txt", "k string, value double").collect() == [("a", 1.5)]
    (tmp_path / "docs").mkdir()
    for i in (2, 1):
        (tmp_path / "docs" / f"{i}.json").write_text('{"doc_id": %d,\n "n": null}' % i)
    assert [r["doc_id"] for r in L.json_folder(spark, f"file://{tmp_path}/docs", "doc_id int, n int").collect()] == [1, 2]
    files = spark.createDataFrame([("a", b"x")], "name string, content binary")
    found, gone = L.evidence(files, spark.createDataFrame([("a",), ("z",)], "name string"))
    assert found.first()["n_bytes"] == 1 and gone.collect() == [("z",)]


def test_small_rules(spark):
    rows = spark.createDataFrame([("c", 1), ("a", 2), ("x", 3), ("b", 4)], "s string, n int")
    assert [r["s"] for r in A.in_order(rows, "s", ["b", "a", "c"]).collect()] == ["b", "a", "c", "x"]
    whole, gone = A.linked(rows.select("s"), spark.createDataFrame([("a", "u2"), ("a", "u1"), ("b", None)], "s string, url string"), ["s"], "url", F.col("url"))
    assert {r["s"]: r["url"] for r in whole.collect()} == {"a": "u1", "b": None, "c": None, "x": None} and gone.count() == 3
    old = spark.createDataFrame([], "pair_id string")
    assert [r["pair_id"] for r in A.next_ids(rows, old, "pair_id", F.col("n")).collect()] == ["P0001", "P0002", "P0003", "P0004"]
    docs = spark.createDataFrame([("d1",), ("d2",)], "doc_id string")
    kept = A.usable(spark.createDataFrame([("d1", None), ("d2", "late"), ("d3", "")], "doc_id string, exclude_reason string"), docs)
    assert [r["doc_id"] for r in kept.collect()] == ["d1"]
    votes = spark.createDataFrame([("k", "x"), ("k", "x"), ("k", "y"), ("l", None)], "k string, v string")
    assert A.majority(votes, "k", "v", 2, 0.6).collect() == [("k", "x")]


def test_shortlist_of_common_trigrams(spark):
    right = spark.createDataFrame([(1, "ALPHA")], "right_id int, name string")
    left = spark.createDataFrame([(5, "ALPHA"), (6, "ALPHB"), (7, "ZZ")], "left_id int, name string")
    assert sorted(r["left_id"] for r in fuzzy.shortlist(left, right).collect()) == [5, 6]
    every = spark.createDataFrame([(i, f"NAME {i:03d} LONG") for i in range(40)], "right_id int, name string")
    got = fuzzy.shortlist(every.toDF("left_id", "name"), every, 7)
    r = {i: set() for i in range(40)}
    import collections

    grams = {i: {f"  NAME {i:03d} LONG "[k : k + 3] for k in range(len(f"NAME {i:03d} LONG") + 1)} for i in range(40)}
    df = collections.Counter(g for s in grams.values() for g in s)
    for i in range(40):
        best = sorted((-round(sum(math.log(1 + 40 / df[g]) for g in grams[i] & grams[j]), 9), j) for j in range(40))[:7]
        r[i] = {j for _, j in best}
    found = {i: set() for i in range(40)}
    for row in got.collect():
        found[row["left_id"]].add(row["right_id"])
    assert found == r


def test_text_model_tells_words_apart(spark):
    rows = [(i, i % 3, i % 2, f"s{i % 12}", (["good", "fine"] if i % 2 else ["bad", "poor"]) + [f"w{i % 7}"]) for i in range(90)] + [(999, 0, 1, "s1", [])]
    got = T.tfidf_oof(spark.createDataFrame(rows, "doc_id int, fold int, label int, source string, tokens array<string>"), size=1 << 12, least_firms=2).collect()
    assert len(got) == 91 and all((r["score"] > 0.5) == (r["label"] == 1) for r in got if r["doc_id"] != 999)
    v = spark.createDataFrame([(1, 2000, [1.0, 0.0]), (1, 2001, [1.0, 1.0]), (1, 2003, [1.0, 1.0])], "firm int, fy int, v array<double>")
    assert [(r["fy"], round(r["cosine"], 6)) for r in T.previous_cosine(v, "firm", "fy", "v").collect()] == [(2001, round(math.sqrt(0.5), 6))]
    m = spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [3.0, 4.0], 1), (1, [9.0, 9.0], 0), (2, [1.0, 1.0], 0)], "k int, v array<double>, mask int")
    assert dict(map(tuple, T.masked_mean(m, "k", "v", "mask").collect())) == {1: [2.0, 3.0], 2: None}
