import corpus_pipeline as p
from ledgerloom.llm import quality, simhash, winnow

SF = "/root/testdata/sf0.001"


def test_stages_do_what_they_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.collect()
    kept = p.STAGES[0][1](spark, docs, SF)
    assert kept.schema == docs.schema
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {r["doc_id"] for r in quality.report(docs).collect() if r["keep"]}

    one = p.STAGES[1][1](spark, kept, SF)
    assert one.schema.names == docs.schema.names
    rows = {r["doc_id"]: r for r in one.collect()}
    texts = [r for r in before if r["doc_id"] in ids]
    gone = [r for r in texts if r["doc_id"] not in rows]
    for r in gone:  # each is similar to something that was there
        assert any(simhash.similar(r["text"], o["text"], 5, 0.8) for o in texts if o["doc_id"] != r["doc_id"])
    firsts = {}
    for r in sorted(texts, key=lambda r: r["doc_id"]):
        firsts.setdefault(r["text"], r["doc_id"])
    assert set(rows) <= set(firsts.values())

    clean = p.STAGES[2][1](spark, one, SF)
    index = winnow.Index([(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert {r["doc_id"] for r in clean.collect()} == {i for i, r in rows.items() if not index.find(winnow.words_of(r["text"]))[0].any()}

    safe = p.STAGES[3][1](spark, clean, SF)
    assert safe.schema.names == docs.schema.names and safe.count() == clean.count()
    assert all("@" not in r["text"] or "." not in r["text"].split("@", 1)[1][:3] for r in safe.collect() if r["text"])
    assert all(r["n_chars"] == len(r["text"]) for r in safe.collect())
    assert p.STAGES[4][1](spark, safe, SF).count() == safe.count()


def test_run_and_empty_stages(spark):
    assert p.run(spark, SF).count() > 100
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_nulls_do_not_break_stages(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "w " * 50_000, "en", "s", 1), (3, None, "en", None, 1)], spark.read.parquet(f"{SF}/documents.parquet").schema)
    assert p.STAGES[0][1](spark, docs, SF).schema == docs.schema
    for _, stage in p.STAGES[1:4]:
        docs = stage(spark, docs, SF)
    assert p.STAGES[4][1](spark, docs, SF).count() == docs.count()


def test_clashing_names_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    wide = docs.selectExpr("*", "1 AS quality", "2 AS n_hit", "'x' AS items", "3 AS node", "4 AS spans", "5 AS kind", "6 AS found")
    for _, stage in p.STAGES[:4]:
        got = stage(spark, wide, SF)
        assert got.columns == wide.columns
        for r in got.collect():
            assert (r["quality"], r["n_hit"], r["items"], r["node"], r["spans"], r["kind"], r["found"]) == (1, 2, "x", 3, 4, 5, 6)


def test_no_near_copy_is_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = p.STAGES[1][1](spark, docs, SF).collect()
    sets = [simhash._shingles(r["text"] or "", 5) for r in kept]
    for i, x in enumerate(sets):
        for y in sets[:i]:
            both = len(x & y)
            assert both < 0.8 * (len(x) + len(y) - both)
