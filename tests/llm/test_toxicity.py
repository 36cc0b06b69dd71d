import zlib

import pytest

from ledgerloom.llm import toxicity


@pytest.fixture(scope="module")
def made(spark):
    """Texts of ten words; the toxic ones have two of two insults or words of one stem."""
    import random

    random.seed(5)
    plain = [f"{a}{b}" for a in "ka lo mi ne pu ra so ti".split() for b in "ban dor fel gim hus".split()]
    docs, labels = [], []
    for i in range(1200):
        words = [random.choice(plain) for _ in range(12)]
        toxic = i % 8 == 0
        if toxic:
            for p in random.sample(range(12), 2):
                words[p] = random.choice(["grobnik", "snerf", "zuxx" + random.choice(plain)])
        docs.append((i, " ".join(words) + "."))
        labels.append((i, int(toxic), 1))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_held_out_texts_are_told_apart(made):
    docs, labels = made
    got = toxicity.report(docs, labels).collect()
    assert len(got) == 1200
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.3)
    wrong = sum(r["predicted"] != (r["doc_id"] % 8 == 0) for r in got if r["held_out"])
    assert wrong <= 3


def test_held_out_labels_teach_nothing(made):
    from pyspark.sql import functions as F

    docs, labels = made
    flipped = labels.withColumn("toxic", F.when(toxicity.crc_remainder("doc_id", 4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(toxicity.report(docs, labels).collect()) == sorted(toxicity.report(docs, flipped).collect())


def test_clauses_have_readings():
    g = toxicity.Grammar({"snerf$": 5.0, "zuxx": 3.0}, {"hurt": 2.5})
    assert g.clauses("A snerf. Fine here.") == [(toxicity.PLAIN, 5.0, 1)]
    assert g.clauses("You zuxxban snerf!")[0] == (toxicity.AIMED, 8.0, 2)
    assert g.clauses("it is not a snerf")[0][0] == toxicity.NEGATED
    assert g.clauses("not at all today but then a snerf")[0][0] == toxicity.PLAIN
    assert g.clauses("Bob said snerf")[0][0] == toxicity.REPORTED
    assert g.clauses("I will hurt you")[0] == (toxicity.THREATENED, 2.5, 0)
    assert g.clauses("We burn you, snerf")[0] == (toxicity.THREATENED, 6.0, 1)
    assert g.clauses("fire can burn. You rest") == [] and g.clauses("snerfs") == [] and g.clauses("") == []


def brute_clause(words, stems):
    """One clause word by word, by the rules alone: (reading, insults' weight, threats, insults), or None."""
    left = weight = threats = hits = negated = 0
    aimed = told = False
    for w in words:
        at = max((stems[s] for s in stems if (w == s[:-1] if s.endswith("$") else w.startswith(s))), default=0)
        fixed = [w in toxicity.NEGATION, w in toxicity.THREAT, w in toxicity.TARGET, w in toxicity.REPORT]
        if any(fixed):
            at = 0
        if fixed[0]:
            left = toxicity.SCOPE + 1
        threats += fixed[1]
        aimed, told = aimed or fixed[2], told or fixed[3]
        if at:
            weight, hits, negated = weight + at, hits + 1, negated + (left > 0)
        left = max(0, left - 1)
    if not hits:
        return (toxicity.THREATENED, threats, 0) if threats and aimed else None
    if negated == hits:
        return toxicity.NEGATED, weight, hits
    if told:
        return toxicity.REPORTED, weight, hits
    if threats:
        return toxicity.THREATENED, weight + threats, hits
    return toxicity.AIMED if aimed else toxicity.PLAIN, weight, hits


def test_machine_equals_a_slow_reader():
    import random

    random.seed(8)
    stems = {"snerf$": 5.0, "zux": 3.0, "zuxxo": 4.0}
    g = toxicity.Grammar(stems)
    words = ["snerf", "snerfs", "zuxa", "zuxxor", "not", "never", "kill", "burn", "you", "they", "said", "wrote", "plain", "other", "tree"]
    for _ in range(3000):
        clauses = [[random.choice(words) for _ in range(random.randrange(9))] for _ in range(random.randrange(1, 4))]
        expected = [r for c in clauses if (r := brute_clause(c, stems))]
        assert g.clauses(". ".join(" ".join(c) for c in clauses)) == expected


def test_scores_do_not_depend_on_partitions(made):
    docs, labels = made
    first = {r["doc_id"]: r["score"] for r in toxicity.report(docs, labels).collect()}
    again = {r["doc_id"]: r["score"] for r in toxicity.report(docs.repartition(13, "text"), labels.orderBy("doc_id", ascending=False)).collect()}
    assert first == again


def test_copies_are_confirmed(frame):
    passage = "a passage of words that many different texts share among themselves "
    rows = [(passage + " ".join(f"{k}w{i}" for i in range(60)), k % 2) for k in range(12)]
    near = " ".join(f"n{i}" for i in range(100))
    rows += [(near, 0), (near + " end", 1), (near.upper(), 0)]
    got = toxicity._without_copies(frame(rows, "text string, toxic int")).collect()
    assert len(got) == 13 and sum(r["toxic"] for r in got) == 7


def test_edge_cases(spark, frame, made):
    _, labels = made
    rows = [(1, None), (2, ""), (2, ""), (None, "x" * 100_000), (3, "word " * 30_000)]
    got = toxicity.report(frame(rows), labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert len({r["score"] for r in toxicity.report(frame(rows), none).collect()}) == 1
    nulls = spark.createDataFrame([(1, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    assert toxicity.report(frame(rows), nulls).count() == 5 and toxicity.report(frame([]), labels).count() == 0
    wide = frame([(1, "a", 2.0, 1)], "doc_id long, text string, score double, toxic int")
    assert toxicity.report(wide, labels).columns == ["doc_id", "held_out", "score", "predicted"]
