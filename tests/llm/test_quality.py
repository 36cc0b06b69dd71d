import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import common, quality


def test_estimate_recovers_accuracies():
    random.seed(4)
    kinds = [(0.9, 0.9, 0.1, 0.1, 0.1, 0.8, 0.1), (0.1, 0.9, 0.1, 0.1, 0.1, 0.9, 0.1), (0.02, 0.02, 0.95, 0.1, 0.95, 0.02, 0.1)]
    counts, truth = {}, {}
    for _ in range(20_000):
        good = random.random() < 0.85
        bad_votes = [0.01] * 7 if good else random.choice(kinds)
        votes = tuple(-1 if random.random() < p else random.choice([0, 1, 1, 1]) for p in bad_votes)
        counts[votes] = counts.get(votes, 0) + 1
        truth.setdefault(votes, []).append(good)
    found, _ = quality.estimate(counts)
    wrong = sum(sum(g != (found[v] >= 0.5) for g in gs) for v, gs in truth.items())
    assert wrong < 0.06 * 20_000  # some bad texts get no bad vote


def test_scores_agree_with_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = {r["doc_id"]: r["keep"] for r in quality.report(docs).collect()}
    assert len(got) == docs.count()
    good = [got[i] for i, q in labels.items() if q == 1]
    bad = [got[i] for i, q in labels.items() if q == 0]
    assert sum(good) > 0.97 * len(good) and sum(bad) < 0.15 * len(bad)


def test_edge_cases(frame):
    rows = [(1, None), (2, ""), (3, "A plain sentence of words."), (3, "A plain sentence of words."), (None, "GO!! " * 20_000), (4, "x" * 100_000)]
    got = quality.report(frame(rows)).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.report(frame([])).count() == 0
    df = frame([(1, "a b c", 9.0)], "doc_id long, text string, Quality_Score double")
    assert quality.score(df, quality.fit(df)).columns == ["doc_id", "text", "quality_score"]


def test_measures():
    m = quality.measures("AA AA AA AA BB!!")
    assert m["n"] == 5 and m["capitals"] == 1 and m["adjacent"] == 0.75 and m["symbols"] == 2 / 12
    assert quality.measures("")["n"] == 0


def slow_estimate(patterns, rounds=200):
    """The same estimate by loops over single votes."""
    k, n = len(next(iter(patterns))), sum(patterns.values())
    good = {p: (0.97, 0.5, 0.05)[min(2, p.count(-1))] for p in patterns}
    other = [[sum(c for p, c in patterns.items() if p[i] == v) + 0.5 for v in (0, 1)] for i in range(k)]
    for _ in range(rounds):
        table = {}
        for cls in (0, 1):
            for i in range(k):
                row = []
                for at, v in enumerate((-1, 0, 1)):
                    w = sum(c * (good[p] if cls else 1 - good[p]) for p, c in patterns.items() if p[i] == v) + 0.5
                    if cls:
                        w += n * (quality.RARE if v == -1 else (1 - quality.RARE) * other[i][at - 1] / sum(other[i])) * quality.PRIOR
                    row.append(w)
                table[cls, i] = [x / sum(row) for x in row]
        prior = min(0.99, max(0.01, sum(c * good[p] for p, c in patterns.items()) / n))
        new = {}
        for p in patterns:
            bad, fine = (math.log(q) + sum(math.log(table[cls, i][p[i] + 1]) for i in range(k)) for cls, q in ((0, 1 - prior), (1, prior)))
            new[p] = 1 / (1 + math.exp(max(-50.0, min(50.0, bad - fine))))
        if max(abs(new[p] - good[p]) for p in patterns) < 1e-9:
            return new
        good = new
    return good


def slow_train(rows, target, rounds=8):
    """AdaGrad on a logistic loss, weight by weight."""
    w, g = {}, {}
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            x = dict(rows[i]) | {quality.SIZE: 1.0}
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w.get(k, 0.0) * v for k, v in x.items())))))
            for k, v in x.items():
                d = (p - target[i]) * v + 1e-5 * w.get(k, 0.0)
                g[k] = g.get(k, 1e-4) + d * d
                w[k] = w.get(k, 0.0) - 0.3 * d / math.sqrt(g[k])
    return w


def test_scores_equal_a_slow_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    shapes, patterns, seen = quality._Shapes(), {}, {}
    for t in texts.values():
        v = tuple(quality.votes(quality.measures(t)))
        patterns[v] = patterns.get(v, 0) + 1
        f = quality.features(t, quality.measures(t), shapes)
        seen[t] = v, np.array(list(f), np.int16).tobytes(), np.array(list(f.values()), np.float32).tobytes()
    posterior = slow_estimate(patterns)
    rows = sorted(seen.values())
    w = slow_train([dict(zip(np.frombuffer(a, np.int16).tolist(), np.frombuffer(x, np.float32).tolist())) for _, a, x in rows], [posterior[v] for v, _, _ in rows])
    got = {r["doc_id"]: r["score"] for r in quality.report(docs).collect()}
    for i, t in texts.items():
        z = w[quality.SIZE] + sum(w.get(k, 0.0) * x for k, x in quality.features(t, quality.measures(t), shapes).items())
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), abs=1e-6)


def test_shapes_read_whole_tokens():
    shapes = quality._Shapes()
    a, b = "a1" * 200, "a1" * 200 + "!"
    found = shapes.learnt([a, b])
    assert found[a] != found[b]


def test_a_worker_holds_few_texts_at_once():
    texts = [f"{i} {'some words, ' * 200}" for i in range(8000)]  # 19 MB in one Arrow batch, as a worker gets it
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    model = quality.Model(np.zeros(quality.SIZE), 0.0, {}, None)
    whole = [quality._vote([batch]), quality._featured([batch]), quality._scores([batch.column(0)], model)]
    del texts
    for run in whole:
        tracemalloc.start()
        rows = sum(len(x) for x in run)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows in (1, 8000) and most < 8e6


def test_what_a_worker_kept_for_another_operator_is_let_go():
    made = common.hold(("codec", "a"), lambda: [1])
    assert common.hold(("codec", "a"), list) is made
    list(quality._vote([pa.RecordBatch.from_arrays([pa.array(["some text"])], ["text"])]))
    assert not common._held
    common.hold(("codec", "a"), list)
    common.hold(("codec", "b"), list)
    assert list(common._held) == [("codec", "b")]
    common.let_go()
