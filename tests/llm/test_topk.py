import math

import numpy as np
import pytest

from ledgerloom.llm import topk


def brute(rows, k=20, every=20):
    good = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in good if i % every == 0}:
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def run(spark, rows, **more):
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), **more)
    assert got.columns[:4] == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("spread", [0.0, 1.0, 3.0])
def test_equals_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(topk, "BUCKET", 16)
    monkeypatch.setattr(topk, "LONGEST", 20)
    rng = np.random.default_rng(int(spread))
    centres = rng.normal(size=(4, 6))
    rows = [(i, (centres[i % 4] + 0.1 * rng.normal(size=6)) * math.exp(spread * rng.normal())) for i in range(300)]
    rows = [(i, v.tolist()) for i, v in rows]
    rows += [(400, None), (401, [1.0, None]), (402, [math.nan] * 6), (403, [math.inf] * 6), (404, []), (420, [0.0] * 6), (440, [9.0]), (None, [1.0] * 6), (405, rows[7][1]), (406, rows[7][1]), (406, rows[7][1])]
    assert run(spark, rows, block=7) == brute(rows)
    assert run(spark, rows, k=3) == brute(rows, k=3)


def test_fewer_than_k_and_no_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [-1.0, 0.5])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(1, [1.0])]) == [] and run(spark, []) == []
    assert run(spark, [(20, [1.0])]) == []


def test_large_values_stay_exact(spark):
    rows = [(i, [float(10**6 * (i % 7) + i), -3.5e6]) for i in range(50)]
    assert run(spark, rows) == brute(rows)


def test_extra_columns(spark):
    df = spark.createDataFrame([(0, [1.0], "a"), (3, [2.0], "b")], "vec_id long, embedding array<double>, score string")
    assert topk.search(df).collect() == [(0, 1, 3, 64 * 128)]


def test_long_vectors_make_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_BYTES", 8 * 3000 * 2)  # two queries
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=3000).tolist()) for i in range(101)]
    assert run(spark, rows) == brute(rows)
