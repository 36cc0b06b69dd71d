import math
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import ctw, lm, packing
from ledgerloom.llm.common import crc_remainder


def slow_tree(training, depth):
    """Context-tree weighting by recursion over dictionaries."""
    counts = {}
    for t in training:
        padded = bytes([ctw.START]) * depth + t + bytes([ctw.END])
        for i in range(depth, len(padded)):
            for d in range(depth + 1):
                for b in range(8):
                    node = (padded[i - d : i], padded[i] >> (8 - b), b)
                    c = counts.setdefault(node, [0, 0])
                    c[padded[i] >> (7 - b) & 1] += 1
    children = {}
    for ctx, bits, b in counts:
        if ctx:
            children.setdefault((ctx[1:], bits, b), []).append((ctx, bits, b))

    def kt(n0, n1):
        return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.log(math.pi) - math.lgamma(n0 + n1 + 1)

    memo = {}

    def weigh(node):
        if node not in memo:
            e = kt(*counts[node])
            if len(node[0]) == depth:
                memo[node] = (e, 1.0)
            else:
                s = sum(weigh(c)[0] for c in children[node])
                both = np.logaddexp(e, s)
                memo[node] = (both - math.log(2), math.exp(e - both))
        return memo[node]

    def log10(t):
        padded, total = bytes([ctw.START]) * depth + t + bytes([ctw.END]), 0.0
        for i in range(depth, len(padded)):
            for b in range(8):
                p = None
                for d in range(depth, -1, -1):
                    node = (padded[i - d : i], padded[i] >> (8 - b), b)
                    if node in counts:
                        c = counts[node]
                        own = (c[padded[i] >> (7 - b) & 1] + 0.5) / (sum(c) + 1)
                        w = weigh(node)[1]
                        p = own if p is None else w * own + (1 - w) * p
                total += math.log10(0.5 if p is None else p)
        return total

    return log10


ROWS = [(i, t) for i, t in enumerate(["The cat sat on the mat.", "the dog sat", None, "", " \t ", "É été 42", "zzzz", "The cat sat on the mat."] * 4)] + [(3, ""), (None, "the cat")]


@pytest.mark.parametrize("size", [6 << 20, 40])
def test_scores_equal_the_slow_tree(frame, size):
    got = lm.scores(frame(ROWS), crc_remainder("doc_id", 5) == 1, size, size).collect()
    low = [(t or "").encode().lower() for _, t in ROWS]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in ROWS]
    training = [t for t, h in zip(low, held) if not h]
    count = Counter(w for t in training for w in [*t.split(), None])
    n, v = sum(count.values()), len(count)
    model = slow_tree(training, lm.DEPTH)
    want = []
    for (i, _), t, h in zip(ROWS, low, held):
        words = [*t.split(), None]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        want.append((i, h, len(words), sum(w in count for w in words), n, base, model(t)))
    found = [(*r[:5], r["base_score"], r["score"]) for r in got]
    for a, b in zip(sorted(found, key=lambda r: str(r[:5])), sorted(want, key=lambda r: str(r[:5])), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)


def test_few_buckets_and_no_table_left(spark, frame, monkeypatch):
    rows = [(i, f"text {i % 9} of some words " * (i % 5)) for i in range(60)] + [(99, "long word " * 40_000)]
    df = frame([(*r, "x") for r in rows], "doc_id long, text string, shard string")
    want = sorted(lm.scores(df, crc_remainder("doc_id", 5) == 1).collect())
    monkeypatch.setattr(packing, "BUCKETS", 3)
    got = sorted(lm.scores(df, crc_remainder("doc_id", 5) == 1, 500, 500).collect())
    assert [r[:5] for r in got] == [r[:5] for r in want] and [r["score"] for r in got] == pytest.approx([r["score"] for r in want], rel=1e-9)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("ledgerloom")]


def test_probabilities_of_all_bytes_sum_to_one():
    keys, counts = np.unique(np.concatenate([ctw.grams(t, 3) for t in [b"abracadabra", b"banana", b"\x00\xc3\xa9"]]), return_counts=True)
    tree = ctw.tree(keys, counts, 0, 3)
    for context in [b"abr", b"zzz", b"xan", b"\xfe\xfe\xfe"]:
        base = int.from_bytes(context, "big") << 8
        asked = np.arange(base, base + 256, dtype=np.uint64)
        assert (10 ** ctw.score(asked, tree)).sum() == pytest.approx(1)


def test_log_gamma():
    x = np.concatenate((np.arange(1, 400) / 2, [1e6, 3e9]))
    assert ctw.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-10)


def test_empty_tables_and_nothing_to_learn(frame):
    from pyspark.sql import functions as F

    assert lm.scores(frame([]), F.lit(True)).count() == 0
    got = lm.scores(frame([(1, "ab c", 4)], "doc_id long, text string, score int"), F.lit(True)).collect()[0]
    assert (got["n_tokens"], got["n_known"], got["train_tokens"], got["base_score"]) == (3, 0, 0, 0)
    assert got["score"] == pytest.approx(5 * 8 * math.log10(0.5))
