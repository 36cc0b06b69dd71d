import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import packing, repeats, suffixes


def brute(rows):
    first = {}
    for i, t in sorted(((i, t) for i, t in rows if i is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if i is not None and first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **sizes):
    got = repeats.remove(spark.createDataFrame(rows, "doc_id long, text string"), **sizes)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + F.get(s, 1) - F.get(s, 0))
    return sorted(map(tuple, got.select("doc_id", "n_bytes", removed, F.size("spans"), "kept_sha256").collect()), key=str)


@pytest.fixture(scope="module")
def rows(spark):
    random.seed(2)
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(80).collect()]
    texts = [t for _, t in docs]
    more = [None, "", "x" * 49, "x" * 50, "x" * 500, "ab" * 300, "ab" * 40 + "c", texts[0], "é" * 100, "\x00" * 90, "\x00" * 60 + "q"]
    for _ in range(50):
        a, b = random.choice(texts), random.choice(texts)
        i = random.randrange(max(1, len(a) - 300))
        more.append(b[: random.randrange(200)] + a[i : i + random.randrange(30, 300)] + b[-random.randrange(1, 100) :])
    return docs + [(random.randrange(-5, 300), t) for t in more] + [(None, texts[1]), (4, texts[4]), (4, texts[4])]


@pytest.mark.parametrize("sizes", [{}, {"piece": 30_000, "shard": 30_000, "block": 9_000}])
def test_equals_brute_force(spark, rows, sizes):
    assert run(spark, rows, **sizes) == brute(rows)


def test_few_buckets_a_long_text_and_no_table_left(spark, rows, monkeypatch):
    monkeypatch.setattr(packing, "BUCKETS", 3)
    more = rows[:40] + [(500, "".join(f"{i} " for i in range(30_000))), (501, "".join(f"{i} " for i in range(20_000, 30_000)))]
    assert run(spark, more, piece=20_000, shard=20_000) == brute(more)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("ledgerloom")]


def test_many_copies_and_a_common_passage(spark):
    passage = "a passage that many of the documents have, word for word, in the middle. "
    made = [(i, "copied text of some length, again and again, more than fifty bytes" if i % 3 == 0 else f"start {i * 7919} " + passage + f" end {i * 104729}") for i in range(600)]
    assert run(spark, made, piece=5_000, shard=5_000) == brute(made)


def test_empty_tables_and_columns(spark, frame):
    assert run(spark, []) == [] and run(spark, [(1, None)]) == brute([(1, None)])
    got = repeats.report(frame([(1, "a", 2)], "doc_id long, text string, key int"))
    assert got.collect()[0]["n_bytes"] == 1 and got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.binary(max_size=60), st.text("ab", max_size=80).map(str.encode)))
def test_suffix_arrays_and_common_prefixes(text):
    t = np.frombuffer(text, np.uint8)
    order, rank = suffixes.suffix_array(t)
    want = sorted(range(len(text)), key=lambda i: text[i:])
    assert order.tolist() == want and all(rank[p] == k for k, p in enumerate(want))
    shared = suffixes.common_prefixes(t, order)
    for k in range(1, len(want)):
        x, y = text[want[k - 1] :], text[want[k] :]
        n = next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))
        assert shared[k] == n


def test_binary_search():
    keys = (np.array([1, 1, 3], np.uint64), np.array([2, 5, 0], np.uint64))
    needles = (np.array([1, 3, 1, 9], np.uint64), np.array([5, 0, 3, 9], np.uint64))
    assert suffixes.search(needles, keys).tolist() == [1, 2, -1, -1]
