import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import winnow

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1) if n and i is not None else ():
            windows.setdefault(n, {}).setdefault(tuple(w[s : s + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, found = words(t), set()
        hit = [0] * len(w)
        for n, known in windows.items():
            for s in range(len(w) - n + 1):
                if ids := known.get(tuple(w[s : s + n])):
                    found |= ids
                    hit[s : s + n] = [1] * n
        joined = ",".join(sorted(map(str, found)))
        out.append((d, len(w), sum(hit), len(found), hashlib.sha256(joined.encode()).hexdigest(), sum(hit) > 0))
    return sorted(out, key=str)


def run(frame, docs, items, most):
    from pyspark.sql import functions as F

    found = winnow.find(frame(docs), frame(items, "item_id long, text string"), most)
    got = found.select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ",").cast("binary"), 256), F.col("n_hit") > 0)
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("most", [winnow.MOST_BYTES, 0])
def test_both_ways_equal_brute_force(spark, frame, most):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    passage = items[0][1]
    docs += [(900, None), (901, ""), (902, passage), (902, passage), (None, passage.upper()), (903, "Été-42 " * 30), (904, "..x " + "été 42 " * 5), (905, "filler words " * 40_000 + (passage or ""))]
    items += [(70, None), (71, ""), (72, "été 42 été"), (73, passage), (73, passage), (None, "the"), (74, "été 42 " * 8)]
    assert run(frame, docs, items, most) == brute(docs, items)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.lists(st.sampled_from("abc"), max_size=40))
def test_every_long_shared_span_is_found(doc, item):
    hit, ids = winnow.Index([("1", " ".join(item))]).find([w.encode() for w in doc])
    want = brute([(0, " ".join(doc))], [(1, " ".join(item))])[0]
    assert (len(doc), int(hit.sum()), len(ids)) == want[1:4]


def test_clashing_columns_and_empty_tables(frame):
    df = frame([(1, "a b", "x", 3)], "doc_id long, text string, row string, n_hit long")
    for most in (winnow.MOST_BYTES, 0):
        got = winnow.find(df, frame([(1, "a b")], "item_id long, text string"), most)
        assert got.select("row", "n_hit").collect() == [("x", 2)]
        assert winnow.find(frame([]), frame([], "item_id long, text string"), most).count() == 0
        assert run(frame, [(1, "a")], [], most)[0][2] == 0
