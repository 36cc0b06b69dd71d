"""Benchmark decontamination by winnowing.

Words are hashed, `GRAM` words make a gram, and of each run of `WINDOW - GRAM + 1`
grams the one of least hash is a fingerprint. Two texts that share WINDOW words
in a row share such a run, hence its least hash: every shared span is found.
Fingerprints that document and benchmark share are extended: the windows of words
around them are looked up, word by word, in the benchmark's.

A benchmark of at most `most_bytes` is indexed once and broadcast, its size
checked first. A larger one is joined: fingerprints first, and only around those
that are shared are windows made and joined in turn.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import staged

WINDOW, GRAM = 10, 5
MOST_BYTES = 1 << 20  # of benchmark texts for the broadcast index, which takes about fifty times that
#: Bytes that part words: all of ASCII but letters and digits; A-Z become a-z.
_TABLE = bytes(b if b >= 128 or chr(b).isdigit() or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(GRAM)], np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def grams(words: list[bytes]) -> np.ndarray:
    """Hash of each run of GRAM words."""
    n = len(words) - GRAM + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    g = sum((h[k : k + n] * _POWERS[k] for k in range(1, GRAM)), h[:n] * _POWERS[0])
    return (g ^ (g >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def fingerprints(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the grams that are least in some run of them; all of them if there are too few for a run."""
    g = grams(words)
    run = WINDOW - GRAM + 1
    if len(g) <= run:
        return (g, np.arange(len(g)))
    views = np.lib.stride_tricks.sliding_window_view(g, run)
    place = np.unique(views.argmin(1) + np.arange(len(views)))
    return g[place], place


def windows_of(words: list[bytes]) -> list[bytes]:
    """A text's windows, each with single spaces: WINDOW words in a row, or all of fewer."""
    n = len(words)
    return [b" ".join(words[i : i + WINDOW]) for i in range(max(1, n - WINDOW + 1))] if n else []


class Index:
    """Windows and fingerprints of benchmark items."""

    def __init__(self, items):
        held: dict[int, dict[bytes, set]] = {}
        prints = [np.empty(0, np.uint64)]
        for item, text in items:
            words = words_of(text)
            size = min(len(words), WINDOW)
            for w in windows_of(words):
                held.setdefault(size, {}).setdefault(w, set()).add(item)
            if size == WINDOW:
                prints.append(fingerprints(words)[0])
        self.long = held.pop(WINDOW, {})
        self.short = held
        self.prints = np.unique(np.concatenate(prints))

    def find(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words are hit, and by which items."""
        hit, items = np.zeros(len(words), bool), set()
        if self.long and len(words) >= WINDOW:
            h, place = fingerprints(words)
            if len(h):
                at = np.searchsorted(self.prints, h)
                near = place[self.prints[np.minimum(at, len(self.prints) - 1)] == h]
                for s in starts(near, len(words)):
                    if found := self.long.get(b" ".join(words[s : s + WINDOW])):
                        hit[s : s + WINDOW] = True
                        items |= found
        for size, known in self.short.items():
            for s in range(len(words) - size + 1):
                if found := known.get(b" ".join(words[s : s + size])):
                    hit[s : s + size] = True
                    items |= found
        return hit, items


def starts(near: np.ndarray, n: int) -> list[int]:
    """Starts of the windows that hold a gram at one of the places `near`."""
    if not len(near):
        return []
    s = np.unique((near[:, None] - np.arange(WINDOW - GRAM + 1)).ravel())
    return s[(s >= 0) & (s <= n - WINDOW)].tolist()


def spans(hit: np.ndarray) -> list[list[int]]:
    """Runs [start, end) of hit words."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return edge.reshape(-1, 2).tolist()


FOUND = "n_words long, n_hit long, items array<string>, spans array<array<int>>"
_NAMES = ("n_words", "n_hit", "items", "spans")


def _schema(docs: DataFrame) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), FOUND])


def find(docs: DataFrame, benchmark: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """`docs` with n_words, n_hit, items (ids, sorted as strings) and spans (hit runs of words).

    Texts of any length are read whole. Null texts have no words; items without words or with a null id match nothing; items of one id
    count once. Rows of docs stay as they are, repeated, tied or with a null id. Columns of docs that have
    one of the new names are replaced; others stay."""
    spark = docs.sparkSession
    docs = docs.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns if c.lower() not in _NAMES])
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("item") + 32)).first()[0] or 0
    if size > most_bytes:
        return _joined(docs, items)
    index = spark.sparkContext.broadcast(Index([tuple(r) for r in items.collect()]))

    def run(batches):
        own = index.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, hits, found, runs = [], [], [], []
                for text in part.column("text").to_pylist():
                    words = words_of(text)
                    hit, ids = own.find(words)
                    n.append(len(words))
                    hits.append(int(hit.sum()))
                    found.append(sorted(ids))
                    runs.append(spans(hit))
                new = [pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(runs, pa.list_(pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *_NAMES])

    return docs.mapInArrow(run, _schema(docs))


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The same for a benchmark of any size; what moves are fingerprints, then windows around shared ones.

    A window is known by the SHA-256 of its words. Short items, which winnowing does not cover,
    are joined by all runs of words of their lengths (at most nine)."""
    names = docs.columns
    docs = docs.withColumn("__row", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    once = docs.select(F.col("__row").alias("row"), "text").dropDuplicates(["row"])

    def digest(w: bytes) -> bytes:
        return hashlib.sha256(w).digest()

    def item_prints(frames):
        for frame in frames:
            got = [fingerprints(words_of(t))[0] for t in frame["text"] if t and len(words_of(t)) >= WINDOW]
            yield pd.DataFrame({"print": np.unique(np.concatenate([np.empty(0, np.uint64), *got])).view(np.int64)})

    def item_windows(frames):
        for frame in frames:
            rows = [(i, digest(w), min(len(words_of(t)), WINDOW)) for i, t in frame.itertuples(index=False, name=None) for w in set(windows_of(words_of(t)))]
            if rows:
                yield pd.DataFrame(rows, columns=["item", "window", "size"])

    def doc_prints(frames):
        for frame in frames:
            got = [(r, np.unique(fingerprints(words_of(t))[0]).view(np.int64)) for r, t in frame.itertuples(index=False, name=None)]
            if any(len(h) for _, h in got):
                yield pd.DataFrame({"row": [r for r, h in got for _ in h], "print": np.concatenate([np.empty(0, np.int64), *(h for _, h in got)])})

    prints = items.mapInPandas(item_prints, "print long").distinct()
    windows = staged(items.mapInPandas(item_windows, "item string, window binary, size int"), "bench-windows")
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect() if r[0] < WINDOW)  # nine at most
    shared = once.mapInPandas(doc_prints, "row string, print long").join(prints, "print", "left_semi")
    near = shared.groupBy("row").agg(F.collect_set("print").alias("prints"))

    def doc_windows(frames):
        for frame in frames:
            rows = []
            for row, text, held in frame.itertuples(index=False, name=None):
                words = words_of(text)
                if held is not None and len(held):
                    h, place = fingerprints(words)
                    around = place[np.isin(h.view(np.int64), np.asarray(held, np.int64))]
                    rows += [(row, s, WINDOW, digest(b" ".join(words[s : s + WINDOW]))) for s in starts(around, len(words))]
                rows += [(row, s, n, digest(b" ".join(words[s : s + n]))) for n in sizes for s in range(len(words) - n + 1)]
            if rows:
                yield pd.DataFrame(rows, columns=["row", "start", "size", "window"])

    tried = once.join(near, "row", "left" if sizes else "inner").select("row", "text", "prints")
    made = tried.mapInPandas(doc_windows, "row string, start int, size int, window binary")
    known = windows.select("window", "size").distinct()
    met = staged(made.join(known, ["window", "size"], "left_semi"), "met-windows")
    by_row = met.groupBy("row").agg(F.collect_set(F.struct("start", "size")).alias("met"))
    ids = met.select("row", "window").distinct().join(windows.select("window", "item").distinct(), "window").select("row", "item").distinct()
    ids = ids.groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))

    def finish(frames):
        for frame in frames:
            rows = []
            for row, text, held, found in frame.itertuples(index=False, name=None):
                hit = np.zeros(len(words_of(text)), bool)
                for x in held if held is not None else ():
                    hit[x["start"] : x["start"] + x["size"]] = True
                rows.append((row, len(hit), int(hit.sum()), found if found is not None else [], spans(hit)))
            if rows:
                yield pd.DataFrame(rows, columns=["row", *_NAMES])

    told = once.join(by_row, "row", "left").join(ids, "row", "left").mapInPandas(finish, f"row string, {FOUND}").withColumnRenamed("row", "__told")
    return docs.join(told, F.col("__row") == F.col("__told")).select(*[F.col(f"`{c}`") for c in names], *_NAMES)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return find(docs.select("doc_id", "text"), benchmark).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
