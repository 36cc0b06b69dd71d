"""Language-model scores of texts: context-tree weighting over all training bytes, and a word base.

The tree is never in one place. Pieces of text send their distinct grams, with
training counts, to the shard of the last three context bytes, which has
every longer context below them. Shards weigh their subtrees; what reaches the
driver are depth-2 nodes only, at most 2^16 contexts of 255 decisions whatever
the corpus. With these broadcast, shards score the grams that each piece asked
for, and pieces add up their texts. Words are counted the same way. Texts and
messages are written once, bucketed, and read in place by later passes.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import ctw
from ledgerloom.llm.common import crc_remainder, staged
from ledgerloom.llm.packing import buckets_of, one_row, pack, save

DEPTH = 5
SPLIT = 3  # context bytes that name a shard
PIECE = 5 << 20
SHARD = 8 << 20  # bytes of all texts for each shard


def tokens(text: bytes) -> list[bytes]:
    return text.split()  # at ASCII white space


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each is there; by sorting, which is faster here than hashing."""
    s = np.sort(x)
    at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.empty(0, np.int64)
    return s[at], np.diff(np.append(at, len(s)))


def _shard_of_grams(keys: np.ndarray, shards: int) -> np.ndarray:
    c = (keys >> np.uint64(8)) & np.uint64((1 << (8 * SPLIT)) - 1)
    c = (c * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    return (c % np.uint64(shards)).astype(np.int64)


def _planes(x: np.ndarray, width: int) -> bytes:
    """Bytes of like weight together, which compresses better."""
    return x.view(np.uint8).reshape(-1, x.itemsize)[:, :width].T.tobytes()


def _from_planes(raw: bytes, at: int, n: int, width: int, kind) -> np.ndarray:
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
    return out.view(kind).ravel()


class Message:
    """A piece's grams and words for one shard, with training counts."""

    def __init__(self, keys, counts, words, word_counts):
        self.keys, self.counts, self.words, self.word_counts = keys, counts, words, word_counts

    def pack(self) -> bytes:
        body = _planes(self.keys, DEPTH + 1) + _planes(self.counts.astype(np.uint32), 4) + self.word_counts.astype(np.uint32).tobytes() + b" ".join(self.words)
        return np.array([len(self.keys), len(self.words)], np.int64).tobytes() + zlib.compress(body, 1)

    @staticmethod
    def open(raw: bytes) -> Message:
        n, m = np.frombuffer(raw, np.int64, 2).tolist()
        body = zlib.decompress(raw[16:])
        at = n * (DEPTH + 1)
        counts = _from_planes(body, at, n, 4, np.uint32)
        at += 4 * n
        return Message(_from_planes(body, 0, n, DEPTH + 1, np.uint64), counts, body[at + 4 * m :].split(b" ") if m else [], np.frombuffer(body, np.uint32, m, at))


class _Piece:
    """A piece's texts and what it sends, the same on every pass."""

    def __init__(self, row, shards: int):
        self.ids, self.held = row.ids, np.asarray(row.held, bool)
        starts = [0, *row.ends[:-1]]
        self.texts = [row.text[a:b] for a, b in zip(starts, row.ends, strict=True)]
        self.keys = distinct(np.concatenate([distinct(g)[0] for g, _ in self.runs(range(len(self.texts)))]))[0]
        where = _shard_of_grams(self.keys, shards)
        self.order = np.argsort(where, kind="stable")
        self.shards = where[self.order]

    def runs(self, texts):
        """Grams of the texts, and whose they are, in runs of about a megabyte, so that a piece never has all of its own at once."""
        held, own, size = [np.empty(0, np.uint64)], [], 0
        for i in texts:
            held.append(ctw.grams(self.texts[i], DEPTH))
            own.append(i)
            size += len(held[-1])
            if size > 1 << 20:
                yield np.concatenate(held), np.repeat(own, [len(h) for h in held[1:]])
                held, own, size = held[:1], [], 0
        yield np.concatenate(held), np.repeat(np.array(own, np.int64), [len(h) for h in held[1:]])

    def messages(self, shards: int):
        counts = np.zeros(len(self.keys), np.int64)
        for g, _ in self.runs(np.flatnonzero(~self.held).tolist()):
            value, n = distinct(g)
            counts[np.searchsorted(self.keys, value)] += n
        split: dict[int, list[bytes]] = {}
        words: Counter = Counter()
        for t, h in zip(self.texts, self.held, strict=True):
            if h:
                for w in tokens(t):
                    words.setdefault(w, 0)
            else:
                words.update(tokens(t))
        for w in words:
            split.setdefault(zlib.crc32(w) % shards, []).append(w)
        bounds = np.searchsorted(self.shards, np.arange(shards + 1))
        for s in range(shards):
            own = self.order[bounds[s] : bounds[s + 1]]
            mine = split.get(s, [])
            if len(own) or mine:
                yield s, Message(self.keys[own], counts[own], mine, np.array([words[w] for w in mine], np.int64)).pack()


def _merged(messages: list[Message]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of all messages, their summed counts, and where each message's keys are among them."""
    every = np.concatenate([m.keys for m in messages])
    keys = distinct(every)[0]
    at = np.concatenate([np.searchsorted(keys, m.keys) for m in messages])  # each message's keys are sorted
    return keys, np.bincount(at, np.concatenate([m.counts for m in messages]), len(keys)), at


def _word_counts(messages: list[Message]) -> dict[bytes, int]:
    total: dict[bytes, int] = {}
    for m in messages:
        for w, n in zip(m.words, m.word_counts.tolist(), strict=True):
            total[w] = total.get(w, 0) + n
    return total


def _subtree(keys: np.ndarray, counts: np.ndarray) -> dict[int, list[ctw.Level]]:
    met = counts > 0
    return ctw.tree(keys[met], counts[met], SPLIT, DEPTH)


def _top(rows) -> dict[int, list[ctw.Level]]:
    """Weighted levels of the depths below SPLIT, from summed nodes (bit, key, n0, n1, log)."""
    by = [sorted((r["key"], r["n0"], r["n1"], r["log"]) for r in rows if r["bit"] == b) for b in range(8)]
    nodes = [(np.array([x[0] for x in v], np.uint64), np.array([x[1:] for x in v], float).reshape(-1, 3)) for v in by]
    last, values = nodes[7]
    keys = np.stack((last << np.uint64(1), last << np.uint64(1) | np.uint64(1)), 1).ravel()
    counts = values[:, :2].ravel()
    return ctw.tree(keys[counts > 0], counts[counts > 0], 0, SPLIT - 1, [(k, v[:, 2]) for k, v in nodes])


def scores(docs: DataFrame, held_out, piece: int = PIECE, shard: int = SHARD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs(doc_id, text).

    held_out: a column; rows where it is true are scored but not learned from
    (null counts as false). A null text counts as empty. Texts are lower-cased (A-Z) first. score is log10 of the model's
    probability of the text's bytes and their end; base_score that of its words and one
    end, by smoothed counts. Repeated rows are learned from as often as they stand there. With nothing
    to learn from, every decision is even and the base has no words. Texts of any length are read whole; other
    columns, whatever their names, are left behind; an empty table gives no rows."""
    spark = docs.sparkSession
    # Ids travel as text: pandas would make a column of whole numbers with a null one of floats.
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    total, learned = rows.agg(F.sum(F.octet_length("text") + 1), F.sum((~F.col("held_out")).cast("long"))).first()
    learned = learned or 0
    pieces, shards = max(1, -(-(total or 0) // piece)), max(1, -(-(total or 0) // shard))
    rows = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(pieces)).alias("piece"), "doc_id", "held_out", F.col("text").cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def packed(frame):
        texts = [bytes(t).lower() for t in frame["text"]]
        return one_row(piece=frame["piece"].iloc[0], ids=frame["doc_id"].tolist(), held=frame["held_out"].tolist(), ends=np.cumsum([len(t) for t in texts]).tolist(), text=b"".join(texts))

    held = pack(rows, pieces, packed, "piece long, ids array<string>, held array<boolean>, ends array<long>, text binary")

    def send(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                sent = list(_Piece(row, shards).messages(shards))
                if sent:
                    yield pd.DataFrame([(s, row.piece, m) for s, m in sent], columns=["shard", "piece", "message"])

    buckets = buckets_of(spark, -(-shards // 2))
    sent = held.table.mapInPandas(send, "shard long, piece long, message binary").repartition(buckets, "shard")
    messages, drop = save(sent, buckets, "shard", "messages")

    def weigh(frame):
        got = [Message.open(m) for m in frame["message"]]
        keys, counts, _ = _merged(got)
        low = _subtree(keys, counts)[SPLIT]
        words = _word_counts(got)
        out = [pd.DataFrame({"bit": [-1], "key": [0], "n0": [float(sum(n > 0 for n in words.values()))], "n1": [float(sum(words.values()))], "log": [0.0]})]
        for b, level in enumerate(low):
            if len(level.key):
                cut, at = np.unique(level.key & np.uint64((1 << (8 * (SPLIT - 1) + b)) - 1), return_inverse=True)
                out.append(pd.DataFrame({"bit": b, "key": cut.astype(np.int64), "n0": np.bincount(at, level.n0), "n1": np.bincount(at, level.n1), "log": np.bincount(at, level.log)}))
        return pd.concat(out)

    nodes = messages.groupBy("shard").applyInPandas(weigh, "bit int, key long, n0 double, n1 double, log double")
    nodes = nodes.groupBy("bit", "key").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "log")]).collect()  # at most 2^16 * 255, and one
    distinct, n = next(((int(r["n0"]), int(r["n1"])) for r in nodes if r["bit"] < 0), (0, 0))
    n, distinct = n + learned, distinct + (learned > 0)  # each text's end is a word
    top = spark.sparkContext.broadcast(_top([r for r in nodes if r["bit"] >= 0]))

    def answer(frame):
        got = [Message.open(m) for m in frame["message"]]
        keys, counts, at = _merged(got)
        scored = ctw.score(keys, _subtree(keys, counts), top.value)[at]
        words = _word_counts(got)
        out, a = [], 0
        for p, m in zip(frame["piece"], got, strict=True):
            body = _planes(scored[a : a + len(m.keys)], 8) + np.array([words[w] for w in m.words], np.int64).tobytes() + b" ".join(m.words)
            out.append((frame["shard"].iloc[0], p, np.array([len(m.keys), len(m.words)], np.int64).tobytes() + zlib.compress(body, 1)))
            a += len(m.keys)
        return pd.DataFrame(out, columns=["shard", "piece", "answer"])

    answers = messages.groupBy("shard").applyInPandas(answer, "shard long, piece long, answer binary")
    scale = math.log10(n + 0.5 * (distinct + 1))
    end = math.log10(learned + 0.5)

    def add_up(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                own = _Piece(row, shards)
                value, logs, unknown = np.zeros(len(own.keys)), {}, set()
                for a in row.answers:
                    n_keys, n_words = np.frombuffer(a["answer"], np.int64, 2).tolist()
                    body = zlib.decompress(a["answer"][16:])
                    low, high = np.searchsorted(own.shards, [a["shard"], a["shard"] + 1])
                    value[own.order[low:high]] = _from_planes(body, 0, n_keys, 8, np.float64)
                    if n_words:
                        at = 8 * n_keys + 8 * n_words
                        counts = np.frombuffer(body, np.int64, n_words, 8 * n_keys)
                        words = body[at:].split(b" ")
                        logs.update(zip(words, np.log10(counts + 0.5).tolist(), strict=True))
                        unknown.update([words[i] for i in np.flatnonzero(counts == 0).tolist()])
                total = np.zeros(len(own.texts))
                for g, whose in own.runs(range(len(own.texts))):
                    order = np.argsort(g)  # sorted, the grams are found in passing
                    total += np.bincount(whose[order], value[np.searchsorted(own.keys, g[order])], len(total))
                out = []
                for i, h, t, s in zip(own.ids, own.held.tolist(), own.texts, total.tolist(), strict=True):
                    found = tokens(t)
                    missed = sum(map(unknown.__contains__, found)) if h else 0
                    base = math.fsum(chain(map(logs.__getitem__, found), (end,))) - (len(found) + 1) * scale
                    out.append((i, h, len(found) + 1, len(found) - missed + (learned > 0), base, s))
                yield pd.DataFrame(out, columns=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    done = held.with_answers(answers, "answer").mapInPandas(add_up, "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    done = staged(done, "scores")  # figures alone; the texts' tables can go
    held.drop()
    drop()
    return done.select(F.col("doc_id").cast(kind).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def report(docs: DataFrame) -> DataFrame:
    return scores(docs.select("doc_id", "text"), crc_remainder("doc_id", 5) == 1)
