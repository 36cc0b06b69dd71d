"""Exact top-k by inner product over integer vectors, norm-bucketed.

Queries are taken in blocks of bounded size, each broadcast to one scan of all
vectors, which never move. A block's first thresholds come from the longest
vectors (a bounded set). Each task groups the vectors it reads by length; for a
bucket and a query the local cosine threshold is the query's threshold over the
product of its length and the bucket's. Above 1 the bucket is skipped; a high
one prunes by coordinates (a unit vector of that cosine lies in a band at each
of the query's strongest coordinates), a low one by length alone. What is left
is verified by exact products, which raise the task's thresholds. A task returns
its k best for each query, and those are ranked across tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import staged

BLOCK = 32_768  # queries in a broadcast, at most
BLOCK_BYTES = 64 << 20  # of a broadcast's queries, about: longer vectors make smaller blocks
BUCKET = 2_048  # vectors of like length
BUFFER = 65_536  # vectors that a task holds at once
LONGEST = 4_096  # vectors behind the first thresholds
HIGH = 0.6  # local cosine threshold from which coordinates prune
FOCUS = 3
STEP = 256
SLACK = 1e-6


def matrix(rows) -> np.ndarray:
    """Integer rows as a matrix; shorter ones end in zeros."""
    width = max(map(len, rows), default=0)
    if all(len(r) == width for r in rows):
        return np.array(rows, np.int64).reshape(len(rows), width)
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _wide(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


class Block:
    """Queries, their thresholds and the best rows so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.length = np.sqrt((vectors.astype(float) ** 2).sum(1))
        self.floor = np.full(len(ids), -np.inf)

    def fresh(self) -> Block:
        """Best rows empty, thresholds as they are."""
        self.threshold = self.floor.copy()
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(self.ids)
        return self

    def offer(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        other = ids != self.ids[i]
        held_s, held_i = self.best[i]
        s, v = np.concatenate((held_s, scores[other])), np.concatenate((held_i, ids[other]))
        if len(s) > self.k:
            least = np.partition(s, len(s) - self.k)[len(s) - self.k]
            s, v = s[keep := s >= least], v[keep]
            order = np.lexsort((v, -s))[: self.k]
            s, v = s[order], v[order]
        self.best[i] = s, v
        if len(s) == self.k:
            self.threshold[i] = max(self.threshold[i], s.min())

    def scan(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Takes in vectors, by buckets of falling length."""
        width = max(vectors.shape[1], self.vectors.shape[1])
        vectors, queries = _wide(vectors, width), _wide(self.vectors, width)
        length = np.sqrt((vectors.astype(float) ** 2).sum(1))
        order = np.argsort(-length, kind="stable")
        most = float(length.max(initial=0)) * float(self.length.max(initial=0))
        # Products and their partial sums are bounded by the lengths' product: floats hold them exactly.
        exact = np.float32 if most < 1 << 23 else np.float64 if most < 1 << 52 else np.int64
        q = queries.astype(exact)
        for at in range(0, len(order), BUCKET):
            own = order[at : at + BUCKET]
            self.bucket(ids[own], vectors[own].astype(exact), length[own], q)

    def bucket(self, ids, p, length, q) -> None:
        top = length[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(self.threshold > 0, self.threshold / (self.length * top), -1.0)
        local[np.isnan(local)] = np.inf
        unit = None
        for i in np.flatnonzero((local >= HIGH) & (local <= 1 + SLACK)):
            if unit is None:
                unit = p / np.maximum(length, 1e-300)[:, None]
            n = int(np.searchsorted(-length, -(self.threshold[i] / self.length[i]) * (1 - SLACK), "right"))
            t, x = min(local[i], 1.0) - SLACK, q[i] / self.length[i]
            near = np.arange(n)
            for f in np.argsort(-np.abs(x))[:FOCUS]:
                band = np.sqrt(max(0.0, 1 - t * t) * max(0.0, 1 - float(x[f]) ** 2)) + SLACK
                # The extremes over all cosines from t to 1; beyond x / t the larger ones reach further.
                low = -1.0 if x[f] < 0 and -x[f] >= t else t * x[f] - band
                high = 1.0 if x[f] >= t else t * x[f] + band
                near = near[(unit[near, f] >= low) & (unit[near, f] <= high)]
            s = (p[near] @ q[i]).astype(np.int64)
            good = s >= self.threshold[i]
            if good.any():
                self.offer(i, s[good], ids[near[good]])
        rest = np.flatnonzero(local < HIGH)
        for a in range(0, len(rest), STEP):
            own = rest[a : a + STEP]
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(self.threshold[own] > 0, self.threshold[own] / self.length[own], 0.0)
            n = int(np.searchsorted(-length, -least.min() * (1 - SLACK), "right"))
            scores = q[own] @ p[:n].T
            for j, i in enumerate(own):
                good = np.flatnonzero(scores[j] >= self.threshold[i])
                if len(good):
                    self.offer(i, scores[j][good].astype(np.int64), ids[good])


def integers(df: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """vec_id LONG and v ARRAY<LONG> = floor(scale * component); rows with a null id or an unusable vector are left out."""
    v = F.col(vec_col)
    usable = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return df.where(F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def search(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows of each query.

    Queries are the rows whose id is divisible by `every`; ties go to the smaller
    id. Rows with a null id, a null vector, or a null or non-finite component take no part. Vectors
    may differ in length: missing components are zero. A repeated row is a
    candidate as often as it stands there, but never for a query of its own id;
    a repeated query is asked once. Other columns are left behind. An empty table, or one
    without queries, gives no rows."""
    spark = df.sparkSession
    rows = integers(df, id_col, vec_col, scale)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    asked = rows.where(F.col("vec_id") % every == 0)
    count, width = asked.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    n_blocks = -(-count // min(block, max(1, BLOCK_BYTES // (8 * max(1, width or 0)))))
    first = rows.select("vec_id", "v", norm.alias("norm")).orderBy(F.desc("norm"), "vec_id").limit(LONGEST).collect()
    long_ids, long_v = np.array([r[0] for r in first], np.int64), matrix([r[1] for r in first])
    found = []
    for b in range(n_blocks):
        mine = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b).distinct().collect()
        own = Block(np.array([r[0] for r in mine], np.int64), matrix([r[1] for r in mine]), k).fresh()
        own.scan(long_ids, long_v)
        own.floor, own.best = own.threshold, []
        sent = spark.sparkContext.broadcast(own)

        def run(frames, sent=sent):
            here, held, n = sent.value.fresh(), [], 0
            for frame in frames:
                held.append(frame)
                n += len(frame)
                if n >= BUFFER:
                    here.scan(*_gathered(held))
                    held, n = [], 0
            if n:
                here.scan(*_gathered(held))
            for at in range(0, len(here.ids), 4096):
                part = range(at, min(at + 4096, len(here.ids)))
                sizes = [len(here.best[i][0]) for i in part]
                if sum(sizes):
                    yield pd.DataFrame({"query_id": np.repeat(here.ids[at : part.stop], sizes), "query": np.repeat(np.arange(at, part.stop), sizes), "vec_id": np.concatenate([here.best[i][1] for i in part]), "score": np.concatenate([here.best[i][0] for i in part])})

        found.append(rows.mapInPandas(run, "query_id long, query int, vec_id long, score long").withColumn("block", F.lit(b)))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    parts = found if len(found) == 1 else [staged(f, "topk") for f in found]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    order = Window.partitionBy("query_id", "block", "query").orderBy(F.desc("score"), "vec_id")
    return whole.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _gathered(frames: list[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
    whole = pd.concat(frames) if len(frames) > 1 else frames[0]
    return whole["vec_id"].to_numpy(np.int64), matrix(list(whole["v"]))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
