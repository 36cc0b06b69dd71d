"""Quality from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each text.
Expectation-maximisation over the counts of vote patterns (at most 3^7, whatever
the number of texts) estimates each labeller's accuracies and so the probability
that a pattern's texts are good. Those posteriors label a bounded sample, on
which a hashed linear scorer is trained; it scores every text.
"""

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import slices

SAMPLE = 20_000  # texts that train the scorer, at most about
SIZE = 1 << 14  # hashed features
KEEP = 0.5
PRIOR, RARE = 1.0, 0.002
COMMON = b".,;:'\"()-"  # punctuation of plain prose
LABELLERS = ("capitals", "symbols", "repeats", "lines", "variety", "letters", "words")


class _Shapes:
    """A whole token's hashed shape: letters by case, digits, other characters themselves, runs as one."""

    def __init__(self):
        self.seen: dict[str, int] = {}
        self.size = 0

    def learnt(self, tokens: list[str]) -> dict[str, int]:
        """Shapes of all these tokens at least."""
        if len(self.seen) > 300_000 or self.size > 20_000_000:
            self.seen, self.size = {}, 0
        for token in set(tokens).difference(self.seen):
            shape = re.sub(r"(.)\1+", r"\1", "".join("X" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else c for c in token))
            self.seen[token] = zlib.crc32(shape.encode()) % (SIZE - 64)
            self.size += len(token)
        return self.seen


PLAIN_END = re.compile(r"[.,;:]+(?=\s|$)")
_UPPER, _LETTERS, _DIGITS = (bytes(r) for r in (range(65, 91), [*range(65, 91), *range(97, 123)], range(48, 58)))
_WIDE = bytes(range(128, 256))


def measures(text: str) -> dict[str, float]:
    """What the labellers look at, each a share from 0 to 1, and the number of words.

    Characters are counted in bulk: those beyond ASCII count as small letters."""
    tokens = text.split()
    n = len(tokens)
    raw = text.encode()
    size, wide = len(raw), len(text) - len(raw.translate(None, _WIDE))
    capitals = size - len(raw.translate(None, _UPPER))
    letters = size - len(raw.translate(None, _LETTERS)) + wide
    digits = size - len(raw.translate(None, _DIGITS))
    chars = sum(map(len, tokens))
    odd = chars - letters - digits - (size - len(raw.translate(None, COMMON)))
    lines = [x for x in text.split("\n") if x.strip()]
    count = Counter(tokens)
    ids = np.fromiter(map(hash, tokens), np.int64, n)
    threes = np.sort(ids[:-2] * 0x9E3779B1 + ids[1:-1] * 0x85EBCA6B + ids[2:])
    return {
        "n": n,
        "capitals": capitals / max(1, letters),
        "symbols": max(0, odd) / max(1, chars),
        "plain": sum(map(str.isalpha, PLAIN_END.sub(" ", text).split())) / max(1, n),
        "repeats": float((threes[1:] == threes[:-1]).sum()) / (n - 2) if n > 2 else 0.0,
        "lines": 1 - len(set(lines)) / max(1, len(lines)),
        "top": max(count.values(), default=0) / max(1, n),
        "adjacent": float((ids[1:] == ids[:-1]).sum()) / max(1, n - 1),
    }


def votes(m: dict[str, float]) -> list[int]:
    """1 good, -1 bad, 0 nothing, in the order of LABELLERS."""

    def side(good: bool, bad: bool) -> int:
        return 1 if good else -1 if bad else 0

    some = m["n"] >= 3
    return [
        side(some and m["capitals"] < 0.15, some and m["capitals"] > 0.5),
        side(m["symbols"] < 0.02, m["symbols"] > 0.08),
        side(m["repeats"] < 0.2, m["repeats"] > 0.6),
        side(m["lines"] < 0.2, m["lines"] > 0.6),
        side(m["adjacent"] < 0.02, m["adjacent"] > 0.2 or m["n"] > 20 and m["top"] > 0.3),
        side(m["plain"] > 0.9, m["plain"] < 0.7),
        side(m["n"] >= 20, m["n"] == 0),
    ]


def features(text: str, m: dict[str, float], shapes: _Shapes) -> dict[int, float]:
    """Hashed shapes by share of tokens, and the measures in steps."""
    tokens = text.split()
    count = Counter(map(shapes.learnt(tokens).__getitem__, tokens))
    n = max(1, sum(count.values()))
    out = {k: math.sqrt(c / n) for k, c in count.items()}
    for i, name in enumerate(("capitals", "symbols", "plain", "repeats", "lines", "top", "adjacent")):
        out[SIZE - 64 + 8 * i + min(7, int(m[name] * 8))] = 1.0
    out[SIZE - 8 + min(7, int(math.log2(m["n"] + 1)))] = 1.0
    return out


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 200) -> tuple[dict[tuple[int, ...], float], np.ndarray]:
    """P(good) of each vote pattern, and P(vote | class) of each labeller.

    Votes are taken as independent given the class. Bad texts are of several
    kinds, each seen by a few labellers only, so the start and a prior say what a
    bad vote is: rare among good texts. The prior weighs as much as PRIOR of the
    texts, RARE of them bad votes and the rest as the labeller votes otherwise."""
    if not patterns:
        return {}, np.full((2, len(LABELLERS), 3), 1 / 3)
    keys = sorted(patterns)
    v = np.array(keys) + 1
    c = np.array([patterns[k] for k in keys], float)
    bad = (v == 0).sum(1)
    good = np.array([0.97, 0.5])[np.minimum(bad, 1)] * np.where(bad > 1, 0.1, 1.0)
    other = np.stack([((v == x) * c[:, None]).sum(0) + 0.5 for x in (1, 2)])
    prior_votes = PRIOR * c.sum() * np.vstack([np.full(v.shape[1], RARE), (1 - RARE) * other / other.sum(0)])
    for _ in range(rounds):
        table = np.empty((2, v.shape[1], 3))
        for k, w in enumerate((c * (1 - good), c * good)):
            for x in range(3):
                table[k, :, x] = ((v == x) * w[:, None]).sum(0) + 0.5 + k * prior_votes[x]
            table[k] /= table[k].sum(1, keepdims=True)
        prior = np.clip((c * good).sum() / c.sum(), 0.01, 0.99)
        log = [np.log(p) + np.log(table[k][np.arange(v.shape[1]), v]).sum(1) for k, p in enumerate((1 - prior, prior))]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return dict(zip(keys, new.tolist(), strict=True)), table


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 8, seed: int = 7) -> tuple[np.ndarray, float]:
    """Logistic weights by AdaGrad over sparse rows (places, values), in a fixed shuffled order."""
    w, g = np.zeros(SIZE + 1), np.full(SIZE + 1, 1e-4)
    order = np.random.default_rng(seed)
    for _ in range(rounds if rows else 0):
        for i in order.permutation(len(rows)):
            at, x = np.append(rows[i][0], SIZE).astype(np.int64), np.append(rows[i][1], 1.0).astype(float)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w[at] @ x)))))
            d = (p - target[i]) * x + 1e-5 * w[at]
            g[at] += d * d
            w[at] -= 0.3 * d / np.sqrt(g[at])
    return w[:-1], float(w[-1])


class Model:
    """The scorer; without training rows it keeps everything."""

    def __init__(self, weights: np.ndarray, bias: float, posterior: dict, accuracy: np.ndarray):
        self.weights, self.bias, self.posterior, self.accuracy = weights, bias, posterior, accuracy

    def score(self, text: str, shapes: _Shapes) -> float:
        f = features(text, measures(text), shapes)
        z = self.bias + sum(self.weights[k] * x for k, x in f.items())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _vote(batches):
    """How many texts have which votes; texts are strings by slices only."""
    total: Counter = Counter()
    for batch in slices(batches):
        total.update(tuple(votes(measures(t))) for t in batch.column(0).to_pylist())
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(map(list, total), pa.list_(pa.int32())), pa.array(total.values(), pa.int64())], ["votes", "n"])


def _featured(batches):
    """Votes and packed features of each text; texts are strings by slices only."""
    shapes = _Shapes()
    for batch in slices(batches):
        got = [(votes(m := measures(t)), features(t, m, shapes)) for t in batch.column(0).to_pylist()]
        packed = [(np.array(list(f), np.int16).tobytes(), np.array(list(f.values()), np.float32).tobytes()) for _, f in got]
        columns = [pa.array([v for v, _ in got], pa.list_(pa.int32())), *(pa.array([x[k] for x in packed], pa.binary()) for k in (0, 1))]
        yield pa.RecordBatch.from_arrays(columns, ["votes", "at", "x"])


def _scores(arrays, model: Model):
    """Scores of each array's texts; texts are strings by slices only."""
    shapes = _Shapes()
    for array in arrays:
        yield pa.array([model.score(t or "", shapes) for part in slices([array]) for t in part.to_pylist()], pa.float64())


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Votes of all texts, their estimate, and the scorer. Labels are not used. Null texts count as empty.

    Texts are read whole, however long. Repeated rows vote each; the scorer learns equal texts once. An empty
    table gives a scorer that keeps everything. Columns other than text are not read."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    counted = docs.select(text.alias("text")).mapInArrow(_vote, "votes array<int>, n long").groupBy("votes").agg(F.sum("n").alias("n"))
    patterns = {tuple(r["votes"]): r["n"] for r in counted.collect()}  # at most 3^7 rows
    posterior, accuracy = estimate(patterns)
    n = sum(patterns.values())
    share = int(min(1.0, sample / max(n, 1)) * (1 << 20)) + 1
    chosen = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share)

    got = chosen.dropDuplicates(["text"]).mapInArrow(_featured, "votes array<int>, at binary, x binary").toArrow()  # bounded by `sample`
    rows = sorted(zip(map(tuple, got["votes"].to_pylist()), got["at"].to_pylist(), got["x"].to_pylist(), strict=True))
    weights, bias = train([(np.frombuffer(a, np.int16), np.frombuffer(x, np.float32)) for _, a, x in rows], np.array([posterior[v] for v, _, _ in rows]))
    return Model(weights, bias, posterior, accuracy)


def score(docs: DataFrame, model: Model, out: str = "quality_score") -> DataFrame:
    """`docs` with `out` DOUBLE from 0 to 1; a column of that name is replaced. Rows, repeated or null, stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _scores(texts, sent.value)

    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() != out.lower()]
    return docs.select(*keep, scored(F.col("text").cast("string")).alias(out))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, score, keep for every row."""
    scored = score(docs.select("doc_id", "text"), fit(docs))
    return scored.select("doc_id", F.col("quality_score").alias("score"), (F.col("quality_score") >= KEEP).alias("keep"))
