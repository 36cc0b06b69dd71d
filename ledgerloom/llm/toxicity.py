"""Toxicity by a weighted finite-state pattern grammar.

A letter trie with weights, the lexicon transducer, turns each word into a symbol:
an insult, threat, target, negation, report, the end of a clause, or anything else.
Five small transducers over symbols follow, each given as its states and arcs
(NEGATE, INSULT, THREATEN, AIM, TELL): negation rewrites the insults in its scope,
insults and threats put out their weights, targets and reported speech change
the state. `compose` builds one machine of them; its final states say
how a clause is read (plain, aimed at someone, negated, reported, threat), and its path
carries the weights. A text's readings, summed by clause, are the features of a
logistic score; single words outside a matched clause score nothing.

Learning: candidate stems are counted in toxic texts, then in the others, and
kept where the odds ratio is large with its error taken off. Equal texts and near
copies, confirmed on their words, count once among the learning rows. A third of these is kept from the
stems and fits the logistic weights. Learning rows are bounded by SAMPLE.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import crc_remainder, staged
from ledgerloom.llm.simhash import similar

SAMPLE = 30_000  # labelled rows to learn from, at most; chosen by hash
SHORTEST, LONGEST = 3, 12  # letters of a stem that is a word's beginning
MIN_DOCS, MIN_SHARE, MIN_WEIGHT = 4, 0.004, 2.5
SCOPE = 3  # words that a negation reaches
THREAT_WEIGHT = 1.0  # of a threat word that the labels say nothing of
LEVEL = 0.3

#: Fixed word lists of the grammar, in English, French, German and Spanish.
THREAT = frozenset("kill hurt destroy burn beat stab shoot hang tuer frapper brûler töten schlagen umbringen verbrennen matar golpear quemar".split())
TARGET = frozenset("you your yours yourself u he she they them these those people tu toi te vous ton ta tes du dich dir dein deine ihr euch sie tú ti usted ustedes vosotros".split())
NEGATION = frozenset("not no never neither nor without isn aren don doesn didn ne pas jamais sans nicht kein keine nie ohne nunca jamás sin".split())
REPORT = frozenset("said says say wrote writes quoted quote called reported according dit écrit selon cité sagte sagt schrieb laut zitiert dijo dice escribió según".split())

TOKEN = re.compile(r"[^\W_]+|[.!?;:\n]")
OTHER, HIT, THREATS, AT, NOT, SAYS, NEGATED_HIT, STOP = range(8)
PLAIN, AIMED, NEGATED, REPORTED, THREATENED = range(5)
END = "$"


class Transducer:
    """States, and arcs (state, symbol) -> (state, symbol put out). State 0 is the start.

    A symbol without an arc passes unchanged and leaves the state, unless `idle` says where it leads."""

    def __init__(self, states: int, arcs: dict[tuple[int, int], tuple[int, int]], idle: dict[int, int] | None = None):
        self.states, self.arcs, self.idle = states, arcs, idle or {}

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        return self.arcs.get((state, symbol)) or (self.idle.get(state, state), symbol)


#: In state k > 0 a negation reaches k more words; an insult there comes out as a negated one.
NEGATE = Transducer(
    SCOPE + 1,
    {(k, NOT): (SCOPE, NOT) for k in range(SCOPE + 1)} | {(k, HIT): (k - 1, NEGATED_HIT) for k in range(1, SCOPE + 1)},
    {k: k - 1 for k in range(1, SCOPE + 1)},
)
#: No insult, one that holds, or negated ones only.
INSULT = Transducer(3, {(k, HIT): (1, HIT) for k in range(3)} | {(0, NEGATED_HIT): (2, NEGATED_HIT)})
THREATEN = Transducer(2, {(0, THREATS): (1, THREATS)})
AIM = Transducer(2, {(0, AT): (1, AT)})
TELL = Transducer(2, {(0, SAYS): (1, SAYS)})
PARTS = (NEGATE, INSULT, THREATEN, AIM, TELL)


def reading(states: tuple[int, ...]) -> int | None:
    """How a clause is read that ends in these states of PARTS; None: it says nothing."""
    _, insult, threat, aim, tell = states
    if not insult:
        return THREATENED if threat and aim else None
    if insult == 2:
        return NEGATED
    if tell:
        return REPORTED
    return THREATENED if threat else AIMED if aim else PLAIN


class Machine:
    """The composition of transducers, each fed with what the one before puts out: one table of arcs over the tuples of states that are met."""

    def __init__(self, parts: tuple[Transducer, ...], symbols: range):
        number = {tuple([0] * len(parts)): 0}
        self.arcs: list[list[int]] = []
        todo = list(number)
        while todo:
            row = []
            for symbol in symbols:
                at, out = [], symbol
                for part, state in zip(parts, todo[0], strict=True):
                    state, out = part.step(state, out)
                    at.append(state)
                if tuple(at) not in number:
                    number[tuple(at)] = len(number)
                    todo.append(tuple(at))
                row.append(number[tuple(at)])
            self.arcs.append(row)
            todo.pop(0)
        self.final = [reading(s) for s in number]


def compose() -> Machine:
    return Machine(PARTS, range(STOP))


class Lexicon(dict):
    """The letter trie of weighted stems and fixed words; as a dict, what the words met so far come to.

    `arcs` lead from (node, letter) to a node, `part` holds the weight of the stem that ends at a node, and `whole` the
    (symbol, weight) of a word that does. A word's insult weight is that of the heaviest stem on its way."""

    def __init__(self, stems: dict[str, float], threats: dict[str, float]):
        self.arcs: dict[tuple[int, str], int] = {}
        self.part: dict[int, float] = {}
        self.whole: dict[int, tuple[int, float]] = {}
        self.size = 0
        for stem, weight in stems.items():
            if stem.endswith(END):
                self.whole[self._node(stem.removesuffix(END))] = (HIT, weight)
            else:
                self.part[self._node(stem)] = weight
        for words, symbol in ((REPORT, SAYS), (NEGATION, NOT), (TARGET, AT), (THREAT, THREATS), (".!?;:\n", STOP)):
            for word in words:
                self.whole[self._node(word)] = (symbol, threats.get(word, THREAT_WEIGHT) if symbol == THREATS else 0.0)

    def _node(self, word: str) -> int:
        node = 0
        for letter in word:
            node = self.arcs.setdefault((node, letter), len(self.arcs) + 1)
        return node

    def walk(self, word: str) -> tuple[int, float]:
        node, weight = 0, 0.0
        for letter in word:
            if (node := self.arcs.get((node, letter))) is None:
                break
            weight = max(weight, self.part.get(node, 0.0))
        symbol, own = self.whole.get(node, (HIT, 0.0))
        if symbol != HIT:
            return symbol, own
        weight = max(weight, own)
        return (HIT, weight) if weight else (OTHER, 0.0)

    def __missing__(self, word: str) -> tuple[int, float]:
        self.size += len(word)
        if self.size > 10_000_000:
            self.clear()
            self.size = 0
        got = self[word] = self.walk(word)
        return got


class Grammar:
    """The lexicon and the composed machine; `threats` has learned weights of threat words."""

    def __init__(self, stems: dict[str, float], threats: dict[str, float] | None = None):
        self.lexicon, self.machine = Lexicon(stems, threats or {}), compose()

    def clauses(self, text: str) -> list[tuple[int, float, int]]:
        """(reading, weight, insults) of each clause that the machine accepts. A threat's weight counts in a threat alone."""
        arcs, final = self.machine.arcs, self.machine.final
        out, state, weight, threat, hits = [], 0, 0.0, 0.0, 0
        for symbol, w in map(self.lexicon.__getitem__, TOKEN.findall(text.lower() + "\n")):
            if symbol == STOP:
                if (kind := final[state]) is not None:
                    out.append((kind, weight + threat if kind == THREATENED else weight, hits))
                state, weight, threat, hits = 0, 0.0, 0.0, 0
                continue
            state = arcs[state][symbol]
            if symbol == HIT:
                weight += w
                hits += 1
            elif symbol == THREATS:
                threat += w
        return out

    def features(self, text: str) -> list[float]:
        """log(1 + summed weight) of each reading, the heaviest clause, log(1 + insults), and their share of words."""
        total, most, hits = [0.0] * 5, 0.0, 0
        for kind, weight, n in self.clauses(text):
            total[kind] += weight
            most = max(most, weight)
            hits += n
        words = text.count(" ") + 1
        return [*map(math.log1p, total), most / 10, math.log1p(hits), math.log1p(100 * hits / words)]


def _stems(text: str) -> set[str]:
    return {s for w in set(TOKEN.findall(text.lower())) for s in _ways(w)}


def _ways(word: str) -> list[str]:
    """The stems that a word passes: its beginnings, and the word to its end."""
    if len(word) < SHORTEST:
        return []
    return [*(word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1)), word + END]


def _told(stems: dict[str, int]) -> list[str]:
    """Stems that no longer one of nearly the same texts makes needless."""
    longer = {s[:-1] for s, n in stems.items() if n >= 0.9 * stems.get(s[:-1], math.inf)}
    return [s for s in stems if s not in longer]


def _without_copies(rows: DataFrame) -> DataFrame:
    """name, text, toxic: one of equal texts (but for case and space) and of near copies, with the largest label.

    A near copy has the least hash of the runs of four words in common with the first text of that hash by digest, and
    is similar to it by its words; any other text stays. The result does not depend on the order of rows."""

    def keyed(frames):
        for frame in frames:
            yield frame.assign(name=[xxhash.xxh3_128_hexdigest(" ".join(t.lower().split())) for t in frame["text"]], key=[_copy_key(t) for t in frame["text"]])

    once = rows.mapInPandas(keyed, "text string, toxic int, name string, key long").groupBy("name").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"), F.min("key").alias("key"))
    once = staged(once, "toxic-texts")
    first = once.groupBy("key").agg(F.min(F.struct("name", "text")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")

    def confirm(frames):
        for frame in frames:
            of = [f["name"] if f is not None and similar(t, f["text"], 4, 0.8) else n for n, t, f in zip(frame["name"], frame["text"], frame["first"], strict=True)]
            yield pd.DataFrame({"of": of, "toxic": frame["toxic"]})

    met = once.join(first.drop("n"), "key", "left").select("name", "text", "toxic", "first").mapInPandas(confirm, "of string, toxic int")
    kept = met.groupBy("of").agg(F.max("toxic").alias("toxic")).withColumnRenamed("of", "name")
    return staged(once.drop("toxic", "key").join(kept, "name"), "toxic-rows")


def _copy_key(text: str) -> int:
    """Least hash of the runs of four words: near copies mostly share it."""
    words = text.lower().split()
    return min((xxhash.xxh64_intdigest(" ".join(words[i : i + 4])) for i in range(max(1, len(words) - 3))), default=0) - (1 << 63)


class Model:
    """The grammar and the logistic weights over its features."""

    def __init__(self, grammar: Grammar, weights: np.ndarray, bias: float):
        self.grammar, self.weights, self.bias = grammar, weights, bias

    def score(self, text: str) -> float:
        f = self.grammar.features(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(self.weights, f)) + self.bias))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps; without both classes, the smoothed rate alone."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    if len(y) == 0 or y.min() == y.max():
        return np.zeros(x.shape[1] if x.ndim == 2 else 8), math.log(rate / (1 - rate)) if len(y) else -2.0
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    w[-1] = math.log(rate / (1 - rate))
    pull = np.full(a.shape[1], ridge)
    pull[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + pull * w
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(pull)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from labelled rows whose crc32 remainder is not 2; at most about `sample` of them.

    Rows with a null label, or a text that is null or empty, teach nothing. A doc_id labelled
    twice takes its largest label. Without toxic rows no stem is learned and
    every score is the same. Ties and the order of rows change nothing. Texts of any length are read whole;
    an empty table teaches nothing. Other columns, whatever their names, are left behind."""
    spark = docs.sparkSession
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.where(crc_remainder("doc_id", 4) != 2)
    n = marks.count()
    marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, sample / max(n, 1)) * (1 << 20)) + 1)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("length(text) > 0").join(marks, "doc_id")

    rows = _without_copies(rows.select("text", "toxic"))
    third = F.pmod(F.xxhash64("name"), F.lit(3)) == 0

    def count(known, toxic):
        def run(frames):
            total: Counter = Counter()
            for frame in frames:
                for text in frame["text"]:
                    total.update(_stems(text) if known is None else known.value & _stems(text))
                if len(total) > 500_000:
                    yield pd.DataFrame({"stem": list(total), "n": list(total.values())})
                    total = Counter()
            if total:
                yield pd.DataFrame({"stem": list(total), "n": list(total.values())})

        return rows.where(~third & (F.col("toxic") == toxic)).mapInPandas(run, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))

    sizes = {r["toxic"]: r["n"] for r in rows.where(~third).groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    least = max(MIN_DOCS, MIN_SHARE * n1)
    found = count(None, 1).where(F.col("n") >= least).collect()  # stems of a share of at most `sample` rows
    hot = {r["stem"]: r["n"] for r in found}
    known = spark.sparkContext.broadcast(frozenset(hot))
    cold = {r["stem"]: r["n"] for r in count(known, 0).collect()} if hot else {}  # no more than `hot`

    def weight(stem):
        p, q = hot[stem], cold.get(stem, 0)
        return math.log((p + 0.5) / (n1 + 1)) - math.log((q + 0.5) / (n0 + 1)) - math.sqrt(1 / (p + 0.5) + 1 / (q + 0.5))

    stems = {s: w for s in sorted(_told(hot)) if (w := weight(s)) >= MIN_WEIGHT}
    threats = {t: max(THREAT_WEIGHT, weight(t + END)) for t in sorted(THREAT) if t + END in hot}
    held = spark.sparkContext.broadcast(Grammar(stems, threats))

    def featured(frames):
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"f": [held.value.features(t) for t in frame["text"]], "toxic": frame["toxic"]})

    got = rows.where(third).mapInPandas(featured, "f array<double>, toxic int").collect()  # bounded by `sample`
    got.sort(key=lambda r: (r["toxic"], r["f"]))
    w, b = logistic(np.array([r["f"] for r in got]), np.array([float(r["toxic"]) for r in got]))
    return Model(Grammar(stems, threats), w, b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score DOUBLE from 0 to 1 for every row of docs; a null text counts as empty.

    Rows stay as often as they stand there, null ids too; other columns are left behind. No rows give none."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            scores = [sent.value.score(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return score(docs, fit(docs, labels)).select("doc_id", (crc_remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= LEVEL).cast("int").alias("predicted"))
