"""Context-tree weighting of bytes.

A byte is eight binary decisions; a decision's node is the context, the last d
bytes for d from 0 to `depth`, with the bits decided so far. Each node has the
Krichevsky-Trofimov estimate of its counts, and its weighted probability is half
that and half the product over the contexts one byte longer. From these follows
how much a node's own estimate counts against the longer contexts' when a byte
is scored, across all depths. A context never met in training passes the
decision to the one that is a byte shorter, so every decision's two sides sum
to one.

Nodes are arrays sorted by context and bits, one for each depth and bit; all
steps below are on arrays.
"""

from __future__ import annotations

import numpy as np

DEPTH = 6
START, END = 0xFE, 0xFF  # bytes that UTF-8 never has


def grams(text: bytes, depth: int = DEPTH) -> np.ndarray:
    """Each byte of the text and its end, below the `depth` bytes before it."""
    padded = np.frombuffer(bytes([START]) * depth + text + bytes([END]), np.uint8).astype(np.uint64)
    n = len(text) + 1
    out = np.zeros(n, np.uint64)
    for k in range(depth + 1):
        out |= padded[k : k + n] << np.uint64(8 * (depth - k))
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series from 8 on, and by the recurrence below."""
    x = np.asarray(x, float)
    y, less = x.copy(), np.zeros_like(x)
    for _ in range(8):
        low = y < 8
        if not low.any():
            break
        less[low] += np.log(y[low])
        y[low] += 1
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - less


def estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov block probability."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - 2 * 0.5723649429247001 - log_gamma(n0 + n1 + 1.0)


def _groups(sorted_: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    return np.flatnonzero(new)


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


class Level:
    """Nodes of one depth and bit: key (context and bits so far), counts, weight of the own estimate."""

    __slots__ = ("key", "n0", "n1", "own", "log")

    def __init__(self, key, n0, n1):
        self.key, self.n0, self.n1 = key, n0, n1
        self.own = self.log = None

    def weigh(self, below: tuple[np.ndarray, np.ndarray] | None) -> None:
        """below: (keys, log weighted probabilities) of nodes one byte deeper, keys cut to this depth; None at full depth."""
        e = estimate(self.n0, self.n1)
        if below is None:
            self.log, self.own = e, np.ones(len(e))
            return
        longer = np.bincount(np.searchsorted(self.key, below[0]), below[1], len(self.key)) if len(below[0]) else np.zeros(len(e))
        both = np.logaddexp(e, longer)
        self.log, self.own = both - np.log(2), np.exp(e - both)


def levels(keys: np.ndarray, counts: np.ndarray, depth: int) -> list[Level]:
    """The eight levels of one depth, from sorted distinct keys (context, byte) with their counts."""
    out = []
    for b in range(8):
        node = keys >> np.uint64(8 - b)
        at = _groups(node)
        bit = ((keys >> np.uint64(7 - b)) & np.uint64(1)).astype(bool)
        n1 = np.add.reduceat(np.where(bit, counts, 0.0), at) if len(at) else np.empty(0)
        n = np.add.reduceat(counts.astype(float), at) if len(at) else np.empty(0)
        out.append(Level(node[at], n - n1, n1))
    return out


def shorter(keys: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of contexts cut to `depth` bytes, with summed counts."""
    cut = keys & _mask(8 * (depth + 1))
    value, at = np.unique(cut, return_inverse=True)
    return value, np.bincount(at, counts, len(value)) if len(value) else np.empty(0)


def tree(keys: np.ndarray, counts: np.ndarray, low: int, high: int, below=None) -> dict[int, list[Level]]:
    """Weighted levels of depths `high` down to `low`, from keys of depth `high`.

    below: for each bit, what stands below depth `high` if that is not the last."""
    out: dict[int, list[Level]] = {}
    for d in range(high, low - 1, -1):
        keys, counts = shorter(keys, counts, d)
        out[d] = levels(keys, counts, d)
        for b, level in enumerate(out[d]):
            if d < high:
                child = out[d + 1][b]
                level.weigh((child.key & _mask(8 * d + b), child.log))
            else:
                level.weigh(below[b] if below else None)
    return out


def score(asked: np.ndarray, *trees: dict[int, list[Level]]) -> np.ndarray:
    """log10 probability of each asked key's byte; trees: from the deepest depths to depth 0."""
    total = np.zeros(len(asked))
    deepest_first = [(d, t[d]) for t in trees for d in sorted(t, reverse=True)]
    for b in range(8):
        bit = ((asked >> np.uint64(7 - b)) & np.uint64(1)).astype(bool)
        p = np.full(len(asked), np.nan)
        for d, found in deepest_first:
            level = found[b]
            if not len(level.key):
                continue
            node = (asked & _mask(8 * (d + 1))) >> np.uint64(8 - b)
            at = np.minimum(np.searchsorted(level.key, node), len(level.key) - 1)
            met = level.key[at] == node
            at, deeper = at[met], p[met]
            own = (np.where(bit[met], level.n1[at], level.n0[at]) + 0.5) / (level.n0[at] + level.n1[at] + 1)
            w = level.own[at]
            p[met] = np.where(np.isnan(deeper), own, w * own + (1 - w) * deeper)
        total += np.log10(np.where(np.isnan(p), 0.5, p))
    return total
