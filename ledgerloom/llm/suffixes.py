"""Suffix arrays of one shard's text, in numpy.

Order: Larsson and Sadakane's refinement. Suffixes are first sorted by eight
bytes; then the groups that are still together, and only those, are split by the
rank of the suffix that starts where the compared bytes end, which doubles what
is compared. Common prefixes: Kasai's, as in the text order (Karkkainen, Manzini
and Puglisi): where the bytes before a suffix and its neighbour agree, the value
is that of the suffix before less one; only the others are compared.
Cross-shard merging: sorted strings of one shard are searched in another's by
binary search, all at once.
"""

from __future__ import annotations

import numpy as np


def words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; beyond the end they are zero."""
    n = len(text)
    out = np.empty(n, np.uint64)
    padded = text.tobytes() + bytes(16)
    for k in range(min(8, n)):  # every eighth place at once, read where it lies
        out[k::8] = np.frombuffer(padded, ">u8", (n - k + 7) // 8, k)
    return out


def suffix_array(text: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of all suffixes; a suffix that ends earlier comes first."""
    n = len(text)
    if n and (text == 0).any():  # zero bytes look like the end: start from single bytes, where nothing is padded
        key, h = text, 1
    else:
        key, h = words(text) if first is None else first, 8
    order = np.argsort(key)
    rank = np.empty(n, np.int64)
    at = np.arange(n)  # places whose group is not settled
    told = key[order]
    while len(at):
        starts = np.ones(len(at), bool)
        starts[1:] = told[1:] != told[:-1]
        head = np.flatnonzero(starts)
        size = np.diff(np.append(head, len(at)))
        rank[order[at]] = np.repeat(at[head], size)
        at = at[np.repeat(size > 1, size)]
        place = order[at]
        nxt = np.where(place + h < n, rank[np.minimum(place + h, n - 1)] + 1, 0)
        mixed = rank[place] * (n + 1) + nxt
        new = np.argsort(mixed)
        order[at], told = place[new], mixed[new]
        h *= 2
    return order, rank


def common_prefixes(text: np.ndarray, order: np.ndarray, key: np.ndarray | None = None) -> np.ndarray:
    """Bytes that each suffix in order shares with the one before it; the first has none."""
    n = len(text)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    key = words(text) if key is None else key
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    i = np.arange(n)
    fresh = (before <= 0) | (i == 0)
    fresh[1:] |= text[:-1] != text[np.maximum(before[1:], 1) - 1]
    start = np.flatnonzero(fresh)
    held = np.zeros(n, np.int64)
    a = start[before[start] >= 0]
    b, size = before[a], np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live):
        x, y = a[live] + size[live], b[live] + size[live]
        inside = np.maximum(x, y) + 8 <= n
        same = np.zeros(len(live), bool)
        same[inside] = key[x[inside]] == key[y[inside]]
        size[live[same]] += 8
        for j in live[~same & ~inside]:  # at the text's end, byte by byte
            while max(a[j], b[j]) + size[j] < n and text[a[j] + size[j]] == text[b[j] + size[j]]:
                size[j] += 1
        ended = live[~same & inside]
        if len(ended):
            differ = key[a[ended] + size[ended]] ^ key[b[ended] + size[ended]]
            size[ended] += sum((differ >> np.uint64(64 - 8 * k) == 0).astype(np.int64) for k in range(1, 8))
        live = live[same]
    held[a] = size
    last = start[np.cumsum(fresh) - 1]
    held = held[last] - (i - last)
    out = held[order]
    out[0] = 0
    return np.maximum(out, 0)


def search(needles: tuple[np.ndarray, ...], keys: tuple[np.ndarray, ...]) -> np.ndarray:
    """Place of each needle among sorted keys, or -1; both are columns compared one after another."""
    n, m = len(needles[0]), len(keys[0])
    low, high = np.zeros(n, np.int64), np.full(n, m)
    while (open_ := low < high).any():
        mid = np.where(open_, (low + high) // 2, 0)
        less, equal = np.zeros(n, bool), np.ones(n, bool)
        for a, b in zip(needles, keys, strict=True):
            less |= equal & (b[mid] < a)
            equal &= b[mid] == a
        low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
    if not m:
        return np.full(n, -1)
    at = np.minimum(low, m - 1)
    hit = low < m
    for a, b in zip(needles, keys, strict=True):
        hit &= b[at] == a
    return np.where(hit, at, -1)
