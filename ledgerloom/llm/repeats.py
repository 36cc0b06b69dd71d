"""Removal of bytes that an earlier document has already, by suffix arrays.

A byte goes if a string of SPAN bytes that covers it also starts in a document
of smaller id. Exact copies are settled by their digests, so one text of each is
looked at further. Texts are packed into pieces of a few megabytes, bucketed on
disk, so that they are shuffled once and later joined where they lie.

Shards are made by content. Of the GRAM-byte hashes within a string of SPAN
bytes the least, leftmost, is its anchor, which equal strings have in common;
strings next to each other mostly share one, and those that do make a segment.
Anchors that two texts share are found from their hashes alone. Segments around
these go, each once a piece, to the shard that their anchor names; all places of
a string come together there. A shard sorts its segments block by block with
suffix arrays, finds from common prefixes which strings are equal, and merges
blocks by binary search. A piece sends each distinct segment once, with the
smallest id it has there: what lies well within a passage of many texts is sent once,
while segments at the passage's edges differ with each text's own bytes. What comes back is, for each distinct segment, a mask of the strings that
an id below that one has too; places within the piece never leave it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import staged
from ledgerloom.llm.packing import one_row, pack, save
from ledgerloom.llm.suffixes import common_prefixes, search, suffix_array, words

SPAN = 50
GRAM = 20
RUN = SPAN - GRAM + 1  # grams in a string, and strings at most in a segment
PIECE = 4 << 20
SHARD = 4 << 20  # bytes of all texts for each shard
BLOCK = 4 << 20  # bytes of segments sorted at once
_PLACE = np.uint64(30)


def _hashes(text: np.ndarray) -> np.ndarray:
    """A mixed hash of the GRAM bytes from each place on; GRAM = 16 + 4."""
    mul = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
    n = len(text) - GRAM + 1
    a = (words(text) ^ mul[2]) * mul[0]
    a ^= a >> np.uint64(29)
    h = (a[:n] * mul[1]) ^ (a[8 : 8 + n] * mul[2]) ^ (a[12 : 12 + n] * mul[3])
    h ^= h >> np.uint64(32)
    h *= mul[1]
    h ^= h >> np.uint64(29)
    return h


class Runs:
    """The segments of a piece: hash of the anchor, first and last string, document."""

    def __init__(self, text: np.ndarray, ends: np.ndarray):
        empty = np.empty(0, np.int64)
        if len(text) < SPAN:
            self.hash, self.first, self.last, self.doc = np.empty(0, np.uint64), empty, empty, empty
            return
        h = _hashes(text)
        least = (h >> _PLACE << _PLACE) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= RUN:  # least of `width`, doubled, then two that overlap
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < RUN:
            least = np.minimum(least[: len(least) - (RUN - width)], least[RUN - width :])
        anchor = (least & np.uint64((1 << 30) - 1)).astype(np.int64)
        start = np.concatenate(([0], ends[:-1]))
        doc = np.repeat(np.arange(len(ends)), ends - start)[: len(anchor)]
        inside = np.arange(len(anchor)) + SPAN <= ends[doc]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(anchor)) - 1
        keep = inside[at]
        self.first, self.last, self.doc = at[keep], last[keep], doc[at[keep]]
        self.hash = h[anchor[self.first]]


def _named(h: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and name within it of an anchor's hash."""
    return ((h >> np.uint64(33)) % np.uint64(shards)).astype(np.int64), h.astype(np.uint32)


def _by_shard(shard: np.ndarray):
    order = np.argsort(shard, kind="stable")
    at = np.flatnonzero(np.diff(shard[order], prepend=-1))
    for a, b in zip(at, [*at[1:], len(order)], strict=True):
        yield int(shard[order[a]]), order[a:b]


def _opened(row) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row.text, np.uint8), np.asarray(row.ends, np.int64)


def _least(seg: np.ndarray, n: int, ids: np.ndarray) -> np.ndarray:
    """The smallest id of each of n segments."""
    out = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(out, seg, ids)
    return out


def _removed(packed: bytes, told: np.ndarray | None, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of a piece's segments for one shard that lose strings, the mask of these, and how many strings each has.

    told: for each distinct segment, the strings that an id below the piece's own smallest has. All of a segment goes from
    texts of larger id than that."""
    raw = zlib.decompress(packed)
    (n,) = struct.unpack_from("<q", raw)
    count = np.frombuffer(raw, np.uint8, n, 8).astype(np.uint32) - np.uint32(SPAN - 1)
    seg, place = np.frombuffer(raw[8 + n :], np.uint32).reshape(2, -1)
    place, count = place.astype(np.int64), count[seg]
    own = ids[np.searchsorted(ends, place, side="right")]
    mask = np.where(own > _least(seg, n, own)[seg], (np.uint32(1) << count) - np.uint32(1), np.uint32(0) if told is None else told[seg])
    hit = mask > 0
    return place[hit], mask[hit], count[hit]


def remove(docs: DataFrame, piece: int = PIECE, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs [start, end) of bytes), kept_sha256, for each row of docs(doc_id, text).

    A null text counts as empty. A row with a null doc_id is compared with
    nothing, and keeps all. Rows of one doc_id are never smaller than each other. Other
    columns are left behind, whatever their names. Ids are compared as integers. A text may have any length that
    a piece can hold (2^30 bytes with its neighbours; more stops the job). An empty table gives no rows."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumns({"key": F.md5("text"), "n_bytes": F.length("text").cast("long")})
    short = F.col("doc_id").isNull() | (F.col("n_bytes") < SPAN)
    known = staged(rows.select("doc_id", "key", "n_bytes", F.when(short, F.sha2("text", 256)).alias("whole")), "ids")
    long = known.where(f"doc_id IS NOT NULL AND n_bytes >= {SPAN}")
    first = long.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n_bytes").alias("size"))
    total = first.agg(F.sum("size")).first()[0] or 0
    pieces, shards = max(1, -(-total // piece)), max(1, -(-total // shard))
    dealt = F.pmod(F.xxhash64("key", "doc_id"), F.lit(pieces)).alias("piece")
    texts = rows.where(f"doc_id IS NOT NULL AND n_bytes >= {SPAN}").select(dealt, "key", "doc_id", "text")

    def pack_firsts(frame, firsts):
        wanted = set(zip(firsts["doc_id"], firsts["key"], strict=True))
        own = {(d, k): bytes(t) for _, k, d, t in frame.itertuples(index=False, name=None) if (d, k) in wanted}  # a repeated row stands once
        keys = sorted(own)
        if sum(map(len, own.values())) >= 1 << 30:
            raise ValueError("a piece of a gigabyte or more: its positions would not fit")
        if not keys:
            return pd.DataFrame(columns=["piece", "ids", "keys", "ends", "text"])
        return one_row(piece=frame["piece"].iloc[0], ids=[d for d, _ in keys], keys=[k for _, k in keys], ends=np.cumsum([len(own[k]) for k in keys]).tolist(), text=b"".join(own[k] for k in keys))

    held = pack(texts, pieces, pack_firsts, "piece long, ids array<long>, keys array<string>, ends array<long>, text binary", first.select(dealt, "key", "doc_id"))
    table = held.table

    def anchors(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                runs = Runs(*_opened(row))
                where, names = _named(runs.hash, shards)
                out = []
                for s, own in _by_shard(where):
                    order = own[np.argsort(names[own], kind="stable")]
                    value, at = np.unique(names[order], return_index=True)
                    doc = runs.doc[order]
                    several = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
                    out.append((s, row.piece, value.tobytes(), np.packbits(several).tobytes()))
                if out:
                    yield pd.DataFrame(out, columns=["shard", "piece", "names", "several"])

    def shared(key, frame):
        lists = [np.frombuffer(x, np.uint32) for x in frame["names"]]
        whole = np.concatenate(lists)
        within = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=len(v)).astype(bool) for b, v in zip(frame["several"], lists, strict=True)])
        value, at, count = np.unique(whole, return_inverse=True, return_counts=True)
        hot = count > 1
        hot[at[within]] = True
        mine = [v[hot[a]] for v, a in zip(lists, np.split(at, np.cumsum([len(v) for v in lists])[:-1]), strict=True)]
        got = pd.DataFrame({"shard": key[0], "piece": frame["piece"], "names": [m.tobytes() for m in mine]})
        return got[[len(m) > 0 for m in mine]]

    found = table.mapInPandas(anchors, "shard long, piece long, names binary, several binary").groupBy("shard").applyInPandas(shared, "shard long, piece long, names binary")

    def segments(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                if row.answers is None or not len(row.answers):
                    continue
                runs = Runs(*_opened(row))
                where, names = _named(runs.hash, shards)
                told = {a["shard"]: np.frombuffer(a["names"], np.uint32) for a in row.answers}
                out = []
                for s, own in _by_shard(where):
                    if (known_here := told.get(s)) is None:
                        continue
                    at = np.minimum(np.searchsorted(known_here, names[own]), len(known_here) - 1)
                    own = np.sort(own[known_here[at] == names[own]])
                    number: dict[bytes, int] = {}
                    seg = [number.setdefault(row.text[a : b + SPAN], len(number)) for a, b in zip(runs.first[own].tolist(), runs.last[own].tolist(), strict=True)]
                    seg = np.array(seg, np.uint32)
                    least = _least(seg, len(number), np.asarray(row.ids, np.int64)[runs.doc[own]])
                    sizes = np.fromiter(map(len, number), np.uint8, len(number)).tobytes()
                    head = struct.pack("<q", len(number))
                    places = b"".join([head, sizes, seg.tobytes(), runs.first[own].astype(np.uint32).tobytes()])
                    out.append((s, row.piece, zlib.compress(b"".join([head, least.tobytes(), sizes, *number]), 1), zlib.compress(places, 1)))
                if out:
                    yield pd.DataFrame(out, columns=["shard", "piece", "segments", "places"])

    # Written where the pieces lie: segments alone go to the shards, places wait for the masks.
    sent, drop_sent = save(held.with_answers(found, "names").mapInPandas(segments, "shard long, piece long, segments binary, places binary"), held.buckets, "piece", "segments")

    def settle(key, frame):
        number: dict[bytes, int] = {}
        own, least = [], []
        for packed_ in frame["segments"]:
            raw = zlib.decompress(packed_)
            (n,) = struct.unpack_from("<q", raw)
            at = 8 + 8 * n
            stops = np.cumsum(np.frombuffer(raw, np.uint8, n, at).astype(np.int64)) + at + n
            own.append(np.fromiter((number.setdefault(raw[a:b], len(number)) for a, b in zip([at + n, *stops[:-1].tolist()], stops.tolist(), strict=True)), np.int64, n))
            least.append(np.frombuffer(raw, np.int64, n, 8).copy())
        bounds = np.cumsum([len(x) for x in own])[:-1]
        seg, ids = np.concatenate(own), np.concatenate(least)
        own.clear()
        least.clear()
        texts = list(number)
        number.clear()
        minima, starts, counts = least_ids(texts, _least(seg, len(texts), ids), block)
        mask = np.zeros(len(seg), np.uint32)
        for k in range(RUN):
            has = np.flatnonzero(counts[seg] > k)
            mask[has] |= (minima[starts[seg[has]] + k] < ids[has]).astype(np.uint32) << np.uint32(k)
        out = [(key[0], p, m.tobytes()) for p, m in zip(frame["piece"], np.split(mask, bounds), strict=True) if m.any()]
        return pd.DataFrame(out, columns=["shard", "piece", "masks"])

    settled = sent.select("shard", "piece", "segments").groupBy("shard").applyInPandas(settle, "shard long, piece long, masks binary")

    def finish(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                text, ends = _opened(row)
                gone = np.zeros(len(text) + SPAN + RUN + 1, np.int64)
                told = {a["shard"]: np.frombuffer(a["masks"], np.uint32) for a in (row.answers if row.answers is not None else ())}
                own = [_removed(a["places"], told.get(a["shard"]), np.asarray(row.ids, np.int64), ends) for a in (row.parts if row.parts is not None else ())]
                if own:
                    place, mask, count = map(np.concatenate, zip(*own, strict=True))
                    whole = mask == (np.uint32(1) << count) - np.uint32(1)
                    np.add.at(gone, place[whole], 1)
                    np.add.at(gone, place[whole] + count[whole] + (SPAN - 1), -1)
                    place, mask = place[~whole], mask[~whole]
                    for k in range(RUN):
                        at = place[(mask >> np.uint32(k)) & 1 == 1] + k
                        np.add.at(gone, at, 1)
                        np.add.at(gone, at + SPAN, -1)
                gone = np.cumsum(gone[: len(text)]) > 0
                out = []
                for key, a, b in zip(row.keys, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    cut = gone[a:b]
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], cut.astype(np.int8), [0]))))
                    out.append((key, edges.reshape(-1, 2).tolist(), text[a:b][~cut].tobytes()))
                for at in range(0, len(out), 500):
                    yield pd.DataFrame(out[at : at + 500], columns=["key", "spans", "kept"])

    parts = sent.groupBy("piece").agg(F.collect_list(F.struct("shard", "places")).alias("parts"))
    done = held.with_answers(settled, "masks").join(parts.hint("shuffle_hash"), "piece", "left").mapInPandas(finish, "key string, spans array<array<long>>, kept binary")
    done = done.select("key", "spans", F.sha2("kept", 256).alias("kept_sha256"))
    # Copies and first texts: what they keep follows from the digest alone. One row a text is written
    # first, so that the join of all rows with it is of two plain exchanges, and a hot digest can be split.
    told = staged(first.select("key", F.col("doc_id").alias("first_id")).join(done, "key", "left"), "told")
    held.drop()
    drop_sent()
    whole = known.join(told, "key", "left")
    plain = F.col("doc_id").isNull() | (F.col("n_bytes") < SPAN)
    copy = F.col("doc_id") > F.col("first_id")
    everything = F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes")))
    return whole.select(
        "doc_id",
        "n_bytes",
        F.when(plain, F.array().cast("array<array<bigint>>")).when(copy, everything).otherwise(F.col("spans")).alias("spans"),
        F.when(plain, F.col("whole")).when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


def least_ids(texts: list[bytes], lowest: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every string of SPAN bytes of the segments, the smallest id among its equals.

    `minima[starts[i] + k]` is that of the k-th string of segment i, of counts[i] strings.
    Blocks of segments have a suffix array each; the distinct strings of one are
    searched in the others."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = sizes - SPAN + 1
    starts = np.cumsum(counts) - counts
    minima = np.empty(int(counts.sum()), np.int64)
    blocks = []
    part = np.cumsum(sizes) // block if len(sizes) else np.empty(0, np.int64)
    for p in np.unique(part):
        own = np.flatnonzero(part == p)
        text = np.frombuffer(b"".join(texts[own[0] : own[-1] + 1]), np.uint8)
        key = words(text)
        order, _ = suffix_array(text, key)
        share = common_prefixes(text, order, key)
        seg = np.repeat(own, sizes[own])
        inner = np.arange(len(text)) - np.repeat(np.cumsum(sizes[own]) - sizes[own], sizes[own])
        label = np.cumsum(share < SPAN) - 1
        real = (inner < counts[seg])[order]  # strings that lie within a segment
        place, label = order[real], label[real]
        if not len(place):
            continue
        head = np.flatnonzero(np.diff(label, prepend=-1))
        least = np.minimum.reduceat(lowest[seg[place]], head)
        group = np.cumsum(np.diff(label, prepend=-1) != 0) - 1
        slot = starts[seg[place]] + inner[place]
        rep = place[head]
        columns = tuple(key[rep + k] for k in (0, 8, 16, 24, 32, 40, SPAN - 8))
        blocks.append((columns, least, slot, group))
    merged = [b[1].copy() for b in blocks]
    for i, (cols, least, _, _) in enumerate(blocks):
        for j, (others, theirs, _, _) in enumerate(blocks):
            if i != j:
                at = search(cols, others)
                hit = at >= 0
                merged[i][hit] = np.minimum(merged[i][hit], theirs[at[hit]])
    for (_, _, slot, group), least in zip(blocks, merged, strict=True):
        minima[slot] = least[group]
    return minima, starts, counts


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + F.get(s, 1) - F.get(s, 0))
    return remove(docs).select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
