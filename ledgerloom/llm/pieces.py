"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is cut where a run of word-start marks begins. No piece of a merge
vocabulary crosses such a place (checked when the model is loaded; if one does,
the text stays whole), so each segment is encoded on its own: an agenda of
adjacent symbol pairs, best score first and leftmost on ties, is worked off
until no pair is a piece. Symbols that are no piece fall back to bytes. Segments
repeat, so a worker keeps those it has met, up to a fixed number. All segments
that an Arrow batch adds are encoded by the sentencepiece library as well, in
one call; a difference stops the task.
"""

from __future__ import annotations

import heapq
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import hold

MARK = "▁"
SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
KEPT = 400_000
KEPT_CHARS = 64 << 20  # characters of the segments kept, about
SHORT = 48
NONE = 1 << 40


class Codec:
    """Encoder and decoder over one model file."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.names = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        self.end, self.unknown = sp.eos_id(), sp.unk_id()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(len(self.names))]
        self.ident = {n: i for i, n in enumerate(self.names) if not special[i]}
        place = {score: k for k, score in enumerate(sorted({sp.get_score(i) for i in self.ident.values()}, reverse=True))}
        self.order = {n: place[sp.get_score(i)] for n, i in self.ident.items()}
        self.byte_id = {int(n[3:5], 16): i for i, n in enumerate(self.names) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.control = {i for i in range(len(self.names)) if sp.is_control(i)}
        self.rank = self.order.get
        self.splits = not any(MARK in n.lstrip(MARK) for n in self.order)
        self.spelt = [n.replace(MARK, " ") for n in self.names]
        self.rest = self.control | {self.unknown, *self.byte_of}
        self.end_bytes = array("i", [self.end]).tobytes()
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.size = 0
        self.odd: dict[str, str] = {}
        if sp.decode(sp.encode(" a  b\t")) != " a  b\t" or sp.decode(sp.encode("a")) != "a":
            raise ValueError("the model's normalizer is not the identity with a leading mark")

    def merge(self, segment: str) -> list[int]:
        """Ids of one segment by the agenda.

        A short segment's agenda is the list of its pairs' ranks in place: the
        first least one is next. A long one's is a heap."""
        if len(segment) > SHORT:
            parts = self._by_heap(segment)
        else:
            rank, none = self.rank, NONE
            parts = list(segment)
            agenda = [rank(x + y, none) for x, y in zip(parts, parts[1:])]
            while agenda and (best := min(agenda)) != none:
                i = agenda.index(best)
                own = parts[i] = parts[i] + parts[i + 1]
                del parts[i + 1], agenda[i]
                if i:
                    agenda[i - 1] = rank(parts[i - 1] + own, none)
                if i < len(agenda):
                    agenda[i] = rank(own + parts[i + 1], none)
        ids: list[int] = []
        for p in parts:
            i = self.ident.get(p)
            if i is not None:
                ids.append(i)
            elif p and self.byte_id:
                ids.extend([self.byte_id[b] for b in p.encode()])
            elif p:
                ids.append(self.unknown)
        return ids

    def _by_heap(self, segment: str) -> list[str]:
        rank = self.rank
        parts: list[str] = list(segment)
        n = len(parts)
        wide = n.bit_length()  # bits of a place
        places, order = (1 << wide) - 1, wide + 20
        heap = []
        for i in range(n - 1):
            r = rank(parts[i] + parts[i + 1])
            if r is not None:  # the rank, then the place; the length tells a stale entry
                heap.append((r << order) | (i << 20) | 2)
        if heap:
            before, after = list(range(-1, n - 1)), [*range(1, n), -1]
            heapq.heapify(heap)
            pop, push = heapq.heappop, heapq.heappush
            while heap:
                top = pop(heap)
                left, size = (top >> 20) & places, top & 0xFFFFF
                right = after[left]
                own = parts[left]
                if not own or right < 0 or len(own) + len(parts[right]) != size:
                    continue
                own = parts[left] = own + parts[right]
                parts[right] = ""
                after[left] = nxt = after[right]
                if nxt >= 0:
                    before[nxt] = left
                    r = rank(own + parts[nxt])
                    if r is not None:
                        push(heap, (r << order) | (left << 20) | (size + len(parts[nxt])))
                prv = before[left]
                if prv >= 0:
                    r = rank(parts[prv] + own)
                    if r is not None:
                        push(heap, (r << order) | (prv << 20) | (size + len(parts[prv])))
        return parts

    def keys(self, text: str) -> list[str]:
        """The segments of a text, each without the mark that it starts with."""
        if not text:
            return []
        if self.splits and MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        whole = MARK + text.replace(" ", MARK)
        return [s[1:] for s in SEGMENT.findall(whole)] if self.splits else [whole[1:]]

    def learn(self, keys: set[str], check: bool = True) -> None:
        """Encodes segments not met before, and holds them against the library.

        Segments live in two generations; the older one is dropped when the
        younger is full, by number or by characters, so those in use stay."""
        if len(self.seen) > KEPT or self.size > KEPT_CHARS:
            self.older, self.seen, self.size = self.seen, {}, 0
            self.odd = {k: v for k, v in self.odd.items() if k in self.older}
        missing = keys.difference(self.seen)
        self.size += sum(map(len, missing))
        older, new = self.older, []
        for k in missing:
            if k in older:
                self.seen[k] = older[k]
            else:
                new.append(k)
        if not new:
            return
        ids = [self.merge(MARK + k) for k in new]
        if check:
            for k, own, theirs in zip(new, ids, self.library.encode(new, num_threads=1), strict=True):
                if own != theirs and k:  # the library gives an empty text no mark
                    raise AssertionError(f"segment {k!r}: {own} here, {theirs} in the library")
        for k, x in zip(new, ids, strict=True):
            self.seen[k] = array("i", x).tobytes()
            if (text := self.spell(x)) != " " + k.replace(MARK, " "):
                self.odd[k] = text

    def packed(self, keys: list[str]) -> bytes:
        """Ids of learnt segments and the end id, as int32."""
        return b"".join(map(self.seen.__getitem__, keys)) + self.end_bytes

    def spelled(self, keys: list[str]) -> str:
        """The decoded text of learnt segments. Decoding goes segment by segment;
        those that do not give back their own text are kept with what they give."""
        if self.odd and not self.odd.keys().isdisjoint(keys):
            return "".join([self.odd.get(k) or " " + k.replace(MARK, " ") for k in keys])[1:]
        return " ".join(keys).replace(MARK, " ")

    def spell(self, ids) -> str:
        """The text of ids, with its leading space; byte ids in a row are UTF-8."""
        names, rest = self.spelt, self.rest
        if rest.isdisjoint(ids):
            return "".join([names[i] for i in ids])
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = bytearray()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i not in self.control:
                out.append(names[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids) -> str:
        text = self.spell(ids)
        return text[1:] if text.startswith(" ") else text

    def encode(self, text: str) -> list[int]:
        found = self.keys(text)
        self.learn(set(found))
        return array("i", self.packed(found)).tolist()


def codec(model_path: str) -> Codec:
    """One codec for each worker and model, until the worker turns to another operator."""
    return hold(("codec", model_path), lambda: Codec(model_path))


def encode_decode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """Returns `id_col`, ids ARRAY<INT> (the end id last) and decoded STRING.

    One row out for each row in, in any order; other columns are left behind,
    so their names cannot clash. A null text counts as empty: its only id is the
    end id and it decodes to the empty text. Repeated rows stay repeated; an
    empty table gives an empty one. A batch's work is bounded by its texts; the
    kept segments by KEPT and KEPT_CHARS. A text or segment may have any length.
    """
    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches):
        c = codec(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cut = [c.keys(t or "") for t in part.column(1).to_pylist()]
                c.learn(set(chain.from_iterable(cut)), check)
                packed = [c.packed(keys) for keys in cut]
                ends = np.cumsum([0, *map(len, packed)]) // 4
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array([c.spelled(keys) for keys in cut], pa.string())], [id_col, "ids", "decoded"])

    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def digests(df: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the operator's outputs."""
    return encode_decode(df, model_path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
