"""SimHash fingerprints and near-duplicate groups by tiled exact comparison.

Distinct fingerprints are classed by the bit counts of their two halves and
dealt into tiles of bounded size. The counts of two fingerprints within the
radius differ by no more than the radius in sum, so only such tile pairs meet;
a pair is compared whole by numpy exclusive-or and bit counts. A tile pair gives
a shortest spanning forest of its links, never all of them, so a dense group of
copies costs no more than its members. Groups are then found by alternating star
contraction on tables of edges (see components.py).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import fresh, release, shuffle_partitions, slices, staged, text_or_empty
from ledgerloom.llm.components import components

TILE = 16_384
PAIRS = 64  # tile pairs for each task, at most, on average
SEED = 42


def fingerprint(text: str, words: int) -> int:
    """64 bits; a bit is 1 if set in over half the shingles' XXH64. No words: zero."""
    found = text.encode().lower().split()  # bytes.lower and bytes.split know ASCII only
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(words, len(found)) - 1 :] - 1).tolist()
    hashed = xxhash.xxh64_intdigest
    h = np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    total = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        part = h[at : at + 4096]
        total += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """doc_id LONG, fp LONG (the 64 bits, signed) for each row; a null text has no words."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t or "", words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def span(n: int, left: np.ndarray, right: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Places of links that form a shortest spanning forest of `n` nodes.

    Links are taken by distance. At each, every component that has a link to one
    of lower label hooks onto the lowest such, so no circle can close; labels
    then jump to their roots until no link joins two components."""
    root, kept = np.arange(n), []
    for d in np.unique(far):
        at = np.flatnonzero(far == d)
        while len(at):
            x, y = root[left[at]], root[right[at]]
            apart = x != y
            at, x, y = at[apart], x[apart], y[apart]
            if not len(at):
                break
            high, low = np.maximum(x, y), np.minimum(x, y)
            order = np.lexsort((low, high))
            top, first = np.unique(high[order], return_index=True)
            chosen = order[first]
            kept.append(at[chosen])
            root[top] = low[chosen]
            while True:
                jumped = root[root]
                if (jumped == root).all():
                    break
                root = jumped
    return np.concatenate(kept) if kept else np.empty(0, np.int64)


def forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shortest spanning forest (a, b, distance) of the links of two tiles, or within one."""
    held = [np.empty(0, np.int64)] * 3
    parts, size = [], 0
    step = max(1, (1 << 16) // max(1, len(b)))

    def thinned():
        i, j, d = (np.concatenate([held[k], *(p[k] for p in parts)]) for k in range(3))
        keep = span(len(a) if same else len(a) + len(b), i, j if same else j + len(a), d)
        return [i[keep], j[keep], d[keep]]

    for at in range(0, len(a), step):
        far = np.bitwise_count(a[at : at + step, None] ^ b[None, :])
        near = np.flatnonzero(far.ravel() <= radius)
        if len(near):
            i, j = near // len(b) + at, near % len(b)
            d = far.ravel()[near].astype(np.int64)
            if same:
                i, j, d = i[i < j], j[i < j], d[i < j]
            parts.append((i, j, d))
            size += len(i)
            if size > 4 << 20:
                held, parts, size = thinned(), [], 0
    i, j, d = thinned()
    return a[i], b[j], d


BASE = 33


def _class(fp):
    """Bit counts of the two halves, as one number."""
    low, high = (F.bit_count(F.shiftrightunsigned(fp, k).bitwiseAND(F.lit(0xFFFFFFFF))) for k in (0, 32))
    return (low * BASE + high).cast("int")


def links(distinct: DataFrame, radius: int, tile: int = TILE, held: list[str] | None = None) -> DataFrame:
    """Links (a, b, distance) that span the groups of the distinct fingerprints `fp`.

    A class of n fingerprints has ceil(n / tile) tiles, dealt by hash, so a
    large class is spread. There are at most 33 squared classes: their sizes and
    neighbours are lists of fixed bound. Pairs of tiles are named first and the
    tiles' bytes joined to them after, so what moves is a tile for each
    pair, not fingerprint pairs."""
    spark = distinct.sparkSession
    classed = distinct.select("fp", _class(F.col("fp")).alias("class"))
    counts = classed.groupBy("class").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    tiles = {r["class"]: r["tiles"] for r in counts.collect()}  # at most 33 * 33 rows
    if not tiles:
        return spark.createDataFrame([], "a long, b long, distance long")
    width = F.element_at(F.create_map(*[F.lit(x) for kv in tiles.items() for x in kv]), F.col("class"))
    dealt = classed.withColumn("tile", F.pmod(F.xxhash64(F.lit(7), "fp"), width).cast("int"))
    packed = staged(dealt.groupBy("class", "tile").agg(F.collect_list("fp").alias("fps")), "tiles", held)
    nears = []
    for c in tiles:
        for e in tiles:
            (x, y), (v, w) = divmod(c, BASE), divmod(e, BASE)
            if c <= e and abs(x - v) + abs(y - w) <= radius:
                nears.append((c, e))
    ids = packed.select("class", "tile")
    pairs = ids.join(F.broadcast(spark.createDataFrame(nears, "class int, class_b int")), "class")
    pairs = pairs.join(ids.toDF("class_b", "tile_b"), "class_b").where("class < class_b or tile <= tile_b")
    joined = pairs.join(packed.toDF("class_b", "tile_b", "fps_b").hint("shuffle_hash"), ["class_b", "tile_b"])
    joined = joined.join(packed.hint("shuffle_hash"), ["class", "tile"])
    joined = joined.select("fps", "fps_b", ((F.col("class") == F.col("class_b")) & (F.col("tile") == F.col("tile_b"))).alias("same"))

    def run(batches):
        for batch in batches:
            out = [[], [], []]
            for x, y, same in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
                x, y = (np.sort(v.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) for v in (x, y))
                for o, v in zip(out, forest(x, y, radius, same), strict=True):
                    o.append(v.astype(np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out], ["a", "b", "distance"])

    sizes = sum(tiles[c] * tiles[e] for c, e in nears)
    spread = joined.repartition(max(8 * shuffle_partitions(spark), -(-sizes // PAIRS)))
    return spread.mapInArrow(run, "a long, b long, distance long")


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """doc_id LONG, fp LONG, component_id LONG for each row.

    component_id is the smallest id reachable over links of at most `radius`
    differing bits, the row itself included. Null ids are passed over by that
    minimum; a group of null ids only has a null component. Texts that are null
    or without words have fingerprint zero, which links like any other. Rows of
    one fingerprint, however many, are one node; repeated rows stay repeated. A
    text may have any length. Other columns are left behind, whatever their
    names. An empty table gives no rows."""
    fps = staged(fingerprints(df, id_col, text_col, words), "fps")
    distinct = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    found = components(links(distinct, radius).select("a", "b"))
    rooted = distinct.join(found.toDF("fp", "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def report(df: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return groups(df).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _shingles(text: str, words: int) -> set[bytes]:
    found = text.encode().lower().split()
    return {b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))}


def similar(a: str, b: str, words: int, least: float) -> bool:
    """Whether the texts' sets of shingles have a Jaccard similarity of `least` or more."""
    x, y = _shingles(a, words), _shingles(b, words)
    both = len(x & y)
    return both >= least * (len(x) + len(y) - both)


CELLS, CHUNK = 1 << 20, 1 << 12
MEMBERS = 4096  # nodes of a shingle's bucket that one tile has
RADIUS = 4  # bits by which fingerprints of the first candidates differ
SLACK = 1e-9  # a product of `least` may be rounded up; a bound never cuts by that


def _hashes(text: str, words: int) -> np.ndarray:
    """A hash of each distinct shingle, sorted: its words' hashes are mixed by place."""
    found = text.encode().lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    n, width = max(1, len(h) - words + 1), min(words, len(h))
    mixed = np.full(n, width, np.uint64)
    for k in range(width):
        mixed = (mixed ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xC2B2AE3D27D4EB4F)
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def _majority(h: np.ndarray) -> int:
    """The fingerprint of distinct shingles: a bit is 1 if set in over half of them; signed."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        part = h[at : at + 4096]
        total += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.int64)[0])


def _commonness(texts: DataFrame, words: int) -> np.ndarray:
    """A byte for each of CELLS cells of shingle hashes: how often its shingles occur, in half powers of two."""

    def count(batches):
        held = np.zeros(CELLS, np.uint32)
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                np.add.at(held, _hashes(text, words) & np.uint64(CELLS - 1), 1)
        parts = held.reshape(-1, CHUNK)
        for at in np.array_split(np.flatnonzero(parts.any(axis=1)), 16):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([parts[k].tobytes() for k in at], pa.binary())], ["chunk", "counts"])

    def total(found: pa.Table) -> pa.Table:
        n = sum(np.frombuffer(v.as_buffer(), np.uint32).astype(np.int64) for v in found["counts"])
        return pa.table({"chunk": found["chunk"][:1], "level": pa.array([np.rint(2 * np.log2(1 + n)).astype(np.uint8).tobytes()], pa.binary())})

    level = np.zeros((CELLS // CHUNK, CHUNK), np.uint8)
    for row in texts.mapInArrow(count, "chunk int, counts binary").groupBy("chunk").applyInArrow(total, "chunk int, level binary").collect():  # CELLS bytes
        level[row["chunk"]] = np.frombuffer(row["level"], np.uint8)
    return level.ravel()


def _prefix(h: np.ndarray, level: np.ndarray, least: float) -> np.ndarray:
    """The rarest shingles by the common order, so many that a similar set must share one."""
    rare = np.lexsort((h, level[(h & np.uint64(CELLS - 1)).astype(np.int64)]))
    return h[rare[: len(h) - int(np.ceil(least * len(h) - SLACK)) + 1]]


def _parities(h: np.ndarray) -> np.ndarray:
    """Four words: for each of 256 classes of shingles, whether an odd number is there."""
    odd = np.bincount((h >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


MARKS = ("s0", "s1", "s2", "s3")


def _apart(least: float) -> float:
    """The share of both sizes by which similar sets may differ."""
    return (1 - least) / (1 + least)


def _possible(a: str, b: str, least: float):
    """Whether sizes and parities of two nodes (struct columns a, b) leave a similarity of `least` open."""
    n, m = F.col(f"{a}.size"), F.col(f"{b}.size")
    far = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in MARKS), F.lit(0))
    return (F.least(n, m) >= least * F.greatest(n, m) - SLACK) & (far <= _apart(least) * (n + m) + SLACK)


def _ordered(a: str, b: str):
    return F.least(F.col(a), F.col(b)).alias("a"), F.greatest(F.col(a), F.col(b)).alias("b")


def _spokes(shared: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of one node of each bucket, which the gram picks, with the others; built-in functions only."""
    member = F.struct("node", "size", "pos", *MARKS)
    centre = shared.groupBy("gram").agg(F.min(F.struct(F.xxhash64("node", "gram").alias("turn"), member.alias("c"))).alias("least"))
    met = shared.select("gram", member.alias("m")).join(centre.select("gram", "least.c"), "gram")
    overlap = F.least(F.col("m.size") - F.col("m.pos"), F.col("c.size") - F.col("c.pos"))
    enough = overlap >= least / (1 + least) * (F.col("m.size") + F.col("c.size")) - SLACK
    return met.where((F.col("m.node") != F.col("c.node")) & enough & _possible("m", "c", least)).select(*_ordered("m.node", "c.node"))


def _rest(shared: DataFrame, least: float, members: int, held: list[str]) -> DataFrame:
    """Pairs (a, b) of nodes that are in one bucket and have different roots, where sizes, places and parities allow them.

    At the first shingle that two sets share in the common order, all that they share is this one and what comes after
    it in both; a pair for which that is too little in this bucket is left to others. A bucket is dealt into tiles of bounded size, which meet pair by pair, so none is ever whole in one place."""
    spread = shared.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count(F.lit(1)) / members).cast("int").alias("tiles"))
    spread = spread.where("low < high").select("gram", "tiles")
    dealt = shared.join(spread, "gram").withColumn("tile", F.pmod(F.xxhash64(F.lit(11), "node"), F.col("tiles")).cast("int"))
    packed = staged(dealt.groupBy("gram", "tiles", "tile").agg(F.collect_list(F.struct("node", "root", "size", "pos", *MARKS)).alias("m")), "buckets", held)
    alone = packed.where("tiles = 1").select("m", F.lit(None).cast(packed.schema["m"].dataType).alias("n"))
    large = packed.where("tiles > 1")
    names = large.select("gram", "tile")
    pairs = names.join(names.withColumnRenamed("tile", "other"), "gram").where("tile <= other")
    first = pairs.join(large.select("gram", "tile", "m"), ["gram", "tile"])
    both = first.join(large.select("gram", F.col("tile").alias("other"), F.col("m").alias("n")), ["gram", "other"])
    both = both.select("m", F.when(F.col("tile") < F.col("other"), F.col("n")).alias("n"))

    def opened(column):
        node, root, size, pos, *marks = (v.to_numpy(zero_copy_only=False) for v in column.flatten().flatten())
        return node, root, size, size - pos, np.stack(marks, axis=1).view(np.uint64), np.cumsum(np.concatenate(([0], column.value_lengths().fill_null(0).to_numpy()))).tolist()

    def run(batches):
        for batch in batches:
            (node, root, size, after, marks, ends), other = opened(batch.column(0)), opened(batch.column(1))
            out = []
            for at, whole in enumerate(batch.column(1).is_null().to_pylist()):
                x = slice(ends[at], ends[at + 1])
                right = [v[x] for v in (node, root, size, after, marks)] if whole else [v[other[5][at] : other[5][at + 1]] for v in other[:5]]
                order = np.argsort(right[2], kind="stable")  # by size: what is too small or large is never touched
                name, top, count, behind, mark = (v[order] for v in right)
                low = np.searchsorted(count, least * size[x] - SLACK)
                high = np.searchsorted(count, size[x] / least + SLACK, side="right")
                for i, a, b in zip(range(ends[at], ends[at + 1]), low.tolist(), high.tolist(), strict=True):
                    j = np.flatnonzero(top[a:b] != root[i]) + a
                    if whole:
                        j = j[name[j] > node[i]]
                    j = j[np.minimum(after[i], behind[j]) >= least / (1 + least) * (size[i] + count[j]) - SLACK]
                    far = np.bitwise_count(marks[i] ^ mark[j]).sum(axis=1, dtype=np.int64)
                    j = j[far <= _apart(least) * (size[i] + count[j]) + SLACK]
                    if len(j):
                        out.append(np.stack([np.minimum(node[i], name[j]), np.maximum(node[i], name[j])], axis=1))
            found = np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return alone.mapInArrow(run, "a long, b long").unionByName(both.mapInArrow(run, "a long, b long"))


def one_of_each(df: DataFrame, words: int = 5, least: float = 0.8, radius: int = RADIUS, members: int = MEMBERS) -> DataFrame:
    """The rows of df(doc_id, text, ...) without near copies: of each group the row of smallest doc_id stays.

    Groups are the components of all pairs of texts whose sets of shingles of `words` words have a Jaccard
    similarity of `least` or more. First candidates are the links of fingerprints of distinct shingles within `radius`
    bits, found by tiles (see `links`); those of one fingerprint meet its least node. An exact way finds the
    rest: two similar sets share one of their rarest shingles, 1 - `least` of each set and one more in any order common
    to both, so every such pair meets in a shingle's bucket (but for equal 64-bit hashes of different shingles). A
    bucket's members are tried with one centre, and then all pairs of it that are not in one group by then; a pair is
    ruled out only by bounds that no similar pair exceeds. The order is by a count of shingles in cells, which
    decides the cost alone. Equal texts are one node. Null texts count as empty, and empty texts are equal. Null ids come
    after all others. Of rows alike in id and text one stays. A text may have any length. An empty table stays
    empty. All columns stay as they are, whatever their names."""
    node = F.xxhash64(text_or_empty("text"))
    spark = df.sparkSession
    held: list[str] = []
    slim = df.select(node.alias("node"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    level = spark.sparkContext.broadcast(_commonness(slim.select("text"), words))  # CELLS bytes

    def run(batches):
        for batch in slices(batches):
            sets = [_hashes(t, words) for t in batch.column("text").to_pylist()]
            odd = np.array([_parities(h) for h in sets], np.int64).reshape(-1, 4)
            grams = pa.array([_prefix(h, level.value, least).view(np.int64) for h in sets], pa.list_(pa.int64()))
            sizes, prints = (pa.array(v, pa.int64()) for v in ([len(h) for h in sets], [_majority(h) for h in sets]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("doc_id"), sizes, prints, *(pa.array(odd[:, k]) for k in range(4)), grams],
                ["node", "doc_id", "size", "fp", *MARKS, "grams"],
            )

    schema = "node long, doc_id long, size long, fp long, s0 long, s1 long, s2 long, s3 long, grams array<long>"
    alike = [F.first(c).alias(c) for c in ("size", "fp", *MARKS, "grams")]  # rows of one node have one text
    whole = staged(slim.mapInArrow(run, schema).groupBy("node").agg(F.min("doc_id").alias("doc_id"), *alike), "nodes", held)
    nodes, grams = whole.drop("grams"), whole.select("node", "size", F.posexplode("grams").alias("pos", "gram"))
    # The smaller set of a similar pair has their first common shingle within its first (1 - least) / (1 + least).
    early = F.min(F.col("pos") - _apart(least) * F.col("size")) <= SLACK
    met = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), early.alias("early")).where("n > 1 AND early").select("gram")
    shared = staged(grams.drop("size").join(met, "gram").join(nodes.drop("doc_id", "fp"), "node"), "shared", held)

    heads = nodes.groupBy("fp").agg(F.min("node").alias("head"))
    same = nodes.select("node", "fp").join(heads, "fp").where("node != head").select(*_ordered("node", "head"))
    across = links(staged(heads.select("fp"), "distinct", held), radius, held=held).select("a", "b")
    across = across.join(heads.toDF("a", "head"), "a").join(heads.toDF("b", "other"), "b").select(*_ordered("head", "other"))

    def verify(batches):
        for batch in slices(batches):
            ok = [similar(x, y, words, least) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def stand(tried):
        tried = staged(tried.distinct(), "candidates", held)
        wanted = tried.select(F.col("a").alias("node")).unionByName(tried.select(F.col("b").alias("node"))).distinct()
        first = wanted.join(nodes.select("node", F.col("doc_id").alias("first_id")), "node")
        texts = slim.join(first, "node").where(F.col("doc_id").eqNullSafe(F.col("first_id"))).select("node", "text").dropDuplicates(["node"])
        texts = staged(texts, "candidate-texts", held)
        pairs = tried.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")
        return staged(pairs.mapInArrow(verify, "a long, b long"), "similar", held)

    near = same.unionByName(across)
    sized = nodes.select("node", F.struct("size", *MARKS).alias("of"))
    near = near.join(sized.toDF("a", "x"), "a").join(sized.toDF("b", "y"), "b").where(_possible("x", "y", least)).select("a", "b")
    tried = stand(near.unionByName(_spokes(shared, least)))
    grouped = components(tried).toDF("node", "root")
    rest = shared.join(grouped, "node", "left").withColumn("root", F.coalesce("root", "node"))
    linked = tried.unionByName(stand(_rest(rest, least, members, held)))
    rooted = nodes.select("node", "doc_id").join(components(linked), "node", "left")
    rooted = rooted.select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")
    own, kept_node, kept_id = fresh(df, "own", "node", "id")
    kept = rooted.groupBy("root").agg(F.min(order).alias("kept")).select(F.col("kept.node").alias(kept_node), F.col("kept.doc_id").alias(kept_id))
    kept = staged(kept, "kept")
    release(spark, *held)
    whole = df.withColumn(own, node).join(kept, (F.col(own) == F.col(kept_node)) & F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)))
    return whole.dropDuplicates([kept_node, kept_id]).select(*[F.col(f"`{c}`") for c in df.columns])
