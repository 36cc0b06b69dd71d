import numpy as np
import xxhash

from ledgerloom.llm import simhash
from ledgerloom.llm.components import components


def brute_print(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_fingerprints_equal_brute_force():
    for t in [None, "", " \t", "One", "one two three four", "A b c d É e f", "the cat " * 50, " x  y\nz w v u t"]:
        assert simhash.fingerprint(t or "", 4) == brute_print(t)


def test_groups_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [(900, None), (901, ""), (902, "a b c"), (902, "a b c"), (903, "A  b c")]
    got = sorted(map(tuple, simhash.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    prints = [brute_print(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 4]
    roots = union(len(rows), pairs)
    least = {}
    for (d, _), r in zip(rows, roots):
        least[r] = min(least.get(r, d), d)
    assert got == sorted((d, f"{p:016x}", least[r]) for (d, _), p, r in zip(rows, prints, roots))


def test_forest_spans_and_is_shortest():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    near = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 6, dtype=np.uint64)) for _ in range(40)]))
    for same in (True, False):
        a, b = (near, near) if same else (near[::2], near[1::2])
        i, j, d = simhash.forest(a, b, 4, same)
        assert (np.bitwise_count(i ^ j) == d).all() and (d <= 4).all()
        every = near.tolist()
        if same:
            links = [(x, y) for x in range(len(every)) for y in range(x) if bin(every[x] ^ every[y]).count("1") <= 4]
        else:
            links = [(every.index(x), every.index(y)) for x in a.tolist() for y in b.tolist() if bin(x ^ y).count("1") <= 4]
        own = [(every.index(x), every.index(y)) for x, y in zip(i.tolist(), j.tolist())]
        assert union(len(every), own) == union(len(every), links)
        assert len(own) == len(every) - len(set(union(len(every), links)))


def test_tiles_of_any_size_give_the_same_groups(spark):
    rng = np.random.default_rng(1)
    fps = np.unique(np.concatenate([rng.integers(0, 2**63, 50), rng.integers(0, 2**63, 5)[:, None].repeat(20, 1).ravel() ^ (1 << rng.integers(0, 62, 100))]))
    distinct = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    found = [sorted(map(tuple, components(simhash.links(distinct, 4, tile).select("a", "b")).collect())) for tile in (3, 1000)]
    assert found[0] == found[1] and found[0]


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (200, 200), (None, 5)] + [(300, 300 + k) for k in range(1, 400)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100} | {300 + k: 300 for k in range(400)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each(frame):
    words = [f"w{i}" for i in range(100)]
    near = [*words[:97], "other", *words[98:]]
    far = [f"v{i}" for i in range(100)]
    rows = [(4, " ".join(words), "x"), (2, " ".join(near), "y"), (3, " ".join(far), "z"), (3, " ".join(far), "z"), (None, " ".join(words), "n"), (7, None, "e"), (6, "", "e"), (None, "alone", "n")]
    got = simhash.one_of_each(frame(rows, "doc_id long, text string, own string"))
    assert sorted(got.collect(), key=str) == sorted([(2, " ".join(near), "y"), (3, " ".join(far), "z"), (6, "", "e"), (None, "alone", "n")], key=str)
    assert got.columns == ["doc_id", "text", "own"]
    assert simhash.one_of_each(frame([])).count() == 0


def smallest_of_groups(texts):
    """The lowest place of each group of texts joined by pairs of Jaccard similarity 0.8 or more, all pairs tried."""
    sets = [simhash._shingles(t, 5) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return [i for i in range(len(texts)) if root[i] == i]


def test_one_of_each_tries_every_pair(frame):
    """Many texts near one another, of which some pairs are similar and others not."""
    draw = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(400):
        own = list(base)
        for at in draw.integers(0, 120, i % 6):
            own[at] = f"x{draw.integers(0, 30)}"
        if i % 3:  # other words' order: near by fingerprint, far by shingles
            cut = int(draw.integers(20, 100))
            own = own[cut:] + own[:cut]
            own[10 : 10 + i % 40] = own[10 : 10 + i % 40][::-1]
        texts.append(" ".join(own))
    rows = frame(list(enumerate(texts)))
    for radius, members in ((4, 4096), (0, 7)):  # buckets in one tile, and in many
        got = simhash.one_of_each(rows, radius=radius, members=members)
        assert sorted(r["doc_id"] for r in got.collect()) == smallest_of_groups(texts)


def test_one_of_each_finds_pairs_far_by_fingerprint(frame):
    """Short texts, texts extended up to the bound, and a line repeated many times."""
    draw = np.random.default_rng(6)
    texts = []
    for k in range(60):
        words = [f"t{k}v{i}" for i in draw.integers(0, 10**6, 404)]
        texts += [" ".join(words[:9]), " ".join(words[:8])]
        texts += [" ".join(["long", *words[9:92]]), " ".join(["long", *words[9:112]])]  # 80 of 100 shingles
        line = " ".join(words[112:122])
        texts += [" ".join(words[112:404]), " ".join([*words[112:404], *[line] * 40])]
    got = simhash.one_of_each(frame(list(enumerate(texts))))
    kept = sorted(r["doc_id"] for r in got.collect())
    assert kept == smallest_of_groups(texts) == list(range(0, len(texts), 2))


def test_very_long_texts_and_clashing_names(frame):
    long = " ".join(f"w{i % 90_000}" for i in range(200_000))
    rows = [(1, long, 5, 6), (2, long + " end", 5, 6), (3, "short", 5, 6)]
    got = simhash.one_of_each(frame(rows, "doc_id long, text string, node long, id long"))
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3] and got.columns == ["doc_id", "text", "node", "id"]
    groups = simhash.groups(frame(rows, "doc_id long, text string, fp long, component_id long")).collect()
    assert len({r["component_id"] for r in groups if r["doc_id"] < 3}) == 1


def test_empty_table(frame):
    assert simhash.report(frame([])).count() == 0
