import random

import numpy as np
import xxhash

from lumenframe.llm.simhash import BKForest, SimHash, fingerprint, hex_digits, near_duplicates, near_links, shard_links, slice_links, tables


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_classes(fps, radius=4):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return label


def test_fingerprints():
    rng = random.Random(1)
    texts = ["", None, "One", "a b c", "A b C d", "  x\ty\nz w v ", "é É ü " * 5]
    texts += [" ".join(rng.choices(["ab", "c", "é", "Q"], k=rng.randint(1, 80))) for _ in range(30)]
    for t in texts:
        assert fingerprint((t or "").encode()) % (1 << 64) == brute_fingerprint(t)


def clustered(seed, n):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)]
    out = {0}
    while len(out) < n:
        v = rng.choice(centres) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 7)):
            v ^= 1 << rng.randrange(64)
        out.add(v)
    return sorted(out)


def test_tables_cover_every_pair_within_the_radius():
    rng = random.Random(2)
    for blocks in (5, 6, 7, 8):
        masks = tables(blocks, 4)
        for _ in range(300):
            flip = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(flip & (m % (1 << 64)) == 0 for m in masks)


def test_forest_finds_what_brute_force_finds():
    values = np.array(clustered(3, 200), np.uint64)
    forest = BKForest(values, np.zeros(200, int))
    got = {(int(a), int(b)) for q, n in forest.within(values, np.zeros(200, int), 4) for a, b in zip(q, n, strict=True)}
    want = {(i, j) for i in range(200) for j in range(200) if (int(values[i]) ^ int(values[j])).bit_count() <= 4}
    assert got == want


def test_links_of_a_slice():
    tree, queries = np.array([1, 0xFFFF0000], np.uint64), np.array([3, 1 << 63], np.uint64)
    a, b = slice_links(queries, tree, 4, pairs=1)
    # 1 is the root of what it reaches: 3 by one bit, the top bit by two.
    assert sorted(zip(a.view(np.uint64).tolist(), b.view(np.uint64).tolist())) == [(3, 1), (1 << 63, 1)]
    a, b = shard_links(np.array([5, 5, 5, 6]), np.array([1, 3, 0xFFFF0000, 7], np.uint64), 4, pairs=1)
    assert [sorted(map(int, e)) for e in zip(a, b, strict=True)] == [[1, 3]]


def test_connected_subtrees_are_left_out():
    """A crowd around one value, large enough for labels: the links connect what brute force connects."""
    rng = random.Random(9)
    values = {0}
    while len(values) < 1500:
        v = rng.choice([0, 0, 0, rng.getrandbits(64)])
        for _ in range(rng.randint(0, 4)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    values = sorted(values)
    a, b = shard_links(np.zeros(len(values), np.int64), np.array(values, np.uint64), 4)
    label = {v: v for v in values}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for x, y in zip(a.view(np.uint64).tolist(), b.view(np.uint64).tolist()):
        label[find(x)] = find(y)
    assert partition([find(v) for v in values]) == partition(brute_classes(values))


def partition(labels):
    first = {}
    return [first.setdefault(x, i) for i, x in enumerate(labels)]


def test_links_with_crowded_shards(spark):
    fps = clustered(4, 400)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for how in (SimHash(tree_size=16), SimHash(blocks=6)):
        label = {f: f for f in fps}

        def find(x):
            while label[x] != x:
                x = label[x]
            return x

        for r in near_links(df, how).collect():
            label[find(r.a % (1 << 64))] = find(r.b % (1 << 64))
        assert partition([find(f) for f in fps]) == partition(brute_classes(fps))


def test_near_duplicates(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    rows = [(None, "a b c d e f"), (90, None), (91, ""), (91, "x"), (92, "X")]
    for k in range(12):
        base = rng.choices(words, k=120)
        for c in range(3):
            copy = list(base)
            for _ in range(c):
                copy[rng.randrange(120)] = "zz"
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(df.repartition(3)).withColumn("fp", hex_digits("fp")).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    label = brute_classes(fps)
    want = []
    for (i, _), f, own in zip(rows, fps, label, strict=True):
        ids = [j for (j, _), x in zip(rows, label, strict=True) if x == own and j is not None]
        want.append((i, f"{f:016x}", min(ids) if ids else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string, fp string")).collect() == []


def test_very_long_texts(spark):
    long = "Word " * 400_000 + "end"
    rows = [(3, long), (1, long.lower()), (2, "other")]
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[3] == got[1] and got[1][1] == 1 and got[3][0] == brute_fingerprint(long)
