import random

import numpy as np

from lumenframe.llm.similar import Similar, representatives, similar_links


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(n, pairs):
    label = list(range(n))
    for i, j in pairs:
        old, new = label[i], label[j]
        label = [new if x == old else x for x in label]
    first = {}
    return [first.setdefault(x, i) for i, x in enumerate(label)]


def brute(sets):
    near = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    return classes(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if near(sets[i], sets[j])])


def test_similar_links_find_what_brute_force_finds():
    rng = random.Random(1)
    for _ in range(20):
        bases = [rng.sample(range(400), rng.randint(3, 60)) for _ in range(6)]
        sets = []
        for _ in range(60):
            base = rng.choice(bases)
            sets.append(set(base) ^ set(rng.sample(range(400), rng.randint(0, 1 + len(base) // 6))) or {1})
        got = similar_links([np.array(sorted(s), np.uint64) for s in sets], 80)
        assert classes(len(sets), got) == brute(sets)


def rows(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    out = [(None, "a b c"), (7000, None), (7001, " "), (7002, "a B c")]
    for _ in range(60):
        base = rng.choices(words, k=rng.randint(60, 300))
        for _ in range(3):
            copy = list(base)
            for _ in range(rng.randint(0, len(base) // 40)):  # from equal down to about 0.75
                copy[rng.randrange(len(copy))] = "zz"
            out.append((len(out), " ".join(copy)))
    return out


def test_copies_of_similarity_0_8_go(spark):
    data = rows(2)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    label = brute([grams(t) for _, t in data])
    least = {}
    for (i, _), x in zip(data, label, strict=True):
        if i is not None:
            least[x] = min(i, least.get(x, i))
    want = sorted((r for r, x in zip(data, label, strict=True) if r[0] == least.get(x)), key=str)
    for how in (Similar(), Similar(group_bytes=1_000)):  # whole groups, and groups in parts
        assert sorted(map(tuple, representatives(df, how).collect()), key=str) == want
    assert representatives(df.limit(0)).collect() == []


def test_stage_uses_it(spark, tmp_path):
    import pytest

    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    words = [f"w{k}" for k in range(120)]
    other = list(words)
    other[40] = other[80] = "zz"  # 10 of 116 shingles differ: 0.84
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, str(tmp_path)).collect()] == [1]
