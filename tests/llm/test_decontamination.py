import random
import re

from lumenframe.llm.decontamination import Phrases, clean_documents, contamination, proximity_matches

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))


def brute(docs, items, size):
    windows = {}
    for i, t in items:
        w = words(t)
        for p in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[p : p + size]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for key, ids in windows.items():
            for p in range(len(w) - len(key) + 1):
                if tuple(w[p : p + len(key)]) == key:
                    hit.update(range(p, p + len(key)))
                    found |= ids
        out.append((i, len(w), len(hit), ",".join(sorted(str(x) for x in found if x is not None))))
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    vocab = ["a", "B", "é", "É", "c3", "dd", "e", "Ff", "日本"]
    text = lambda n: rng.choice([" ", "-", "\n", "\x00."]).join(rng.choices(vocab, k=n))
    items = [(k, text(rng.randint(1, 9))) for k in range(12)] + [(50, None), (51, " . "), (3, "a B c3 dd e"), (None, "dd dd dd dd")]
    docs = [(k, text(rng.randint(0, 60))) for k in range(50)] + [(1, "a b"), (None, text(30)), (70, None), (71, "")]
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, term string, pos int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    for how in (Phrases(4), Phrases(4, broadcast_bytes=0), Phrases(13)):
        got = [(r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in contamination(d, b, how).collect()]
        assert sorted(got, key=str) == sorted(brute(docs, items, how.window), key=str)


def test_empty_sides_and_filter(spark):
    schema = "doc_id long, text string, row int, item_id string"
    d = spark.createDataFrame([(1, "one two three", 5, "q"), (1, "four five", None, None), (2, None, 7, "z")], schema)
    b = spark.createDataFrame([(9, "ONE two")], "item_id long, text string")
    assert sorted(map(tuple, clean_documents(d, b).collect()), key=str) == sorted([(1, "four five", None, None), (2, None, 7, "z")], key=str)
    assert clean_documents(d, b).columns == d.columns
    assert contamination(d.limit(0), b).collect() == [] and contamination(d, b.limit(0)).where("n_hit > 0").collect() == []


def test_proximity(spark):
    d = spark.createDataFrame([(1, "x beta y Alpha z"), (2, "alpha q q q q q beta")], "doc_id long, text string")
    b = spark.createDataFrame([(9, "alpha beta")], "item_id long, text string")
    assert {r.doc_id for r in proximity_matches(d, b, 3).collect()} == {1}


def test_proximity_against_brute_force(spark):
    rng = random.Random(3)
    vocab = ["a", "b", "c", "d", "e", "f", "G"]
    docs = [(k, " ".join(rng.choices(vocab, k=rng.randint(0, 40)))) for k in range(40)]
    items = [(k, " ".join(rng.sample(vocab, rng.randint(1, 4)))) for k in range(8)]
    counts = {}
    for _, t in docs:
        for w in words(t):
            counts[w] = counts.get(w, 0) + 1
    want = set()
    for i, t in items:
        asked = set(words(t))
        if not all(w in counts for w in asked):
            continue
        rare = min(asked, key=lambda w: (counts[w], w))
        for j, d in docs:
            own = words(d)
            for p, w in enumerate(own):
                if w == rare and asked <= set(own[max(0, p - 3) : p + 4]):
                    want.add((j, str(i), p))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    for how in (Phrases(), Phrases(broadcast_bytes=0)):
        assert {(r.doc_id, r.item_id, r.pos) for r in proximity_matches(d, b, 3, how).collect()} == want


def test_shared_windows_and_long_texts(spark):
    """Many items of the same words are one window; a text of a million words is read whole."""
    passage = " ".join(f"p{k}" for k in range(20))
    docs = [(1, "x " * 1_000_000 + passage), (2, "x " * 50), (1, passage)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(k, passage) for k in range(300)] + [(900, "x")], "item_id long, text string")
    got = sorted((r.n_words, r.n_hit, len(r["items"])) for r in contamination(d, b).collect())
    assert got == [(20, 20, 300), (50, 50, 1), (1_000_020, 1_000_020, 301)]
