import random

from lumenframe.llm.substring import Anchors, remove_repeats, without_repeats, words_of


def brute(rows, window):
    """Straight from the definition: words covered by a window that starts earlier."""
    words = [(-(10**18) if i is None else i, (t or "").encode().split()) for i, t in rows]
    out = []
    for r, (i, own) in enumerate(words):
        gone = [False] * len(own)
        for p in range(len(own) - window + 1):
            w = own[p : p + window]
            earlier = any(own[q : q + window] == w for q in range(p)) or any(
                j < i and any(other[q : q + window] == w for q in range(len(other) - window + 1)) for j, other in words
            )
            if earlier:
                gone[p : p + window] = [True] * window
        out.append((len(own), sum(gone), b" ".join(x for x, g in zip(own, gone) if not g).decode()))
    return out


def documents(seed, n, window):
    rng = random.Random(seed)
    vocab = ["a", "bé", "c,", "dd", "e", "日本"]
    passages = [" ".join(rng.choices(vocab, k=rng.randint(window - 2, 3 * window))) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choices(vocab, k=rng.randint(0, 9))))
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(parts)))
    return rows


def check(spark, rows, window, chunk_bytes=400):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = remove_repeats(df, Anchors(window, chunk_bytes)).select("doc_id", "text", "n_words", "n_removed", "kept").collect()
    want = brute(rows, window)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "", *r[2:])
    assert sorted(map(tuple, got), key=key) == sorted(((i, t, *w) for (i, t), w in zip(rows, want)), key=key)


def test_against_brute_force(spark):
    check(spark, documents(1, 60, 6), 6)
    check(spark, documents(2, 40, 7), 7, 90)


def test_production_window(spark):
    check(spark, documents(3, 40, 20), 20)
    check(spark, documents(4, 40, 20), 20, 3 << 20)


def test_nulls_ties_and_repeats_within(spark):
    long = " ".join(f"w{k}" for k in range(30))
    rows = [(5, long), (5, long), (None, "x " + long), (None, None), (7, ""), (8, f"{long} {long}"), (9, "one"), (3, " ".join(["a"] * 50))]
    check(spark, rows, 20)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, chunk int, rows string, bits string")
    assert remove_repeats(df).collect() == []
    assert without_repeats(df).collect() == []
    df = spark.createDataFrame([(1, "a b", 7, "r", "s")], df.schema)
    assert remove_repeats(df).collect()[0].asDict() == {"doc_id": 1, "text": "a b", "chunk": 7, "rows": "r", "bits": "s", "n_words": 2, "n_removed": 0, "kept": "a b"}


def test_made_names_may_be_taken(spark):
    long = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(1, long, "k", 5, 6.5, "c", len(long)), (2, "x " + long, "k", 5, 6.5, "d", 2 + len(long))], "doc_id int, text string, kept string, n_words int, n_removed double, c0 string, n_chars int")
    assert sorted((r.doc_id, r.text, r.c0, r.n_words, r.n_removed, r.kept) for r in remove_repeats(df).collect()) == [(1, long, "c", 30, 0, long), (2, "x " + long, "d", 31, 30, "x")]
    left = without_repeats(df)
    assert left.schema == df.schema
    assert sorted(map(tuple, left.collect())) == [(1, long, "k", 5, 6.5, "c", len(long)), (2, "x", "k", 5, 6.5, "d", 1)]


def thue_morse(bits):
    t = "a"
    for _ in range(bits):
        t += t.translate(str.maketrans("ab", "ba"))
    return t, t.translate(str.maketrans("ab", "ba"))


def test_words_of_equal_hash_are_told_apart(spark):
    """Two different words of 1,024 letters whose polynomial hashes are equal."""
    one, two = thue_morse(10)
    first, second = (words_of(w.encode())[2] for w in (one, two))
    assert one != two and first == second
    rest = " ".join(f"w{k}" for k in range(19))
    check(spark, [(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{one} {rest}")], 20)


def test_a_very_long_text(spark):
    rng = random.Random(6)
    own = " ".join(str(rng.randrange(10**6)) for _ in range(200_000))
    passage = " ".join(f"p{k}" for k in range(40))
    df = spark.createDataFrame([(1, own + "\t" + passage), (2, "q " + passage), (3, "z" * 600_000 + " " + passage + " " + passage)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed, len(r.kept)) for r in remove_repeats(df).collect())
    assert got == [(1, 200_040, 0, len(own) + 1 + len(passage)), (2, 41, 40, 1), (3, 81, 80, 600_000)]
