import random
import re
import string

from lumenframe.llm.quality import judge, passing


def brute(text):
    t = text or ""
    words = re.findall(rb"[^\x20\x09-\x0D]+", t.encode())
    lines = [x for x in t.encode().split(b"\n") if re.search(rb"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return (
        len(words), sum(len(w.decode()) for w in words), len(re.findall(r"[#*$%&|<>]", t)),
        sum(x in lines[:i] for i, x in enumerate(lines)), len(covered),
    )


def judged_by_definition(text):
    """The verdict from the rule's own words: base rules, the whole ratio in the band of its
    length and script, and at most 30 % of full 2,048-byte chunks outside theirs."""
    import zstandard

    from lumenframe.llm.quality import NARROW, WIDE

    raw, (n, _, _, _, repeated) = (text or "").encode(), brute(text)
    if n < 50 or 100 * repeated > 50 * n:
        return False
    ratio = lambda b: len(b) / len(zstandard.ZstdCompressor(level=3).compress(b))
    wide = len(raw) >= 1.5 * len(text)
    low, high = next((b.low, b.high) for b in (WIDE if wide else NARROW) if b.max_bytes is None or len(raw) <= b.max_bytes)
    chunks = [ratio(raw[k : k + 2048]) for k in range(0, len(raw) - 2047, 2048)]
    bad = [r for r in chunks if not (1.44 if wide else 1.58) <= r <= 4.0]
    return low <= ratio(raw) <= high and 10 * len(bad) <= 3 * len(chunks)


def test_verdicts_by_definition(spark):
    rng = random.Random(11)
    rows = []
    for k in range(160):
        n = rng.choice([55, 90, 200, 600, 1500, 6000])
        kind, words = k % 4, None
        if kind == 0:  # prose of a small vocabulary
            vocab = ["".join(rng.choices("abcdefghiéß", k=rng.randint(1, 9))) for _ in range(rng.choice([30, 300, 3000]))]
            words = [rng.choice(vocab) for _ in range(n)]
        elif kind == 1:  # noise
            words = ["".join(rng.choices(string.ascii_letters + string.digits, k=8)) for _ in range(n)]
        elif kind == 2:  # another script
            words = ["".join(chr(rng.randrange(0x430, 0x450)) for _ in range(rng.randint(1, 9))) for _ in range(n)]
        else:  # prose with a noisy or repetitive stretch
            words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(n)] + rng.choice([["x"], [str(rng.random())]]) * rng.choice([0, n // 4, n])
        rows.append((k, " ".join(words)))
    got = {r.doc_id: r.kept for r in judge(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = {k: judged_by_definition(t) for k, t in rows}
    assert got == want and 20 < sum(want.values()) < 140


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdeéß", k=rng.randint(1, 9))) for _ in range(n))


def test_counts_and_base_rules(spark):
    rng = random.Random(1)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "a b c d a b c x\x0by"), (None, "a\n\na\n a\na"), (3, "a # | <é>"), (4, "x y z " * 40), (5, prose(rng, 300))]
    rows += [(k, " ".join(rng.choices(["a", "b", "é", "c\n", "\n"], k=rng.randint(0, 60)))) for k in range(10, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = judge(df, keep=("doc_id", "text")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_bands_keep_prose_and_reject_repetition_and_noise(spark):
    rng = random.Random(2)
    noise = "".join(chr(rng.choice([*range(0x4E00, 0x9FFF)])) + (" " if k % 9 == 8 else "") for k in range(3000))
    lines = "\n".join(f"{k} the same line as ever with hardly anything new in it at all" for k in range(200))
    rows = [(1, prose(rng, 80)), (2, prose(rng, 5000)), (3, noise), (4, lines)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.kept for r in judge(df).collect()} == {1: True, 2: True, 3: False, 4: False}


def test_passing_keeps_columns_and_rows(spark):
    good = prose(random.Random(3), 100)
    schema = "text string, doc_id long, kept boolean, ratio string"
    df = spark.createDataFrame([(good, 1, None, "r"), (good, 1, False, "r"), ("short", 2, True, None)], schema)
    out = passing(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(good, 1, None, "r"), (good, 1, False, "r")], key=str)
    assert passing(df.limit(0)).collect() == [] and judge(df.limit(0)).collect() == []


def spaced(rng, letters, size):
    """Random letters of exactly ``size`` bytes in more than 50 words."""
    longest = min(9, size // 60)
    out = ""
    while len(out) < size:
        out += "".join(rng.choices(letters, k=rng.randint(min(4, longest), longest))) + " "
    return out[: size - 1] + "x"


def test_noise_of_each_length_class(spark):
    rng = random.Random(4)
    sizes = (390, 490, 640, 700, 990, 1_200, 1_500, 2_100, 2_500, 3_900, 5_000, 8_000, 15_000, 30_000, 60_000, 100_000)
    base64, lower, hexes = string.ascii_letters + string.digits + "+/", string.ascii_lowercase, string.hexdigits[:16]
    texts = [spaced(rng, base64, n) for n in sizes for _ in range(3)]
    texts += [spaced(rng, string.ascii_letters, n) for n in sizes if n > 1_000]
    texts += [spaced(rng, lower, n) for n in sizes if n > 4_000] + [spaced(rng, hexes, n) for n in sizes if n > 9_000]
    half = spaced(rng, base64, 20_000)
    texts.append(prose(rng, 3_000) + " " + half)  # in places only
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = judge(df).collect()
    assert not any(r.base_failed for r in got) and [r.doc_id for r in got if r.kept] == []


def test_wide_scripts_have_their_own_bands(spark):
    rng = random.Random(5)
    syllables = ["".join(rng.choices("абвгдежзиклмнопрстуя", k=rng.randint(1, 3))) for _ in range(500)]
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(1_500)]
    texts = [" ".join(rng.choices(words, [1 / (k + 9) for k in range(1_500)], k=n)) for n in (60, 150, 300, 900)]
    noise = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) + (" " if k % 9 == 8 else "") for k in range(600))
    df = spark.createDataFrame(list(enumerate([*texts, noise])), "doc_id long, text string")
    assert [r.kept for r in judge(df).orderBy("doc_id").collect()] == [True] * 4 + [False]


def test_very_long_and_empty(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdefghi", k=rng.randint(2, 9))) for _ in range(20_000)]
    long = " ".join(rng.choice(vocab) for _ in range(300_000))
    rows = [(1, long), (2, "same line\n" * 200_000)]
    got = {r.doc_id: r for r in judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_words == 300_000 and got[1].n_chunks == len(long) // 2048 and got[1].kept == judged_by_definition_of_long(long)
    assert (got[2].n_words, got[2].n_dup_lines, got[2].base_failed, got[2].kept) == (400_000, 199_999, True, False)


def judged_by_definition_of_long(text):
    import zstandard

    from lumenframe.llm.quality import NARROW

    raw, press = text.encode(), zstandard.ZstdCompressor(level=3)
    ratios = [2048 / len(press.compress(raw[k : k + 2048])) for k in range(0, len(raw) - 2047, 2048)]
    bad = sum(not 1.58 <= r <= 4.0 for r in ratios)
    return NARROW[-1].low <= len(raw) / len(press.compress(raw)) <= NARROW[-1].high and 10 * bad <= 3 * len(ratios)
