import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

public_tokenizers = pytest.importorskip("public_tokenizers")

from lumenframe.llm import packing, token_counts, token_store  # noqa: E402
from lumenframe.llm.encoding import Encoder, default_tokenizer, located  # noqa: E402

PATH = located(default_tokenizer())

PARTS = ["a", "the", "é", " ", "  ", "\n", "\t", "'s", "1", "²", "<|endoftext|>", "<|", "!", "　", "ß", "日本", "\x1c", "\x85", "😀", "é", "can't", ","]


def texts(seed, n):
    rng = random.Random(seed)
    out = [None, "", " ", "a", "x <|endoftext|> y", "word " * 700]
    while len(out) < n:
        if rng.random() < 0.5:
            out.append("".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))))
        else:
            out.append(" ".join("".join(rng.choices("aeinort,.", k=rng.randint(1, 8))) for _ in range(rng.randint(1, 400))))
    return out


def library(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_encoder_gives_the_librarys_ids():
    tokenizer = Tokenizer.from_file(PATH)
    enc = Encoder(PATH, room=40)
    for t in texts(1, 600):
        assert np.frombuffer(enc.encode([t])[0], "<u4").tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(name):
    path = public_tokenizers.path(name)
    got = [np.frombuffer(x, "<u4").tolist() for x in Encoder(path).encode(["Hello  world", None])]
    if name.endswith(".json"):
        want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in ("Hello  world", "")]
    else:
        import sentencepiece

        want = sentencepiece.SentencePieceProcessor(model_file=path).encode(["Hello  world", ""])
    assert got == want


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids string").repartition(3)


def rows_of(seed, n):
    out = [(k, t, "x", None) for k, t in enumerate(texts(seed, n))]
    return [*out, out[-1], out[5], (None, "no id", "x", None)]


def test_counts_with_a_growing_cache(spark, tmp_path):
    rows = rows_of(2, 40)
    cache = str(tmp_path / "cache")
    for part in (rows[:20], rows, rows[:0]):
        got = token_counts.count_tokens(frame(spark, part), default_tokenizer(), cache).collect()
        want = [(i, len((t or "").encode()), len(library(t))) for i, t, *_ in part]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    stored = spark.read.parquet(f"{cache}/batch=*")
    assert stored.count() == stored.select("content").distinct().count() == len({t or "" for _, t, *_ in rows})
    other = public_tokenizers.path("word_bpe_49k.json")
    got = token_counts.count_tokens(frame(spark, rows[:3]), other, cache).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(Tokenizer.from_file(other).encode(t or "", add_special_tokens=False).ids) for _, t, *_ in rows[:3])


@pytest.mark.parametrize("capacity", [2048, 64, 60, 1])
def test_packing(spark, capacity):
    rows = rows_of(3, 30 if capacity > 1 else 7)
    got = packing.pack(frame(spark, rows), default_tokenizer(), capacity).collect()
    bins: dict = {}
    for r in got:
        assert len(r.ids) == 4 * r.length > 0
        bins.setdefault(r.sequence_id, []).append(r)
    for pieces in bins.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    docs: dict = {}
    for i, t, *_ in rows:
        docs.setdefault(i, []).append([*library(t), 1])
    for i, all_ids in docs.items():
        own = [r for r in got if r.doc_id == i]
        flat = sorted((r.start, r.ids) for r in own)
        assert all(r.doc_tokens in {len(x) for x in all_ids} for r in own)
        if len(all_ids) == 1:
            assert np.frombuffer(b"".join(x for _, x in flat), "<u4").tolist() == all_ids[0]
        assert sum(r.length for r in own) == sum(map(len, all_ids))
    # A document shorter than a sequence is cut only where one ends; each worker's last one is short.
    for i, all_ids in docs.items():
        if len(all_ids) == 1 and len(all_ids[0]) <= capacity:
            own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
            assert all(r.offset + r.length == capacity for r in own[:-1])
    total = sum(r.length for r in got)
    assert len(bins) * capacity - total < 3 * capacity
    assert packing.pack(frame(spark, rows[:0]), default_tokenizer()).collect() == []


def test_cuts_follow_the_content():
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 50_000, 30_000).astype("<u4")
    ends = token_store.cuts(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and (sizes[:-1] >= 128).all() and (sizes <= 4096).all()
    moved = np.concatenate([ids[:77], ids])
    kept = {ids[a:b].tobytes() for a, b in zip([0, *ends], ends)}
    again = token_store.cuts(moved)
    assert len(kept & {moved[a:b].tobytes() for a, b in zip([0, *again], again)}) > 0.8 * len(kept)
    for x in (ids[:1], ids[:500], np.array([70_000, 3], "<u4")):
        assert (token_store.unpacked(token_store.packed(x)) == x).all()


def test_store_round_trip(spark, tmp_path):
    rows = [r for r in rows_of(5, 40) if r[0] is not None]
    path = str(tmp_path / "store")
    got = sorted(token_store.round_trip(frame(spark, rows), default_tokenizer(), path).collect(), key=lambda r: r.start)
    at = 0
    assert [r.doc_id for r in got] == sorted(i for i, *_ in rows)
    texts_of = {i: t for i, t, *_ in rows}
    for r in got:
        ids = np.array([*library(texts_of[r.doc_id]), 2], "<u4")
        assert (r.start, r.n_tokens, zlib.crc32(r.ids)) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    chunks = spark.read.parquet(f"{path}/objects").where("kind = 'chunk'")
    assert chunks.count() == chunks.select("key").distinct().count()
    manifest = spark.read.parquet(f"{path}/manifest").collect()
    assert sum(m.n_tokens for m in manifest) == at and sum(m.n_docs for m in manifest) == len(rows)


def test_store_finds_damage(spark, tmp_path):
    path = token_store.write_store(frame(spark, rows_of(6, 12)), str(tmp_path / "store"), default_tokenizer())
    objects = spark.read.parquet(f"{path}/objects").where("kind = 'chunk'")
    rows = objects.drop("kind").collect()
    bad = [(*r[:3], rows[0].data if k == 1 else r.data, *r[4:]) for k, r in enumerate(rows)]
    other = str(tmp_path / "other")
    for name in ("recipes", "manifest"):
        spark.read.parquet(f"{path}/{name}").write.parquet(f"{other}/{name}")
    spark.createDataFrame(bad, objects.drop("kind").schema).write.parquet(f"{other}/objects/kind=chunk")
    assert all(r.verified for r in token_store.read_documents(spark, path).collect())
    assert not all(r.verified for r in token_store.read_documents(spark, other).collect())


def test_reading_holds_recipes_against_the_manifest(spark, tmp_path):
    import shutil

    path = token_store.write_store(frame(spark, rows_of(8, 12)), str(tmp_path / "store"), default_tokenizer())
    recipes = spark.read.parquet(f"{path}/recipes")
    rows = recipes.collect()
    at = next(k for k, r in enumerate(rows) if r.chunks != rows[0].chunks)
    replaced = [*rows[:at], (*rows[at][:4], *rows[0][4:]), *rows[at + 1 :]]  # sound in itself
    for k, bad in enumerate((rows[:at] + rows[at + 1 :], rows[:at] + rows[at:][:1] * 2 + rows[at + 1 :], replaced)):
        other = str(tmp_path / f"other{k}")
        for name in ("objects", "manifest"):
            shutil.copytree(f"{path}/{name}", f"{other}/{name}")
        spark.createDataFrame(bad, recipes.schema).write.parquet(f"{other}/recipes")
        with pytest.raises(token_store.Altered):
            token_store.read_documents(spark, other)
    assert token_store.read_documents(spark, path).count() == len(rows)


def test_store_shares_chunks(spark, tmp_path):
    base = [t or "" for _, t, *_ in rows_of(9, 30)]
    long = " ".join(base)
    texts = [long, base[3], long, long + " end", "begin " + long, long + " " + long, None, "", long] * 3
    path = str(tmp_path / "store")
    docs = spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = token_store.round_trip(docs, default_tokenizer(), path).collect()
    want = [(k // 2, np.array([*library(t), 2], "<u4").tobytes()) for k, t in enumerate(texts)]
    assert sorted((r.doc_id, bytes(r.ids)) for r in got) == sorted(want)
    ends = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    chunks = spark.read.parquet(f"{path}/objects").where("kind = 'chunk'")
    assert chunks.count() == chunks.select("key").distinct().count()


def test_empty_store(spark, tmp_path):
    assert token_store.round_trip(frame(spark, []), default_tokenizer(), str(tmp_path / "s")).collect() == []


def test_classes_take_a_fixed_number_of_documents():
    packer = packing.HarmonicPacker(100)
    full = []
    for i, n in enumerate([30, 26, 50, 33, 300, 40, 9]):  # classes 3, 3, 2, 3, ...
        full += list(packer.add(i, b"\0\0\0\0" * n))
    # 30, 26 and 33 fill a bin of class 3, whose slack of 11 takes the head of the next document;
    # its 289 are two bins and 89, a bin of class 1, whose slack takes the head of the 40.
    assert [[(p.doc_id, p.start, p.length) for p in b] for b in full] == [
        [(0, 0, 30), (1, 0, 26), (3, 0, 33), (4, 0, 11)], [(4, 11, 100)], [(4, 111, 100)], [(4, 211, 89), (5, 0, 11)],
    ]
    assert [[(p.doc_id, p.start, p.length) for p in b] for b in packer.finish()] == [[(2, 0, 50), (5, 11, 29), (6, 0, 9)]]


def test_a_warm_cache_is_joined(spark, tmp_path):
    """Counts that an earlier run stored are taken, not made anew."""
    rows, cache = rows_of(4, 30), str(tmp_path / "cache")
    docs = frame(spark, rows)
    earlier = docs.where(token_counts.content_digest(docs.text) < bytearray(b"\x80"))
    token_counts.fill_cache(earlier, default_tokenizer(), cache)
    before = spark.read.parquet(f"{cache}/batch=*")
    changed = before.withColumn("n_tokens", before.n_tokens + 1000).collect()
    for batch in (tmp_path / "cache").iterdir():
        import shutil

        shutil.rmtree(batch)
    token_counts.DigestCache(spark, cache).append(spark.createDataFrame([(r.content, r.n_tokens) for r in changed], "content binary, n_tokens long"), token_counts.version(default_tokenizer()))
    got = token_counts.count_tokens(docs, default_tokenizer(), cache).collect()
    known = {bytes(r.content) for r in changed}
    import hashlib

    want = [(i, len((t or "").encode()), len(library(t)) + 1000 * (hashlib.sha256((t or "").encode()).digest() in known)) for i, t, *_ in rows]
    assert 0 < len(known) < len({t for _, t, *_ in rows}) and sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_very_long_texts(spark):
    """Texts of over a million characters: counted, packed and stored whole."""
    rng = random.Random(8)
    long = " ".join("".join(rng.choices("aeinort,.", k=rng.randint(1, 8))) for _ in range(250_000))
    want = library(long)
    docs = spark.createDataFrame([(1, long), (2, "x")], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, default_tokenizer()).collect()}[1] == len(want)
    pieces = sorted((r for r in packing.pack(docs, default_tokenizer()).collect() if r.doc_id == 1), key=lambda r: r.start)
    assert np.frombuffer(b"".join(p.ids for p in pieces), "<u4").tolist() == [*want, 1]
    back = {r.doc_id: r for r in token_store.round_trip(docs, default_tokenizer()).collect()}
    assert np.frombuffer(back[1].ids, "<u4").tolist() == [*want, 2] and back[2].start == len(want) + 1


def test_store_orders_missing_and_equal_ids(spark, tmp_path):
    """Documents without an id come first; rows of one id stand together, by their roots."""
    rows = [(5, "five"), (None, "no id"), (2, "two"), (2, "two again"), (None, None), (2, "two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(token_store.round_trip(docs, default_tokenizer(), str(tmp_path / "s")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 2, 2, 2, 5]
    want = sorted((i is not None, i or 0, np.array([*library(t), 2], "<u4").tobytes()) for i, t in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.ids)) for r in got) == want
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
