import random

import pytest

pytest.importorskip("public_tokenizers")


def test_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(1)
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(n))
    base, passage, question = prose(200), prose(60), prose(30)
    texts = [base, base, base + " x", prose(80) + " " + passage, prose(80) + " " + passage, prose(90) + " " + question, "short", None, prose(100)]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, question)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    ids = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packed_sequences":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids.append(sorted({r.doc_id for r in docs.collect()}))
    assert ids == [[0, 1, 2, 3, 4, 5, 8], [0, 3, 4, 5, 8], [0, 3, 4, 5, 8], [0, 3, 4, 8], [0, 3, 4, 8]]
    kept = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "repeated_passages")).collect()}
    assert passage in kept[3] and passage not in kept[4] and kept[0] == base
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def run_stages(spark, docs, folder, benchmark):
    """Each stage's rows, checked to have the columns of documents until the last."""
    import corpus_pipeline

    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    out = []
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(folder))
        if name != "packed_sequences":
            assert got.schema == docs.schema
        got.write.parquet(str(folder / name))
        docs = spark.read.schema(got.schema).parquet(str(folder / name))
        out.append(docs.collect())
    return out


def test_empty_tables(spark, tmp_path):
    assert run_stages(spark, spark.createDataFrame([], FIELDS), tmp_path, []) == [[]] * 5


def test_against_brute_force(spark, tmp_path):
    """All stages on one small table, with equal and missing doc_ids and columns of the operators' own names."""
    from tokenizers import Tokenizer

    from lumenframe.llm.decontamination import UPPER  # noqa: F401  the operators are imported by the stages
    from lumenframe.llm.encoding import default_tokenizer, located

    from .test_quality import judged_by_definition
    from .test_similar import brute, grams
    from .test_substring import brute as without_passages

    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(n))
    base, passage, question = prose(200), prose(60), prose(30)
    texts = [(1, base), (1, base), (None, base + " x"), (4, prose(80) + " " + passage), (None, prose(80) + " " + passage), (6, prose(90) + "\n" + question.upper())]
    texts += [(7, "short"), (8, None), (9, prose(100)), (9, prose(120) + " " + passage), (11, "word " * 300), (12, passage + " " + passage), (13, "0 1 " + prose(70)), (14, prose(3000))]
    extra = "__row long, kept string, n_words int, n_removed int, c0 string, fp string, node string, row int, `a b` string, id int"
    rows = [(i, t, "en", "s", len(t or ""), k, "k", 1, 2, "c", "f", "n", 3, "ab", 4) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, f"{FIELDS}, {extra}").repartition(3)
    got = run_stages(spark, docs, tmp_path, [(0, question)])

    want = [(i, t) for i, t in texts if judged_by_definition(t)]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    plain = lambda rows: sorted(((r.doc_id, r.text) for r in rows), key=key)
    assert plain(got[0]) == sorted(want, key=key)
    label = brute([grams(t) for _, t in want])
    least = {x: min((i for (i, _), y in zip(want, label) if y == x and i is not None), default=None) for x in label}
    want = [(i, t) for (i, t), x in zip(want, label) if i == least[x]]
    assert plain(got[1]) == sorted(want, key=key)
    want = [(i, kept if n else t) for (i, t), (_, n, kept) in zip(want, without_passages(want, 20))]
    assert plain(got[2]) == sorted(want, key=key) and all(r.n_chars == len(r.text) and r["a b"] == "ab" for r in got[2])

    def hit(text):
        import re

        words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        own, item = words(text), words(question)
        windows = {tuple(item[k : k + 13]) for k in range(len(item) - 12)}
        places = {p for k in range(len(own)) if tuple(own[k : k + 13]) in windows for p in range(k, k + 13)}
        return bool(places) and 20 * len(places) >= len(own)

    want = [(i, t) for i, t in want if not hit(t)]
    assert plain(got[3]) == sorted(want, key=key)
    tokenizer = Tokenizer.from_file(located(default_tokenizer()))
    total = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in want)
    assert sum(r.length for r in got[4]) == total and {r.doc_id for r in got[4]} == {i for i, _ in want}


def test_stages_tidy_up(spark, tmp_path):
    """What a stage stored is gone once the next one has begun, but nothing that is still read."""
    import os

    import corpus_pipeline
    from lumenframe.llm.common import shared_dir

    kept = lambda: {n for n in os.listdir(shared_dir(spark)) if n.startswith("numbered-")}
    before = kept()
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3)], FIELDS)
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    lazy = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    own = kept() - before
    assert own
    chained = corpus_pipeline.benchmark_passages(spark, lazy, str(tmp_path))  # not written in between
    assert own <= kept() and chained.count() == 1
    corpus_pipeline.packed_sequences(spark, docs, str(tmp_path))
    assert kept() <= before
