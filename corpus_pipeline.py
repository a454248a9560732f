"""Training-corpus pipeline: five stages over ``documents``, each one operator.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns the columns of documents; the last returns packed pieces.

For every stage: a null or blank text has no words; a text of any length is read
whole; rows with equal or no doc_id are rows of their own; an empty table gives an
empty result; further columns, of any name, are carried unread.

What a stage stores on its way is deleted when the next stage begins, as its result
has been written by then.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import decontamination, packing, quality, similar, substring
from lumenframe.llm.common import fresh_path, made_by, table, tidy
from lumenframe.llm.encoding import default_tokenizer

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that stages have stored and that may still be read.
LEFT: list[str] = []


def stage(f: Stage) -> Stage:
    """``f`` after tidying up what the stage before left."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        still = tidy(spark, LEFT, docs)
        out, made = made_by(lambda: f(spark, docs, sf_dir))
        LEFT[:] = still + made
        return out

    return run


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression bands or base rules reject go (texts without words among them)."""
    return quality.passing(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts connected by a 5-word similarity of 0.8 or more the rows with the smallest
    doc_id stay. Rows of that same doc_id all stay; rows without doc_id go where others
    of their group have one, and all stay where none has."""
    return similar.representatives(docs)


@stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand earlier (smaller doc_id, null first, then place) go from the
    texts; untouched texts stay as they are. Rows of equal doc_id don't precede one another."""
    return substring.without_repeats(docs)


@stage
def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark windows cover by a twentieth or more go; texts without
    words stay, and an empty benchmark takes nothing."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


@stage
def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' ids in sequences of 2048; a text without words gives its ids and the end id."""
    return packing.pack(docs, default_tokenizer(), with_ids=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("packed_sequences", packed_sequences),
]

#: No SQL: compression ratios, XXH64 fingerprints and token ids aren't expressible.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES:
        path = fresh_path(spark, name)
        work(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
