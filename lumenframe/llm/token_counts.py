"""Token counts through a digest cache.

The cache is a table ``content, version, n_tokens`` under the digest of the
normalised content and the digest of the tokenizer file. A run joins digests to
stored counts, encodes each distinct missing text once, appends those counts as
one more batch of the cache, and joins them back.

Defined results: a null text counts as the empty text; a text of any length is
encoded whole in one worker; repeated rows each get their count; an empty table gives an empty result and appends an empty batch;
extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import bounded, fresh_path
from lumenframe.llm.encoding import encoder, version

CACHE_SCHEMA = "content binary, version string, n_tokens long"


def normalised(text):
    """What is digested and encoded: null becomes empty. The byte-level tokenizers
    tell any two different texts apart, so nothing else may be changed."""
    return F.coalesce(text, F.lit(""))


def digest(text):
    """SHA-256 of the UTF-8 bytes, packed in 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


class DigestCache:
    """An append-only folder of Parquet batches.

    A batch is committed whole by Spark's writer or not at all. Two runs that
    append the same digest at once store the same count twice; readers group.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def counts(self, tokenizer_version: str) -> DataFrame | None:
        """``content, n_tokens`` under one version, or None before the first append."""
        try:
            stored = self.spark.read.schema(CACHE_SCHEMA).parquet(f"{self.path}/batch=*")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        own = stored.where(F.col("version") == tokenizer_version)
        return own.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, counts: DataFrame, tokenizer_version: str) -> DataFrame:
        """Store ``content, n_tokens`` and return what was stored."""
        path = f"{self.path}/batch={uuid.uuid4().hex}"
        counts.select("content", F.lit(tokenizer_version).alias("version"), "n_tokens").write.parquet(path)
        return self.spark.read.schema(CACHE_SCHEMA).parquet(path).select("content", "n_tokens")


def encoded_lengths(texts: DataFrame, tokenizer: str) -> DataFrame:
    """``content, n_tokens`` of ``content, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(enc.counts(batch.column(1)), pa.int64())], names=["content", "n_tokens"])

    return texts.select("content", "text").mapInArrow(run, "content binary, n_tokens long")


def content_digest(text):
    """The cache key of a text."""
    return digest(normalised(text))


def fill_cache(docs: DataFrame, tokenizer: str, cache_path: str) -> DataFrame:
    """Encode the texts of ``docs`` that the cache lacks, append their counts and
    return all counts ``content, n_tokens`` that are stored now.

    Texts move once, to meet the cache and their copies by digest; the grouping
    keeps one text a digest before that shuffle. A digest that many rows share is
    thus one row a task.
    """
    spark = docs.sparkSession
    cache, tokenizer_version = DigestCache(spark, cache_path), version(tokenizer)
    texts = bounded(docs).select(normalised(F.col("text")).alias("text")).select(digest(F.col("text")).alias("content"), "text")
    distinct = texts.groupBy("content").agg(F.first("text").alias("text"))
    known = cache.counts(tokenizer_version)
    if known is not None:
        distinct = distinct.join(known, "content", "left_anti")
    added = cache.append(encoded_lengths(distinct, tokenizer), tokenizer_version)
    return added if known is None else known.unionByName(added)  # no digest is in both


def count_tokens(docs: DataFrame, tokenizer: str, cache_path: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row of ``docs``.

    The join back moves digests and counts; a digest that many rows share is split
    by adaptive skew-join handling, as nothing above it needs its rows together.
    """
    counts = fill_cache(docs, tokenizer, cache_path or fresh_path(docs.sparkSession, "token-counts"))
    n_bytes = F.octet_length(normalised(F.col("text"))).cast("long").alias("n_bytes")
    rows = docs.select("doc_id", n_bytes, content_digest(F.col("text")).alias("content"))
    return rows.join(counts, "content", "left").select("doc_id", "n_bytes", "n_tokens")
