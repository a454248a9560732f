"""Image files as a stream: the same row operators on files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, folder: str) -> DataFrame:
    """``binaryFile`` rows of a growing folder."""
    return spark.readStream.format("binaryFile").schema(FILE_SCHEMA).load(folder)


def run_once(source: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str):
    """Handles what has arrived since the last run, batch by batch; a batch that was
    finished isn't handled again after a restart."""
    return source.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
