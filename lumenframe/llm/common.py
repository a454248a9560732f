"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the word separators of most operators here.
BLANKS = b" \t\n\x0b\x0c\r"
SIZE = re.compile(r"(-?\d+)([kmg]?b?)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark only (the path may be in a remote store)."""
    return bounded(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset on a single machine (tests) a temporary folder is set;
    on a cluster that folder would differ from executor to executor, so this raises.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not where:
        jvm_dir = context._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            return jvm_dir.get()
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        where = tempfile.mkdtemp(prefix="lumenframe-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(where)
    return where


def removed(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Bytes of one Arrow batch between Spark and a Python worker.
BATCH_BYTES = 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are bounded by bytes, not by rows
    alone: 10,000 long texts would not fit a worker. A smaller bound stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    held = SIZE.fullmatch(str(conf.get(key)).strip().lower())
    size = int(held[1]) << {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30}[held[2]] if held else 0
    if size <= 0 or size > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


#: Paths that ``fresh_path`` gave in this process, for those who tidy up (``made_by``).
PATHS: list[str] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, for a table that cuts lineage."""
    PATHS.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return PATHS[-1]


def made_by(work: Callable[[], DataFrame]) -> tuple[DataFrame, list[str]]:
    """What ``work`` returns, and the paths of the tables it stored meanwhile. They are
    needed until the result has been written."""
    before = len(PATHS)
    out = work()
    return out, PATHS[before:]


def tidy(spark: SparkSession, paths: list[str], reader: DataFrame) -> list[str]:
    """Deletes stored tables, but none that ``reader`` still reads; those are returned."""
    read = "\n".join(reader.inputFiles()) if paths else ""
    left = []
    for path in paths:
        if path.rpartition("/")[2] in read:
            left.append(path)
        else:
            removed(spark, path)
    return left


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` in the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which the operators follow."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator needs, so that extra ones cannot clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def beside_group(rows: DataFrame, grouped: DataFrame, *keys: str) -> DataFrame:
    """``rows`` joined with the row of their group, of a table that was grouped by ``keys``.

    The keys' hash is joined too. The grouping isn't partitioned by it, so both sides
    of the join are plain shuffles, and adaptive execution splits those where a group
    is hot; it can't where a grouping stands between shuffle and join."""
    mark = F.xxhash64(*keys)
    return rows.withColumn("__mark", mark).join(grouped.withColumn("__mark", mark), [*keys, "__mark"]).drop("__mark")
