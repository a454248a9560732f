"""Connected components of an edge table by alternating large and small stars.

Each round is two grouped minima and two joins; both only replace edges by edges
to smaller nodes, so the table never grows beyond its first size. A node that has a
large part of all edges is split in the joins (``beside_group``). Rounds are stored
in the shared folder, each in place of the one before; the driver sees one count
and one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import beside_group, fresh_path, removed


def large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return beside_group(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of those."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = beside_group(down, least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (longs ``a, b``) but the roots,
    where root is the least node that can be reached."""
    spark, now, mark, last = edges.sparkSession, edges.where("a <> b").select("a", "b").distinct(), None, None
    while True:
        path = fresh_path(spark, "stars")
        now.write.parquet(path)
        held = spark.read.schema("a long, b long").parquet(path)
        if last is not None:
            removed(spark, last)  # the round before is read no more
        found = held.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == found:
            return held.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark, last, now = found, path, small_star(large_star(held))
