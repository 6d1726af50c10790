"""Connected components by alternating stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import settled


def dealt_anew(rows: DataFrame, key: str) -> DataFrame:
    """rows with a key that Spark does not take for the one they were grouped by.
    A join then shuffles both its sides, and AQE can split the partition of a
    frequent key, which it cannot where a side is an aggregate in place."""
    return rows.withColumn(key, F.col(key).bitwiseXOR(F.lit(0).cast("long")))


def _counted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """edges as a table, and their number and checksum, observed as they are written."""
    seen = Observation()
    sums = (F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b") % 2147483647), F.lit(0)).alias("c"))
    table = settled(edges.observe(seen, *sums))
    return table, (seen.get["n"], seen.get["c"])


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, root), root the least node of its component; nodes
    without an edge are not listed. Each step joins neighbours to the least node
    seen around them: a groupBy with partial sums and a join, never a group in
    one task. It ends when a step leaves the edges as they were."""
    edges, was = _counted(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while was[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(dealt_anew(least, "a"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(dealt_anew(least, "a"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(least.select("a", F.col("m").alias("b")))
        edges, now = _counted(small.distinct())
        if now == was:
            break
        was = now
    # each node is left with one edge, to the root
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
