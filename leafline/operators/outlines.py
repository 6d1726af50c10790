"""Outlines: trees in pre-order from rows with levels, and counts of raw outlines
whose links may run in circles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Rounds


def tree(entries: DataFrame, keys: list[str], order: str, level: str) -> DataFrame:
    """entries in pre-order with their ``parent``: the last entry before them that lies
    higher (null at the top). Levels count from 0 and may leave gaps. An entry asks for
    the last one of each level above its own, in windows of one level each; the latest
    of these is the parent, so the work is entries times depth."""
    asks = entries.where(F.col(level) > 0).select(*keys, order, F.explode(F.sequence(F.lit(0), (F.col(level) - 1).cast("int"))).alias("_l"))
    both = asks.withColumn("_at", F.lit(None).cast(dict(entries.dtypes)[order])).unionByName(entries.select(*keys, order, F.col(level).cast("int").alias("_l"), F.col(order).alias("_at")))
    w = Window.partitionBy(*keys, "_l").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("_up", F.last("_at", ignorenulls=True).over(w)).where("_at is null")
    found = seen.groupBy(*keys, order).agg(F.max("_up").alias("parent"))
    return entries.join(found, [*keys, order], "left")


def linked(entries: DataFrame, keys: list[str], order: str) -> DataFrame:
    """entries of ``tree`` as raw links: first (the first child) and next (the next
    sibling), null where there is none."""
    siblings = Window.partitionBy(*keys, "parent").orderBy(order)
    rows = entries.withColumn("next", F.lead(order).over(siblings))
    first = entries.where("parent is not null").groupBy(*keys, F.col("parent").alias(order)).agg(F.min(order).alias("first"))
    return rows.join(first, [*keys, order], "left")


def counted(links: DataFrame, key: str, node: str, roots: DataFrame) -> DataFrame:
    """links(key, node, first, next) and roots(key, node: the first entry at the top) ->
    key, top_level (entries reached by next alone) and total (by first and next), each
    entry counted once, also where links run in a circle.

    Most entries have one predecessor, so a way back to the root is one pointer an
    entry and is followed by doubling: log n rounds for chains of any length. Entries
    with several predecessors end such a way; which of these are reached is settled on
    the small graph between them."""
    nodes = links.select(key, node, "first", "next")
    top = _reached(nodes.select(key, F.col(node).alias("a"), F.col("next").alias("b")), key, roots.select(key, F.col(node).alias("a")))
    both = nodes.select(key, F.col(node).alias("a"), F.explode(F.array("first", "next")).alias("b"))
    every = _reached(both, key, roots.select(key, F.col(node).alias("a")))
    known = nodes.select(key, F.col(node).alias("a"))
    count = lambda rows, name: rows.join(known, [key, "a"]).groupBy(key).agg(F.count("*").alias(name))
    return links.select(key).distinct().join(count(top, "top_level"), key, "left").join(count(every, "total"), key, "left").select(key, F.coalesce("top_level", F.lit(0)).alias("top_level"), F.coalesce("total", F.lit(0)).alias("total"))


def _reached(edges: DataFrame, key: str, roots: DataFrame) -> DataFrame:
    """(key, a) of all nodes reached from the roots by edges(key, a, b)."""
    rounds = Rounds(edges.sparkSession)
    roots = rounds.kept(roots.where("a is not null").distinct())
    edges = rounds.kept(edges.where("a is not null and b is not null and a != b").distinct().join(roots.select(key, F.col("a").alias("b")), [key, "b"], "left_anti"))
    into = edges.groupBy(key, "b").agg(F.count("*").alias("n"), F.min("a").alias("a"))
    joints = rounds.kept(into.where("n > 1").select(key, F.col("b").alias("a")))
    # the head of each other node: pointers back, doubled until they stand still
    back = rounds.kept(into.where("n = 1").select(key, F.col("b").alias("node"), F.col("a").alias("head")))
    for _ in range(max(1, back.count()).bit_length() + 1):
        jump = back.select(key, F.col("node").alias("head"), F.col("head").alias("_far"))
        moved = rounds.kept(back.join(jump, [key, "head"], "left").select(key, "node", F.coalesce("_far", "head").alias("head"), F.col("_far").isNotNull().alias("moved")))
        rounds.drop(back)
        back = moved
        if moved.where("moved").isEmpty():
            break
    # what still moves runs in a circle: its head is neither a root nor a joint, so nothing reaches it
    heads = back.select(key, "node", "head").unionByName(joints.select(key, F.col("a").alias("node"), F.col("a").alias("head"))).unionByName(roots.select(key, F.col("a").alias("node"), F.col("a").alias("head")))
    heads = rounds.kept(heads.distinct())
    between = edges.join(joints.select(key, F.col("a").alias("b")), [key, "b"]).join(heads.select(key, F.col("node").alias("a"), "head"), [key, "a"]).select(key, F.col("head").alias("a"), "b").distinct()
    between = rounds.kept(between)
    live, was = roots, -1
    while (n := live.count()) != was:
        live, was = rounds.kept(live.unionByName(between.join(live, [key, "a"]).select(key, F.col("b").alias("a"))).distinct()), n
    return heads.join(live.select(key, F.col("a").alias("head")), [key, "head"]).select(key, F.col("node").alias("a")).distinct()
