"""Blocks, lines and paragraphs of positioned operators.

Rows are operators of streams in order: keys, tok_index, op, y (the vertical operand
of Tm, Td and TD) and text (of showing operators). A stream is one text, so the
windows here are over one text at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHOWING, BREAKING = ("Tj", "TJ", "'", '"'), ("'", '"')
_Y = ("Tm", "Td", "TD")


def with_levels(ops: DataFrame, keys: list[str]) -> DataFrame:
    """level: the height after a positioning operator; was: the height before it,
    null where BT or T* has made it unknown. Td adds to it, Tm sets it."""
    order = Window.partitionBy(*keys).orderBy("tok_index").rowsBetween(Window.unboundedPreceding, 0)
    rows = ops.withColumn("_scope", F.count_if(F.col("op").isin("BT", "T*")).over(order)).withColumn("_set", F.count_if(F.col("op").isin("BT", "T*", "Tm")).over(order))
    moved = F.when(F.col("op").isin(*_Y), F.col("y"))
    level = F.sum(moved).over(Window.partitionBy(*keys, "_set").orderBy("tok_index").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("level", F.when(moved.isNotNull(), level))
    before = Window.partitionBy(*keys, "_scope").orderBy("tok_index").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("was", F.last("level", ignorenulls=True).over(before)).drop("_scope", "_set")


def _flushes(tolerance: float) -> Column:
    moved = F.coalesce(F.abs(F.col("level") - F.col("was")) > tolerance, F.lit(False))
    return F.col("op").isin("BT", "ET", "T*") | moved


def _numbered(ops: DataFrame, keys: list[str], tolerance: float, allowed: tuple) -> DataFrame:
    """The showing operators that are allowed, numbered from 1 (op_index), and the
    block each falls in. A block ends before BT, ET, T* and a change of height, and
    after an operator that breaks the line."""
    w = Window.partitionBy(*keys).orderBy("tok_index")
    rows = with_levels(ops, keys)
    after = F.count_if(F.col("op").isin(*BREAKING)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_block", F.count_if(_flushes(tolerance)).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(after, F.lit(0)))
    rows = rows.where(F.col("op").isin(*(allowed or SHOWING)))
    return rows.withColumn("op_index", F.row_number().over(w))


def _joined(separator: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("op_index", "text"))), lambda x: x["text"]), separator)


def blocks(ops: DataFrame, keys: list[str], tolerance: float = 0.1, allowed: tuple = ()) -> DataFrame:
    """keys, block (from 1), start_op, end_op, text, pattern (1 for tokens of one
    character, W for longer ones), longest token and ops; blank blocks are left out."""
    tokens = F.array_sort(F.collect_list(F.struct("op_index", "text", "op")))
    rows = _numbered(ops, keys, tolerance, allowed).groupBy(*keys, "_block").agg(F.min("op_index").alias("start_op"), F.max("op_index").alias("end_op"), tokens.alias("_t"))
    text = F.array_join(F.transform("_t", lambda x: x["text"]), "")
    lengths = F.filter(F.transform("_t", lambda x: F.when(F.trim(x["text"]) != "", F.length(x["text"]))), lambda n: n.isNotNull())
    rows = rows.select(*keys, "start_op", "end_op", text.alias("text"), lengths.alias("_n"), F.array_join(F.array_distinct(F.transform("_t", lambda x: x["op"])), ",").alias("ops")).where(F.trim("text") != "")
    pattern = F.array_join(F.transform("_n", lambda n: F.when(n == 1, "1").otherwise("W")), "")
    rows = rows.select(*keys, "start_op", "end_op", "text", pattern.alias("pattern"), F.array_max("_n").alias("longest"), "ops")
    return rows.withColumn("block", F.row_number().over(Window.partitionBy(*keys).orderBy("start_op")))


def lines(ops: DataFrame, keys: list[str], tolerance: float = 2.0) -> DataFrame:
    """keys, line (from 1), its first operator and text; blank lines stay."""
    rows = _numbered(ops, keys, tolerance, ())
    found = rows.groupBy(*keys, "_block").agg(F.min("op_index").alias("start_op"), _joined("").alias("text"))
    return found.withColumn("line", F.row_number().over(Window.partitionBy(*keys).orderBy("start_op"))).select(*keys, "line", "start_op", "text")


def paragraphs(rows: DataFrame, keys: list[str], factor: float = 1.6) -> DataFrame:
    """Lines(keys, line, y, text) joined by line ends: a new paragraph after a
    blank line and where the gap exceeds ``factor`` times the upper median gap."""
    w = Window.partitionBy(*keys).orderBy("line")
    gap = F.abs(F.col("y") - F.lag("y").over(w))
    found = rows.withColumn("_gap", gap).withColumn("_blank", F.trim("text") == "")
    every = F.array_sort(F.collect_list(F.when(F.col("_gap") > 0, F.col("_gap"))))
    middle = found.groupBy(*keys).agg(every.alias("_g")).select(*keys, F.try_element_at("_g", (F.size("_g") / 2).cast("int") + 1).alias("_m"))
    found = found.join(middle, keys)
    starts = F.col("_blank") | F.coalesce(F.lag("_blank").over(w), F.lit(False)) | F.coalesce(F.col("_gap") > F.col("_m") * factor, F.lit(False))
    found = found.withColumn("_p", F.count_if(starts).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(~F.col("_blank"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    found = found.groupBy(*keys, "_p").agg(F.min("line").alias("first_line"), text.alias("text"))
    return found.withColumn("paragraph", F.row_number().over(Window.partitionBy(*keys).orderBy("first_line"))).select(*keys, "paragraph", "first_line", "text")


def full_text(ops: DataFrame, keys: list[str], line_break: str = "\n", tolerance: float = 0.01) -> DataFrame:
    """keys, op_index, begins (offset from 0) and piece: the stream's text in pieces,
    each after the breaks that T*, ' and " and changes of height put before it. The
    break belongs to the operator before. A blank as break is left out after blanks."""
    w = Window.partitionBy(*keys).orderBy("tok_index")
    rows = with_levels(ops, keys)
    moves = (F.col("op").isin("Td", "TD") & (F.abs(F.col("y")) > tolerance)) | ((F.col("op") == "Tm") & F.coalesce(F.abs(F.col("level") - F.col("was")) > tolerance, F.lit(False)))
    breaks = (F.col("op") == "T*") | F.col("op").isin(*BREAKING) | moves
    rows = rows.withColumn("_breaks", F.count_if(breaks).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("op").isin(*SHOWING))
    rows = rows.withColumn("op_index", F.row_number().over(w)).withColumn("_before", F.lag("text").over(w))
    broken = (F.col("_breaks") > F.lag("_breaks").over(w)) & F.col("_before").isNotNull()
    blank = F.lit(line_break == " ") & F.coalesce(F.col("_before").rlike(r"\s$"), F.lit(False))
    rows = rows.withColumn("piece", F.concat(F.when(broken & ~blank, line_break).otherwise(""), F.coalesce("text", F.lit(""))))
    ends = F.sum(F.length("piece")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("begins", (ends - F.length("piece")).cast("int")).select(*keys, "op_index", "op", "begins", "piece")


def sliced(rows: DataFrame, keys: list[str], start: int, end: int) -> DataFrame:
    """The text of an op range (cut to at least 1, and an end at the start or after)."""
    start, end = max(1, start), max(1, start, end)
    return rows.where(F.col("op_index").between(start, end)).groupBy(*keys).agg(_joined("").alias("value"))


def variable_runs(slots: DataFrame, keys: list[str]) -> DataFrame:
    """slots(keys, slot, variable): maximal runs of variable slots, first and last."""
    w = Window.partitionBy(*keys).orderBy("slot")
    rows = slots.where("variable").withColumn("_run", F.col("slot") - F.row_number().over(w))
    return rows.groupBy(*keys, "_run").agg(F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot")).drop("_run")
