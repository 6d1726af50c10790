"""Operators on ordered rows: blocks, lines, runs, ranges and anchors. Every one
takes partition keys and a total order, so the result never depends on how rows
are spread."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blocks(rows: DataFrame, keys: list[str], order: list[str], starts: Column) -> DataFrame:
    """block: a number from 1 that grows at each row where ``starts`` holds (a
    condition on the columns and on ``prev(column)`` made with lag())."""
    w = Window.partitionBy(*keys).orderBy(*order)
    flagged = rows.withColumn("_new", F.when(starts, 1).otherwise(0))
    return flagged.withColumn("block", (F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).cast("int")).drop("_new")


def prev(column: str, keys: list[str], order: list[str]) -> Column:
    return F.lag(column).over(Window.partitionBy(*keys).orderBy(*order))


def carried_forward(rows: DataFrame, keys: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """name: the last value of ``column`` that is not null, up to the row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(column, ignorenulls=True).over(w))


def spans(rows: DataFrame, keys: list[str], order: list[str], value: str, at: str) -> DataFrame:
    """Maximal runs of equal values: keys, value, first and last place, length."""
    changed = ~F.col(value).eqNullSafe(prev(value, keys, order))
    return blocks(rows.withColumn("_changed", changed), keys, order, F.col("_changed")).groupBy(*keys, "block", value).agg(F.min(at).alias("start_at"), F.max(at).alias("end_at"), F.count("*").alias("n"))


def ranges(rows: DataFrame, keys: list[str], order: list[str], page: str, last_page: Column) -> DataFrame:
    """start_page and end_page: up to the page before the next entry, or the last."""
    following = F.lead(page).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("start_page", F.col(page)).withColumn("end_page", F.greatest(F.col(page), F.coalesce(following - 1, last_page)))


def anchors(rows: DataFrame, keys: list[str], order: list[str], fixed: Column, text: str) -> DataFrame:
    """The variable rows with the nearest fixed texts before and after them."""
    w = Window.partitionBy(*keys).orderBy(*order)
    fixed_text = F.when(fixed, F.col(text))
    before = F.last(fixed_text, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(fixed_text, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("prev", before).withColumn("next", after).where(~fixed)


def best(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order: the one "first or best wins"."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


class Cells:
    """Windows over rows of a key that are cut into cells (ranges of their order), so that
    a key with a third of all rows is spread over tasks. Each cell is a window of its
    own; what goes from cell to cell (the last row, a sum, the last value) is kept in a
    small table of cells and joined back. ``cell`` must rise with the order."""

    def __init__(self, rows: DataFrame, keys: list[str], order: list[str], cell: Column):
        self.rows, self.keys, self.order = rows.withColumn("_cell", cell), keys, order
        self.by = [*keys, "_cell"]

    def _joined(self, cells: DataFrame) -> DataFrame:
        named = cells.withColumnsRenamed({k: f"_k_{k}" for k in self.by})  # keys may be null
        return self.rows.join(named, [self.rows[k].eqNullSafe(named[f"_k_{k}"]) for k in self.by]).drop(*(f"_k_{k}" for k in self.by))

    def previous(self, *columns: str) -> Cells:
        """prev_<column>: its value in the row before, null in a key's first row."""
        own = F.struct(*columns)
        ends = self.rows.groupBy(*self.by).agg(F.max_by(own, F.struct(*self.order)).alias("_end"))
        was = F.lag("_end").over(Window.partitionBy(*self.keys).orderBy("_cell"))
        cells = ends.select(*self.by, was.alias("_was"))
        inner = F.lag(own).over(Window.partitionBy(*self.by).orderBy(*self.order))
        self.rows = self.rows.withColumn("_own", inner)
        found = F.coalesce("_own", "_was")
        self.rows = self._joined(cells).withColumn("_found", found).withColumns({f"prev_{c}": F.col(f"_found.{c}") for c in columns}).drop("_own", "_was", "_found")
        return self

    def running(self, name: str, amount: Column, **more: Column) -> Cells:
        """name (and each of ``more``): the sum of amounts up to the row."""
        amounts = {name: amount, **more}
        self.rows = self.rows.withColumns({f"_amount_{n}": c for n, c in amounts.items()})
        sums = self.rows.groupBy(*self.by).agg(*(F.sum(f"_amount_{n}").alias(f"_sum_{n}") for n in amounts))
        earlier = Window.partitionBy(*self.keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = sums.select(*self.by, *(F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in amounts))
        inner = Window.partitionBy(*self.by).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0)
        self.rows = self.rows.withColumns({f"_inner_{n}": F.sum(f"_amount_{n}").over(inner) for n in amounts})
        found = self._joined(cells).withColumns({n: F.col(f"_inner_{n}") + F.col(f"_before_{n}") for n in amounts})
        self.rows = found.drop(*(f"_{part}_{n}" for part in ("amount", "inner", "before") for n in amounts))
        return self

    def carried(self, name: str, value: Column) -> Cells:
        """name: the last value that is not null, up to the row."""
        self.rows = self.rows.withColumn("_value", value)
        known = F.when(F.col("_value").isNotNull(), F.struct(*self.order))  # rows of no place don't count
        ends = self.rows.groupBy(*self.by).agg(F.max_by("_value", known).alias("_end"))
        before = F.last("_end", ignorenulls=True).over(Window.partitionBy(*self.keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
        inner = F.last("_value", ignorenulls=True).over(Window.partitionBy(*self.by).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0))
        self.rows = self.rows.withColumn("_inner", inner)
        self.rows = self._joined(ends.select(*self.by, before.alias("_before"))).withColumn(name, F.coalesce("_inner", "_before")).drop("_value", "_inner", "_before")
        return self


def at_rank(rows: DataFrame, keys: list[str], value: str, rank: Callable[[Column], Column]) -> DataFrame:
    """keys and the value at place ``rank(n)`` (from 1) of the n values of each key, in
    rising order, nulls left out. Values fall into cells that grow with them; counts tell
    the cell that holds the place, and only that cell's values are sorted."""
    held = rows.where(F.col(value).isNotNull()).select(*keys, value)
    size = F.floor(F.log2(F.abs(value) + 1) * 16)
    held = held.withColumn("_cell", F.when(F.col(value) < 0, -size - 1).otherwise(size))
    every, rising = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = held.groupBy(*keys, "_cell").agg(F.count("*").alias("_n")).withColumn("_upto", F.sum("_n").over(rising)).withColumn("_rank", rank(F.sum("_n").over(every)))
    cells = cells.where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank")))
    same = Window.partitionBy(*keys).orderBy(value)
    found = held.join(cells, [*keys, "_cell"]).withColumn("_r", F.row_number().over(same) + F.col("_upto") - F.col("_n"))
    return found.where(F.col("_r") == F.col("_rank")).select(*keys, value)


def neighbours(rows: DataFrame, values: DataFrame, key: str, wanted: str, value: str, width: float) -> DataFrame:
    """rows with ``below``, the greatest value of their key up to ``wanted``, and
    ``above``, the least beyond it (null where there is none). Both sides are sorted in
    ranges of ``width``, and what lies beyond a range's borders comes from a small
    table of ranges, so neither a key is one task's nor do rows meet all values."""
    at = lambda c: F.floor(F.col(c) / width)
    listed = values.select(key, F.col(value).alias("_x")).where("_x is not null").distinct().withColumn("_at", at("_x"))
    asked = rows.where(F.col(wanted).isNotNull()).withColumn("_at", at(wanted))
    held = listed.groupBy(key, "_at").agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    ranges_ = held.unionByName(asked.select(key, "_at").distinct(), allowMissingColumns=True).groupBy(key, "_at").agg(F.max("_low").alias("_low"), F.max("_high").alias("_high"))
    w = Window.partitionBy(key).orderBy("_at")
    below = F.last("_high", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    above = F.first("_low", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    borders = ranges_.select(key, "_at", below.alias("_below"), above.alias("_above"))
    both = asked.withColumn("_x", F.col(wanted)).withColumn("_asks", F.lit(1)).unionByName(listed.withColumn("_asks", F.lit(0)), allowMissingColumns=True)
    place = Window.partitionBy(key, "_at").orderBy("_x", "_asks")
    price = F.when(F.col("_asks") == 0, F.col("_x"))
    both = both.withColumn("_p", F.last(price, ignorenulls=True).over(place.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.first(price, ignorenulls=True).over(place.rowsBetween(1, Window.unboundedFollowing)))
    found = both.where("_asks = 1").join(borders, [key, "_at"])
    return found.select(*rows.columns, F.coalesce("_p", "_below").alias("below"), F.coalesce("_n", "_above").alias("above"))


def nearest(rows: DataFrame, values: DataFrame, key: str, wanted: str, value: str, width: float) -> DataFrame:
    """rows with the value of their key that is nearest to ``wanted``, the lesser of
    two as near; rows of keys without values are left out."""
    found = neighbours(rows, values, key, wanted, value, width)
    lower = F.col("above").isNull() | (F.abs(F.col("below") - F.col(wanted)) <= F.abs(F.col("above") - F.col(wanted)))
    return found.withColumn(value, F.when(F.col("below").isNotNull() & lower, F.col("below")).otherwise(F.col("above"))).where(F.col(value).isNotNull()).select(*rows.columns, value)


def following(steps: DataFrame, first: DataFrame, key: str, at: str, to: str, rounds) -> DataFrame:
    """The places that are reached from ``first``(key, at) by steps(key, at, to): one
    step a place, none where ``to`` is null. Steps are doubled in each round, so a way
    of n steps takes log n rounds of two joins on (key, place), however long it is for
    one key; ways that run in a circle end as well."""
    reached, was = rounds.kept(first.select(key, at).distinct()), -1
    steps = rounds.kept(steps.select(key, at, to).where(F.col(to).isNotNull()))
    while True:
        n = reached.count()
        if n == was or steps.isEmpty():
            return reached
        onward = reached.join(steps, [key, at]).select(key, F.col(to).alias(at))
        old = reached
        reached, was = rounds.kept(reached.unionByName(onward).distinct()), n
        twice = rounds.kept(steps.alias("s").join(steps.select(key, F.col(at).alias(to), F.col(to).alias("_far")), [key, to]).select(key, at, F.col("_far").alias(to)))
        rounds.drop(old, steps)
        steps = twice
