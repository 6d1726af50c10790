"""Positioned words: bands and regions of a page, reading order, and lines that are
held against their first word.

Words are rows (keys, text, x0, x1, y and, for regions, y1), y growing upwards. Heights
are compared in whole thousandths, as the tolerance is, so no rounding decides."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import bounded
from .ordered import following, neighbours
from .storage import Rounds

TOLERANCE = 2.0
#: Shares of the page's height. Fixed values.
TOP, BOTTOM, LEAST, MOST = 0.45, 0.25, 0.05, 0.5


def _placed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """The words between blanks of all texts: which text each is of, its number there, the
    words, and where in its text each begins."""
    words = pc.split_pattern(texts, " ")
    flat = words.flatten()
    size, first = np.diff(words.offsets.to_numpy()), words.offsets.to_numpy()[:-1] - words.offsets[0].as_py()
    at = np.arange(len(flat)) - np.repeat(first, size)
    ends = np.concatenate([[0], np.cumsum(pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64) + 1)])
    x0 = ends[:-1] - np.repeat(ends[:-1][np.minimum(first, max(0, len(flat) - 1))], size) if len(flat) else at
    return np.repeat(np.arange(len(texts)), size), at, flat, x0


def placed_words(lines: DataFrame) -> DataFrame:
    """lines(doc_id, op_index, text) -> a row for each word between blanks (empty ones,
    too): at (from 0), text and x0, the place in its line where it begins."""

    def run(batches):
        for batch in batches:
            owner, at, flat, x0 = _placed(batch.column("text"))
            owner = pa.array(owner)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(owner), batch.column("op_index").take(owner), pa.array(at, pa.int32()), flat, pa.array(x0, pa.int64())], ["doc_id", "op_index", "at", "text", "x0"])

    kinds = dict(lines.dtypes)
    rows = bounded(lines.select("doc_id", "op_index", "text").where("text is not null"))
    return rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, op_index {kinds['op_index']}, at int, text string, x0 long")


def in_band(y: Column, height: Column, band: str, share: float | None = None) -> Column:
    """Whether a baseline lies in the top or bottom band; shares are kept within bounds."""
    share = min(MOST, max(LEAST, (TOP if band == "top" else BOTTOM) if share is None else share))
    return y >= height * (1 - share) if band == "top" else y <= height * share


def in_region(low: Column, high: Column, least: float, most: float) -> Column:
    """Whether a word from ``low`` to ``high`` overlaps a region; its limits are kept
    within 0 and 1, and exchanged if they are reversed."""
    least, most = sorted(min(1.0, max(0.0, x)) for x in (least, most))
    return (high >= least) & (low <= most)


def _milli(c: str) -> Column:
    return F.round(F.col(c) * 1000).cast("long")


def reading_order(words: DataFrame, keys: list[str], y: str = "y", x: str = "x0", name: str = "place") -> DataFrame:
    """place: from 1, the highest first, then from left to right, then by text."""
    return words.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(y).desc(), F.col(x), F.col("text"))))


def anchored_lines(words: DataFrame, key: str, tolerance: float = TOLERANCE) -> DataFrame:
    """words with ``line_y``, the height (in thousandths) of their line's first word. Going
    down, a word belongs to the line while it is at most ``tolerance`` below the first
    word of that line; the next one begins a line.

    Where a line begins depends on where the one before began, so no look at the
    neighbouring row can tell. But each height has one successor, the greatest that is
    too low for a line begun at it; the beginnings are what is reached from the top
    by successors, found by doubling. Successors and lines are looked up in ranges of
    heights, so a document of any size is spread over tasks."""
    rounds = Rounds(words.sparkSession)
    milli = int(round(tolerance * 1000))
    heights = rounds.kept(words.where(F.col("y").isNotNull()).select(key, _milli("y").alias("_h")).distinct())
    width = 64.0 * max(1, milli)
    lower = neighbours(heights.withColumn("_asked", F.col("_h") - milli - 1), heights, key, "_asked", "_h", width)
    steps = lower.select(key, F.col("_h").alias("_at"), F.col("below").alias("_to"))
    top = heights.groupBy(key).agg(F.max("_h").alias("_at"))
    begins = following(steps, top, key, "_at", "_to", rounds)
    named = neighbours(heights.withColumn("_asked", F.col("_h") - 1), begins, key, "_asked", "_at", width).select(key, "_h", F.col("above").alias("line_y"))
    return words.withColumn("_h", _milli("y")).join(named, [key, "_h"], "left").drop("_h")


def line_texts(words: DataFrame, key: str, tolerance: float = TOLERANCE) -> DataFrame:
    """key, line (from 1, downwards), text: the words of each line from left to right."""
    rows = anchored_lines(words, key, tolerance).where("line_y is not null")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ")
    lines = rows.groupBy(key, "line_y").agg(texts.alias("text")).where(F.trim("text") != "")
    return lines.withColumn("line", F.row_number().over(Window.partitionBy(key).orderBy(F.col("line_y").desc()))).select(key, "line", "line_y", "text")


#: So many characters of pages are taken apart at once, or one page.
PAGE_CHARS = 1 << 20


def page_lines(lines: DataFrame, key: str, height: Callable, kept: Callable, tolerance: float = TOLERANCE) -> DataFrame:
    """key, line_y, n and text of the lines that ``anchored_lines`` makes of the words of
    lines(key, op_index, text): ``height(op_index, at, size)`` is a word's baseline, ``kept``
    tells of baselines which count (both take arrays). Keys are pages: the lines of one
    must fit a row. They are shuffled as they are and taken apart afterwards, as words in
    rows of their own take many times the room, and no round is written."""
    milli = int(round(tolerance * 1000))

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = batch.column("held")
        page, held = pc.list_parent_indices(held).to_numpy(), held.flatten()
        owner, at, flat, x0 = _placed(pc.struct_field(held, "text"))
        size = pc.utf8_length(flat).to_numpy(zero_copy_only=False)
        y = height(pc.struct_field(held, "op_index").to_numpy()[owner], at, size)
        own = np.flatnonzero((size > 0) & kept(y))
        h = y[own] * 1000
        h, page = np.trunc(h + np.copysign(0.5, h)).astype(np.int64), page[owner[own]]
        down = np.lexsort((-h, page))
        own, h, page = own[down], h[down], page[down]
        # the heights of a page, downwards: each begins a line or belongs to the one before
        fresh = np.flatnonzero(np.diff(h, prepend=0) | np.diff(page, prepend=-1))
        begins, was, line = [], -1, 0
        for p, x in zip(page[fresh].tolist(), h[fresh].tolist(), strict=True):
            begins.append(p != was or x < line - milli)
            if begins[-1]:
                was, line = p, x
        first = fresh[np.array(begins, bool)]
        number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(own))))
        across = np.lexsort((x0[own], number))
        tied = np.flatnonzero((np.diff(number[across]) == 0) & (np.diff(x0[own][across]) == 0))
        if len(tied):
            rank = np.zeros(len(own), np.int64)
            tied = across[np.union1d(tied, tied + 1)]
            rank[tied] = pc.rank(flat.take(pa.array(own[tied])), tiebreaker="dense").to_numpy()
            across = np.lexsort((rank, x0[own], number))
        edges = np.append(first, len(own))
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), flat.take(pa.array(own[across]))), " ")
        return pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(page[first])), pa.array(h[first]), pa.array(np.diff(edges), pa.int64()), texts], [key, "line_y", "n", "text"])

    def run(batches):
        for batch in batches:
            begin = chars = 0
            for k, page in enumerate(batch.column("held")):
                more = pc.sum(pc.binary_length(pc.struct_field(page.values, "text"))).as_py() or 0
                if k > begin and chars + more > PAGE_CHARS:
                    yield found(batch.slice(begin, k - begin))
                    begin, chars = k, 0
                chars += more
            yield found(batch.slice(begin))

    rows = lines.where("text is not null").groupBy(key).agg(F.collect_list(F.struct("op_index", "text")).alias("held"))
    return bounded(rows).mapInArrow(run, f"{key} {dict(lines.dtypes)[key]}, line_y long, n long, text string")


SIDES = ("x0", "y0", "x1", "y1")


def deduplicated(words: DataFrame, keys: list[str], digits: int = 3) -> DataFrame:
    """One word of each text and four sides, rounded half to even: the first by ``place``."""
    grid = {f"_{c}": F.bround(F.col(c), digits) for c in SIDES}
    first = F.min_by(F.struct(*words.columns), "place")
    return words.withColumns(grid).groupBy(*keys, "text", *grid).agg(first.alias("w")).select("w.*")


def union_box() -> list[Column]:
    """Aggregates for the box around boxes: from an empty one turned inside out, within 0 and 1."""
    held = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    low = lambda c: held(F.least(F.lit(1.0), F.min(c))).alias(c)
    high = lambda c: held(F.greatest(F.lit(0.0), F.max(c))).alias(c)
    return [low("x0"), low("y0"), high("x1"), high("y1")]


def evidence(words: DataFrame, key: str, pattern: str, before: int = 40, most: int = 160) -> DataFrame:
    """key, value, n, the box around the words that the first match of a pattern in a
    key's text (its words in order of ``place``, with blanks between) overlaps, and a
    snippet of at most ``most`` characters that begins ``before`` characters earlier.
    Only keys with a match are kept; the overlap is tested within a row, without a join."""
    held = F.array_sort(F.collect_list(F.struct("place", "text", *SIDES)))
    rows = words.groupBy(key).agg(held.alias("w")).withColumn("whole", F.array_join(F.transform("w", lambda w: w["text"]), " "))
    rows = rows.where(F.col("whole").rlike(pattern)).withColumn("value", F.regexp_extract("whole", pattern, 0)).withColumn("a", F.regexp_instr("whole", F.lit(pattern)) - 1)
    step = lambda s, w: F.struct((s["at"] + F.length(w["text"]) + 1).alias("at"), F.when((s["at"] < F.col("a") + F.length("value")) & (s["at"] + F.length(w["text"]) > F.col("a")), F.array_append(s["met"], F.struct(*(w[c].alias(c) for c in SIDES)))).otherwise(s["met"]).alias("met"))
    none = F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    rows = rows.withColumn("met", F.aggregate("w", F.struct(F.lit(0).alias("at"), none.alias("met")), step, lambda s: s["met"]))
    side = lambda c, pick, edge, clamp: F.least(F.lit(1.0), F.greatest(F.lit(0.0), clamp(F.lit(edge), pick(F.transform("met", lambda m: m[c]))))).alias(c)
    box = [side("x0", F.array_min, 1.0, F.least), side("y0", F.array_min, 1.0, F.least), side("x1", F.array_max, 0.0, F.greatest), side("y1", F.array_max, 0.0, F.greatest)]
    snippet = F.substring(F.col("whole"), F.greatest(F.lit(0), F.col("a") - before) + 1, F.lit(most))
    return rows.select(key, "value", F.size("met").cast("long").alias("n"), *box, snippet.alias("snippet"))
