"""Candidates of documents: windows of pages, the anchors that they hold, how full
their pages are, and how much they are like a template."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import difference
from .align import all_distances
from .kernels import by_row
from .ordered import best

#: Below this the second scorer is asked as well, and a candidate counts as weak.
SURE = 0.70
#: Text of a window without any anchor that is compared instead.
UNANCHORED = 2000


def anchored(rows: DataFrame, text: str, groups: dict[str, list[str]], name: str = "anchors") -> DataFrame:
    """rows with a bit for each group of which the text holds a hint: all hints of all
    groups in one pass of an automaton over each text."""
    columns = rows.columns

    def run(batches):
        import ahocorasick

        automaton, bits = ahocorasick.Automaton(), {}
        for i, hints in enumerate(groups.values()):
            for hint in hints:
                if hint:
                    bits[hint] = bits.get(hint, 0) | 1 << i
        for hint, bit in bits.items():
            automaton.add_word(hint, bit)
        if bits:
            automaton.make_automaton()
        whole = (1 << len(groups)) - 1
        for batch in batches:
            masks = []
            for t in batch.column(text).to_pylist():
                mask = 0
                for _, bit in automaton.iter(t or "") if bits else ():
                    mask |= bit
                    if mask == whole:
                        break
                masks.append(mask)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(masks, pa.int32())], [*columns, name])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in rows.dtypes) + f", {name} int")


def density(width: Column, height: Column, area: Column | float) -> Column:
    """The share of a page's area that its words cover (none counts less than nothing)."""
    area = area if isinstance(area, Column) else F.lit(float(area))
    return F.sum(F.greatest(F.lit(0.0), width * height)) / F.greatest(F.lit(1.0), area)


def windows(pages: DataFrame, key: str, title_bit: int, sizes: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """pages(key, page, anchors, density, lines) -> key, start_page, end_page, anchors (of
    all pages of the window), densities and lines: windows of these sizes from each page
    that holds a title (the first page, where none does), cut at the last page, each once."""
    held = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page", "anchors", "density", "lines"))).alias("p"))
    begins = F.transform(F.filter("p", lambda x: x["anchors"].bitwiseAND(title_bit) != 0), lambda x: x["page"])
    held = held.withColumn("_last", F.array_max(F.transform("p", lambda x: x["page"]))).withColumn("_begins", F.when(F.size(begins) > 0, begins).otherwise(F.array(F.array_min(F.transform("p", lambda x: x["page"])))))
    ends = F.flatten(F.transform("_begins", lambda b: F.array(*(F.struct(b.alias("start_page"), F.least(b + (n - 1), F.col("_last")).alias("end_page")) for n in sizes))))
    rows = held.select(key, "p", F.explode(F.array_distinct(ends)).alias("w")).select(key, "p", "w.*")
    inside = F.filter("p", lambda x: (x["page"] >= F.col("start_page")) & (x["page"] <= F.col("end_page")))
    rows = rows.select(key, "start_page", "end_page", inside.alias("p"))
    mask = F.aggregate("p", F.lit(0), lambda m, x: m.bitwiseOR(x["anchors"]))
    return rows.select(key, "start_page", "end_page", mask.alias("anchors"), F.transform("p", lambda x: x["density"]).alias("densities"), F.flatten(F.transform("p", lambda x: x["lines"])).alias("lines"))


def names_of(mask: Column, names: list[str]) -> Column:
    """The names of the bits that are set, joined by commas."""
    return F.array_join(F.array_compact(F.array(*(F.when(mask.bitwiseAND(1 << i) != 0, F.lit(n)) for i, n in enumerate(names)))), ",")


def edits(script: difference.Script) -> int:
    """Edits of a script, where what is gone and new in one change is exchanged one for one."""
    return sum(max(len(g), len(n)) for g, n in zip(script.gone, script.new, strict=True))


def likeness(a: str, b: str) -> tuple[float, float]:
    """One less the share of edits in the longer text: by the readable difference of
    both, and, where that is below ``SURE``, by the least number of edits."""
    longest = max(len(a), len(b))
    if not a.strip() or not b.strip():
        return 0.0, 0.0
    first = max(0.0, 1 - edits(difference.semantic(difference.by_characters(a, b))) / longest)
    if first >= SURE:
        return first, first
    return first, 1 - int(all_distances([a], [b])[0, 0]) / longest


def scored(rows: DataFrame, key: str, hints: list[str], template: str) -> DataFrame:
    """windows (lines in normal form) with score (the readable difference) and second:
    the lines that hold a hint, or else the beginning of the text, against the template."""
    kept = [c for c in rows.columns if c != "lines"]
    kinds = dict(rows.dtypes)

    def measured(lines, *rest):
        lines = [x for x in lines if x is not None]
        chosen = [x for x in lines if any(h in x for h in hints)]
        text = " ".join(chosen) if chosen else " ".join(lines)[:UNANCHORED]
        yield *rest, *likeness(template, text)

    return by_row(rows.select("lines", *kept), measured, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", score double, second double")


def chosen(rows: DataFrame, key: str, groups: int) -> DataFrame:
    """The best window of each key: by the greater score, then by how many groups of
    anchors it holds, then the first; ``weak`` where it stays below SURE."""
    top = F.greatest("score", "second")
    hit = reduce(lambda a, b: a + b, (F.when(F.col("anchors").bitwiseAND(1 << i) != 0, 1).otherwise(0) for i in range(groups)))
    return best(rows, [key], [top.desc(), hit.desc(), F.col("start_page"), F.col("end_page")]).withColumn("weak", top < SURE)
