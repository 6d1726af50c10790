"""Fields that follow from other fields: a graph, put in order and compiled to columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Derived:
    """A field that ``build`` makes of the values it needs (columns, in that order)."""

    needs: tuple[str, ...]
    build: Callable[..., Column]
    confidence: float = 0.7
    method: str = "derived"


def layers(given: set[str], fields: Mapping[str, Derived], wanted: list[str] | None = None) -> list[list[str]]:
    """The derived fields that are wanted and all that these need, in layers: each needs
    only what is given or lies in a layer before. Circles and unknown names are errors."""
    need, open_ = {}, list(fields if wanted is None else wanted)
    while open_:
        name = open_.pop()
        if name in need or (name in given and name not in fields):
            continue
        if name not in fields:
            raise ValueError(f"unknown field {name}")
        # a field may override what is given of its own name, and read it
        need[name] = {n for n in fields[name].needs if n != name or name not in given}
        open_ += need[name]
    sorter = TopologicalSorter({n: {d for d in ds if d in fields} for n, ds in need.items()})
    try:
        sorter.prepare()
    except CycleError as error:
        raise ValueError(f"fields need each other: {' -> '.join(error.args[1])}") from None
    out = []
    while sorter.is_active():
        ready = sorted(sorter.get_ready())
        out.append(ready)
        sorter.done(*ready)
    return out


def wide(candidates: DataFrame, keys: list[str], names: list[str], field: str = "field", value: str = "value") -> DataFrame:
    """One row of each key with a column a field: one shuffle, partial sums first.
    Candidates hold one row a key and field, as ``best`` leaves them."""
    return candidates.groupBy(*keys).agg(*(F.max(F.when(F.col(field) == n, F.col(value))).alias(n) for n in names))


def with_derived(rows: DataFrame, given: list[str], fields: Mapping[str, Derived], wanted: list[str] | None = None) -> DataFrame:
    """rows (wide, a column of each given field) with a column of each derived one: a
    projection a layer, no shuffle. Blank results are null."""
    for layer in layers(set(given), fields, wanted):
        built = {n: fields[n].build(*(F.col(d) for d in fields[n].needs)).cast("string") for n in layer}
        rows = rows.withColumns({n: F.when(F.trim(c) != "", c) for n, c in built.items()})
    return rows


def listed(rows: DataFrame, keys: list[str], given: list[str], fields: Mapping[str, Derived], wanted: list[str] | None = None) -> DataFrame:
    """The long form: keys, field, value, confidence, method, status (OK, OK_DERIVED or NOT_FOUND)."""
    made = [n for layer in layers(set(given), fields, wanted) for n in layer]
    entries = []
    for n in [*(g for g in given if g not in made), *made]:
        held = F.col(n).isNotNull()
        sure, how = (fields[n].confidence, fields[n].method) if n in made else (1.0, "given")
        entries.append(F.struct(F.lit(n).alias("field"), F.col(n).alias("value"), F.when(held, sure).otherwise(0.1).alias("confidence"), F.when(held, how).otherwise("not_found").alias("method"), F.when(held, "OK_DERIVED" if n in made else "OK").otherwise("NOT_FOUND").alias("status")))
    return with_derived(rows, given, fields, wanted).select(*keys, F.explode(F.array(*entries)).alias("f")).select(*keys, "f.*")
