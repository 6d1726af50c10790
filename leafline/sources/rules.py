"""Rules, patterns and field maps as JSON files, and an index over many rules.

A file holds a list of rules or an object with such a list under ``rules``. A rule has a
name and any of min_len, max_len, starts_with, ends_with, contains and regex. Rules
keep the order of files by name and of their places in a file. Patterns are in the
engine's own dialect (java.util.regex) and checked there; a rule whose pattern is none
is never fulfilled."""

from __future__ import annotations

import json
from pathlib import Path

import pyarrow as pa
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("name", "min_len", "max_len", "starts_with", "ends_with", "contains", "regex")
LITERALS = ("contains", "starts_with", "ends_with")
#: Rules are held by the driver and in every task: at most so many characters of files.
MOST_CHARS = 64 << 20
PACKAGED = Path(__file__).resolve().parent.parent / "rules"


def compiles(pattern: str) -> bool:
    """Whether the engine takes the pattern, as a condition without regard to case."""
    context = SparkContext._active_spark_context
    if context is None:
        raise RuntimeError("patterns are checked by a running session")
    try:
        context._jvm.java.util.regex.Pattern.compile(f"(?iu){pattern}")
    except IllegalArgumentException:  # what a pattern that is none raises there
        return False
    return True


def parsed(text: str, origin: str = "") -> list[dict]:
    """The rules of one file; unknown keys and wrong kinds are errors that name the file."""
    found = json.loads(text)
    found = found.get("rules", []) if isinstance(found, dict) else found
    out = []
    for n, r in enumerate(found):
        unknown = set(r) - set(KEYS)
        if unknown:
            raise ValueError(f"{origin}: rule {n} has unknown keys {sorted(unknown)}")
        for key in KEYS:
            kind = int if key.endswith("_len") else str
            if r.get(key) is not None and (not isinstance(r[key], kind) or isinstance(r[key], bool)):
                raise ValueError(f"{origin}: rule {n}: {key} must be of type {kind.__name__}")
        out.append({k: r[k] for k in KEYS if r.get(k) is not None})
    return out


def read_rules(spark: SparkSession, folder: str) -> list[dict]:
    """The rules of all JSON files of a folder that Spark can read."""
    files = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
    size = files.agg(F.coalesce(F.sum(F.length("value")), F.lit(0))).first()[0]
    if size > MOST_CHARS:
        raise ValueError(f"{size} characters of rules; at most {MOST_CHARS} are held")
    return [r for f in sorted(files.collect(), key=lambda f: f.name) for r in parsed(f.value, f.name)]


def packaged_rules(name: str) -> list[dict]:
    """The rules of a file that belongs to the library."""
    path = PACKAGED / f"{name}.json"
    return parsed(path.read_text(encoding="utf-8"), path.name)


def _low(r: dict, key: str) -> str:
    value = (r.get(key) or "").strip()
    return r[key].lower() if value else ""


class Index:
    """Which rules a line may fulfil: an automaton over one literal of each rule (its
    longest) names them in one pass over the line, however many rules there are; rules
    without a literal are candidates by length alone. A pattern is left to the engine."""

    def __init__(self, rules: list[dict], sound: list[bool]):
        import ahocorasick

        self.rules = [(r.get("min_len"), r.get("max_len"), _low(r, "starts_with"), _low(r, "ends_with"), _low(r, "contains"), (r.get("regex") or "").strip() and r["regex"]) for r in rules]
        self.bare, keyed = [], {}
        for n, r in enumerate(rules):
            literal = max((_low(r, k) for k in LITERALS), key=len)
            if not sound[n]:
                continue
            if literal:
                keyed.setdefault(literal, []).append(n)
            else:
                self.bare.append(n)
        self.automaton = ahocorasick.Automaton()
        for literal, numbers in keyed.items():
            self.automaton.add_word(literal, numbers)
        if keyed:
            self.automaton.make_automaton()
        self.any = bool(keyed)

    def candidates(self, low: str, size: int) -> list[tuple[int, str | None]]:
        """(number, pattern that the line must hold besides), by number."""
        met = set(self.bare)
        if self.any:
            for _, numbers in self.automaton.iter(low):
                met.update(numbers)
        out = []
        for n in sorted(met):
            least, most, begin, end, inside, pattern = self.rules[n]
            if (least is None or size >= least) and (most is None or size <= most) and low.startswith(begin) and low.endswith(end) and inside in low:
                out.append((n, pattern or None))
                if not pattern:
                    break  # no later rule can be the first
        return out


def first_rule(rows: DataFrame, text: str, rules: list[dict], name: str = "rule") -> DataFrame:
    """rows with the number (from 1) of the first rule that their text fulfils, 0 if none."""
    sound = [not (r.get("regex") or "").strip() or compiles(r["regex"]) for r in rules]
    low, size, hits = (f"_{name}_{x}" for x in ("low", "size", "hits"))
    given = rows.withColumns({low: F.lower(text), size: F.length(text)})
    kind = "array<struct<n:int,pattern:string>>"
    arrow = pa.list_(pa.struct([("n", pa.int32()), ("pattern", pa.string())]))

    names = rows.columns

    def run(batches):
        index = Index(rules, sound)
        for batch in batches:
            found = [index.candidates(t, n) if t is not None else [] for t, n in zip(batch.column(low).to_pylist(), batch.column(size).to_pylist(), strict=True)]
            hit = pa.array([[{"n": n + 1, "pattern": p} for n, p in f] for f in found], arrow)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), hit], [*names, hits])

    schema = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)
    found = given.mapInArrow(run, f"{schema}, {hits} {kind}")
    done = lambda h: h["pattern"].isNull() | F.rlike(F.col(text), F.concat(F.lit("(?iu)"), h["pattern"]))
    number: Column = F.coalesce(F.array_min(F.transform(F.filter(hits, done), lambda h: h["n"])), F.lit(0))
    return found.withColumn(name, number).drop(hits)
