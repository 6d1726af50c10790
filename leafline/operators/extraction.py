"""Fields by op ranges: candidates of each field are tried in order on every stream,
through the range, the operators' kind, the text, a pattern that narrows the range,
anchors on both sides, lengths and the kind of block; the first that passes all wins.

Streams are rows with their operators as an array, so a candidate is a projection; only
outcomes are grouped, never texts of other candidates. Patterns are constants of the
plan. A group's place in a match is where its text first stands in the match."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.rules import compiles

#: Why a candidate fails.
REASONS = {
    "bad range": "range_invalido", "outside": "range_fora_do_stream", "other op": "op_mismatch", "blank": "texto_vazio",
    "bad pattern": "regex_invalido", "no match": "regex_sem_match", "bad group": "regex_grupo_invalido", "empty group": "regex_grupo_vazio",
    "no anchors": "anchors_missing", "no anchor before": "anchor_prev_missing", "no anchor after": "anchor_next_missing",
    "short": "min_text_len", "long": "max_text_len", "short words": "min_token_len", "long words": "max_token_len",
    "not variable": "self_not_variable", "not fixed": "self_not_fixed", "in no block": "self_block_missing",
}


@dataclass(frozen=True)
class Candidate:
    """One way to a field. Ranges are written op<start>[-<end>][<op>]; an end of 0 is the
    stream's last operator. ``group`` is by default the first of the pattern, if it has
    any. ``block`` is None, 'variable', 'fixed' or 'any'. 0 turns a length's bound off."""

    field: str
    op_range: str
    pattern: str | None = None
    group: int | None = None
    before: tuple[str, ...] = ()
    after: tuple[str, ...] = ()
    needs_anchors: bool = False
    least: int = 0
    most: int = 0
    least_word: int = 0
    most_word: int = 0
    block: str | None = None
    clean: Callable[[Column], Column] | None = field(default=None, compare=False)


def parsed(raw: str) -> tuple[int, int, str | None] | None:
    """(start, end, op) of a written range; None if it is none."""
    body, _, kind = raw.strip().partition("[")
    if not body.lower().startswith("op"):
        return None
    begin, dash, end = body[2:].partition("-")
    if not begin.isdigit() or (dash and not end.isdigit()) or (kind and not kind.endswith("]")):
        return None
    op = kind[:-1]
    return int(begin), int(end) if dash else int(begin), None if op.upper() in ("", "*", "ANY", "ALL") else op


def written(start: Column, end: Column, op: Column) -> Column:
    """A range as it is written; no end where it is the start."""
    return F.concat(F.lit("op"), start.cast("string"), F.when(end != start, F.concat(F.lit("-"), end.cast("string"))).otherwise(""), F.when(op.isNotNull(), F.concat(F.lit("["), op, F.lit("]"))).otherwise(""))


def _groups(pattern: str) -> int:
    return SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern).matcher("").groupCount()


def _range(r: tuple[int, int, str | None]) -> Column:
    return F.struct(F.lit(r[0]).alias("start"), F.lit(r[1]).alias("end"), F.lit(r[2]).cast("string").alias("op"))


def _text_of(ops: Column, r: Column) -> Column:
    """The text of a range; null where the range is none of the stream's or has another operator."""
    end = F.when(r["end"] == 0, F.size(ops)).otherwise(r["end"])
    sound = (r["start"] >= 1) & (end >= r["start"]) & (end <= F.size(ops))
    held = F.slice(ops, F.greatest(r["start"], F.lit(1)), F.when(sound, end - r["start"] + 1).otherwise(0))
    kind = F.forall(held, lambda o: r["op"].isNull() | (o["op"] == r["op"]))
    return F.when(sound & kind, F.array_join(F.transform(held, lambda o: F.coalesce(o["text"], F.lit(""))), ""))


def _blank(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"\s+", ""), F.lit("")) == ""


def _longest_word(text: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.split(text, r"\s+"), lambda w: F.length(w))), F.lit(0))


def outcomes(streams: DataFrame, keys: list[str], candidates: list[Candidate]) -> DataFrame:
    """streams(keys, ops array<struct<op, text>> and, for gates on blocks, blocks
    array<struct<start, end, kind>> of kinds V and F) -> a row for each stream and
    candidate whose range can be read: keys, field, ord, op_range, ok, reason, start,
    end, value, value_full, prev_text, next_text. A null in ops or blocks is an empty list."""
    known = [(n, c, r) for n, c in enumerate(candidates) if (r := parsed(c.op_range))]
    sound = {n: not c.pattern or compiles_plain(c.pattern) for n, c, _ in known}
    groups = {n: _groups(c.pattern) if c.pattern and sound[n] else 0 for n, c, _ in known}
    ranges = lambda raws: F.array(*(_range(r) for raw in raws if (r := parsed(raw)))).cast("array<struct<start:int,end:int,op:string>>")
    entry = lambda n, c, r: F.struct(F.lit(n).alias("ord"), F.lit(c.field).alias("field"), F.lit(c.op_range).alias("op_range"), _range(r).alias("r"), ranges(c.before).alias("before"), ranges(c.after).alias("after"), F.lit(bool(c.before)).alias("has_before"), F.lit(bool(c.after)).alias("has_after"), *(F.lit(getattr(c, k)).alias(k) for k in ("needs_anchors", "least", "most", "least_word", "most_word")), F.lit(c.block).cast("string").alias("block"))
    has_blocks = "blocks" in streams.columns
    none = F.array().cast("array<struct<op:string,text:string>>")
    no_blocks = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    rows = streams.select(*keys, F.coalesce("ops", none).alias("ops"), (F.coalesce("blocks", no_blocks) if has_blocks else no_blocks).alias("blocks"), F.explode(F.array(*(entry(*k) for k in known))).alias("c")).select(*keys, "ops", "blocks", "c.*")
    end = F.when(F.col("r.end") == 0, F.size("ops")).otherwise(F.col("r.end"))
    rows = rows.withColumn("last", end)
    start = F.col("r.start")
    held = F.slice("ops", F.greatest(start, F.lit(1)), F.when((start >= 1) & (F.col("last") >= start) & (F.col("last") <= F.size("ops")), F.col("last") - start + 1).otherwise(0))
    rows = rows.withColumn("held", F.transform(held, lambda o: F.struct(o["op"].alias("op"), F.coalesce(o["text"], F.lit("")).alias("text"))))
    rows = rows.withColumn("full", F.array_join(F.transform("held", lambda o: o["text"]), ""))
    rows = rows.withColumn("range_reason", F.when((start <= 0) | (F.col("last") < start), REASONS["bad range"]).when(F.col("last") > F.size("ops"), REASONS["outside"]).when(F.exists("held", lambda o: F.col("r.op").isNotNull() & (o["op"] != F.col("r.op"))), REASONS["other op"]).when(_blank(F.col("full")), REASONS["blank"]))

    patterned = [(n, c) for n, c, _ in known if c.pattern]
    choose = lambda pairs, rest: reduce(lambda w, p: w.when(F.col("ord") == p[0], p[1]), pairs[1:], F.when(F.col("ord") == pairs[0][0], pairs[0][1])).otherwise(rest) if pairs else rest
    single = lambda c: f"(?s){c.pattern}"
    group_of = lambda n, c: (1 if groups[n] else 0) if c.group is None else c.group
    usable = [(n, c) for n, c in patterned if sound[n] and 0 <= group_of(n, c) <= groups[n]]
    tried = F.col("range_reason").isNull()
    rows = rows.withColumns({
        "hit": choose([(n, tried & F.col("full").rlike(single(c))) for n, c in patterned if sound[n]], F.lit(True)),
        "match": choose([(n, F.when(tried, F.regexp_extract("full", single(c), 0))) for n, c in usable], F.lit(None).cast("string")),
        "got": choose([(n, F.when(tried, F.regexp_extract("full", single(c), group_of(n, c)))) for n, c in usable], F.col("full")),
        "at": choose([(n, F.when(tried, F.regexp_instr("full", F.lit(single(c))) - 1)) for n, c in usable], F.lit(0)),
    })
    of = lambda numbers: F.col("ord").isin(*numbers) if numbers else F.lit(False)
    bad_pattern, bad_group = of([n for n, c in patterned if not sound[n]]), of([n for n, c in patterned if sound[n] and (n, c) not in usable])
    has_pattern = of([n for n, _ in patterned])
    rows = rows.withColumn("pattern_reason", F.when(F.col("range_reason").isNotNull() | ~has_pattern, F.lit(None)).when(bad_pattern, REASONS["bad pattern"]).when(~F.col("hit"), REASONS["no match"]).when(bad_group, REASONS["bad group"]).when(F.col("got") == "", REASONS["empty group"]))

    # which operators the group's characters come from
    step = lambda s, o: F.struct((s["at"] + F.length(o["text"])).alias("at"), F.array_append(s["ends"], s["at"] + F.length(o["text"])).alias("ends"))
    ends = F.aggregate("held", F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends")), step, lambda s: s["ends"])
    rows = rows.withColumn("ends", ends).withColumn("begin", F.col("at") + F.greatest(F.instr("match", F.col("got")) - 1, F.lit(0)))
    narrowed = has_pattern & F.col("pattern_reason").isNull()
    rows = rows.withColumns({
        "first_op": F.when(narrowed, start + F.size(F.filter("ends", lambda e: e <= F.col("begin")))).otherwise(start),
        "last_op": F.when(narrowed, start + F.size(F.filter("ends", lambda e: e < F.col("begin") + F.length("got")))).otherwise(F.col("r.end")),
        "value": F.when(F.col("range_reason").isNull() & F.col("pattern_reason").isNull(), F.col("got")),
        "prev_text": F.try_element_at(F.filter(F.transform("before", lambda r: _text_of(F.col("ops"), r)), lambda t: ~_blank(t)), F.lit(1)),
        "next_text": F.try_element_at(F.filter(F.transform("after", lambda r: _text_of(F.col("ops"), r)), lambda t: ~_blank(t)), F.lit(1)),
    })
    inside = lambda kind: F.exists("blocks", lambda b: (b["kind"] == kind) & (F.col("first_op") >= b["start"]) & (F.col("last_op") <= b["end"]))
    rows = rows.withColumns({"size": F.length("value"), "word": _longest_word(F.col("value")), "in_variable": inside("V"), "in_fixed": inside("F")})
    reason = F.coalesce(
        "range_reason",
        "pattern_reason",
        F.when(F.col("needs_anchors") & ~F.col("has_before") & ~F.col("has_after"), REASONS["no anchors"]),
        F.when(F.col("has_before") & F.col("prev_text").isNull(), REASONS["no anchor before"]),
        F.when(F.col("has_after") & F.col("next_text").isNull(), REASONS["no anchor after"]),
        F.when((F.col("least") > 0) & (F.col("size") < F.col("least")), REASONS["short"]),
        F.when((F.col("most") > 0) & (F.col("size") > F.col("most")), REASONS["long"]),
        F.when((F.col("least_word") > 0) & (F.col("word") < F.col("least_word")), REASONS["short words"]),
        F.when((F.col("most_word") > 0) & (F.col("word") > F.col("most_word")), REASONS["long words"]),
        F.when((F.col("block") == "variable") & ~F.col("in_variable"), REASONS["not variable"]),
        F.when((F.col("block") == "fixed") & ~F.col("in_fixed"), REASONS["not fixed"]),
        F.when(F.col("block").isNotNull() & ~F.col("in_variable") & ~F.col("in_fixed"), REASONS["in no block"]),
    )
    rows = rows.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())
    cleaned = choose([(n, c.clean(F.col("value"))) for n, c, _ in known if c.clean], F.col("value"))
    range_ = F.when(F.col("ok") & has_pattern, written(F.col("first_op"), F.col("last_op"), F.col("r.op"))).otherwise(F.col("op_range"))
    return rows.select(*keys, "field", "ord", range_.alias("op_range"), "ok", "reason", F.col("first_op").alias("start_op"), F.col("last_op").alias("end_op"), F.when(F.col("ok"), cleaned).alias("value"), F.when(F.col("range_reason").isNull(), F.col("full")).alias("value_full"), "prev_text", "next_text")


def compiles_plain(pattern: str) -> bool:
    return compiles(f"(?-iu){pattern}")


def extracted(streams: DataFrame, keys: list[str], candidates: list[Candidate], wanted: list[str] | None = None) -> DataFrame:
    """keys, field, status, op_range, value, value_full, prev_text, next_text: the first
    candidate that passes (OK); else the first whose range holds a text (REGEX_FAIL if its
    pattern failed, RANGE_FAIL if another gate did), without a value; else NOT_FOUND. A
    wanted field without any candidate: NO_CANDIDATES."""
    every = wanted or list(dict.fromkeys(c.field for c in candidates))
    tried = outcomes(streams, keys, [c for c in candidates if c.field in every]) if any(c.field in every and parsed(c.op_range) for c in candidates) else None
    names = streams.select(*keys).distinct().withColumn("field", F.explode(F.array(*map(F.lit, every))))
    empty = F.lit(None).cast("string")
    if tried is None:
        found = names.withColumns({c: empty for c in ("status", "op_range", "value", "value_full", "prev_text", "next_text")})
    else:
        texts = ("value_full", "prev_text", "next_text")
        good = F.struct("ord", F.lit("OK").alias("status"), "op_range", "value", *texts)
        rest = F.struct("ord", F.when(F.col("reason").startswith("regex_"), "REGEX_FAIL").otherwise("RANGE_FAIL").alias("status"), "op_range", empty.alias("value"), *texts)
        first = F.coalesce(F.min(F.when(F.col("ok"), good)), F.min(F.when(~F.col("ok") & F.col("value_full").isNotNull(), rest)))
        best = tried.groupBy(*keys, "field").agg(first.alias("x"))
        found = names.join(best, [*keys, "field"], "left").select(*keys, "field", "x.status", "x.op_range", "x.value", *(f"x.{t}" for t in texts))
    held = {c.field for c in candidates}
    missing = F.when(F.col("field").isin(*held) if held else F.lit(False), "NOT_FOUND").otherwise("NO_CANDIDATES")
    return found.withColumn("status", F.coalesce("status", missing))
