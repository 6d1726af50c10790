"""Rules as data, compiled to conditions, and what is extracted by op ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.ordered import best
from ..sources.content import line_ops, table
from ..sources.rules import compiles, first_rule, packaged_rules
from .documents import LINES
from .registry import query

VARIABLE = [{"name": "number", "regex": "[0-9]{4,}"}, {"name": "mail", "contains": "@"}, {"name": "broken", "regex": "("}]
FIXED = [{"name": "label", "max_len": 30, "regex": "^[a-z ]+:?$"}]


def rule(r: dict, text: Column) -> Column:
    """All conditions of a rule: min_len, max_len, starts_with, ends_with, contains
    and regex, without regard to case. A regex that is none in the engine's own
    dialect makes the rule false."""
    low, found = F.lower(text), F.lit(True)
    if r.get("min_len") is not None:
        found = found & (F.length(text) >= r["min_len"])
    if r.get("max_len") is not None:
        found = found & (F.length(text) <= r["max_len"])
    for key, test in (("starts_with", low.startswith), ("ends_with", low.endswith), ("contains", low.contains)):
        if (r.get(key) or "").strip():
            found = found & test(r[key].lower())
    if (r.get("regex") or "").strip():
        if not compiles(r["regex"]):
            return F.lit(False)
        found = found & text.rlike(f"(?iu){r['regex']}")
    return found


def any_rule(rules: list[dict], text: Column) -> Column:
    return reduce(lambda a, b: a | b, (rule(r, text) for r in rules), F.lit(False))


@query(f"WITH {LINES} SELECT doc_id, op_index, CASE WHEN starts_with(lower(text), 'the') AND length(text) >= 40 THEN 1 WHEN ends_with(text, '.') AND length(text) <= 60 THEN 2 WHEN contains(lower(text), 'license') AND regexp_matches(text, '[0-9]') THEN 3 WHEN regexp_matches(text, '^\\S+$') AND length(text) >= 3 THEN 4 ELSE 0 END AS rule FROM L")
def rule_table(spark, sf_dir):
    """The first rule of a file (rules/lines.json) that a line fulfils, 0 if none."""
    return first_rule(line_ops(table(spark, sf_dir, "documents")), "text", packaged_rules("lines")).select("doc_id", "op_index", "rule")


#: So many words, each with a rule that a line holds it and is long enough for it.
WORDS = 500
MANY = f"""{LINES}, V AS (SELECT w, row_number() OVER (ORDER BY n DESC, w)::INT AS rule FROM (SELECT w, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS w FROM L) WHERE length(w) >= 4 GROUP BY w) QUALIFY row_number() OVER (ORDER BY n DESC, w) <= {WORDS})"""


@query(f"WITH {MANY} SELECT doc_id, op_index, coalesce(min(rule), 0)::INT AS rule FROM L LEFT JOIN V ON contains(lower(text), w) AND length(text) >= 10 + rule % 30 GROUP BY doc_id, op_index")
def many_rules(spark, sf_dir):
    """Hundreds of rules, made of the most frequent words, in one pass over each line."""
    lines = line_ops(table(spark, sf_dir, "documents"))
    words = lines.select(F.explode(F.split(F.lower("text"), " ")).alias("w")).where(F.length("w") >= 4).groupBy("w").count().orderBy(F.desc("count"), "w").limit(WORDS)
    rules = [{"name": r.w, "contains": r.w, "min_len": 10 + (n + 1) % 30} for n, r in enumerate(words.collect())]
    return first_rule(lines, "text", rules).select("doc_id", "op_index", "rule")


#: Candidates of a field: which operators, of which kind, and what must match.
RANGES = [("op2-3[Tj]", r"\b[0-9]{4,}\b"), ("op1-2[*]", "[A-Z][a-z]+ [A-Z][a-z]+"), ("op4[Tj]", "[a-z]{8,}"), ("op90-95[ANY]", ".+")]
RANGE = r"^op([0-9]+)(?:-([0-9]+))?(?:\[([^\]]*)\])?$"
VALUES = ", ".join(f"({i}, '{r}', '{p}')" for i, (r, p) in enumerate(RANGES))


def op_range(text: Column) -> Column:
    """start, end (the start, if none is given) and op of 'op<start>[-<end>][<op>]';
    op is null for *, ANY and ALL."""
    start, end, op = (F.regexp_extract(text, RANGE, i) for i in (1, 2, 3))
    return F.struct(start.try_cast("int").alias("start"), F.coalesce(end.try_cast("int"), start.try_cast("int")).alias("end"), F.when(~F.upper(op).isin("", "*", "ANY", "ALL"), op).alias("op"))


def range_text(start: Column, end: Column, op: Column) -> Column:
    return F.concat(F.lit("op"), start.cast("string"), F.when(end > start, F.concat(F.lit("-"), end.cast("string"))).otherwise(""), F.when(op.isNotNull(), F.concat(F.lit("["), op, F.lit("]"))).otherwise(""))


EXTRACTED = rf"""{LINES}, O AS (SELECT doc_id, op_index, text, CASE WHEN length(text) % 3 = 0 THEN 'TJ' ELSE 'Tj' END AS op FROM L), C(ord, raw, pattern) AS (VALUES {VALUES}),
R AS (SELECT ord, pattern, regexp_extract(raw, '^op([0-9]+)', 1)::INT AS a, coalesce(nullif(regexp_extract(raw, '-([0-9]+)', 1), '')::INT, regexp_extract(raw, '^op([0-9]+)', 1)::INT) AS z, nullif(nullif(regexp_extract(raw, '\[(.*)\]', 1), '*'), 'ANY') AS kind FROM C),
J AS (SELECT d.doc_id, R.ord, R.kind, count(O.op_index) AS n, count_if(coalesce(O.op <> R.kind, false)) AS other, string_agg(O.text, ' ' ORDER BY O.op_index) AS value, any_value(R.pattern) AS pattern FROM documents d CROSS JOIN R LEFT JOIN O ON O.doc_id = d.doc_id AND O.op_index BETWEEN R.a AND R.z GROUP BY d.doc_id, R.ord, R.kind),
S AS (SELECT doc_id, ord, CASE WHEN n = 0 THEN 'RANGE_FAIL' WHEN other > 0 THEN 'OP_MISMATCH' WHEN trim(value) = '' THEN 'BLANK' WHEN regexp_extract(value, pattern) = '' THEN 'REGEX_FAIL' ELSE 'OK' END AS status, CASE WHEN n > 0 AND other = 0 THEN regexp_extract(value, pattern) END AS value FROM J)"""


def _extracted(spark, sf_dir):
    """(doc_id, ord, status, value): each candidate's outcome in each document. The
    candidates are a list of the plan, so they are conditions, not a joined table."""
    ops = line_ops(table(spark, sf_dir, "documents")).withColumn("op", F.when(F.length("text") % 3 == 0, "TJ").otherwise("Tj"))
    wanted = F.array(*(F.struct(F.lit(i).alias("ord"), op_range(F.lit(r)).alias("r")) for i, (r, _) in enumerate(RANGES)))
    inside = ops.select("doc_id", "op_index", "op", "text", F.explode(F.filter(wanted, lambda c: F.col("op_index").between(c["r"]["start"], c["r"]["end"]))).alias("c"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("op_index", "text"))), lambda x: x["text"]), " ")
    found = inside.groupBy("doc_id", "c.ord").agg(F.count_if(F.coalesce(F.col("op") != F.col("c.r.op"), F.lit(False))).alias("other"), text.alias("text"))
    every = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*map(F.lit, range(len(RANGES))))).alias("ord"))
    rows = every.join(found, ["doc_id", "ord"], "left")
    match = reduce(lambda w, i: w.when(F.col("ord") == i, F.regexp_extract("text", RANGES[i][1], 0)), range(1, len(RANGES)), F.when(F.col("ord") == 0, F.regexp_extract("text", RANGES[0][1], 0)))
    rows = rows.withColumn("match", match)
    status = F.when(F.col("text").isNull(), "RANGE_FAIL").when(F.col("other") > 0, "OP_MISMATCH").when(F.trim("text") == "", "BLANK").when(F.col("match") == "", "REGEX_FAIL").otherwise("OK")
    return rows.select("doc_id", "ord", status.alias("status"), F.when(F.col("other") == 0, F.col("match")).alias("value"))


@query(f"WITH {EXTRACTED} SELECT doc_id, ord, status, value FROM S")
def range_candidates(spark, sf_dir):
    return _extracted(spark, sf_dir)


@query(f"WITH {EXTRACTED}, B AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY status <> 'OK', ord) AS r FROM S) SELECT doc_id, CASE WHEN status = 'OK' THEN ord END AS ord, CASE WHEN status = 'OK' THEN value END AS value, CASE WHEN status = 'OK' THEN 'OK' ELSE 'NOT_FOUND' END AS status FROM B WHERE r = 1")
def range_first_success(spark, sf_dir):
    """The first candidate of each document that succeeds."""
    rows = best(_extracted(spark, sf_dir), ["doc_id"], [F.col("status") != "OK", F.col("ord")])
    done = F.col("status") == "OK"
    return rows.select("doc_id", F.when(done, F.col("ord")).alias("ord"), F.when(done, F.col("value")).alias("value"), F.when(done, "OK").otherwise("NOT_FOUND").alias("status"))


@query("SELECT l_orderkey, l_linenumber, (l_linenumber)::INT AS start, (l_linenumber + l_quantity::INT % 3)::INT AS \"end\", CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS op, 'op' || l_linenumber || CASE WHEN l_quantity::INT % 3 > 0 THEN '-' || (l_linenumber + l_quantity::INT % 3) ELSE '' END || CASE WHEN l_returnflag <> 'N' THEN '[' || l_returnflag || ']' ELSE '' END AS written FROM lineitem")
def op_range_forms(spark, sf_dir):
    """Op ranges written, parsed and written again; N stands for any operator."""
    last = F.col("l_linenumber") + F.col("l_quantity").cast("int") % 3
    raw = F.concat(F.lit("op"), F.col("l_linenumber"), F.when(last > F.col("l_linenumber"), F.concat(F.lit("-"), last)).otherwise(""), F.lit("["), F.when(F.col("l_returnflag") == "N", F.lit("any")).otherwise(F.col("l_returnflag")), F.lit("]"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", op_range(raw).alias("r"))
    return rows.select("l_orderkey", "l_linenumber", "r.start", "r.end", "r.op", range_text(F.col("r.start"), F.col("r.end"), F.col("r.op")).alias("written"))


@query("WITH S AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS named FROM events) SELECT event_id FROM S WHERE (named = 1 AND event_type = 'purchase') OR (named = 0 AND event_type = 'view')")
def candidate_pruning(spark, sf_dir):
    """Where a key has candidates of its own name only those count, else the generic ones."""
    rows = table(spark, sf_dir, "events")
    named = rows.groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("named"))
    kept = rows.join(named, "user_id").where((F.col("named") & (F.col("event_type") == "purchase")) | (~F.col("named") & (F.col("event_type") == "view")))
    return kept.select("event_id")
