"""Queries on fields by op ranges, on the lines of documents as operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extraction as E
from ..sources.content import line_ops, table
from .documents import LINES
from .registry import query

C = E.Candidate
CANDIDATES = [
    C("NUMBER", "op2-3[Tj]", "([0-9]{3,})"), C("NUMBER", "op1-4", "([0-9]{2,})[^0-9]"),
    C("NAME", "op1", "^([^ ]+) ", after=("op9[q]", "op2"), least=6), C("NAME", "op2", "^([^ ]+) ", after=("op3",)),
    C("WORDS", "op4-5[TJ]", least_word=9, most=500), C("WORDS", "op1", least_word=16), C("WORDS", "op1-2", most_word=14),
    C("BROKEN", "op1", "("), C("GROUP", "op1", "[aeiou]", group=3), C("HOLLOW", "op1", "(#?)e"),
    C("VARIED", "op2", block="variable"), C("VARIED", "op1", block="variable"), C("JOINED", "op2-3", block="any"), C("SETTLED", "op1", block="fixed"), C("SETTLED", "op2", block="fixed"),
    C("ZERO", "op0-2"), C("TURNED", "op5-3"), C("FAR", "op90"), C("ALONE", "op2", needs_anchors=True),
    C("BEFORE", "op3", before=("op2[TJ]", "op1[TJ]"), most=300), C("REST", "op3-0", r"\.([^.]+)\.$"), C("UNREAD", "line 3"),
]
WANTED = [*dict.fromkeys(c.field for c in CANDIDATES), "NEVER"]


def _sql_text(x) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


def _ranges_sql(raws) -> str:
    return "[" + ", ".join(f"{{'a': {r[0]}, 'z': {r[1]}, 'k': {_sql_text(r[2])}::VARCHAR}}" for raw in raws if (r := E.parsed(raw))) + "]::STRUCT(a INT, z INT, k VARCHAR)[]"


VALUES = ", ".join(f"({n}, '{c.field}', {_sql_text(c.op_range)}, {r[0]}, {r[1]}, {_sql_text(r[2])}::VARCHAR, {_ranges_sql(c.before)}, {_ranges_sql(c.after)}, {c.needs_anchors}, {c.least}, {c.most}, {c.least_word}, {c.most_word}, {_sql_text(c.block)}::VARCHAR, {_sql_text(c.pattern)}::VARCHAR)" for n, c in enumerate(CANDIDATES) if (r := E.parsed(c.op_range)))
# one branch a pattern: the other engine takes constants only
GROUPED = {n: 1 if c.pattern and "(" in c.pattern else 0 for n, c in enumerate(CANDIDATES)}
USED = [(n, c) for n, c in enumerate(CANDIDATES) if c.pattern and c.field not in ("BROKEN", "GROUP")]
CASES = lambda f: "CASE ord " + " ".join(f"WHEN {n} THEN {f(n, c)}" for n, c in USED)
HELD = "(SELECT string_agg(O.text, '' ORDER BY O.op_index) FROM O WHERE O.doc_id = T.doc_id AND O.op_index BETWEEN x.a AND x.z HAVING x.a >= 1 AND x.z <= T.n AND bool_and(x.k IS NULL OR O.op = x.k) AND regexp_replace(string_agg(O.text, ''), '\\s+', '', 'g') <> '')"


def _anchor(side: str) -> str:
    return f"(SELECT arg_min({HELD}, p) FROM (SELECT unnest(T.{side}) AS x, generate_subscripts(T.{side}, 1) AS p) WHERE {HELD} IS NOT NULL)"


EXTRACTED = rf"""{LINES}, O AS (SELECT doc_id, op_index, text, CASE WHEN length(text) % 3 = 0 THEN 'TJ' ELSE 'Tj' END AS op FROM L), D AS (SELECT doc_id, count(*) AS n FROM O GROUP BY doc_id),
V(ord, field, raw, a, z0, kind, before, after, needs, least, most, least_word, most_word, block, pattern) AS (VALUES {VALUES}),
J AS (SELECT D.doc_id, D.n, V.*, CASE WHEN z0 = 0 THEN n ELSE z0 END AS z FROM D, V),
H AS (SELECT J.doc_id, J.ord, string_agg(O.text, '' ORDER BY O.op_index) AS full_text, bool_or(coalesce(O.op <> J.kind, false)) AS other FROM J JOIN O ON O.doc_id = J.doc_id AND O.op_index BETWEEN J.a AND J.z WHERE J.a >= 1 AND J.z <= J.n GROUP BY J.doc_id, J.ord),
R AS (SELECT J.*, H.full_text, CASE WHEN a <= 0 OR z < a THEN 'range_invalido' WHEN z > n THEN 'range_fora_do_stream' WHEN other THEN 'op_mismatch' WHEN regexp_replace(full_text, '\s+', '', 'g') = '' THEN 'texto_vazio' END AS range_reason FROM J LEFT JOIN H USING (doc_id, ord)),
M AS (SELECT *, {CASES(lambda n, c: f"regexp_matches(full_text, '(?s){c.pattern}')")} WHEN {next(n for n, c in enumerate(CANDIDATES) if c.field == 'GROUP')} THEN regexp_matches(full_text, '[aeiou]') ELSE true END AS hit, {CASES(lambda n, c: f"regexp_extract(full_text, '(?s){c.pattern}', 0)")} END AS whole, {CASES(lambda n, c: f"regexp_extract(full_text, '(?s){c.pattern}', {GROUPED[n]})")} ELSE full_text END AS got FROM R),
P AS (SELECT *, CASE WHEN range_reason IS NOT NULL OR pattern IS NULL THEN NULL WHEN field = 'BROKEN' THEN 'regex_invalido' WHEN NOT hit THEN 'regex_sem_match' WHEN field = 'GROUP' THEN 'regex_grupo_invalido' WHEN got = '' THEN 'regex_grupo_vazio' END AS pattern_reason FROM M),
B AS (SELECT *, CASE WHEN ends_with(pattern, '$') THEN length(full_text) - length(whole) ELSE strpos(full_text, whole) - 1 END + strpos(whole, got) - 1 AS begins FROM P),
Q AS (SELECT O.doc_id, B.ord, O.op_index, sum(length(O.text)) OVER (PARTITION BY O.doc_id, B.ord ORDER BY O.op_index ROWS UNBOUNDED PRECEDING) AS ends FROM B JOIN O ON O.doc_id = B.doc_id AND O.op_index BETWEEN B.a AND B.z WHERE pattern IS NOT NULL AND range_reason IS NULL AND pattern_reason IS NULL),
N AS (SELECT Q.doc_id, Q.ord, min(op_index) FILTER (ends > begins) AS first_op, min(op_index) FILTER (ends >= begins + length(got)) AS last_op FROM Q JOIN B USING (doc_id, ord) GROUP BY Q.doc_id, Q.ord),
T AS (SELECT B.*, coalesce(first_op, a) AS s, coalesce(last_op, z0) AS e, CASE WHEN range_reason IS NULL AND pattern_reason IS NULL THEN got END AS value FROM B LEFT JOIN N USING (doc_id, ord)),
A AS (SELECT T.*, {_anchor('before')} AS prev_text, {_anchor('after')} AS next_text, length(value) AS size, list_max(list_transform(regexp_split_to_array(value, '\s+'), lambda w: length(w))) AS word,
  (s = e AND s % 2 = 1) AS in_variable, (s % 2 = 0 AND e <= s) AS in_fixed FROM T),
G AS (SELECT *, coalesce(range_reason, pattern_reason, CASE WHEN needs AND len(before) = 0 AND len(after) = 0 THEN 'anchors_missing' WHEN len(before) > 0 AND prev_text IS NULL THEN 'anchor_prev_missing' WHEN len(after) > 0 AND next_text IS NULL THEN 'anchor_next_missing'
  WHEN least > 0 AND size < least THEN 'min_text_len' WHEN most > 0 AND size > most THEN 'max_text_len' WHEN least_word > 0 AND word < least_word THEN 'min_token_len' WHEN most_word > 0 AND word > most_word THEN 'max_token_len'
  WHEN block = 'variable' AND NOT in_variable THEN 'self_not_variable' WHEN block = 'fixed' AND NOT in_fixed THEN 'self_not_fixed' WHEN block IS NOT NULL AND NOT in_variable AND NOT in_fixed THEN 'self_block_missing' END) AS reason FROM A),
W AS (SELECT doc_id, ord, field, reason IS NULL AS ok, reason, CASE WHEN reason IS NULL AND pattern IS NOT NULL THEN 'op' || s || CASE WHEN e <> s THEN '-' || e ELSE '' END || CASE WHEN kind IS NOT NULL THEN '[' || kind || ']' ELSE '' END ELSE raw END AS op_range, CASE WHEN reason IS NULL THEN value END AS value, CASE WHEN range_reason IS NULL THEN full_text END AS value_full, prev_text, next_text FROM G)"""


def _streams(spark, sf_dir):
    """Documents with their lines as operators; every odd one is a block that varies,
    every even one a fixed block."""
    lines = line_ops(table(spark, sf_dir, "documents"))
    ops = F.transform(F.array_sort(F.collect_list(F.struct("op_index", "text"))), lambda o: F.struct(F.when(F.length(o["text"]) % 3 == 0, "TJ").otherwise("Tj").alias("op"), o["text"].alias("text")))
    rows = lines.groupBy("doc_id").agg(ops.alias("ops"))
    blocks = F.transform(F.sequence(F.lit(1), F.size("ops")), lambda i: F.struct(i.alias("start"), i.alias("end"), F.when(i % 2 == 1, "V").otherwise("F").alias("kind")))
    return rows.withColumn("blocks", blocks)


@query(f"WITH {EXTRACTED} SELECT doc_id, ord, field, ok, coalesce(reason, '') AS reason, op_range, md5(coalesce(value, '-')) AS value, coalesce(length(value_full), -1) AS size FROM W")
def range_outcomes(spark, sf_dir):
    """What becomes of every candidate in every document, and why."""
    rows = E.outcomes(_streams(spark, sf_dir), ["doc_id"], CANDIDATES)
    return rows.select("doc_id", "ord", "field", "ok", F.coalesce("reason", F.lit("")).alias("reason"), "op_range", F.md5(F.coalesce("value", F.lit("-"))).alias("value"), F.coalesce(F.length("value_full"), F.lit(-1)).alias("size"))


NAMES = ", ".join(f"('{w}')" for w in WANTED)
STATUS = "CASE WHEN bool_or(ok) THEN 'OK' WHEN arg_min(reason, ord) FILTER (NOT ok AND value_full IS NOT NULL) LIKE 'regex_%' THEN 'REGEX_FAIL' WHEN count(value_full) > 0 THEN 'RANGE_FAIL' END"


@query(f"""WITH {EXTRACTED}, F AS (SELECT *, bool_or(ok) OVER (PARTITION BY doc_id, field) AS any_ok FROM W), K AS (SELECT doc_id, field, {STATUS} AS status, min(ord) FILTER (ok OR (NOT any_ok AND value_full IS NOT NULL)) AS ord FROM F GROUP BY doc_id, field), Z(field) AS (VALUES {NAMES})
SELECT D.doc_id, Z.field, coalesce(K.status, CASE WHEN Z.field = 'NEVER' THEN 'NO_CANDIDATES' ELSE 'NOT_FOUND' END) AS status, W.op_range, md5(coalesce(W.value, '-')) AS value, md5(coalesce(W.value_full, '-')) AS value_full, md5(coalesce(W.prev_text, '-')) AS prev_text, md5(coalesce(W.next_text, '-')) AS next_text
FROM D CROSS JOIN Z LEFT JOIN K ON K.doc_id = D.doc_id AND K.field = Z.field LEFT JOIN W ON W.doc_id = K.doc_id AND W.ord = K.ord""")
def range_fields(spark, sf_dir):
    """The fields of each document with status, range, value and anchors."""
    rows = E.extracted(_streams(spark, sf_dir), ["doc_id"], CANDIDATES, WANTED)
    return rows.select("doc_id", "field", "status", "op_range", *(F.md5(F.coalesce(c, F.lit("-"))).alias(c) for c in ("value", "value_full", "prev_text", "next_text")))
