"""Queries on positioned operators: every document's lines, placed as a stream is.

Each line is preceded by one positioning operator, by place and length, and shown by
Tj, TJ or '. The rows are made alike in both engines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..sources.content import line_ops, table
from .documents import LINES
from .registry import query

KEYS = ["doc_id"]
PLACED = """O AS (
  SELECT doc_id, 2 * op_index - 1 AS tok_index, ['BT', 'T*', 'Tm', 'Td', 'ET', 'q'][(op_index + length(text)) % 6 + 1] AS op,
    CASE (op_index + length(text)) % 6 WHEN 2 THEN 700.0 - 14 * op_index WHEN 3 THEN (CASE WHEN length(text) % 2 = 0 THEN -14.0 ELSE 0.05 END) END::DOUBLE AS y, NULL::VARCHAR AS text FROM L
  UNION ALL SELECT doc_id, 2 * op_index, CASE WHEN length(text) % 4 = 3 THEN '''' WHEN length(text) % 3 = 0 THEN 'TJ' ELSE 'Tj' END, NULL, text FROM L)"""
LEVELS = f"""{LINES}, {PLACED},
O1 AS (SELECT *, count_if(op IN ('BT', 'T*')) OVER w AS scope, count_if(op IN ('BT', 'T*', 'Tm')) OVER w AS part FROM O WINDOW w AS (PARTITION BY doc_id ORDER BY tok_index ROWS UNBOUNDED PRECEDING)),
O2 AS (SELECT *, CASE WHEN op IN ('Tm', 'Td') THEN sum(CASE WHEN op IN ('Tm', 'Td') THEN y END) OVER (PARTITION BY doc_id, part ORDER BY tok_index ROWS UNBOUNDED PRECEDING) END AS level FROM O1),
V AS (SELECT *, last_value(level IGNORE NULLS) OVER (PARTITION BY doc_id, scope ORDER BY tok_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM O2)"""


def _numbered_sql(tolerance: float, ops: str = "'Tj', 'TJ', ''''") -> str:
    return f"""{LEVELS}, V1 AS (SELECT *, count_if(op IN ('BT', 'ET', 'T*') OR coalesce(abs(level - was) > {tolerance}, false)) OVER (PARTITION BY doc_id ORDER BY tok_index ROWS UNBOUNDED PRECEDING)
    + coalesce(count_if(op = '''') OVER (PARTITION BY doc_id ORDER BY tok_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM V),
N AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tok_index) AS op_index FROM V1 WHERE op IN ({ops}))"""


BLOCKS = f"""{_numbered_sql(0.1)}, K AS (SELECT doc_id, b, min(op_index) AS start_op, max(op_index) AS end_op, string_agg(text, '' ORDER BY op_index) AS text,
  coalesce(string_agg(CASE WHEN length(text) = 1 THEN '1' ELSE 'W' END, '' ORDER BY op_index) FILTER (trim(text) <> ''), '') AS pattern, max(length(text)) FILTER (trim(text) <> '') AS longest FROM N GROUP BY doc_id, b HAVING trim(string_agg(text, '' ORDER BY op_index)) <> ''),
BL AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_op) AS block FROM K)"""


def placed(spark, sf_dir):
    lines = line_ops(table(spark, sf_dir, "documents"))
    n, size = F.col("op_index"), F.length("text")
    kind = (n + size) % 6
    y = F.when(kind == 2, 700.0 - 14 * n).when(kind == 3, F.when(size % 2 == 0, F.lit(-14.0)).otherwise(F.lit(0.05)))
    op = F.when(size % 4 == 3, "'").when(size % 3 == 0, "TJ").otherwise("Tj")
    two = F.array(F.struct((2 * n - 1).alias("tok_index"), F.element_at(F.array(*map(F.lit, ("BT", "T*", "Tm", "Td", "ET", "q"))), kind.cast("int") + 1).alias("op"), y.cast("double").alias("y"), F.lit(None).cast("string").alias("text")), F.struct((2 * n).alias("tok_index"), op.alias("op"), F.lit(None).cast("double").alias("y"), F.col("text").alias("text")))
    return lines.select("doc_id", F.explode(two).alias("x")).select("doc_id", "x.*")


@query(f"WITH {BLOCKS} SELECT doc_id, block::INT AS block, start_op::INT AS start_op, end_op::INT AS end_op, md5(text) AS text, pattern, longest::INT AS longest FROM BL")
def stream_blocks(spark, sf_dir):
    return B.blocks(placed(spark, sf_dir), KEYS).select("doc_id", "block", "start_op", "end_op", F.md5("text").alias("text"), "pattern", "longest")


TJ_ONLY = _numbered_sql(0.1, "'TJ'")


@query(f"WITH {TJ_ONLY}, A AS (SELECT doc_id, tok_index, row_number() OVER (PARTITION BY doc_id ORDER BY tok_index) AS every FROM V WHERE op IN ('Tj', 'TJ', '''')) SELECT N.doc_id, N.op_index::INT AS among_allowed, A.every::INT AS among_all FROM N JOIN A USING (doc_id, tok_index)")
def op_numberings(spark, sf_dir):
    """TJ operators numbered among those allowed and among all."""
    w = Window.partitionBy(*KEYS).orderBy("tok_index")
    rows = placed(spark, sf_dir).where(F.col("op").isin(*B.SHOWING)).withColumn("among_all", F.row_number().over(w)).where("op = 'TJ'")
    return rows.select("doc_id", F.row_number().over(w).alias("among_allowed"), "among_all")


@query(f"WITH {BLOCKS}, C AS (SELECT *, count(*) OVER (PARTITION BY doc_id, pattern) AS n FROM BL), M AS (SELECT *, CASE WHEN longest >= 5 AND n <= 2 THEN 'V' ELSE 'F' END AS guess FROM C) SELECT doc_id, block::INT AS block, CASE WHEN regexp_matches(lower(text), '[0-9]{{4,}}') OR contains(text, '@') THEN 'V' WHEN length(text) <= 30 AND regexp_matches(lower(text), '^[a-z ]+:?$') THEN 'F' ELSE guess END AS kind FROM M")
def block_kinds(spark, sf_dir):
    """Blocks of rare patterns with long tokens vary; rules for fixed and, above
    them, for variable blocks decide otherwise."""
    rows = B.blocks(placed(spark, sf_dir), KEYS).withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "pattern")))
    guess = F.when((F.col("longest") >= 5) & (F.col("n") <= 2), "V").otherwise("F")
    from .rules import FIXED, VARIABLE, any_rule

    return rows.select("doc_id", "block", F.when(any_rule(VARIABLE, F.col("text")), "V").when(any_rule(FIXED, F.col("text")), "F").otherwise(guess).alias("kind"))


KIND_OF = "CASE WHEN longest >= 40 THEN 'V' ELSE 'F' END"
ANCHORS = f"""A AS (SELECT doc_id, block, start_op, {KIND_OF} AS kind, last_value(CASE WHEN {KIND_OF} = 'F' THEN pattern END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
  first_value(CASE WHEN {KIND_OF} = 'F' THEN pattern END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM BL)"""


def _anchored(spark, sf_dir):
    rows = B.blocks(placed(spark, sf_dir), KEYS).withColumn("kind", F.when(F.col("longest") >= 40, "V").otherwise("F"))
    from ..operators.ordered import anchors

    return anchors(rows, KEYS, ["block"], F.col("kind") == "F", "pattern")


@query(f"WITH {BLOCKS}, {ANCHORS} SELECT prev, next, count(*) AS n, array_to_string(list_transform((list_sort(list(doc_id * 1000000 + start_op)))[1:3], lambda x: x::VARCHAR), ',') AS examples FROM A WHERE kind = 'V' AND prev IS NOT NULL AND next IS NOT NULL GROUP BY prev, next")
def anchor_groups(spark, sf_dir):
    """Pairs of fixed neighbours of variable blocks, how often, and the first three places."""
    rows = _anchored(spark, sf_dir).where("prev is not null and next is not null").withColumn("at", F.struct("doc_id", "start_op"))
    # the three least of each part first, so that no group is gathered whole
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("prev", "next").orderBy("at"))).where("r <= 3").groupBy("prev", "next").agg(F.array_join(F.transform(F.array_sort(F.collect_list("at")), lambda x: (x["doc_id"] * 1000000 + x["start_op"]).cast("string")), ",").alias("examples"))
    return rows.groupBy("prev", "next").agg(F.count("*").alias("n")).join(few, ["prev", "next"])


@query(f"WITH {_numbered_sql(2.0)}, G AS (SELECT doc_id, b, min(op_index) AS start_op, string_agg(text, '' ORDER BY op_index) AS text FROM N GROUP BY doc_id, b) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_op)::INT AS line, md5(text) AS text FROM G")
def stream_lines(spark, sf_dir):
    return B.lines(placed(spark, sf_dir), KEYS).select("doc_id", "line", F.md5("text").alias("text"))


PARAS = f"""{LINES}, Y AS (SELECT doc_id, op_index AS line, (1000 - sum(10 + length(text) % 3 * 12) OVER (PARTITION BY doc_id ORDER BY op_index))::DOUBLE AS y, text FROM L),
G AS (SELECT *, abs(y - lag(y) OVER w) AS gap, trim(text) = '' AS blank, lag(trim(text) = '') OVER w AS after_blank FROM Y WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
M AS (SELECT doc_id, list_sort(list(gap) FILTER (gap > 0)) AS g FROM G GROUP BY doc_id),
P AS (SELECT G.*, count_if(blank OR coalesce(after_blank, false) OR coalesce(gap > g[len(g) // 2 + 1] * 1.6, false)) OVER (PARTITION BY G.doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS p FROM G JOIN M USING (doc_id)),
Q AS (SELECT doc_id, p, min(line) AS first_line, string_agg(text, chr(10) ORDER BY line) AS text FROM P WHERE NOT blank GROUP BY doc_id, p)"""


@query(f"WITH {PARAS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first_line)::INT AS paragraph, first_line::INT AS first_line, md5(text) AS text FROM Q")
def text_paragraphs(spark, sf_dir):
    """Paragraphs of each document's lines, whose heights follow from their lengths."""
    lines = line_ops(table(spark, sf_dir, "documents")).withColumnRenamed("op_index", "line")
    y = 1000 - F.sum(10 + F.length("text") % 3 * 12).over(Window.partitionBy("doc_id").orderBy("line"))
    return B.paragraphs(lines.withColumn("y", y.cast("double")), KEYS).select("doc_id", "paragraph", "first_line", F.md5("text").alias("text"))


FULL = f"""{LEVELS}, X AS (SELECT *, count_if(op IN ('T*', '''') OR (op = 'Td' AND abs(y) > 0.01) OR (op = 'Tm' AND coalesce(abs(level - was) > 0.01, false))) OVER (PARTITION BY doc_id ORDER BY tok_index ROWS UNBOUNDED PRECEDING) AS brk FROM V),
X1 AS (SELECT *, row_number() OVER w AS op_index, lag(text) OVER w AS before, lag(brk) OVER w AS brk0 FROM X WHERE op IN ('Tj', 'TJ', '''') WINDOW w AS (PARTITION BY doc_id ORDER BY tok_index)),
X2 AS (SELECT *, CASE WHEN brk > brk0 AND before IS NOT NULL THEN chr(10) ELSE '' END || text AS piece FROM X1),
X3 AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY tok_index ROWS UNBOUNDED PRECEDING) - length(piece) AS begins FROM X2)"""


@query(f"WITH {FULL} SELECT doc_id, op_index::INT AS op_index, begins::INT AS begins, md5(piece) AS piece FROM X3")
def full_text_ops(spark, sf_dir):
    return B.full_text(placed(spark, sf_dir), KEYS).select("doc_id", "op_index", "begins", F.md5("piece").alias("piece"))


@query(f"WITH {FULL}, T AS (SELECT doc_id, string_agg(piece, '' ORDER BY op_index) AS whole FROM X3 GROUP BY doc_id), F AS (SELECT doc_id, strpos(whole, regexp_extract(whole, '[0-9]{{3,}}[^0-9]')) - 1 AS a, strpos(whole, regexp_extract(whole, '[0-9]{{3,}}[^0-9]')) - 1 + length(regexp_extract(whole, '[0-9]{{3,}}[^0-9]')) AS z FROM T WHERE regexp_matches(whole, '[0-9]{{3,}}[^0-9]')) SELECT F.doc_id, min(op_index)::INT AS first_op, max(op_index)::INT AS last_op FROM F JOIN X3 ON F.doc_id = X3.doc_id AND begins < z AND begins + length(piece) > a GROUP BY F.doc_id")
def offset_to_op(spark, sf_dir):
    """The operators that the first long number of a stream's whole text spans."""
    pieces = B.full_text(placed(spark, sf_dir), KEYS)
    whole = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("op_index", "begins", "piece"))).alias("p"))
    rows = whole.withColumn("whole", F.array_join(F.transform("p", lambda x: x["piece"]), "")).withColumn("value", F.regexp_extract("whole", "[0-9]{3,}[^0-9]", 0)).where("value != ''")
    rows = rows.withColumn("a", F.expr("locate(value, whole) - 1")).withColumn("z", F.col("a") + F.length("value"))
    hit = F.filter("p", lambda x: (x["begins"] < F.col("z")) & (x["begins"] + F.length(x["piece"]) > F.col("a")))
    return rows.select("doc_id", hit.alias("h")).select("doc_id", F.array_min(F.transform("h", lambda x: x["op_index"])).alias("first_op"), F.array_max(F.transform("h", lambda x: x["op_index"])).alias("last_op"))


@query(f"WITH {BLOCKS}, W AS (SELECT doc_id, min(start_op) AS start_op, max(end_op) AS end_op, string_agg(text, '' ORDER BY block) AS text FROM BL WHERE block BETWEEN 2 AND 4 GROUP BY doc_id) SELECT doc_id, start_op::INT AS start_op, end_op::INT AS end_op, md5(text) AS text FROM W")
def block_range(spark, sf_dir):
    """Blocks 2 to 4 of each stream as one."""
    rows = B.blocks(placed(spark, sf_dir), KEYS).where("block between 2 and 4").groupBy("doc_id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "")
    return rows.agg(F.min("start_op").alias("start_op"), F.max("end_op").alias("end_op"), F.md5(text).alias("text"))


@query(f"WITH {_numbered_sql(0.1)} SELECT doc_id, md5(string_agg(text, '' ORDER BY op_index)) AS value FROM N WHERE op_index BETWEEN 2 AND 5 GROUP BY doc_id")
def op_slice(spark, sf_dir):
    """The text of operators 2 to 5."""
    rows = placed(spark, sf_dir).where(F.col("op").isin(*B.SHOWING)).withColumn("op_index", F.row_number().over(Window.partitionBy(*KEYS).orderBy("tok_index")))
    return B.sliced(rows, KEYS, 2, 5).select("doc_id", F.md5("value").alias("value"))


@query("WITH S AS (SELECT conv_id, turn AS slot, bool_or(length(text) % 3 <> 0) AS variable FROM conversations GROUP BY conv_id, turn), R AS (SELECT *, slot - row_number() OVER (PARTITION BY conv_id ORDER BY slot) AS g FROM S WHERE variable) SELECT conv_id, min(slot) AS first_slot, max(slot) AS last_slot FROM R GROUP BY conv_id, g")
def variable_slots(spark, sf_dir):
    """Runs of turns whose length is no multiple of three, as variable slots are."""
    slots = table(spark, sf_dir, "conversations").groupBy("conv_id", F.col("turn").alias("slot")).agg(F.bool_or(F.length("text") % 3 != 0).alias("variable"))
    return B.variable_runs(slots, ["conv_id"])
