"""Queries on pairs and groups of documents: what differs, and where."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import align, difference
from ..operators import blocks as B
from ..sources.content import line_ops, table
from .documents import _pairs
from .registry import query
from .streams import FULL, placed


def _normed(pairs):
    """pairs(pair_id, a, b) with the forms that decide whether paired operators vary."""
    return pairs.withColumns({f"{x}_norm": F.transform(x, T.digits_hidden) for x in "ab"})


@query()
def variable_ranges(spark, sf_dir):
    """For each pair the operators of the first from the first to the last that differ in
    their normal form (two further back, at least 1), or all, and the text of that range."""
    found = align.variable_ranges(_normed(_pairs(spark, sf_dir, F.split("text", "\n"))))
    return found.where("side = 'a'").drop("side")


@query()
def page_align_ranges(spark, sf_dir):
    """What varies on the page that each document of a pair resolves to (front_head) and
    on the page after it (back_tail), on both sides. Where a page is missing on a side,
    the band is empty."""
    from .detection import page_resolver

    lines = line_ops(table(spark, sf_dir, "documents")).withColumn("page", F.floor((F.col("op_index") - 1) / 6) + 1)
    at = page_resolver(spark, sf_dir).select("doc_id", F.col("page").alias("found"))
    lines = lines.join(at, "doc_id").where("page between found and found + 1")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("op_index", "text"))), lambda x: x["text"])
    ops = lines.groupBy("doc_id", "page", (F.col("page") - F.col("found")).cast("int").alias("band")).agg(texts.alias("ops"))
    every = at.select("doc_id", "found", F.explode(F.array(F.lit(0), F.lit(1))).alias("band")).join(ops, ["doc_id", "band"], "left")
    side = lambda k: F.max(F.when(F.col("doc_id") % 2 == k, F.struct((F.col("found") + F.col("band")).alias("page"), "ops")))
    both = every.groupBy((F.floor(F.col("doc_id") / 2) * 2 + F.col("band")).alias("pair_id")).agg(side(0).alias("x"), side(1).alias("y")).where("x is not null and y is not null")
    none = F.array().cast("array<string>")
    whole = F.col("x.ops").isNotNull() & F.col("y.ops").isNotNull()
    pairs = both.select("pair_id", F.when(whole, F.col("x.ops")).otherwise(none).alias("a"), F.when(whole, F.col("y.ops")).otherwise(none).alias("b"))
    found = align.variable_ranges(_normed(pairs)).join(both.select("pair_id", F.col("x.page").alias("a_page"), F.col("y.page").alias("b_page")), "pair_id")
    return found.select(F.floor(F.col("pair_id") / 2).alias("pair_id"), F.when(F.col("pair_id") % 2 == 0, "front_head").otherwise("back_tail").alias("band"), "side", F.when(F.col("side") == "a", F.col("a_page")).otherwise(F.col("b_page")).alias("page"), "start_op", "end_op", "value_full")


def _streams(spark, sf_dir):
    """Pairs of whole texts of streams, with the operators that their pieces come from."""
    pieces = B.full_text(placed(spark, sf_dir), ["doc_id"])
    held = F.array_sort(F.collect_list(F.struct("op_index", "begins", "op", "piece")))
    docs = pieces.groupBy("doc_id").agg(held.alias("p"))
    docs = docs.select("doc_id", F.struct(F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"), F.transform("p", lambda x: F.struct(x["begins"].alias("begins"), x["op"].alias("op"))).alias("ops")).alias("d"))
    side = lambda k: F.max(F.when(F.col("doc_id") % 2 == k, F.col("d")))
    both = docs.groupBy(F.floor(F.col("doc_id") / 2).alias("pair_id")).agg(side(0).alias("x"), side(1).alias("y")).where("x is not null and y is not null")
    return both.select("pair_id", F.col("x.text").alias("a"), F.col("x.ops").alias("a_ops"), F.col("y.text").alias("b"), F.col("y.ops").alias("b_ops"))


@query()
def char_diff(spark, sf_dir):
    """Segments of the whole texts of neighbouring streams that are equal, gone or new,
    after the semantic pass, with the operators that they come from."""
    return difference.text_difference(_streams(spark, sf_dir))


def _side_sql(kind: str) -> str:
    return f"(SELECT md5(string_agg(piece, '' ORDER BY doc_id, op_index)) FROM X3 WHERE doc_id = 2 * P.pair_id + {kind})"


@query(f"WITH {FULL}, P AS (SELECT doc_id // 2 AS pair_id FROM X3 GROUP BY 1 HAVING count(DISTINCT doc_id) = 2) SELECT pair_id, {_side_sql('0')} AS a, {_side_sql('1')} AS b FROM P")
def diff_sides(spark, sf_dir):
    """Both texts, rebuilt from the segments of their difference by lines, cleaned for efficiency."""
    rows = difference.text_difference(_streams(spark, sf_dir), passes=("semantic", "lossless", "efficiency"), line_mode=True)
    text = lambda other: F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") != other, F.struct("ord", "text")))), lambda x: x["text"]), ""))
    return rows.groupBy("pair_id").agg(text("INS").alias("a"), text("DEL").alias("b"))


@query()
def fixed_segments(spark, sf_dir):
    """Equal segments of two characters or more are fixed, all others vary."""
    kind = difference.fixed_or_variable(F.col("kind"), F.col("text"))
    return char_diff(spark, sf_dir).groupBy("pair_id", kind.alias("segment")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query()
def variable_tokens(spark, sf_dir):
    """Of four documents each, the tokens and gaps of the first that vary against any
    of the other three, as blocks of neighbouring slots."""
    docs = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 4).alias("group_id"), (F.col("doc_id") % 4).alias("member"), F.split(T.squeeze(F.col("text")), " ").alias("tokens"))
    held = lambda c: F.collect_list(F.when(c, F.col("tokens")))
    groups = docs.groupBy("group_id").agg(held(F.col("member") == 0).alias("bases"), held(F.col("member") > 0).alias("others"))
    return align.base_blocks(groups)


#: The other engine measures bytes, so the characters of a pair become as many bytes first.
NARROWED = "P AS (SELECT *, list_distinct(string_split(coalesce(a, '') || coalesce(b, ''), '')) AS s FROM P0), Q AS (SELECT *, array_to_string(s, '') AS f, array_to_string(list_transform(range(1, len(s) + 1), lambda i: chr(i::INT)), '') AS t FROM P)"


@query(f"WITH P0 AS (SELECT doc_id // 2 AS pair_id, max(CASE WHEN doc_id % 2 = 0 THEN string_split(text, chr(10))[1] END) AS a, max(CASE WHEN doc_id % 2 = 1 THEN string_split(text, chr(10))[1] END) AS b FROM documents GROUP BY 1), {NARROWED} SELECT pair_id, round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 1 WHEN length(a) = 0 OR length(b) = 0 THEN 0 WHEN len(s) > 127 THEN NULL ELSE 0.7 * (1 - levenshtein(translate(a, f, t), translate(b, f, t)) / greatest(length(a), length(b))) + 0.3 * (1 - abs(length(a) - length(b)) / greatest(length(a), length(b))) END::DOUBLE, 6) AS score FROM Q WHERE a IS NOT NULL AND b IS NOT NULL")
def line_similarity(spark, sf_dir):
    """Similarity of the first lines of neighbouring documents."""
    first = F.split("text", "\n")[0]
    rows = table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 2).alias("pair_id")).agg(F.max(F.when(F.col("doc_id") % 2 == 0, first)).alias("a"), F.max(F.when(F.col("doc_id") % 2 == 1, first)).alias("b"))
    return rows.where("a is not null and b is not null").select("pair_id", F.round(align.similarity(F.col("a"), F.col("b")), 6).alias("score"))


#: Templates: literals and fields in order.
TEMPLATES = ["Processo nº {{NUMBER}}, Requerente: {{PARTY}}, fim", "valor de R$ {{AMOUNT}}, em {{DATE}}."]


def compiled(template: str) -> tuple[str, list[str]]:
    """A pattern with a lazy group for each field, and the fields' names."""
    import re

    parts = re.split(r"\{\{(\w+)\}\}", template)
    names = parts[1::2]
    pattern = "".join(re.escape(p).replace("\\ ", r"\s+") if i % 2 == 0 else "(.+?)" for i, p in enumerate(parts))
    return pattern, names


CONFIDENT = "CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 0.9 END::DOUBLE"


@query(f"WITH T AS (SELECT o_orderkey, c_name, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey) SELECT o_orderkey, 'NUMBER' AS field, CASE WHEN o_orderkey % 4 <> 0 THEN lpad(o_orderkey::VARCHAR, 7, '0') END AS value, {CONFIDENT} AS confidence FROM T UNION ALL SELECT o_orderkey, 'PARTY', CASE WHEN o_orderkey % 4 <> 0 THEN c_name END, {CONFIDENT} FROM T UNION ALL SELECT o_orderkey, 'AMOUNT', o_orderkey || ',00', 0.9 FROM T UNION ALL SELECT o_orderkey, 'DATE', strftime(o_orderdate, '%d/%m/%Y'), 0.9 FROM T")
def template_fields(spark, sf_dir):
    """Fields by templates: all literals of a template must stand in order (confidence
    0.65 and a quarter for the share found, 0.9 when all are), else the field is missing."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    label = F.when(F.col("o_orderkey") % 4 == 0, "Autor").otherwise("Requerente")
    text = F.concat(F.lit("Processo nº  "), F.lpad(F.col("o_orderkey").cast("string"), 7, "0"), F.lit(", "), label, F.lit(": "), F.col("c_name"), F.lit(", fim; valor de R$ "), F.col("o_orderkey").cast("string"), F.lit(",00, em "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("."))
    rows = rows.select("o_orderkey", text.alias("text"))
    found = []
    for template in TEMPLATES:
        pattern, names = compiled(template)
        hit = F.col("text").rlike(pattern)
        found += [F.struct(F.lit(n).alias("field"), F.when(hit, F.regexp_extract("text", pattern, i + 1)).alias("value"), F.when(hit, 0.9).otherwise(0.0).alias("confidence")) for i, n in enumerate(names)]
    return rows.select("o_orderkey", F.explode(F.array(*found)).alias("x")).select("o_orderkey", "x.*")


@query("WITH T AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'SEI ' ELSE '' END || CASE o_orderkey % 4 WHEN 1 THEN 'Processo nº ' ELSE '' END || lpad(o_orderkey::VARCHAR, 7, '0') || '-' || lpad((o_custkey % 100)::VARCHAR, 2, '0') || CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE '.2020.8.15' END AS text FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE regexp_extract(text, '[0-9]{7}-[0-9]{2}\\.[0-9]{4}\\.[0-9]\\.[0-9]{2}') END AS number, CASE o_orderkey % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.75 WHEN 2 THEN 0.7 ELSE 0 END::DOUBLE AS confidence, CASE o_orderkey % 4 WHEN 0 THEN 'label' WHEN 1 THEN 'word' WHEN 2 THEN 'bare' ELSE 'not_found' END AS method FROM T")
def case_numbers(spark, sf_dir):
    """Case numbers by a ladder of patterns, the surest first, with method and confidence."""
    key = F.col("o_orderkey")
    number = F.concat(F.lpad(key.cast("string"), 7, "0"), F.lit("-"), F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0"), F.when(key % 4 == 3, "").otherwise(".2020.8.15"))
    text = F.concat(F.when(key % 4 == 0, "SEI ").when(key % 4 == 1, "Processo nº ").otherwise(""), number)
    form = r"([0-9]{7}-[0-9]{2}\.[0-9]{4}\.[0-9]\.[0-9]{2})"
    ladder = (("label", 0.9, rf"(?i)\bSEI\s*{form}"), ("word", 0.75, rf"(?i)processo\s*(?:n[ºo]?\s*)?{form}"), ("bare", 0.7, form))
    hits = F.filter(F.array(*(F.struct(F.regexp_extract(text, p, 1).alias("number"), F.lit(c).alias("confidence"), F.lit(m).alias("method")) for m, c, p in ladder)), lambda h: h["number"] != "")
    first = F.coalesce(F.try_element_at(hits, F.lit(1)), F.struct(F.lit("").alias("number"), F.lit(0.0).alias("confidence"), F.lit("not_found").alias("method")))
    return table(spark, sf_dir, "orders").select("o_orderkey", first.alias("x")).select("o_orderkey", "x.*")


@query("SELECT o_orderkey, c_name AS plaintiff, n_name AS defendant, 'Vara ' || n_nationkey AS court, n_name AS district FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def parties_and_court(spark, sf_dir):
    """Parties, court and district read from a written order."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    text = F.concat(F.lit("O Juízo da Vara "), F.col("n_nationkey"), F.lit(" da Comarca de "), F.col("n_name"), F.lit(", ação movida por "), F.col("c_name"), F.lit(", em face de "), F.col("n_name"), F.lit(", decide."))
    part = lambda p: F.regexp_extract(text, p, 1)
    return rows.select("o_orderkey", part(r"(?i)movid[oa]\s+por\s+([^,\n]+)").alias("plaintiff"), part(r"(?i)em\s+face\s+d[aeo]\s+([^,\n]+)").alias("defendant"), part(r"(?iu)ju[ií]zo\s+d[ao]\s+(.+?)(?:,|\s+d[ao]\s+comarca\b)").alias("court"), part(r"(?i)comarca\s+d[ae]\s+([^,\n]+)").alias("district"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity < 15 THEN 'JZ' WHEN l_quantity < 30 THEN 'DE' ELSE 'CM' END AS role, l_extendedprice::DECIMAL(18,2)::DOUBLE AS amount, (l_discount * 100)::INT AS percent FROM lineitem")
def amounts_and_percents(spark, sf_dir):
    """Amounts with the role that the words before them give, and percents, read back."""
    q = F.col("l_quantity")
    words = F.when(q < 15, "fixados os honorários em ").when(q < 30, "autorizo a despesa no valor de ").otherwise("o Conselho arbitra em ")
    text = F.concat(words, T.format_money(F.col("l_extendedprice").cast("decimal(18,2)")), F.lit(", com adiantamento de "), F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("% do valor"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.alias("text"))
    low = F.lower("text")
    role = F.when(low.contains("conselho"), "CM").when(low.contains("autorizo"), "DE").otherwise("JZ")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", role.alias("role"), T.parse_money(F.col("text")).cast("double").alias("amount"), F.regexp_extract("text", r"([0-9]{1,3})\s*%", 1).cast("int").alias("percent"))
