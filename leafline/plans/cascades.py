"""Queries on regions of pages and on ladders that keep the step that won.

Documents are cut into pages of six lines, as in the queries on detection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.ordered import best
from ..sources.content import line_ops, table
from .detection import STREAMS, streams
from .documents import LINES
from .registry import query

PAGED = f"{LINES}, P AS (SELECT *, (op_index - 1) // 6 + 1 AS page, (op_index - 1) % 6 AS place, max((op_index - 1) // 6 + 1) OVER (PARTITION BY doc_id) AS last FROM L)"


def _paged(spark, sf_dir):
    """Lines with page, place (0 to 5) and the document's last page."""
    at = F.col("op_index") - 1
    rows = line_ops(table(spark, sf_dir, "documents")).withColumn("page", F.floor(at / 6) + 1).withColumn("place", at % 6)
    return rows.withColumn("last", F.max("page").over(Window.partitionBy("doc_id")))


def _joined(separator):
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("op_index", "text"))), lambda x: x["text"]), separator)


def first_of(steps, none):
    """The first of (condition, struct) whose condition holds, else ``none``."""
    return reduce(lambda rest, step: F.when(step[0], step[1]).otherwise(rest), reversed(steps), none)


REASON = "CASE WHEN NOT contains(body, 'the') THEN 'missing_header' WHEN NOT (contains(body, 'license') OR contains(body, 'with')) THEN 'missing_title' WHEN NOT (contains(body, 'share') OR regexp_matches(body, '[0-9]{{3,}}')) THEN 'missing_body_or_amount' WHEN NOT (contains(footer, '.') OR contains(signed, '@')) THEN 'missing_signer' ELSE 'ok' END"
CERTIFIED = f"{PAGED}, G AS (SELECT doc_id, page, string_agg(lower(text), ' ' ORDER BY op_index) AS body, arg_max(text, op_index) AS footer FROM P GROUP BY doc_id, page), Z AS (SELECT doc_id, arg_max(text, op_index) AS signed FROM L GROUP BY doc_id), R AS (SELECT doc_id, page, {REASON.replace('{{', '{').replace('}}', '}')} AS reason FROM G JOIN Z USING (doc_id))"


def _certified(spark, sf_dir):
    """Each page's reason: header, title, body or an amount, and a signer in the footer
    or in the document's last line, in that order."""
    rows = _paged(spark, sf_dir).groupBy("doc_id", "page").agg(F.lower(_joined(" ")).alias("body"), F.max_by("text", "op_index").alias("footer"))
    signed = F.last("footer").over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    body = F.col("body")
    reason = F.when(~body.contains("the"), "missing_header").when(~(body.contains("license") | body.contains("with")), "missing_title").when(~(body.contains("share") | body.rlike("[0-9]{3,}")), "missing_body_or_amount").when(~(F.col("footer").contains(".") | signed.contains("@")), "missing_signer").otherwise("ok")
    return rows.select("doc_id", "page", reason.alias("reason"))


@query(f"WITH {CERTIFIED} SELECT doc_id, page, reason FROM R")
def certificate_pages(spark, sf_dir):
    return _certified(spark, sf_dir)


@query(f"WITH {CERTIFIED} SELECT doc_id, coalesce(min(page) FILTER (reason = 'ok'), 0) AS page FROM R GROUP BY doc_id")
def certificate_first(spark, sf_dir):
    """The first page that passes, 0 if none does."""
    return _certified(spark, sf_dir).groupBy("doc_id").agg(F.coalesce(F.min(F.when(F.col("reason") == "ok", F.col("page"))), F.lit(0)).alias("page"))


@query(f"""WITH {LINES}, K AS (SELECT doc_id, coalesce(min(op_index) FILTER (contains(text, 'share') AND contains(text, 'with')), min(op_index) FILTER (contains(text, 'share')), min(op_index) FILTER (contains(text, 'click')), 1) AS start_line,
coalesce(min(op_index) FILTER (regexp_matches(text, '[0-9]{{3,}}') AND contains(text, 'the')), min(op_index) FILTER (regexp_matches(text, '[0-9]{{3,}}'))) AS value_line,
coalesce(max(op_index) FILTER (regexp_matches(text, '[0-9]{{2}}') AND contains(text, 'on ')), max(op_index) FILTER (regexp_matches(text, '[0-9]{{2}}'))) AS date_line FROM L GROUP BY doc_id)
SELECT doc_id, any_value(start_line) AS start_line, any_value(value_line) AS value_line, any_value(date_line) AS date_line, sum(length(text)) FILTER (op_index >= start_line)::BIGINT AS full_chars, coalesce(sum(length(text)) FILTER (op_index = value_line OR op_index = date_line), 0)::BIGINT AS value_date_chars FROM L JOIN K USING (doc_id) GROUP BY doc_id""")
def certificate_regions(spark, sf_dir):
    """Two regions by ranked picks: all from the start on (both words, one, another,
    else the first line), and the lines of value (the first with a hint, else the
    first) and date (the last with a hint, else the last)."""
    text, at = F.col("text"), F.col("op_index")
    value, date = text.rlike("[0-9]{3,}"), text.rlike("[0-9]{2}")
    low, high = (lambda c: F.min(F.when(c, at))), (lambda c: F.max(F.when(c, at)))
    start = F.coalesce(low(text.contains("share") & text.contains("with")), low(text.contains("share")), low(text.contains("click")), F.lit(1))
    rows = line_ops(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(start.alias("start_line"), F.coalesce(low(value & text.contains("the")), low(value)).alias("value_line"), F.coalesce(high(date & text.contains("on ")), high(date)).alias("date_line"), F.collect_list(F.struct("op_index", F.length("text").cast("long").alias("n"))).alias("s"))
    total = lambda keep: F.aggregate(F.filter("s", keep), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    here = lambda x: F.coalesce(x["op_index"] == F.col("value_line"), F.lit(False)) | F.coalesce(x["op_index"] == F.col("date_line"), F.lit(False))
    return rows.select("doc_id", "start_line", "value_line", "date_line", total(lambda x: x["op_index"] >= F.col("start_line")).alias("full_chars"), total(here).alias("value_date_chars"))


@query(f"""WITH {PAGED}, R AS (SELECT *, 'first_top' AS region FROM P WHERE page = 1 AND place < 3 UNION ALL SELECT *, 'last_bottom' FROM P WHERE page = last AND place >= 3
UNION ALL SELECT *, 'second_bottom' FROM P WHERE page = 2 AND last >= 3 AND place >= 3 UNION ALL SELECT *, 'last_bottom_prev' FROM P WHERE page = last - 1 AND place >= 3) SELECT doc_id, region, page, md5(string_agg(text, chr(10) ORDER BY op_index)) AS text FROM R GROUP BY doc_id, region, page""")
def template_regions(spark, sf_dir):
    """The first page's top, the last one's bottom, the second's from three pages on
    and the last but one's from two on; a line may be in several regions."""
    page, last, top = F.col("page"), F.col("last"), F.col("place") < 3
    held = {"first_top": (page == 1) & top, "last_bottom": (page == last) & ~top, "second_bottom": (page == 2) & (last >= 3) & ~top, "last_bottom_prev": (page == last - 1) & ~top}
    regions = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in held.items())))
    rows = _paged(spark, sf_dir).select("doc_id", "page", "op_index", "text", F.explode(regions).alias("region"))
    return rows.groupBy("doc_id", "region", "page").agg(F.md5(_joined("\n")).alias("text"))


@query(f"WITH {PAGED}, U AS (SELECT doc_id, page, text, min(op_index) AS op_index FROM P WHERE (page <= 2 OR page = last OR (last >= 3 AND page = last - 1)) AND trim(text) <> '' GROUP BY doc_id, page, text) SELECT doc_id, page, op_index, row_number() OVER (PARTITION BY doc_id ORDER BY op_index)::INT AS paragraph FROM U")
def document_build(spark, sf_dir):
    """Paragraphs of the first two and the last two pages, each once a page, numbered anew."""
    page, last = F.col("page"), F.col("last")
    rows = _paged(spark, sf_dir).where(((page <= 2) | (page == last) | ((last >= 3) & (page == last - 1))) & (F.trim("text") != ""))
    kept = rows.groupBy("doc_id", "page", "text").agg(F.min("op_index").alias("op_index"))
    return kept.select("doc_id", "page", "op_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("op_index")).alias("paragraph"))


@query(f"""WITH {STREAMS}, W AS (SELECT doc_id, max(page) AS last, min(page) FILTER (contains(lower(prefix), 'license')) AS p1, min(page) FILTER (idx = 1 AND starts_with(lower(prefix), 're:')) AS p2, min(page) FILTER (contains(lower(prefix), 'subject')) AS p3, min(page) FILTER (starts_with(lower(prefix), 'the ')) AS p4, arg_max(page, [len, -page, -idx]) AS p5 FROM S GROUP BY doc_id)
SELECT doc_id, coalesce(p1, p2, p3, p4, p5) AS page, CASE WHEN p1 IS NOT NULL THEN last WHEN p2 IS NOT NULL THEN p2 + 1 WHEN p3 IS NOT NULL THEN p3 + 1 WHEN p4 IS NOT NULL THEN p4 ELSE p5 + 1 END AS end_page, CASE WHEN p1 IS NOT NULL THEN 'marker' WHEN p2 IS NOT NULL THEN 'prefix' WHEN p3 IS NOT NULL THEN 'header' WHEN p4 IS NOT NULL THEN 'other' ELSE 'largest' END AS method FROM W""")
def document_cascade(spark, sf_dir):
    """Five detectors in turn, each with its own end page: a marker's range, a prefix,
    a header, another kind of document, the largest stream."""
    low, page = F.lower("prefix"), F.col("page")
    first = lambda c: F.min(F.when(c, page))
    rows = streams(spark, sf_dir).groupBy("doc_id").agg(F.max("page").alias("last"), first(low.contains("license")).alias("marker"), first((F.col("idx") == 1) & low.startswith("re:")).alias("prefix"), first(low.contains("subject")).alias("header"), first(low.startswith("the ")).alias("other"), F.max_by("page", F.struct("len", -page, -F.col("idx"))).alias("largest"))
    ends = {"marker": F.col("last"), "prefix": F.col("prefix") + 1, "header": F.col("header") + 1, "other": F.col("other"), "largest": F.col("largest") + 1}
    steps = [(F.col(m).isNotNull(), F.struct(F.col(m).alias("page"), e.alias("end_page"), F.lit(m).alias("method"))) for m, e in ends.items()]
    return rows.select("doc_id", first_of(steps[:-1], steps[-1][1]).alias("x")).select("doc_id", "x.*")


#: A field's patterns: field, label, pattern, weight and priority.
STRATEGIES = [("number", "long", "(?:^| )([0-9]{4,})", 1.35, 1.25), ("number", "short", "(?:^| )([0-9]{2,3})", 1.1, 1.25), ("word", "capital", "(?:^| )([A-Z][a-z]{6,})", 1.25, 1.0), ("word", "plain", "(?:^| )([a-z]{9,})", 1.0, 1.5)]
TRIED = " UNION ALL ".join(f"SELECT doc_id, op_index, '{f}' AS field, '{n}' AS label, regexp_extract(text, '{p}', 1) AS value, {w * q}::DOUBLE AS score FROM L" for f, n, p, w, q in STRATEGIES)


@query(f"WITH {LINES}, C AS ({TRIED}), B AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY score DESC, op_index) AS r FROM C WHERE value <> '') SELECT doc_id, field, label, value, round(score, 6) AS score FROM B WHERE r = 1")
def strategy_fields(spark, sf_dir):
    """Patterns as data: the value of the greatest weight times priority, then of the
    first line, of each document and field."""
    tried = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(n).alias("label"), F.regexp_extract("text", p, 1).alias("value"), F.lit(w * q).alias("score")) for f, n, p, w, q in STRATEGIES))
    rows = line_ops(table(spark, sf_dir, "documents")).select("doc_id", "op_index", F.explode(F.filter(tried, lambda t: t["value"] != "")).alias("t")).select("doc_id", "op_index", "t.*")
    return best(rows, ["doc_id", "field"], [F.col("score").desc(), F.col("op_index")]).select("doc_id", "field", "label", "value", F.round("score", 6).alias("score"))


# The words that stand before or after a signer, and how sure each way is.
SIGNED = ("assinado eletronicamente por", "assinada eletronicamente por")
NUMBERED = ("numero do documento", "número do documento")
DIRECTORS = ("Diretor Especial", "Diretora Especial")
SIGNER_CONFIDENCE = {"footer": 0.82, "footer:collapsed": 0.70, "pje": 0.78, "director_line": 0.80, "digital_signature": 0.90}
REGISTRY = ("matricula", "cadastro", "numero do perito", "num. perito")
REGISTRY_CONFIDENCE = 0.55


def after(text, labels):
    """What follows the first of the labels that the text holds (in any case), without
    colons, dashes and blanks before it; null where it holds none."""
    low = F.lower(text)
    found = [F.when(low.contains(x.lower()), F.substring(text, F.instr(low, x.lower()) + len(x), F.length(text))) for x in labels]
    return F.ltrim(F.regexp_replace(F.coalesce(*found), "^[\\s:–-]+", ""))


def until(text, stops: str):
    """What stands before the first of some characters."""
    return F.trim(F.substring_index(F.translate(text, stops, stops[0] * len(stops)), stops[0], 1))


def named(value):
    """A value that can be a person: no digits, no institution's mark, two words or ten letters."""
    return (F.length(value) >= 5) & ~value.rlike("[0-9]") & ~F.lower(value).contains("sei") & (value.contains(" ") | (F.length(value) >= 10))


def signers(rows, text: str, digital: str):
    """rows with value, confidence and method of a text's signer, by the first way that gives a name."""
    tails = {
        "_signed": after(F.col(text), SIGNED),
        "_joined": after(F.regexp_replace(text, r"\s", ""), [x.replace(" ", "") for x in SIGNED]),
        "_numbered": after(F.col(text), NUMBERED),
        "_before": F.coalesce(*(F.when(F.col(text).contains(d), F.substring_index(text, d, 1)) for d in DIRECTORS)),
    }
    # a name has no stop in it, so what is cut off at one is what was there
    ways = {
        "footer": until(F.col("_signed"), ",;-–\n"),
        "footer:collapsed": F.regexp_extract("_joined", r"^\p{L}+", 0),
        "pje": until(F.col("_by"), "-–\n0123456789"),
        "director_line": F.regexp_replace("_before", r"[\s,–-]+$", ""),
        "digital_signature": F.col(digital),
    }
    found = rows.withColumns(tails).withColumn("_by", after(F.col("_numbered"), [" por:", " por "]))
    found = found.withColumns({f"_{m}": v for m, v in ways.items()})
    of = lambda v, c, m: F.struct(v.alias("value"), F.lit(c).alias("confidence"), F.lit(m).alias("method"))
    steps = [(F.coalesce(named(F.col(f"`_{m}`")), F.lit(False)), of(F.col(f"`_{m}`"), SIGNER_CONFIDENCE[m], m)) for m in ways]
    return found.withColumn("_x", first_of(steps, of(F.lit("-"), 0.0, "not_found"))).select(*rows.columns, "_x.*")


SURNAME = "CASE o_orderstatus WHEN 'O' THEN 'Oliveira' WHEN 'F' THEN 'Ferreira' ELSE 'Pereira' END"


@query(f"SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN 'Maria' || {SURNAME} WHEN 4 THEN (CASE WHEN o_custkey % 2 = 0 THEN 'Rui ' || {SURNAME} ELSE '-' END) ELSE 'Maria ' || {SURNAME} END AS value, CASE o_orderkey % 5 WHEN 0 THEN 0.82 WHEN 1 THEN 0.7 WHEN 2 THEN 0.78 WHEN 3 THEN 0.8 ELSE (CASE WHEN o_custkey % 2 = 0 THEN 0.9 ELSE 0 END) END::DOUBLE AS confidence, CASE o_orderkey % 5 WHEN 0 THEN 'footer' WHEN 1 THEN 'footer:collapsed' WHEN 2 THEN 'pje' WHEN 3 THEN 'director_line' ELSE (CASE WHEN o_custkey % 2 = 0 THEN 'digital_signature' ELSE 'not_found' END) END AS method FROM orders")
def signer_ladder(spark, sf_dir):
    """A signer from a written order: the signature's line, the same with its blanks
    lost, a document's number, a director's line, the digital signature. Names have
    no digits, and two words or ten letters."""
    kind, status = F.col("o_orderkey") % 5, F.col("o_orderstatus")
    surname = F.when(status == "O", "Oliveira").when(status == "F", "Ferreira").otherwise("Pereira")
    text = F.when(kind == 0, F.concat(F.lit("Documento assinado eletronicamente por: Maria "), surname, F.lit(", em 01/02/2020"))).when(kind == 1, F.concat(F.lit("documentoassinadoeletronicamentepor:Maria"), surname, F.lit("!"))).when(kind == 2, F.concat(F.lit("Numero do documento 77 por: Maria "), surname, F.lit(" - 01/02/2020"))).when(kind == 3, F.concat(F.lit("Maria "), surname, F.lit(", Diretora Especial"))).otherwise("assinado eletronicamente por: SEI 99")
    digital = F.when((kind == 4) & (F.col("o_custkey") % 2 == 0), F.concat(F.lit("Rui "), surname))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"), digital.alias("digital"))
    return signers(rows, "text", "digital").select("o_orderkey", "value", "confidence", "method")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 AND o_custkey >= 100 THEN o_custkey::VARCHAR ELSE '-' END AS value, CASE WHEN o_orderkey % 4 < 3 AND o_custkey >= 100 THEN 0.55 ELSE 0 END::DOUBLE AS confidence FROM orders")
def registry_numbers(spark, sf_dir):
    """An expert's number of three digits or more after one of its names."""
    key = F.col("o_orderkey") % 4
    text = F.concat(F.when(key == 0, "Matricula: ").when(key == 1, "cadastro - ").when(key == 2, "Numero do perito ").otherwise("registro "), F.col("o_custkey").cast("string"))
    value = F.regexp_extract(after(text, REGISTRY), "^[0-9]+", 0)
    sound = F.coalesce(F.length(value) >= 3, F.lit(False))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(sound, value).otherwise("-").alias("value"), F.when(sound, REGISTRY_CONFIDENCE).otherwise(0.0).alias("confidence"))


@query(f"""WITH {LINES}, M AS (SELECT doc_id, op_index, text, regexp_extract(text, '[0-9]{{3,}}') AS value, strpos(text, regexp_extract(text, '[0-9]{{3,}}')) - 1 AS a FROM L WHERE regexp_matches(text, '[0-9]{{3,}}')),
S AS (SELECT doc_id, op_index, value, a, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS i FROM M), T AS (SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id, op_index ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM S)
SELECT doc_id, op_index, any_value(value) AS value, min(begins)::INT AS x0, max(begins + length(word))::INT AS x1, string_agg(word, ' ' ORDER BY i) AS words FROM T WHERE begins < a + length(value) AND begins + length(word) > a GROUP BY doc_id, op_index""")
def evidence_boxes(spark, sf_dir):
    """For the first long number of each line the words that it overlaps, and from
    where to where they stand."""
    rows = line_ops(table(spark, sf_dir, "documents")).withColumn("value", F.regexp_extract("text", "[0-9]{3,}", 0)).where("value != ''").withColumn("a", F.expr("locate(value, text) - 1"))
    step = lambda s, w: F.struct((s["at"] + F.length(w) + 1).alias("at"), F.when((s["at"] < F.col("a") + F.length("value")) & (s["at"] + F.length(w) > F.col("a")), F.array_append(s["held"], F.struct(s["at"].alias("x0"), (s["at"] + F.length(w)).alias("x1"), w.alias("word")))).otherwise(s["held"]).alias("held"))
    none = F.array().cast("array<struct<x0:int,x1:int,word:string>>")
    held = F.aggregate(F.split("text", " "), F.struct(F.lit(0).alias("at"), none.alias("held")), step, lambda s: s["held"])
    rows = rows.select("doc_id", "op_index", "value", held.alias("h"))
    return rows.select("doc_id", "op_index", "value", F.array_min(F.col("h.x0")).alias("x0"), F.array_max(F.col("h.x1")).alias("x1"), F.array_join(F.col("h.word"), " ").alias("words"))
