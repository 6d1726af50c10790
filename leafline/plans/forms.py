"""Queries on forms of text: normal forms, keys, cleaners, spans, dates and ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.content import line_ops, table
from .documents import LINES
from .registry import query

# The SQL is written for an engine without look-around and with functions of its own.
J = r"[\p{L}\p{Nd}$/.,\-\x{2013}\x{00AA}\x{00BA}\x{00B0}]"
ALONE = rf"regexp_matches(t[i - 1], '(^|\s){J}$') AND regexp_matches(t[i], '^{J}(\s|$)')"
SPLIT = "S AS (SELECT doc_id, string_split(text, ' ') AS t FROM documents)"
JOINED = f"list_reduce(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN i = 1 THEN t[1] WHEN {ALONE} THEN t[i] ELSE ' ' || t[i] END), lambda x, y: x || y)"


def squeezed(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _lines(spark, sf_dir):
    return line_ops(table(spark, sf_dir, "documents"))


@query(f"WITH {SPLIT} SELECT doc_id, sha256({squeezed(JOINED)}) AS joined, sha256({squeezed(f'''regexp_replace(lower(strip_accents({squeezed(JOINED)})), '[^a-z0-9\\s/\\-.]+', ' ', 'g')''')}) AS form FROM S")
def match_forms(spark, sf_dir):
    """Digests of each text with spaced letters joined, and in the form for matching."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.spaced_letters_joined(text), 256).alias("joined"), F.sha2(T.match_form(text), 256).alias("form"))


KEYS = rf"""SELECT doc_id, op_index, md5(lower(strip_accents(text))) AS diff_form,
  md5({squeezed(r"regexp_replace(lower(text), '\p{C}+', ' ', 'g')")}) AS hash_form,
  md5(regexp_replace(lower({squeezed('text')}), '[0-9]', '#', 'g')) AS similarity_form,
  md5({squeezed("regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')")}) AS table_key,
  md5({squeezed("regexp_replace(upper(strip_accents(text)), '[^A-Z0-9 ]+', ' ', 'g')")}) AS name_key,
  md5(regexp_replace(lower(strip_accents(text)), '[^a-z]+', '', 'g')) AS letters_key,
  md5(regexp_replace(lower(text), '[^\p{{L}}\p{{Nd}}]+', '', 'g')) AS title_key FROM L"""


@query(f"WITH {LINES} {KEYS}")
def text_keys(spark, sf_dir):
    """Digests of the other normal forms and keys of each line."""
    text = F.col("text")
    forms = {"diff_form": F.lower(T.without_marks(text)), "hash_form": T.hash_form(text), "similarity_form": T.digits_hidden(text), "table_key": T.table_key(text), "name_key": T.name_key(text), "letters_key": T.letters_key(text), "title_key": T.title_key(text)}
    return _lines(spark, sf_dir).select("doc_id", "op_index", *(F.md5(x).alias(n) for n, x in forms.items()))


@query("WITH P AS (SELECT p_partkey, p_partkey % 3 AS kind, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE regexp_replace(p_type, '(.)', '\\1\\1', 'g') END AS t FROM part), N AS (SELECT *, length(t) AS n, len(list_filter(range(0, length(t) // 2), lambda i: substr(t, 2 * i + 1, 1) = substr(t, 2 * i + 2, 1))) AS same FROM P) SELECT p_partkey, CASE WHEN n >= 4 AND n % 2 = 0 AND same >= greatest(3, ceil(n // 2 * 0.7)) THEN list_reduce(list_transform(range(0, n // 2), lambda i: substr(t, 2 * i + 1, 1)), lambda x, y: x || y) ELSE t END AS text FROM N")
def doubled_chars(spark, sf_dir):
    """Doubled characters of two thirds of the part types, undone."""
    doubled = F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise(F.regexp_replace("p_type", "(.)", "$1$1"))
    return table(spark, sf_dir, "part").select("p_partkey", doubled.alias("t")).select("p_partkey", T.undoubled(F.col("t")).alias("text"))


def _mended(x: str) -> str:
    for a, b in (("([,:;])", r"(\S)"), (r"(\))", r"(\S)"), (r"(\S)", r"(\()"), ("([A-Za-zÀ-ÿ])", "([0-9])"), ("([0-9])", "([A-Za-zÀ-ÿ])")):
        for _ in range(2):  # matches that touch need a second pass
            x = rf"regexp_replace({x}, '{a}{b}', '\1 \2', 'g')"
    return squeezed(x)


@query(f"WITH {LINES} SELECT doc_id, op_index, md5({_mended('text')}) AS mended, md5(regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g')) AS split FROM L")
def mended_spaces(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "op_index", F.md5(T.spaces_mended(F.col("text"))).alias("mended"), F.md5(T.camel_split(F.col("text"))).alias("split"))


CUTS = ("specialist", " cpf", "fim")
RAW = "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN c_name || ', - CPF 0' WHEN 1 THEN 'Specialist ' || c_name || ' Specialist; fim' ELSE c_name || ' . ' END AS raw FROM orders JOIN customer ON o_custkey = c_custkey"
FIRST = "least(" + ", ".join(f"CASE WHEN strpos(lower(raw), '{k}') > 1 THEN strpos(lower(raw), '{k}') END" for k in CUTS) + ")"


@query(f"SELECT o_orderkey, regexp_replace(CASE WHEN {FIRST} IS NOT NULL THEN substr(raw, 1, {FIRST} - 1) ELSE raw END, '[\\s,;.\\-–]+$', '') AS name FROM ({RAW})")
def cleaned_names(spark, sf_dir):
    """Names cut at the first keyword that does not begin them."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    name, kind = F.col("c_name"), F.col("o_orderkey") % 3
    raw = F.when(kind == 0, F.concat(name, F.lit(", - CPF 0"))).when(kind == 1, F.concat(F.lit("Specialist "), name, F.lit(" Specialist; fim"))).otherwise(F.concat(name, F.lit(" . ")))
    return rows.select("o_orderkey", raw.alias("raw")).select("o_orderkey", T.cut_at(F.col("raw"), list(CUTS)).alias("name"))


NUMBER = "[0-9]{4,}"


@query(f"WITH M AS (SELECT doc_id, text, regexp_extract(text, '{NUMBER}') AS value FROM documents WHERE regexp_matches(text, '{NUMBER}')) SELECT doc_id, value, strpos(text, value)::INT AS at, md5(substr({squeezed('substr(text, greatest(1, strpos(text, value) - 40), 200)')}, 1, 160)) AS snippet FROM M")
def first_matches(spark, sf_dir):
    """The first long number of each text, its place and what stands around it."""
    rows = table(spark, sf_dir, "documents").withColumn("value", F.regexp_extract("text", NUMBER, 0)).where("value != ''").withColumn("at", F.expr("locate(value, text)"))
    return rows.select("doc_id", "value", "at", F.md5(T.snippet(F.col("text"), F.col("at"))).alias("snippet"))


SHOWN = r"replace(replace(replace(replace(regexp_replace(text, '\x1B\[[0-9;]*m', '', 'g'), '\', '\\'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')"


@query(f"SELECT doc_id, CASE WHEN length({SHOWN}) > 80 THEN substr({SHOWN}, 1, 77) || '...' ELSE {SHOWN} END AS shown FROM documents")
def shown_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.shown(F.col("text")).alias("shown"))


@query(rf"WITH {LINES} SELECT doc_id, op_index, CASE WHEN length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) > 0 THEN round(length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) / length(regexp_replace(text, '[^\p{{L}}]', '', 'g')), 6) ELSE 0 END AS upper_ratio, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::INT AS words, list_max(list_transform(regexp_split_to_array(text, '\s+'), lambda w: length(w)))::INT AS longest FROM L")
def line_measures(spark, sf_dir):
    text = F.col("text")
    return _lines(spark, sf_dir).select("doc_id", "op_index", F.round(T.uppercase_ratio(text), 6).alias("upper_ratio"), T.word_count(text).alias("words"), F.array_max(F.transform(F.split(text, r"\s+"), lambda w: F.length(w))).alias("longest"))


HINTS = ["Licença", "mit  license", "cookie policy", "e"]


@query(f"WITH {SPLIT}, N AS (SELECT doc_id, {squeezed(f'''regexp_replace(lower(strip_accents({squeezed(JOINED)})), '[^a-z0-9\\s/\\-.]+', ' ', 'g')''')} AS n FROM S) SELECT doc_id, contains(n, 'licenca') OR contains(n, 'mit license') OR contains(n, 'cookie policy') AS strict, contains(replace(n, ' ', ''), 'licenca') OR contains(replace(n, ' ', ''), 'mitlicense') OR contains(replace(n, ' ', ''), 'cookiepolicy') OR contains(n, 'licenca') OR contains(n, 'mit license') OR contains(n, 'cookie policy') AS loose FROM N")
def hint_matches(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", T.match_form(F.col("text")).alias("n"))
    return rows.select("doc_id", T.contains_any(F.col("n"), HINTS[:3]).alias("strict"), T.contains_any(F.col("n"), HINTS[:3], loose=True).alias("loose"))


SPANS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "number": "[0-9]{2,}", "word": "[a-z]{9,}"}
PIECES = ", ".join(f"string_split(regexp_replace(text, '({p})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS p_{k}" for k, p in SPANS.items())
LISTED = " UNION ALL ".join(f"SELECT doc_id, op_index, '{k}' AS kind, (list_sum(list_transform(p_{k}[1:i], lambda x: length(x))) - (i - 1))::INT AS start, string_split(p_{k}[i + 1], chr(2))[1] AS value FROM (SELECT *, unnest(range(1, len(p_{k}))) AS i FROM P)" for k in SPANS)
FOUND = f"{LINES}, P AS (SELECT doc_id, op_index, {PIECES} FROM L), E AS ({LISTED})"


def _found(spark, sf_dir):
    spans = [F.when(F.col("text").rlike("[0-9]" if k in ("ip", "number") else "@" if k == "email" else "[a-z]"), T.found_spans(F.col("text"), k, p)) for k, p in SPANS.items()]
    empty = F.array().cast("array<struct<start:int,stop:int,kind:string,value:string>>")
    return _lines(spark, sf_dir).select("doc_id", "op_index", F.concat(*(F.coalesce(s, empty) for s in spans)).alias("spans"))


@query(f"WITH {FOUND} SELECT doc_id, op_index, kind, start, value FROM E")
def entity_positions(spark, sf_dir):
    """Every match of each pattern with its place in the line, from 0."""
    return _found(spark, sf_dir).select("doc_id", "op_index", F.explode("spans").alias("s")).select("doc_id", "op_index", "s.kind", "s.start", "s.value")


@query(f"WITH RECURSIVE {FOUND}, O AS (SELECT *, start + length(value) AS stop, row_number() OVER (PARTITION BY doc_id, op_index ORDER BY start, length(value) DESC, kind) AS r FROM E), G AS (SELECT doc_id, op_index, 0::BIGINT AS r, 0::BIGINT AS until, false AS kept, '' AS kind, 0::BIGINT AS start, '' AS value FROM (SELECT DISTINCT doc_id, op_index FROM O) UNION ALL SELECT o.doc_id, o.op_index, o.r, CASE WHEN o.start >= g.until THEN o.stop ELSE g.until END, o.start >= g.until, o.kind, o.start, o.value FROM G g JOIN O o ON o.doc_id = g.doc_id AND o.op_index = g.op_index AND o.r = g.r + 1) SELECT doc_id, op_index, kind, start::INT AS start, value FROM G WHERE kept")
def entity_greedy(spark, sf_dir):
    """Matches that do not overlap, the earliest and longest first."""
    rows = _found(spark, sf_dir).where(F.size("spans") > 0).select("doc_id", "op_index", F.explode(T.greedy_spans(F.col("spans"))).alias("s"))
    return rows.select("doc_id", "op_index", "s.kind", "s.start", "s.value")


FORMATS = ("%d/%m/%Y", "%-d/%-m/%Y", "%d/%m/%y", "%-d/%-m/%y", "%d-%m-%Y", "%-d-%-m-%Y", "%d-%m-%y", "%-d-%-m-%y")
SPARK_FORMATS = ("dd/MM/yyyy", "d/M/yyyy", "dd/MM/yy", "d/M/yy", "dd-MM-yyyy", "d-M-yyyy", "dd-MM-yy", "d-M-yy")


@query("SELECT o_orderkey, k::INT AS k, CASE WHEN k < 9 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN k < 9 THEN strftime(o_orderdate, '%d/%m/%Y') END AS written, CASE WHEN k < 9 THEN o_orderdate::DATE BETWEEN DATE '1991-01-01' AND DATE '1996-01-02' END AS recent FROM orders, (SELECT unnest(range(0, 11)) AS k)")
def date_forms(spark, sf_dir):
    """Each order's date in eight written forms and spoken, and two that are no
    days, read back; recent within five years of the first day of 1996."""
    day = F.col("o_orderdate")
    texts = F.array(*(F.date_format(day, f) for f in SPARK_FORMATS), F.concat(F.lit("em "), T.spoken_date(day), F.lit(".")), F.lit("31/02/1995"), F.lit("31 de fevereiro de 1995"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(texts).alias("k", "text")).withColumn("d", T.any_date(F.col("text")))
    return rows.select("o_orderkey", "k", F.col("d").cast("string").alias("day"), F.date_format("d", "dd/MM/yyyy").alias("written"), T.recent(F.col("d"), F.lit("1996-01-01").cast("date")).alias("recent"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '12-34' ELSE substr(d, 1, 3) || '.' || substr(d, 4, 3) || '.' || substr(d, 7, 3) || '-' || substr(d, 10, 2) END AS id, CASE WHEN c_custkey % 4 = 0 THEN '1234' ELSE d END AS digits FROM (SELECT c_custkey, lpad((c_custkey * 7919)::VARCHAR, 11, '0') AS d FROM customer)")
def id_forms(spark, sf_dir):
    """Numbers written with blanks, as ids; too short ones stay as they are."""
    d = F.lpad((F.col("c_custkey") * 7919).cast("string"), 11, "0")
    raw = F.when(F.col("c_custkey") % 4 == 0, "12-34").otherwise(F.concat(d.substr(1, 5), F.lit(" "), d.substr(6, 6)))
    return table(spark, sf_dir, "customer").select("c_custkey", T.id_form(raw).alias("id"), T.digits_only(raw).alias("digits"))
