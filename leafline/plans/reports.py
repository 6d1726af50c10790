"""Queries on reports: bounded beginnings, positions, unions, ranges over files, filters,
fields by bands, and what varies in groups of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import align
from ..sources.content import line_ops, table
from .documents import LINES
from .registry import query


def _lines(spark, sf_dir):
    return line_ops(table(spark, sf_dir, "documents"))


#: How many operators from the beginning (or, below zero, from the end) a reader looks at.
BOUNDS = {"first_10": 10, "first_20": 20, "first_200": 200, "last_40": -40, "last_12": -12}
PREFIXES = ", ".join(f"md5(coalesce(string_agg(text, chr(10) ORDER BY op_index) FILTER ({f'op_index <= {n}' if n > 0 else f'op_index > n - {-n}'}), '')) AS {name}" for name, n in BOUNDS.items())


@query(f"WITH {LINES}, C AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM L) SELECT doc_id, {PREFIXES} FROM C GROUP BY doc_id")
def bounded_prefixes(spark, sf_dir):
    """The first and last operators of each document, within bounds."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("t"))
    part = lambda n: F.slice("t", 1, n) if n > 0 else F.slice("t", F.greatest(F.lit(1), F.size("t") + n + 1), -n)
    return rows.select("doc_id", *(F.md5(F.array_join(part(n), "\n")).alias(name) for name, n in BOUNDS.items()))


@query(f"WITH {LINES}, P AS (SELECT doc_id, op_index, (op_index - 1) // 6 AS page, max((op_index - 1) // 6) OVER (PARTITION BY doc_id) AS last FROM L) SELECT doc_id, op_index, round(CASE WHEN last < 1 THEN 0.5 ELSE least(1, greatest(0, page / last)) END::DOUBLE, 6) AS position FROM P")
def relative_positions(spark, sf_dir):
    """Where in its document each line's page stands, from 0 to 1; 0.5 where there is one page."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("n"), F.posexplode(F.split("text", "\n")).alias("at", "text"))
    page, last = F.floor(F.col("at") / 6), F.floor((F.col("n") - 1) / 6)
    return rows.select("doc_id", (F.col("at") + 1).alias("op_index"), F.round(T.relative_position(page, last + 1), 6).alias("position"))


@query(f"WITH {LINES}, U AS (SELECT lower(text) AS key, doc_id % 2 AS side, doc_id, op_index, text FROM L WHERE trim(text) <> '') SELECT sha256(key) AS key, sha256(arg_min(text, [side, doc_id, op_index])) AS template, count(*) AS n FROM U GROUP BY lower(key), key")
def template_union(spark, sf_dir):
    """Lines of even documents and then of odd ones as templates, each once whatever its
    case: the first is kept."""
    rows = _lines(spark, sf_dir).where(F.trim("text") != "").withColumn("key", F.lower("text"))
    first = F.min_by("text", F.struct((F.col("doc_id") % 2).alias("side"), "doc_id", "op_index"))
    return rows.groupBy("key").agg(first.alias("template"), F.count("*").alias("n")).select(F.sha2("key", 256).alias("key"), F.sha2("template", 256).alias("template"), "n")


@query(f"WITH {LINES} SELECT doc_id // 4 AS group_id, min(op_index)::INT AS first_op, max(op_index)::INT AS last_op, count(DISTINCT doc_id) AS files FROM L WHERE regexp_matches(text, '[0-9@]') GROUP BY 1")
def global_op_ranges(spark, sf_dir):
    """Over the files of a group, the operators from the first to the last that hold a digit or a mail sign."""
    rows = _lines(spark, sf_dir).where(F.col("text").rlike("[0-9@]"))
    return rows.groupBy(F.floor(F.col("doc_id") / 4).alias("group_id")).agg(F.min("op_index").alias("first_op"), F.max("op_index").alias("last_op"), F.countDistinct("doc_id").alias("files"))


@query("SELECT doc_id, source, md5(string_split(text, chr(10))[1]) AS title FROM documents WHERE lower(source) <> 'src0' AND contains(lower(source), 'rc') AND contains(lower(string_split(text, chr(10))[1]), 'the') ORDER BY doc_id LIMIT 100 OFFSET 3")
def filtered_report(spark, sf_dir):
    """Documents by source and title, from the fourth on, a hundred at most (a report's page)."""
    rows = table(spark, sf_dir, "documents").withColumn("first", F.split("text", "\n")[0])
    rows = rows.where((F.lower("source") != "src0") & F.lower("source").contains("rc") & F.lower("first").contains("the"))
    return rows.select("doc_id", "source", F.md5("first").alias("title")).orderBy("doc_id").offset(max(0, 3)).limit(100)


#: A field's sources in order: band, kind of entity (or none) and a pattern to try after it.
MAIL, ADDRESS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
FIELD_MAP = {
    "CONTACT": [("front_head", MAIL, "[A-Z][a-z]+ @"), ("back_tail", MAIL, r"\+[0-9 ()-]{9,}[0-9]")],
    "HOST": [("back_tail", ADDRESS, r"[a-z]+[0-9]\.example\.com"), ("front_head", ADDRESS, r"[a-z]+[0-9]\.example\.com")],
    "WORD": [("back_tail", None, "[A-Z][a-z]{9,}"), ("front_head", None, "[A-Z][a-z]{7,}")],
}
BANDS = f"{LINES}, P AS (SELECT doc_id, (op_index - 1) // 6 AS page, max((op_index - 1) // 6) OVER (PARTITION BY doc_id) AS last, op_index, text FROM L), B AS (SELECT doc_id, coalesce(string_agg(text, chr(10) ORDER BY op_index) FILTER (page = 0), '') AS front_head, coalesce(string_agg(text, chr(10) ORDER BY op_index) FILTER (page = last AND last > 0), '') AS back_tail FROM P GROUP BY doc_id)"


def _mapped_sql(name: str, sources) -> str:
    steps = [(band, kind, pattern) for band, entity, regex in sources for kind, pattern in (("entity", entity), ("regex", regex)) if pattern]
    value = " ".join(f"WHEN regexp_matches({b}, '{p}') THEN regexp_extract({b}, '{p}')" for b, _, p in steps)
    method = " ".join(f"WHEN regexp_matches({b}, '{p}') THEN '{k}'" for b, k, p in steps)
    band = " ".join(f"WHEN regexp_matches({b}, '{p}') THEN '{b}'" for b, _, p in steps)
    return f"SELECT doc_id, '{name}' AS field, CASE {value} END AS value, CASE {band} ELSE '{sources[0][0]}' END AS band, CASE {method} ELSE 'not_found' END AS method, md5(CASE {' '.join(f'''WHEN regexp_matches({b}, '{p}') THEN {b}''' for b, _, p in steps)} ELSE {sources[0][0]} END) AS value_full FROM B"


@query(f"WITH {BANDS} " + " UNION ALL ".join(_mapped_sql(n, s) for n, s in FIELD_MAP.items()))
def mapped_fields(spark, sf_dir):
    """Fields from the first and the last page by a map: in each source's band an entity
    first, then a pattern; the first hit wins, and the band's whole text is kept."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("t"))
    last = F.floor((F.size("t") - 1) / 6).cast("int")
    front = F.array_join(F.slice("t", 1, 6), "\n")
    back = F.when(last > 0, F.array_join(F.slice("t", last * 6 + 1, 6), "\n")).otherwise("")
    rows = rows.select("doc_id", front.alias("front_head"), back.alias("back_tail"))
    found = []
    for name, sources in FIELD_MAP.items():
        steps = [(band, kind, pattern) for band, entity, regex in sources for kind, pattern in (("entity", entity), ("regex", regex)) if pattern]
        entry = lambda value, band, method, n=name: F.struct(F.lit(n).alias("field"), value.alias("value"), F.lit(band).alias("band"), F.lit(method).alias("method"), F.col(band).alias("value_full"))
        hits = [F.when(F.col(b).rlike(p), entry(F.regexp_extract(b, p, 0), b, k)) for b, k, p in steps]
        found.append(F.coalesce(*hits, entry(F.lit(None).cast("string"), sources[0][0], "not_found")))
    return rows.select("doc_id", F.explode(F.array(*found)).alias("f")).select("doc_id", "f.field", "f.value", "f.band", "f.method", F.md5("f.value_full").alias("value_full"))


def _members(spark, sf_dir):
    """Documents with their group and their number in it, as the SQL divides (towards
    zero) and with the blanks that it knows (no vertical tab)."""
    text = F.trim(F.regexp_replace("text", r"[ \t\n\f\r]+", " "))
    return table(spark, sf_dir, "documents").select(F.expr("doc_id div 4").alias("group_id"), (F.col("doc_id") % 4).cast("int").alias("member"), text.alias("text"))


def _groups(docs):
    """Texts are gathered whole and split then: their tokens take several times the room.
    A group may lack numbers or have one more than once, so names tell its members' numbers."""
    held = docs.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("member", "text"))).alias("held"))
    return held.select("group_id", F.transform("held", lambda m: F.split(m["text"], " ")).alias("members"), F.col("held.member").alias("names"))


@query()
def variation_blocks(spark, sf_dir):
    """What varies in groups of four documents, as blocks of the first one's tokens and
    gaps, with the text that each document has there."""
    rows = align.variation_blocks(_groups(_members(spark, sf_dir)), named=True)
    return rows.select("group_id", "block", "first_slot", "last_slot", F.col("name").alias("member"), "text")


@query("SELECT doc_id // 4 AS group_id, (doc_id % 4)::INT AS member, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS text FROM documents")
def variation_sides(spark, sf_dir):
    """Every document of a group, put together again from the tokens that all share and
    the blocks in which they vary; one without text stays without."""
    docs = _members(spark, sf_dir)
    rows = align.variation_blocks(_groups(docs.where("text is not null")), fixed=True, named=True)
    pieces = F.filter(F.array_sort(F.collect_list(F.struct("first_slot", "text"))), lambda b: b["text"] != "")
    text = F.array_join(F.transform(pieces, lambda b: b["text"]), " ")
    # the run at slot 0 is kept for documents that have no piece
    found = rows.where("text != '' OR first_slot = 0").groupBy("group_id", F.col("member").alias("place"), F.col("name").alias("member")).agg(F.md5(text).alias("text"))
    return found.select("group_id", "member", "text").unionByName(docs.where("text is null"))
