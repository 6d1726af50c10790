"""Queries on windows of pages that may be a document."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import candidates as C
from ..sources.content import line_ops, table
from .documents import LINES
from .forms import squeezed
from .registry import query

#: Hints of each group, in the normal form of the lines.
GROUPS = {"HEADER": ["the and attion", "and therhean is"], "SUBHEADER": ["license", "lizenz"], "TITLE": ["ietzte", "stteen", "anquean"], "FOOTER": ["token", "example com"]}
TITLE_BIT = 1 << list(GROUPS).index("TITLE")
PAGE_LINES, PAGE_AREA = 6, 1200.0
FORM = squeezed("regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')")
HITS = " + ".join(f"CASE WHEN {' OR '.join(f'''contains(form, '{h}')''' for h in hints)} THEN {1 << i} ELSE 0 END" for i, hints in enumerate(GROUPS.values()))
NAMED = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN anchors & {1 << i} <> 0 THEN '{n}' END" for i, n in enumerate(GROUPS)) + "], lambda x: x IS NOT NULL), ',')"
SCANNED = f"""{LINES}, P AS (SELECT doc_id, (op_index - 1) // {PAGE_LINES} + 1 AS page, string_agg({FORM}, ' ' ORDER BY op_index) AS form, sum(length(text)) / {PAGE_AREA} AS density FROM L GROUP BY 1, 2),
H AS (SELECT doc_id, page, {HITS} AS hits, density FROM P), Z AS (SELECT doc_id, max(page) AS last, bool_or(hits & {TITLE_BIT} <> 0) AS titled FROM H GROUP BY doc_id),
B AS (SELECT H.doc_id, page AS start_page, last FROM H JOIN Z USING (doc_id) WHERE CASE WHEN titled THEN hits & {TITLE_BIT} <> 0 ELSE page = 1 END),
W AS (SELECT DISTINCT doc_id, start_page, least(last, start_page + n - 1) AS end_page FROM B, (VALUES (2), (3), (4)) v(n)),
G AS (SELECT W.doc_id, start_page, end_page, bit_or(hits) AS anchors, list(round(density, 6) ORDER BY page) AS densities FROM W JOIN H ON H.doc_id = W.doc_id AND H.page BETWEEN start_page AND end_page GROUP BY ALL)"""


def _windows(spark, sf_dir):
    lines = line_ops(table(spark, sf_dir, "documents")).withColumn("page", F.floor((F.col("op_index") - 1) / PAGE_LINES) + 1)
    lines = lines.withColumn("form", T.table_key(F.col("text")))
    forms = F.transform(F.array_sort(F.collect_list(F.struct("op_index", "form"))), lambda x: x["form"])
    pages = lines.groupBy("doc_id", "page").agg(forms.alias("lines"), C.density(F.length("text").cast("double"), F.lit(1.0), PAGE_AREA).alias("density"))
    pages = C.anchored(pages.withColumn("form", F.array_join("lines", " ")), "form", GROUPS)
    return C.windows(pages.drop("form"), "doc_id", TITLE_BIT)


@query(f"WITH {SCANNED} SELECT doc_id, start_page, end_page, {NAMED} AS anchors, densities FROM G")
def candidate_anchors(spark, sf_dir):
    """Windows of two to four pages from each page with a title: the groups of anchors
    that they hold, and how full each page is."""
    rows = _windows(spark, sf_dir)
    return rows.select("doc_id", "start_page", "end_page", C.names_of(F.col("anchors"), list(GROUPS)).alias("anchors"), F.transform("densities", lambda d: F.round(d, 6)).alias("densities"))


@query()
def candidate_best(spark, sf_dir):
    """The window of each document that is most like the template of all hints."""
    hints = [h for hints in GROUPS.values() for h in hints]
    rows = C.chosen(C.scored(_windows(spark, sf_dir), "doc_id", hints, " ".join(hints)), "doc_id", len(GROUPS))
    return rows.select("doc_id", "start_page", "end_page", C.names_of(F.col("anchors"), list(GROUPS)).alias("anchors"), F.round("score", 6).alias("score"), F.round("second", 6).alias("second"), "weak")
