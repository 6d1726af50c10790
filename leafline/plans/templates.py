"""Queries on templates: the nearest to a line by edit distance, and their fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import approximate
from ..operators.storage import Rounds
from ..sources.content import line_ops, table
from .documents import LINES
from .forms import squeezed
from .registry import query

#: A line is a template if so many documents have it.
SHARED = 5
FORM = squeezed("regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')")
NORMED = f"""{LINES}, N AS (SELECT doc_id, {FORM} AS form FROM L),
T AS (SELECT form AS template FROM N WHERE length(form) > 0 GROUP BY form HAVING count(DISTINCT doc_id) >= {SHARED}),
S AS (SELECT form, template, 1 - levenshtein(form, template) / greatest(length(form), length(template)) AS score FROM (SELECT DISTINCT form FROM N WHERE length(form) > 0) JOIN T ON abs(length(form) - length(template)) <= 0.3 * greatest(length(form), length(template)))"""


def _forms(spark, sf_dir):
    return line_ops(table(spark, sf_dir, "documents")).select("doc_id", T.table_key(F.col("text")).alias("form"))


@query(f"WITH {NORMED}, R AS (SELECT *, row_number() OVER (PARTITION BY form ORDER BY score DESC, template) AS rank FROM S WHERE score >= 0.7) SELECT form, template, round(score, 6)::DOUBLE AS score, rank::INT AS rank FROM R WHERE rank <= 3")
def nearest_templates(spark, sf_dir):
    """The three templates (lines that several documents have) nearest to each distinct
    line, by edit distance over normal forms, where they are similar enough."""
    forms = _forms(spark, sf_dir).where("form != ''").groupBy("form").agg(F.countDistinct("doc_id").alias("n"))
    forms = Rounds(spark).kept(forms)  # made once, read for templates and for lines
    shared = forms.where(F.col("n") >= SHARED).select(F.col("form").alias("name"), F.col("form").alias("template"))
    found = approximate.nearest_templates(forms, "form", shared, "name", "template")
    return found.select("form", F.col("name").alias("template"), F.round("score", 6).alias("score"), "rank")


#: Fields of lines that documents carry, in words that may be written otherwise.
WRITTEN = {"license": "Licenced under {{NAME}} License, Version {{VERSION}}.", "secret": 'tokens = "{{VALUE}}"'}


@query()
def literal_fields(spark, sf_dir):
    """Fields of whole documents by templates whose literals need not stand exactly."""
    docs = table(spark, sf_dir, "documents").where(F.lower("text").contains("license") | F.col("text").contains("token ="))
    return approximate.template_values(docs, ["doc_id"], "text", WRITTEN)
