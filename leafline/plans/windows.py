"""Queries on candidate windows, overlapping spans, structure similarity and field maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.ordered import best
from ..sources.content import table
from . import documents
from .registry import query

LAST_PAGE = 366


@query(f"SELECT DISTINCT o_custkey, page AS start_page, least(page + s.size - 1, {LAST_PAGE})::INT AS end_page FROM (SELECT o_custkey, dayofyear(o_orderdate)::INT AS page FROM orders) o, (SELECT unnest([2, 3, 4]) AS size) s")
def candidate_windows(spark, sf_dir):
    """Windows of two, three and four pages from each mark, cut at the last page."""
    marks = table(spark, sf_dir, "orders").select("o_custkey", F.dayofyear("o_orderdate").alias("start_page")).distinct()
    size = F.explode(F.array(*map(F.lit, (2, 3, 4))))
    rows = marks.withColumn("size", size)
    return rows.select("o_custkey", "start_page", F.least(F.col("start_page") + F.col("size") - 1, F.lit(LAST_PAGE)).alias("end_page")).distinct()


@query("WITH S AS (SELECT l_orderkey AS k, l_linenumber AS n, l_shipdate AS a, l_shipdate + INTERVAL 7 DAY AS b FROM lineitem) SELECT x.k AS l_orderkey, count(*) AS overlaps FROM S x JOIN S y ON x.k = y.k AND x.n < y.n AND x.a < y.b AND y.a < x.b GROUP BY x.k")
def span_overlap(spark, sf_dir):
    """Pairs of an order's lines whose weeks after shipping overlap."""
    span = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_shipdate").alias("a"), (F.col("l_shipdate") + F.expr("INTERVAL 7 DAYS")).alias("b"))
    x, y = span.alias("x"), span.alias("y")
    meet = (F.col("x.l_orderkey") == F.col("y.l_orderkey")) & (F.col("x.n") < F.col("y.n")) & (F.col("x.a") < F.col("y.b")) & (F.col("y.a") < F.col("x.b"))
    return x.join(y, meet).groupBy("x.l_orderkey").agg(F.count("*").alias("overlaps"))


SIDES = "SELECT page_id // 2 AS pair_id, tag, count_if(page_id % 2 = 0) AS a, count_if(page_id % 2 = 1) AS b FROM P GROUP BY 1, 2"


@query(f"WITH {documents.TAGS}, S AS ({SIDES}) SELECT pair_id::BIGINT AS pair_id, round(1 - sum(abs(a - b)) / sum(greatest(a, b)), 6) AS bag, round(count_if(a > 0 AND b > 0) / count(*), 6) AS jaccard FROM S GROUP BY pair_id")
def structure_similarity(spark, sf_dir):
    """Pages 2k and 2k+1: similarity of their bags and of their sets of operators."""
    page = F.col("page_id")
    tags = documents._tags(spark, sf_dir).groupBy(F.floor(page / 2).alias("pair_id"), "tag").agg(F.count_if(page % 2 == 0).alias("a"), F.count_if(page % 2 == 1).alias("b"))
    bag = 1 - F.sum(F.abs(F.col("a") - F.col("b"))) / F.sum(F.greatest("a", "b"))
    both = F.count_if((F.col("a") > 0) & (F.col("b") > 0)) / F.count("*")
    return tags.groupBy("pair_id").agg(F.round(bag, 6).alias("bag"), F.round(both, 6).alias("jaccard"))


KINDS = (("listing", "<li"), ("table", "<table"), ("prose", "<p"))


@query("SELECT page_id, CASE " + " ".join(f"WHEN contains(lower(html), '{mark}') THEN '{kind}'" for kind, mark in KINDS) + " ELSE 'unknown' END AS kind FROM pages")
def doc_type(spark, sf_dir):
    """The first kind, in order, of which a mark occurs; otherwise unknown."""
    html = F.lower("html")
    kind = F.coalesce(*(F.when(html.contains(mark), F.lit(kind)) for kind, mark in KINDS), F.lit("unknown"))
    return table(spark, sf_dir, "pages").select("page_id", kind.alias("kind"))


@query(f"WITH {documents.LINES}, E AS ({documents.ALL}), B AS (SELECT doc_id, field, value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY op_index, length(value) DESC, value) AS r FROM E) WHERE r = 1) SELECT doc_id, " + ", ".join(f"max(CASE WHEN field = '{k}' THEN value END) AS {k}" for k in documents.ENTITIES) + " FROM B GROUP BY doc_id")
def map_fields(spark, sf_dir):
    """One row a document with its best value of each field. The fields are
    known, so the pivot needs no pass of its own to find them."""
    return documents.field_best(spark, sf_dir).groupBy("doc_id").pivot("field", list(documents.ENTITIES)).agg(F.max("value"))


@query("SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY CASE WHEN value >= 50 THEN 0 ELSE 1 END, ts DESC, event_id) AS r FROM events) WHERE r = 1")
def prefer_by_rank(spark, sf_dir):
    """Candidates that pass a threshold go first, then the latest."""
    order = [F.when(F.col("value") >= 50, 0).otherwise(1), F.col("ts").desc(), F.col("event_id")]
    return best(table(spark, sf_dir, "events"), ["user_id", "event_type"], order).select("user_id", "event_type", "value", "event_id")
