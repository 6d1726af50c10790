"""Queries on pages and streams: pickers, titles, page resolvers, spans and regions.

Every document is cut into pages of six lines and each page into streams of two."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.ordered import best, carried_forward, spans
from ..sources.content import line_ops, table
from .documents import LINES
from .registry import query

STREAMS = f"""{LINES}, S AS (SELECT doc_id, (op_index - 1) // 6 + 1 AS page, ((op_index - 1) % 6) // 2 + 1 AS idx, count_if(text <> '') AS ops, sum(length(text) + 1) AS len, arg_min(text, op_index) AS prefix FROM L GROUP BY ALL)"""
PAGE = ["doc_id", "page"]


def streams(spark, sf_dir):
    """doc_id, page, idx, ops (lines that hold something), len and prefix (the first line)."""
    at = F.col("op_index") - 1
    rows = line_ops(table(spark, sf_dir, "documents")).withColumn("page", F.floor(at / 6) + 1).withColumn("idx", F.floor(at % 6 / 2) + 1)
    return rows.groupBy(*PAGE, "idx").agg(F.count_if(F.col("text") != "").alias("ops"), F.sum(F.length("text") + 1).alias("len"), F.min_by("text", "op_index").alias("prefix"))


@query(f"WITH {STREAMS} SELECT doc_id, page, idx, ops, len::BIGINT AS len FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY ops DESC, len DESC, idx) AS r FROM S) WHERE r = 1")
def primary_stream(spark, sf_dir):
    """A page's stream with most operators, then the longest, then the first."""
    pick = F.max_by(F.struct("idx", "ops", "len"), F.struct("ops", "len", -F.col("idx")))
    return streams(spark, sf_dir).groupBy(*PAGE).agg(pick.alias("x")).select(*PAGE, "x.idx", "x.ops", "x.len")


@query(f"WITH {STREAMS}, R AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page) AS n, row_number() OVER (PARTITION BY doc_id, page ORDER BY len, idx) AS r FROM S) SELECT doc_id, page, idx FROM R WHERE r <= CASE WHEN n <= 1 THEN 1 WHEN n <= 3 THEN 2 ELSE 3 END")
def header_streams(spark, sf_dir):
    """The shortest two streams of a page (three of more than three; an only one itself)."""
    ordered = F.array_sort(F.collect_list(F.struct("len", "idx")))
    n = F.size("s")
    rows = streams(spark, sf_dir).groupBy(*PAGE).agg(ordered.alias("s"))
    return rows.select(*PAGE, F.explode(F.slice("s", F.lit(1), F.when(n <= 1, 1).when(n <= 3, 2).otherwise(3))).alias("x")).select(*PAGE, "x.idx")


MOST = 120
TITLES = ["re:", "subject", "license", "the "]
FIRST_KEY = "CASE " + " ".join(f"WHEN contains(lower(prefix), '{k}') THEN '{k.strip()}'" for k in TITLES) + " END"
UPPER = r"CASE WHEN length(regexp_replace(title, '[^\p{L}]', '', 'g')) > 0 THEN length(regexp_replace(title, '[^\p{Lu}]', '', 'g')) / length(regexp_replace(title, '[^\p{L}]', '', 'g')) ELSE 0 END"
TITLED = f"{STREAMS}, H AS (SELECT *, {FIRST_KEY} AS key, substr(trim(regexp_replace(prefix, '\\s+', ' ', 'g')), 1, {MOST}) AS title FROM S), I AS (SELECT *, 100 + CASE WHEN {UPPER} >= 0.6 THEN 10 ELSE 0 END + 5 - len / 1000.0 AS score FROM H WHERE key IS NOT NULL AND title <> '')"


def titled(rows):
    """key (the first keyword, in order, that the prefix holds), title and score:
    100, 10 for capitals, 5 for its length, less a point for a thousand characters."""
    low = F.lower("prefix")
    key = F.coalesce(*(F.when(low.contains(k), F.lit(k.strip())) for k in TITLES))
    rows = rows.withColumn("key", key).withColumn("title", T.squeeze(F.col("prefix")).substr(1, MOST)).where("key is not null and title != ''")
    return rows.withColumn("score", 100 + F.when(T.uppercase_ratio(F.col("title")) >= 0.6, 10).otherwise(0) + 5 - F.col("len") / 1000.0)


@query(f"WITH {TITLED} SELECT doc_id, page, idx, key, title, round(score, 6)::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY score DESC, idx) AS r FROM I) WHERE r = 1")
def scored_titles(spark, sf_dir):
    rows = best(titled(streams(spark, sf_dir)), PAGE, [F.col("score").desc(), F.col("idx")])
    return rows.select(*PAGE, "idx", "key", "title", F.round("score", 6).alias("score"))


RESOLVED = f"""{STREAMS}, W AS (SELECT doc_id, min(page) FILTER (idx = 1 AND starts_with(lower(prefix), 're:')) AS p1, min(page) FILTER (contains(lower(prefix), 'license') OR contains(lower(prefix), 'subject')) AS p2, arg_max(page, [len, -page, -idx]) AS p3 FROM S GROUP BY doc_id)"""


@query(f"WITH {RESOLVED} SELECT doc_id, coalesce(p1, p2, p3) AS page, CASE WHEN p1 IS NOT NULL THEN 'title' WHEN p2 IS NOT NULL THEN 'label' ELSE 'largest' END AS method FROM W")
def page_resolver(spark, sf_dir):
    """The first page with a title, else with a label, else that of the largest stream."""
    low, page = F.lower("prefix"), F.col("page")
    rows = streams(spark, sf_dir).groupBy("doc_id").agg(F.min(F.when((F.col("idx") == 1) & low.startswith("re:"), page)).alias("p1"), F.min(F.when(low.contains("license") | low.contains("subject"), page)).alias("p2"), F.max_by("page", F.struct("len", -page, -F.col("idx"))).alias("p3"))
    return rows.select("doc_id", F.coalesce("p1", "p2", "p3").alias("page"), F.when(F.col("p1").isNotNull(), "title").when(F.col("p2").isNotNull(), "label").otherwise("largest").alias("method"))


@query(f"WITH {STREAMS}, H AS (SELECT *, {FIRST_KEY} IS NOT NULL AS head FROM S), D AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, head ORDER BY len, idx) AS r, count(*) OVER (PARTITION BY doc_id, page) AS n FROM H), K AS (SELECT * FROM D WHERE NOT (head AND r = 1 AND n > 1)), P AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY head DESC, len DESC, idx) AS q FROM K) SELECT doc_id, page, idx, head FROM P WHERE q = 1")
def body_streams(spark, sf_dir):
    """Without the shortest titled stream of a page: the largest with a header, else the largest."""
    rows = streams(spark, sf_dir).withColumn("head", F.coalesce(*(F.when(F.lower("prefix").contains(k), F.lit(True)) for k in TITLES), F.lit(False)))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy(*PAGE, "head").orderBy("len", "idx"))).withColumn("n", F.count("*").over(Window.partitionBy(*PAGE)))
    rows = rows.where(~(F.col("head") & (F.col("r") == 1) & (F.col("n") > 1)))
    return best(rows, PAGE, [F.col("head").desc(), F.col("len").desc(), F.col("idx")]).select(*PAGE, "idx", "head")


@query(f"WITH {STREAMS}, M AS (SELECT doc_id, page, min(len) AS low, min(ops) AS few FROM S GROUP BY doc_id, page), B AS (SELECT S.*, contains(lower(prefix), 'the') AND (len <= 1.25 * low OR S.ops <= few + 1) AS marked FROM S JOIN M USING (doc_id, page)) SELECT doc_id, page, idx, marked FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY marked DESC, ops DESC, len DESC, idx) AS r FROM B) WHERE r = 1")
def stream_picker(spark, sf_dir):
    """Marked and small streams first, then most operators, then the longest."""
    w = Window.partitionBy(*PAGE)
    small = (F.col("len") <= 1.25 * F.min("len").over(w)) | (F.col("ops") <= F.min("ops").over(w) + 1)
    rows = streams(spark, sf_dir).withColumn("marked", F.lower("prefix").contains("the") & small)
    return best(rows, PAGE, [F.col("marked").desc(), F.col("ops").desc(), F.col("len").desc(), F.col("idx")]).select(*PAGE, "idx", "marked")


@query(f"WITH {TITLED}, T AS (SELECT * FROM (SELECT doc_id, page, key, row_number() OVER (PARTITION BY doc_id, page ORDER BY score DESC, idx) AS r FROM I) WHERE r = 1), G AS (SELECT DISTINCT doc_id, page FROM S), K AS (SELECT G.doc_id, G.page, last_value(key IGNORE NULLS) OVER (PARTITION BY G.doc_id ORDER BY G.page ROWS UNBOUNDED PRECEDING) AS key FROM G LEFT JOIN T USING (doc_id, page)), C AS (SELECT *, CASE WHEN key IS DISTINCT FROM lag(key) OVER (PARTITION BY doc_id ORDER BY page) THEN 1 ELSE 0 END AS c FROM K), B AS (SELECT *, sum(c) OVER (PARTITION BY doc_id ORDER BY page ROWS UNBOUNDED PRECEDING) AS b FROM C) SELECT doc_id, key, min(page) AS start_page, max(page) AS end_page FROM B WHERE key IS NOT NULL GROUP BY doc_id, b, key")
def page_spans(spark, sf_dir):
    """Titles carried forward over pages without one, then runs of equal titles;
    pages before the first title belong to none."""
    found = best(titled(streams(spark, sf_dir)), PAGE, [F.col("score").desc(), F.col("idx")]).select(*PAGE, "key")
    every = streams(spark, sf_dir).select(*PAGE).distinct().join(found, PAGE, "left")
    carried = carried_forward(every, ["doc_id"], ["page"], "key", "title")
    runs = spans(carried.where("title is not null"), ["doc_id"], ["page"], "title", "page")
    return runs.select("doc_id", F.col("title").alias("key"), F.col("start_at").alias("start_page"), F.col("end_at").alias("end_page"))


LEAST_PAGES, MOST_PAGES = 2, 4
PAGES = f"{STREAMS}, G AS (SELECT doc_id, page, bool_or(contains(lower(prefix), 'the')) AS header, bool_or(len % 7 = 0) AS footer FROM S GROUP BY doc_id, page), Z AS (SELECT doc_id, max(page) AS total FROM G GROUP BY doc_id)"


@query(f"""WITH {PAGES}, A AS (SELECT G.doc_id, G.page AS mark, total, CASE WHEN G.page > 1 AND P.header THEN G.page - 1 ELSE G.page END AS a FROM G JOIN Z USING (doc_id) LEFT JOIN G P ON P.doc_id = G.doc_id AND P.page = G.page - 1),
B AS (SELECT *, greatest(mark, least(total, a + {LEAST_PAGES - 1})) AS e FROM A), F AS (SELECT B.doc_id, B.mark, any_value(a) AS a, any_value(e) AS e, any_value(total) AS total, min(G.page) FILTER (G.footer AND G.page >= B.a) AS foot FROM B JOIN G ON G.doc_id = B.doc_id GROUP BY B.doc_id, B.mark)
SELECT doc_id, mark, a AS start_page, least(CASE WHEN foot <= e THEN e ELSE greatest(e, least(coalesce(foot, total), total, a + {MOST_PAGES - 1})) END, a + {MOST_PAGES - 1}) AS end_page FROM F""")
def range_adjust(spark, sf_dir):
    """A range from each page: back by one if that page has a header, to the least
    number of pages, on to the first footer, at most so many. The next footer of each
    page is a window's value, so the fold of steps has a closed form."""
    low = F.lower("prefix")
    pages = streams(spark, sf_dir).groupBy(*PAGE).agg(F.bool_or(low.contains("the")).alias("header"), F.bool_or(F.col("len") % 7 == 0).alias("footer"))
    w = Window.partitionBy("doc_id").orderBy("page")
    foot = F.first(F.when(F.col("footer"), F.col("page")), ignorenulls=True)
    rows = pages.withColumn("total", F.max("page").over(Window.partitionBy("doc_id"))).withColumn("own", foot.over(w.rowsBetween(0, Window.unboundedFollowing))).withColumn("back", (F.col("page") > 1) & F.coalesce(F.lag("header").over(w), F.lit(False)))
    earlier = F.when(F.lag("footer").over(w), F.col("page") - 1)
    rows = rows.withColumn("foot", F.when(F.col("back"), F.coalesce(earlier, "own")).otherwise(F.col("own"))).withColumn("a", F.col("page") - F.col("back").cast("int"))
    rows = rows.withColumn("e", F.greatest("page", F.least("total", F.col("a") + LEAST_PAGES - 1)))
    further = F.greatest("e", F.least(F.coalesce("foot", "total"), "total", F.col("a") + MOST_PAGES - 1))
    return rows.select("doc_id", F.col("page").alias("mark"), F.col("a").alias("start_page"), F.least(F.when(F.col("foot") <= F.col("e"), F.col("e")).otherwise(further), F.col("a") + MOST_PAGES - 1).alias("end_page"))


@query(f"WITH {LINES}, B AS (SELECT doc_id, max(op_index) AS last FROM L GROUP BY doc_id), X AS (SELECT doc_id, coalesce(string_agg(lower(text), ' ' ORDER BY op_index) FILTER (op_index > last - 3), '') AS bottom, coalesce(string_agg(lower(text), ' ' ORDER BY op_index) FILTER (op_index <= 3), '') AS top FROM L JOIN B USING (doc_id) GROUP BY doc_id) SELECT doc_id, CASE WHEN contains(bottom, 'license') OR contains(bottom, '@') THEN 'closing' WHEN contains(top, 'the') AND (contains(top, 'share') OR contains(top, 'click')) THEN 'forward' WHEN contains(bottom, '.') THEN 'prose' ELSE 'unknown' END AS kind FROM X")
def document_kinds(spark, sf_dir):
    """By hints at the bottom, then by two kinds of words at the top, then by the end."""
    lines = line_ops(table(spark, sf_dir, "documents"))
    text = F.array_sort(F.collect_list(F.struct("op_index", F.lower("text").alias("text"))))
    joined = lambda part: F.array_join(F.transform(part, lambda x: x["text"]), " ")
    rows = lines.groupBy("doc_id").agg(text.alias("t")).select("doc_id", joined(F.slice("t", F.greatest(F.size("t") - 2, F.lit(1)), F.lit(3))).alias("bottom"), joined(F.slice("t", 1, 3)).alias("top"))
    bottom, top = F.col("bottom"), F.col("top")
    return rows.select("doc_id", F.when(bottom.contains("license") | bottom.contains("@"), "closing").when(top.contains("the") & (top.contains("share") | top.contains("click")), "forward").when(bottom.contains("."), "prose").otherwise("unknown").alias("kind"))


HEAD = "CASE WHEN contains(lower(text), 'subject') THEN 0 WHEN length(text) >= 120 AND NOT regexp_matches(text, '^[A-Z]') THEN 1 WHEN NOT regexp_matches(text, '^[A-Z]') THEN 2 ELSE 3 END"
TAIL = "CASE WHEN contains(lower(text), '.') THEN 2 ELSE 0 END + CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN length(text) > 80 THEN 1 ELSE 0 END"


@query(f"WITH {LINES}, H AS (SELECT doc_id, op_index AS head FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {HEAD}, op_index) AS r FROM L) WHERE r = 1), T AS (SELECT doc_id, op_index AS tail FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {TAIL} DESC, op_index DESC) AS r FROM L WHERE NOT contains(text, '@')) WHERE r = 1) SELECT doc_id, head, tail FROM H LEFT JOIN T USING (doc_id)")
def paragraph_picks(spark, sf_dir):
    """The head: a wanted phrase, else long and no label, else no label, else the
    first. The tail: the best sum of phrase scores, the last of equals, no footer."""
    text, at = F.col("text"), F.col("op_index")
    label = text.rlike("^[A-Z]")
    head = F.when(F.lower(text).contains("subject"), 0).when((F.length(text) >= 120) & ~label, 1).when(~label, 2).otherwise(3)
    score = F.when(text.contains("."), 2).otherwise(0) + F.when(F.lower(text).contains("the"), 1).otherwise(0) + F.when(F.length(text) > 80, 1).otherwise(0)
    rows = line_ops(table(spark, sf_dir, "documents"))
    return rows.groupBy("doc_id").agg(F.min_by("op_index", F.struct(head, at)).alias("head"), F.max_by(F.when(~text.contains("@"), at), F.when(~text.contains("@"), F.struct(score, at))).alias("tail"))


@query("WITH R AS (SELECT user_id, min(value) AS low, max(value) AS high FROM events GROUP BY user_id) SELECT user_id, round(low, 6) AS low, round(high, 6) AS high, high >= 65 AND low <= 100 AS front, high >= 0 AND low <= 35 AS back FROM R")
def band_filter(spark, sf_dir):
    """Vertical ranges of streams and whether they overlap the front and the back band."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    meets = lambda a, z: (F.col("high") >= a) & (F.col("low") <= z)
    return rows.select("user_id", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), meets(65, 100).alias("front"), meets(0, 35).alias("back"))


BOX = "least(greatest({}, 0), 1)"


@query(f"SELECT user_id, {BOX.format('least(min(value / 200), 1)')} AS x0, {BOX.format('greatest(max(value / 200), 0)')} AS x1, round(sum(greatest(0, value / 200 * 0.5)) / greatest(1, count(DISTINCT event_type)), 6) AS density FROM events GROUP BY user_id")
def region_boxes(spark, sf_dir):
    """Union of boxes from an inverted unit box, cut to 0 and 1, and the share of the area that words cover."""
    x = F.col("value") / 200
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.sum(F.greatest(F.lit(0.0), x * 0.5)).alias("area"))
    return rows.groupBy("user_id").agg(unit(F.least(F.min("lo"), F.lit(1.0))).alias("x0"), unit(F.greatest(F.max("hi"), F.lit(0.0))).alias("x1"), F.round(F.sum("area") / F.greatest(F.lit(1), F.count("*")), 6).alias("density"))


@query("SELECT user_id, event_type, round_even(value, 3) AS x, min(event_id) AS event_id FROM events WHERE event_type <> '' GROUP BY 1, 2, 3")
def deduplicated_words(spark, sf_dir):
    """The first of the rows that are alike once rounded half to even."""
    return table(spark, sf_dir, "events").where("event_type != ''").groupBy("user_id", "event_type", F.bround("value", 3).alias("x")).agg(F.min("event_id").alias("event_id"))


@query("WITH G AS (SELECT l_orderkey AS k, l_extendedprice / 100000 - lag(l_extendedprice / 100000) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey) AS gap FROM lineitem), S AS (SELECT k, count(*) AS n, list_sort(list(gap) FILTER (gap > 0)) AS g FROM G GROUP BY k) SELECT k AS l_orderkey, round(CASE WHEN n >= 4 AND len(g) >= 4 THEN greatest(0.001, least(0.02, g[floor(0.9 * (len(g) - 1))::INT + 1] * 0.3)) ELSE 0.02 END, 8) AS threshold FROM S")
def word_gap_threshold(spark, sf_dir):
    """Three tenths of the gap at nine tenths of an order's, between 0.001 and 0.02,
    where there are four rows and four gaps; else 0.02."""
    x = F.col("l_extendedprice") / 100000
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (x - F.lag(x).over(Window.partitionBy("l_orderkey").orderBy("l_extendedprice", "l_partkey"))).alias("gap"))
    rows = rows.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("gap") > 0, F.col("gap")))).alias("g"))
    at = F.try_element_at("g", F.floor(0.9 * (F.size("g") - 1)).cast("int") + 1)
    return rows.select("l_orderkey", F.round(F.when((F.col("n") >= 4) & (F.size("g") >= 4), F.greatest(F.lit(0.001), F.least(F.lit(0.02), at * 0.3))).otherwise(0.02), 8).alias("threshold"))


@query("WITH T AS (SELECT page_id, page_id // 2 AS pair_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages), C AS (SELECT pair_id, tag, count_if(page_id % 2 = 0) AS a, count_if(page_id % 2 = 1) AS b FROM T GROUP BY 1, 2), O AS (SELECT pair_id, 1 - sum(abs(a - b)) / sum(greatest(a, b)) AS ops, CASE WHEN count_if(length(tag) > 2) = 0 THEN 0 ELSE count_if(length(tag) > 2 AND a > 0 AND b > 0) / count_if(length(tag) > 2) END AS fonts FROM C GROUP BY pair_id), Z AS (SELECT page_id // 2 AS pair_id, coalesce(max(length(html)) FILTER (page_id % 2 = 0), 0) AS la, coalesce(max(length(html)) FILTER (page_id % 2 = 1), 0) AS lb, max(starts_with(url, 'https')) FILTER (page_id % 2 = 0) IS NOT DISTINCT FROM max(starts_with(url, 'https')) FILTER (page_id % 2 = 1) AS filters FROM pages GROUP BY 1) SELECT Z.pair_id, round(0.6 * ops + 0.2 * fonts + 0.1 * (CASE WHEN greatest(la, lb) <= 0 THEN 1 ELSE 1 - abs(la - lb) / greatest(la, lb) END) + 0.1 * filters::INT, 6) AS score FROM Z JOIN O USING (pair_id)")
def structure_score(spark, sf_dir):
    """Pages 2k and 2k+1: six parts bag of operators, two parts set of long operators
    (0 if there are none), one part length and one part kind of address."""
    page = F.col("page_id")
    side = lambda c: F.count_if(c)
    pages = table(spark, sf_dir, "pages").withColumn("pair_id", F.floor(page / 2))
    tags = pages.select("pair_id", "page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag")).groupBy("pair_id", "tag").agg(side(page % 2 == 0).alias("a"), side(page % 2 == 1).alias("b"))
    long, both = F.length("tag") > 2, (F.col("a") > 0) & (F.col("b") > 0)
    ops = tags.groupBy("pair_id").agg((1 - F.sum(F.abs(F.col("a") - F.col("b"))) / F.sum(F.greatest("a", "b"))).alias("ops"), F.when(F.count_if(long) == 0, 0.0).otherwise(F.count_if(long & both) / F.greatest(F.count_if(long), F.lit(1))).alias("fonts"))
    size = lambda k: F.coalesce(F.max(F.when(page % 2 == k, F.length("html"))), F.lit(0))
    kind = lambda k: F.max(F.when(page % 2 == k, F.col("url").startswith("https")))
    rest = pages.groupBy("pair_id").agg(size(0).alias("la"), size(1).alias("lb"), kind(0).eqNullSafe(kind(1)).alias("filters"))
    score = 0.6 * F.col("ops") + 0.2 * F.col("fonts") + 0.1 * T.length_score(F.col("la"), F.col("lb")) + 0.1 * F.col("filters").cast("int")
    return rest.join(ops, "pair_id").select("pair_id", F.round(score, 6).alias("score"))


@query("WITH T AS (SELECT page_id, regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1) AS t FROM pages), R AS (SELECT unnest(t) AS tag, page_id FROM T), N AS (SELECT tag, page_id, count(*) AS k FROM R GROUP BY 1, 2) SELECT tag, sum(k)::BIGINT AS n, count(*) AS pages, array_to_string(list_transform((list_sort(list(page_id)))[1:8], lambda x: x::VARCHAR), ',') AS samples, CASE WHEN tag IN ('html', 'body', 'head') THEN 0 WHEN tag IN ('p', 'div') THEN 1 ELSE 2 END AS rank FROM N GROUP BY tag")
def object_explain(spark, sf_dir):
    """Kinds of objects: how many, on how many pages, up to eight of them, and a fixed rank."""
    tags = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag")).groupBy("tag", "page_id").agg(F.count("*").alias("k"))
    few = tags.withColumn("r", F.row_number().over(Window.partitionBy("tag").orderBy("page_id"))).where("r <= 8").groupBy("tag").agg(F.array_join(F.transform(F.array_sort(F.collect_list("page_id")), lambda x: x.cast("string")), ",").alias("samples"))
    counts = tags.groupBy("tag").agg(F.sum("k").alias("n"), F.count("*").alias("pages"))
    return counts.join(few, "tag").withColumn("rank", F.when(F.col("tag").isin("html", "body", "head"), 0).when(F.col("tag").isin("p", "div"), 1).otherwise(2))
