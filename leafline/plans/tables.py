"""Queries on events and the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.ordered import Cells, at_rank, best, nearest, ranges
from ..sources.content import table
from .registry import query

W = "(PARTITION BY user_id ORDER BY ts, event_id)"
USER, TIME = ["user_id"], ["ts", "event_id"]


#: Events of a user are cut at so many seconds.
CELL = 5 * 86_400


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def _cut(spark, sf_dir):
    return Cells(_events(spark, sf_dir), USER, TIME, F.floor(_micros("ts") / (CELL * 1_000_000)))


def _gaps(spark, sf_dir):
    """gap: microseconds since the user's event before."""
    cut = _cut(spark, sf_dir).previous("ts")
    cut.rows = cut.rows.withColumn("gap", _micros("ts") - _micros("prev_ts"))
    return cut


@query(f"WITH J AS (SELECT *, CASE WHEN abs(value - lag(value) OVER {W}) > 20 THEN 1 ELSE 0 END AS j FROM events), B AS (SELECT *, 1 + sum(j) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS block FROM J) SELECT user_id, block::INT AS block, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM B GROUP BY user_id, block")
def block_sessionize(spark, sf_dir):
    """A new block where the level jumps by more than 20."""
    rows = _cut(spark, sf_dir).previous("value")
    jumps = F.coalesce(F.abs(F.col("value") - F.col("prev_value")) > 20, F.lit(False))
    rows = rows.running("block", F.when(jumps, 1).otherwise(0)).rows.withColumn("block", (F.col("block") + 1).cast("int"))
    return rows.groupBy("user_id", "block").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query(f"WITH G AS (SELECT user_id, event_id, ts, epoch_us(ts) - epoch_us(lag(ts) OVER {W}) AS gap FROM events), B AS (SELECT *, 1 + sum(CASE WHEN gap > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS block FROM G) SELECT user_id, block::INT AS block, count(*) AS n FROM B GROUP BY user_id, block")
def line_merge(spark, sf_dir):
    """Rows closer than an hour belong to one line."""
    rows = _gaps(spark, sf_dir).running("block", F.when(F.col("gap") > 3_600_000_000, 1).otherwise(0)).rows
    return rows.withColumn("block", (F.col("block") + 1).cast("int")).groupBy("user_id", "block").agg(F.count("*").alias("n"))


@query(f"WITH G AS (SELECT user_id, event_id, ts, epoch_us(ts) - epoch_us(lag(ts) OVER {W}) AS gap FROM events), S AS (SELECT user_id, list_sort(list(gap)) AS gaps FROM G WHERE gap IS NOT NULL GROUP BY user_id), M AS (SELECT user_id, gaps[len(gaps) // 2 + 1] AS middle FROM S), B AS (SELECT G.user_id, 1 + sum(CASE WHEN gap > middle * 1.6 THEN 1 ELSE 0 END) OVER (PARTITION BY G.user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS p FROM G JOIN M USING (user_id)) SELECT user_id, max(p)::INT AS paragraphs, count(*) AS n FROM B GROUP BY user_id")
def paragraph_threshold(spark, sf_dir):
    """A new paragraph where a gap exceeds 1.6 times the upper median gap."""
    rows = _gaps(spark, sf_dir).rows
    middle = at_rank(rows, USER, "gap", lambda n: F.floor(n / 2) + 1).withColumnRenamed("gap", "middle")
    wide = F.coalesce(F.col("gap") > F.col("middle") * 1.6, F.lit(False))
    return rows.join(middle, "user_id").groupBy("user_id").agg((F.count_if(wide) + 1).cast("int").alias("paragraphs"), F.count("*").alias("n"))


@query(f"WITH G AS (SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER {W}) AS gap FROM events), S AS (SELECT user_id, list_sort(list(gap)) AS g FROM G WHERE gap IS NOT NULL GROUP BY user_id) SELECT user_id, g[floor(0.9 * (len(g) - 1))::INT + 1] AS p90 FROM S")
def p90_gap(spark, sf_dir):
    rows = at_rank(_gaps(spark, sf_dir).rows, USER, "gap", lambda n: F.floor(0.9 * (n - 1)) + 1)
    return rows.select("user_id", F.col("gap").alias("p90"))


@query(f"SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), -1) AS carried FROM events")
def carry_forward(spark, sf_dir):
    rows = _cut(spark, sf_dir).carried("carried", F.when(F.col("event_type") == "purchase", F.col("event_id"))).rows
    return rows.select("event_id", F.coalesce("carried", F.lit(-1).cast("long")).alias("carried"))


@query(f"WITH N AS (SELECT *, row_number() OVER {W} AS place, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER {W} THEN 1 ELSE 0 END AS c FROM events), B AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS b FROM N) SELECT user_id, event_type, min(place)::INT AS start_at, max(place)::INT AS end_at, count(*) AS n FROM B GROUP BY user_id, b, event_type")
def doc_spans(spark, sf_dir):
    rows = _cut(spark, sf_dir).previous("event_type", "event_id")
    changed = F.col("prev_event_id").isNull() | ~F.col("event_type").eqNullSafe(F.col("prev_event_type"))
    rows = rows.running("run", F.when(changed, 1).otherwise(0), at=F.lit(1)).rows
    return rows.groupBy("user_id", "run", "event_type").agg(F.min("at").cast("int").alias("start_at"), F.max("at").cast("int").alias("end_at"), F.count("*").alias("n")).drop("run")


@query("WITH R AS (SELECT o_custkey, o_orderkey, o_orderdate, dayofyear(o_orderdate)::INT AS page FROM orders), S AS (SELECT *, lead(page) OVER (PARTITION BY o_custkey ORDER BY page, o_orderkey) AS nxt FROM R) SELECT o_orderkey, page AS start_page, greatest(page, coalesce(nxt - 1, 366))::INT AS end_page FROM S")
def bookmark_ranges(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.dayofyear("o_orderdate").alias("page"))
    return ranges(rows, ["o_custkey"], ["page", "o_orderkey"], "page", F.lit(366)).select("o_orderkey", "start_page", "end_page")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def inventory_rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT o.o_orderkey, coalesce(c.c_name, n.c_name) AS name, CASE WHEN c.c_name IS NOT NULL THEN 'id' WHEN n.c_name IS NOT NULL THEN 'name' ELSE 'none' END AS method FROM orders o LEFT JOIN (SELECT * FROM customer) c ON o.o_custkey = c.c_custkey LEFT JOIN (SELECT lower(c_name) AS key, min(c_name) AS c_name FROM customer GROUP BY 1) n ON n.key = 'customer#' || lpad(o.o_custkey::VARCHAR, 9, '0')")
def catalog_lookup(spark, sf_dir):
    """By id first, then by name."""
    customer = table(spark, sf_dir, "customer")
    by_id = customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("by_id"))
    by_name = customer.groupBy(F.lower("c_name").alias("key")).agg(F.min("c_name").alias("by_name"))
    orders = table(spark, sf_dir, "orders").withColumn("key", F.concat(F.lit("customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")))
    rows = orders.join(by_id, "o_custkey", "left").join(by_name, "key", "left")
    return rows.select("o_orderkey", F.coalesce("by_id", "by_name").alias("name"), F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_name").isNotNull(), "name").otherwise("none").alias("method"))


ALIASES = (("metal", ("STEEL", "BRASS", "COPPER", "TIN", "NICKEL")), ("size", ("SMALL", "LARGE", "MEDIUM")), ("other", ("",)))


@query("SELECT p_partkey, CASE " + " ".join(f"WHEN {' OR '.join(f'contains(upper(p_type), {chr(39)}{k}{chr(39)})' for k in ks)} THEN '{g}'" for g, ks in ALIASES) + " END AS alias FROM part")
def alias_lookup(spark, sf_dir):
    """The first group, in order, of which a keyword occurs."""
    found = F.coalesce(*(F.when(F.greatest(*(F.upper("p_type").contains(k) for k in (*ks, ks[0]))), F.lit(g)) for g, ks in ALIASES))
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("alias"))


@query("WITH B AS (SELECT DISTINCT p_brand, p_retailprice FROM part), C AS (SELECT p.p_partkey, b.p_retailprice AS nearest, abs(b.p_retailprice - p.p_retailprice * 1.02) AS diff, p.p_retailprice * 1.02 AS wanted FROM part p JOIN B b USING (p_brand)), R AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY diff, nearest) AS r FROM C WHERE diff <= wanted * 0.15) SELECT p_partkey, nearest FROM R WHERE r = 1")
def nearest_value(spark, sf_dir):
    """The brand's list price nearest to a part's price raised by 2 %, within 15 %."""
    part = table(spark, sf_dir, "part")
    prices = part.select("p_brand", F.col("p_retailprice").alias("price"))
    wanted = part.select("p_partkey", "p_brand", (F.col("p_retailprice") * 1.02).alias("wanted"))
    rows = nearest(wanted, prices, "p_brand", "wanted", "price", width=10.0)
    diff = F.abs(F.col("price") - F.col("wanted"))
    return rows.where(diff <= F.col("wanted") * 0.15).select("p_partkey", F.col("price").alias("nearest"))


@query("SELECT l.l_orderkey, count(*) AS inside FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey AND l.l_shipdate >= o.o_orderdate AND l.l_shipdate < o.o_orderdate + INTERVAL 60 DAY GROUP BY 1")
def interval_containment(spark, sf_dir):
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    inside = (F.col("l_shipdate") >= F.col("o_orderdate")) & (F.col("l_shipdate") < F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS"))
    return line.join(orders, (F.col("l_orderkey") == F.col("o_orderkey")) & inside).groupBy("l_orderkey").agg(F.count("*").alias("inside"))


@query("SELECT user_id, event_type, round(min(value), 6) AS x0, round(max(value), 6) AS x1, count(*) AS n, round(count(*) / (1 + max(value) - min(value)), 6) AS density FROM events GROUP BY user_id, event_type")
def bbox_union(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.round(F.min("value"), 6).alias("x0"), F.round(F.max("value"), 6).alias("x1"), F.count("*").alias("n"), F.round(F.count("*") / (1 + F.max("value") - F.min("value")), 6).alias("density"))


@query("SELECT user_id, floor(value)::BIGINT AS bucket, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def dedupe_rounded(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("user_id", F.floor("value").alias("bucket")).agg(F.min("event_id").alias("event_id"))


ORDER_TEXT = "SELECT o_orderkey, 'Processo nº ' || lpad(o_orderkey::VARCHAR, 7, '0') || ', Requerente: ' || c_name || ', fim' AS text FROM orders JOIN customer ON o_custkey = c_custkey"


@query(f"SELECT o_orderkey, regexp_extract(text, 'Processo nº ([0-9]+)', 1) AS process, regexp_extract(text, 'Requerente: ([^,]+),', 1) AS party FROM ({ORDER_TEXT})")
def template_extract(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    text = F.concat(F.lit("Processo nº "), F.lpad(F.col("o_orderkey").cast("string"), 7, "0"), F.lit(", Requerente: "), F.col("c_name"), F.lit(", fim"))
    return rows.select("o_orderkey", F.regexp_extract(text, "Processo nº ([0-9]+)", 1).alias("process"), F.regexp_extract(text, "Requerente: ([^,]+),", 1).alias("party"))


@query("SELECT o_orderkey, o_totalprice::DECIMAL(18,2)::DOUBLE AS amount, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def money_and_dates(spark, sf_dir):
    """Amounts and dates written out in words and read back."""
    text = F.concat(F.lit("no valor de "), T.format_money(F.col("o_totalprice").cast("decimal(18,2)")), F.lit(", em "), T.spoken_date(F.col("o_orderdate")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return rows.select("o_orderkey", T.parse_money(F.col("text")).cast("double").alias("amount"), T.parse_date(F.col("text")).cast("string").alias("day"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice WHEN o_orderstatus = 'O' AND o_totalprice > 1000 THEN o_totalprice / 2 END AS final_value, CASE WHEN o_orderstatus = 'F' THEN 'council' WHEN o_orderstatus = 'O' AND o_totalprice > 1000 THEN 'directorate' ELSE 'not_found' END AS method FROM orders")
def final_value_rule(spark, sf_dir):
    done, large = F.col("o_orderstatus") == "F", (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 1000)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(done, F.col("o_totalprice")).when(large, F.col("o_totalprice") / 2).alias("final_value"), F.when(done, "council").when(large, "directorate").otherwise("not_found").alias("method"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 100")
def paged_listing(spark, sf_dir):
    """The second page of a hundred rows: here the limit is the feature."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").offset(100).limit(100)
