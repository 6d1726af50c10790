"""Queries on field candidates: overlays, choices, reports and catalogs.

Candidates are made of order lines: a field, a source, a value, a confidence, a page
and a method each."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.dependencies import Derived, listed, wide
from ..operators.ordered import best
from ..sources.content import table
from .registry import query

FIELDS = ["NUMBER", "AMOUNT", "NAME", "DATE", "SIGNER", "PLACE"]
CANDIDATES = """C AS (SELECT l_orderkey AS doc, l_linenumber AS ord, ['NUMBER', 'AMOUNT', 'NAME', 'DATE', 'SIGNER'][l_partkey % 5 + 1] AS field, CASE WHEN l_suppkey % 2 = 0 THEN 'seed' ELSE 'fallback' END AS source,
  CASE l_partkey % 5 WHEN 0 THEN l_partkey::VARCHAR WHEN 1 THEN (CASE WHEN l_quantity > 25 THEN 'R$ ' || l_partkey || ',00' ELSE l_partkey::VARCHAR END) WHEN 2 THEN (CASE WHEN l_quantity > 40 THEN 'Court ' ELSE 'Ana ' END) || l_returnflag WHEN 3 THEN (CASE WHEN l_quantity > 45 THEN '-' ELSE strftime(l_shipdate, '%d/%m/%Y') END) ELSE 'Rui ' || l_returnflag END AS value,
  round(0.3 + l_discount * 6, 3) AS confidence, l_quantity::INT % 3 AS page, CASE WHEN l_tax = 0 THEN 'not_found' WHEN l_tax < 0.03 THEN 'regex' WHEN l_tax < 0.06 THEN 'filename_fallback' ELSE 'template' END AS method FROM lineitem)"""


def candidates(spark, sf_dir):
    kind, amount = F.col("l_partkey") % 5, F.col("l_quantity")
    number = F.col("l_partkey").cast("string")
    value = F.when(kind == 0, number).when(kind == 1, F.when(amount > 25, F.concat(F.lit("R$ "), number, F.lit(",00"))).otherwise(number)).when(kind == 2, F.concat(F.when(amount > 40, "Court ").otherwise("Ana "), F.col("l_returnflag"))).when(kind == 3, F.when(amount > 45, "-").otherwise(F.date_format("l_shipdate", "dd/MM/yyyy"))).otherwise(F.concat(F.lit("Rui "), F.col("l_returnflag")))
    method = F.when(F.col("l_tax") == 0, "not_found").when(F.col("l_tax") < 0.03, "regex").when(F.col("l_tax") < 0.06, "filename_fallback").otherwise("template")
    field = F.element_at(F.array(*map(F.lit, FIELDS[:5])), kind.cast("int") + 1)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("ord"), field.alias("field"), F.when(F.col("l_suppkey") % 2 == 0, "seed").otherwise("fallback").alias("source"), value.alias("value"), F.round(0.3 + F.col("l_discount") * 6, 3).alias("confidence"), (amount.cast("int") % 3).alias("page"), method.alias("method"))


OVERLAID = f"{CANDIDATES}, M AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, field, source ORDER BY confidence DESC, ord, value, method, page) AS r FROM C) WHERE r = 1)"


def overlaid(rows):
    """One candidate a document, field and source: the most confident, the first of equals."""
    return best(rows, ["doc", "field", "source"], [F.col("confidence").desc(), *map(F.col, ("ord", "value", "method", "page"))])


@query(f"WITH {OVERLAID} SELECT doc, field, source, value, confidence FROM M")
def overlay_merge(spark, sf_dir):
    return overlaid(candidates(spark, sf_dir)).select("doc", "field", "source", "value", "confidence")


SIDES = f"""{OVERLAID}, D AS (SELECT doc, field, max(value) FILTER (source = 'seed') AS sv, max(confidence) FILTER (source = 'seed') AS sc, max(method) FILTER (source = 'seed') AS sm, max(page) FILTER (source = 'seed') AS sp,
  max(value) FILTER (source = 'fallback') AS fv, max(confidence) FILTER (source = 'fallback') AS fc, coalesce(max(method) FILTER (source = 'fallback'), 'not_found') AS fm, max(page) FILTER (source = 'fallback') AS fp FROM M GROUP BY doc, field)"""
SEEDED = "sm <> 'not_found' AND (fm = 'not_found' OR sc >= fc)"


def _sides(spark, sf_dir):
    """Seed (s) and fallback (f) of each document and field in one row: a pivot, not a join."""
    rows = overlaid(candidates(spark, sf_dir))
    side = lambda c, s: F.max(F.when(F.col("source") == s, F.col(c)))
    names = (("value", "v"), ("confidence", "c"), ("method", "m"), ("page", "p"))
    out = rows.groupBy("doc", "field").agg(*(side(c, s).alias(s[0] + a) for s in ("seed", "fallback") for c, a in names))
    return out.withColumn("fm", F.coalesce("fm", F.lit("not_found")))


def _seeded():
    return F.coalesce((F.col("sm") != "not_found") & ((F.col("fm") == "not_found") | (F.col("sc") >= F.col("fc"))), F.lit(False))


PREFERRED = f"{SIDES}, W AS (SELECT *, coalesce(field <> 'SIGNER' AND NOT (field = 'NAME' AND starts_with(sv, 'Court')) AND {SEEDED}, false) AS seeded FROM D), B AS (SELECT doc, field, CASE WHEN seeded THEN sv ELSE fv END AS value, CASE WHEN seeded THEN sc ELSE fc END AS confidence, CASE WHEN seeded THEN sm ELSE fm END AS method FROM W)"


def preferred(spark, sf_dir):
    """The seed if it is as confident as the fallback; never for a signer, and not for
    an institution as a name."""
    seeded = _seeded() & (F.col("field") != "SIGNER") & ~((F.col("field") == "NAME") & F.coalesce(F.col("sv").startswith("Court"), F.lit(False)))
    return _sides(spark, sf_dir).withColumn("seeded", seeded).select("doc", "field", *(F.when(F.col("seeded"), F.col("s" + a)).otherwise(F.col("f" + a)).alias(n) for n, a in (("value", "v"), ("confidence", "c"), ("method", "m"))))


@query(f"WITH {PREFERRED} SELECT doc, field, value, confidence, method FROM B")
def prefer_seed(spark, sf_dir):
    return preferred(spark, sf_dir)


@query(f"WITH {SIDES}, W AS (SELECT *, coalesce(sp = 2 AND {SEEDED}, false) AS seeded, fm <> 'not_found' AND fp = 2 AS other FROM D) SELECT doc, field, CASE WHEN seeded THEN sv WHEN other THEN fv END AS value, CASE WHEN seeded THEN sm WHEN other THEN fm ELSE 'not_found' END AS method FROM W")
def prefer_by_page(spark, sf_dir):
    """Only what was found on page 2 counts."""
    rows = _sides(spark, sf_dir).withColumn("seeded", F.coalesce(F.col("sp") == 2, F.lit(False)) & _seeded()).withColumn("other", (F.col("fm") != "not_found") & (F.col("fp") == 2))
    return rows.select("doc", "field", F.when(F.col("seeded"), F.col("sv")).when(F.col("other"), F.col("fv")).alias("value"), F.when(F.col("seeded"), F.col("sm")).when(F.col("other"), F.col("fm")).otherwise("not_found").alias("method"))


NAMES = ", ".join(f"('{f}')" for f in FIELDS)
FILLED = "method <> 'not_found' AND value IS NOT NULL AND trim(value) NOT IN ('', '-')"


def _is_filled():
    return F.coalesce((F.col("method") != "not_found") & ~F.trim("value").isin("", "-"), F.lit(False))


@query(f"WITH {PREFERRED}, N(field) AS (VALUES {NAMES}) SELECT o_orderkey AS doc, N.field, coalesce(B.value, '-') AS value, coalesce(B.method, 'not_found') AS method FROM orders CROSS JOIN N LEFT JOIN B ON B.doc = o_orderkey AND B.field = N.field")
def whitelisted_fields(spark, sf_dir):
    """The listed fields of every document; those it lacks as '-', not found."""
    every = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.explode(F.array(*map(F.lit, FIELDS))).alias("field"))
    rows = every.join(preferred(spark, sf_dir), ["doc", "field"], "left")
    return rows.select("doc", "field", F.coalesce("value", F.lit("-")).alias("value"), F.coalesce("method", F.lit("not_found")).alias("method"))


@query(f"WITH {PREFERRED}, N(field) AS (VALUES {NAMES}), E AS (SELECT o_orderkey AS doc, N.field, coalesce({FILLED}, false) AS filled FROM orders CROSS JOIN N LEFT JOIN B ON B.doc = o_orderkey AND B.field = N.field) SELECT doc, string_agg(field, ',' ORDER BY field) AS missing FROM E WHERE NOT filled GROUP BY doc")
def field_rejects(spark, sf_dir):
    """The fields that each document lacks."""
    held = preferred(spark, sf_dir).where(_is_filled()).groupBy("doc").agg(F.collect_set("field").alias("held"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc")).join(held, "doc", "left")
    missing = F.array_except(F.array(*map(F.lit, sorted(FIELDS))), F.coalesce("held", F.array().cast("array<string>")))
    return rows.select("doc", F.array_join(missing, ",").alias("missing")).where("missing != ''")


SUSPECT = "CASE field WHEN 'AMOUNT' THEN NOT starts_with(value, 'R$') WHEN 'NAME' THEN contains(lower(value), 'court') WHEN 'SIGNER' THEN regexp_matches(value, '[0-9]') WHEN 'DATE' THEN NOT regexp_matches(value, '^[0-9]{2}/[0-9]{2}/[0-9]{4}$') ELSE false END"


@query(f"""WITH {PREFERRED}, F AS (SELECT *, {SUSPECT} AS suspect FROM B WHERE {FILLED}), T AS (SELECT count(*) AS total FROM orders), N(field) AS (VALUES {NAMES}),
MS AS (SELECT field, string_agg(method || ':' || n, ', ' ORDER BY n DESC, method) AS methods FROM (SELECT field, method, count(*) AS n, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, method) AS r FROM F GROUP BY field, method) WHERE r <= 4 GROUP BY field),
X AS (SELECT field, string_agg(doc || ': ' || value, '; ' ORDER BY doc) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY doc) AS r FROM F WHERE suspect) WHERE r <= 5 GROUP BY field),
G AS (SELECT field, count(*) AS filled, count_if(confidence < 0.6) AS low_conf, count_if(suspect) AS suspect, count_if(method = 'filename_fallback') AS filename_fallback FROM F GROUP BY field)
SELECT N.field, coalesce(filled, 0)::BIGINT AS filled, (total - coalesce(filled, 0))::BIGINT AS missing, coalesce(low_conf, 0)::BIGINT AS low_conf, coalesce(suspect, 0)::BIGINT AS suspect, coalesce(filename_fallback, 0)::BIGINT AS filename_fallback, coalesce(methods, '') AS methods, coalesce(examples, '') AS examples FROM N CROSS JOIN T LEFT JOIN G ON G.field = N.field LEFT JOIN MS ON MS.field = N.field LEFT JOIN X ON X.field = N.field""")
def field_report(spark, sf_dir):
    """Each field's coverage: filled, missing, of low confidence, suspect, from file
    names, the four most frequent methods and up to five suspect examples."""
    field, value = F.col("field"), F.col("value")
    suspect = F.when(field == "AMOUNT", ~value.startswith("R$")).when(field == "NAME", F.lower(value).contains("court")).when(field == "SIGNER", value.rlike("[0-9]")).when(field == "DATE", ~value.rlike("^[0-9]{2}/[0-9]{2}/[0-9]{4}$")).otherwise(False)
    rows = preferred(spark, sf_dir).where(_is_filled()).withColumn("suspect", suspect)
    counts = rows.groupBy("field").agg(F.count("*").alias("filled"), F.count_if(F.col("confidence") < 0.6).alias("low_conf"), F.count_if("suspect").alias("suspect"), F.count_if(F.col("method") == "filename_fallback").alias("filename_fallback"))
    by_method = rows.groupBy("field", "method").agg(F.count("*").alias("n"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "method")))
    methods = by_method.groupBy("field").agg(F.array_join(F.transform(F.slice(ranked, 1, 4), lambda m: F.concat(m["method"], F.lit(":"), (-m["n"]).cast("string"))), ", ").alias("methods"))
    few = rows.where("suspect").withColumn("r", F.row_number().over(Window.partitionBy("field").orderBy("doc"))).where("r <= 5")
    examples = few.groupBy("field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc", "value"))), lambda x: F.concat(x["doc"].cast("string"), F.lit(": "), x["value"])), "; ").alias("examples"))
    total = table(spark, sf_dir, "orders").agg(F.count("*").alias("total")).select("total", F.explode(F.array(*map(F.lit, FIELDS))).alias("field"))
    rows = total.join(F.broadcast(counts), "field", "left").join(F.broadcast(methods), "field", "left").join(F.broadcast(examples), "field", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.select("field", zero("filled").alias("filled"), (F.col("total") - zero("filled")).alias("missing"), *(zero(c).alias(c) for c in ("low_conf", "suspect", "filename_fallback")), F.coalesce("methods", F.lit("")).alias("methods"), F.coalesce("examples", F.lit("")).alias("examples"))


CATALOG = "K AS (SELECT c_custkey AS ord, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE lpad(c_custkey::VARCHAR, 11, '0') END AS id, 'Customer ' || (c_custkey // 4) AS name, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS specialty FROM customer)"
BY_NAME = "Y AS (SELECT * FROM (SELECT *, upper(name) AS key, row_number() OVER (PARTITION BY upper(name) ORDER BY specialty <> '' DESC, id <> '' DESC, ord) AS r, count(DISTINCT CASE WHEN specialty <> '' THEN lower(specialty) END) OVER (PARTITION BY upper(name)) AS kinds FROM K) WHERE r = 1)"


@query(f"WITH {CATALOG}, I AS (SELECT id, arg_min(name, ord) AS name, arg_min(specialty, ord) AS specialty FROM K WHERE id <> '' GROUP BY id), {BY_NAME} SELECT o_orderkey, coalesce(I.name, Y.name) AS name, coalesce(I.specialty, Y.specialty) AS specialty, CASE WHEN I.id IS NOT NULL THEN 0.9 WHEN Y.key IS NOT NULL AND kinds > 1 THEN 0.6 WHEN Y.key IS NOT NULL THEN 0.75 ELSE 0 END::DOUBLE AS confidence FROM orders LEFT JOIN I ON I.id = lpad(o_custkey::VARCHAR, 11, '0') LEFT JOIN Y ON Y.key = 'CUSTOMER ' || (o_custkey // 4)")
def catalog_match(spark, sf_dir):
    """By digits of the id (0.9), else by name key: rows with a specialty first, then
    with an id (0.75, or 0.6 where the name has several specialties)."""
    key = F.col("c_custkey")
    catalog = table(spark, sf_dir, "customer").select(key.alias("ord"), F.when(key % 3 == 0, "").otherwise(F.lpad(key.cast("string"), 11, "0")).alias("id"), F.concat(F.lit("Customer "), F.floor(key / 4)).alias("name"), F.when(key % 5 == 0, "").otherwise(F.col("c_mktsegment")).alias("specialty"))
    by_id = catalog.where("id != ''").groupBy("id").agg(F.min_by(F.struct("name", "specialty"), "ord").alias("i"))
    named = catalog.withColumn("key", T.name_key(F.col("name")))
    chosen = F.min_by(F.struct("name", "specialty"), F.struct(F.col("specialty") == "", F.col("id") == "", "ord"))
    by_name = named.groupBy("key").agg(chosen.alias("n"), F.countDistinct(F.when(F.col("specialty") != "", F.lower("specialty"))).alias("kinds"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", T.digits_only(T.id_form(F.lpad(F.col("o_custkey").cast("string"), 11, "0"))).alias("id"), T.name_key(F.concat(F.lit("customer "), F.floor(F.col("o_custkey") / 4))).alias("key"))
    rows = orders.join(by_id, "id", "left").join(by_name, "key", "left")
    found, named_ = F.col("i").isNotNull(), F.col("n").isNotNull()
    return rows.select("o_orderkey", F.coalesce("i.name", "n.name").alias("name"), F.coalesce("i.specialty", "n.specialty").alias("specialty"), F.when(found, 0.9).when(named_ & (F.col("kinds") > 1), 0.6).when(named_, 0.75).otherwise(0.0).alias("confidence"))


#: Aliases in order: a target (a region's number) and its keywords. 9 is no region.
ALIASES = [(9, ("steel",)), (1, ("brass", "nickel")), (2, ("promo", "tin")), (0, ("copper",)), (3, ("small", "large"))]
CASES = " ".join(f"WHEN {' OR '.join(f'contains(lower(p_type), {chr(39)}{k}{chr(39)})' for k in ks)} THEN {t}" for t, ks in ALIASES if t != 9)


@query(f"SELECT p_partkey, r_name AS target, CASE WHEN r_name IS NOT NULL THEN 0.9 ELSE 0 END::DOUBLE AS confidence FROM (SELECT p_partkey, CASE {CASES} END AS t FROM part) LEFT JOIN region ON r_regionkey = t")
def alias_match(spark, sf_dir):
    """The first alias in order that has a keyword in the text and a target that exists."""
    text = T.table_key(F.col("p_type"))
    aliases = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(t).alias("r_regionkey"), F.array(*map(F.lit, ks)).alias("keys")) for i, (t, ks) in enumerate(ALIASES)))
    parts = table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))
    hits = parts.select("p_partkey", F.explode(F.filter(aliases, lambda a: F.exists(a["keys"], lambda k: F.col("text").contains(k)))).alias("a")).select("p_partkey", "a.ord", "a.r_regionkey")
    first = hits.join(table(spark, sf_dir, "region"), "r_regionkey").groupBy("p_partkey").agg(F.min_by("r_name", "ord").alias("target"))
    return parts.select("p_partkey").join(first, "p_partkey", "left").select("p_partkey", "target", F.when(F.col("target").isNotNull(), 0.9).otherwise(0.0).alias("confidence"))


#: Ranges of interest by name; the entry without a name is the default.
REGIONS = [("france", "front", 1, 9), ("BRAZIL", "back", 3, 4), ("", "front", 0, 99)]


@query("SELECT n_nationkey, CASE lower(n_name) WHEN 'brazil' THEN 'back' ELSE 'front' END AS part, CASE lower(n_name) WHEN 'france' THEN 1 WHEN 'brazil' THEN 3 ELSE 0 END AS start_op, CASE lower(n_name) WHEN 'france' THEN 9 WHEN 'brazil' THEN 4 ELSE 99 END AS end_op FROM nation")
def default_row(spark, sf_dir):
    """The entry of a name without regard to case, else the default's."""
    known = spark.createDataFrame([(n.lower(), p, a, z) for n, p, a, z in REGIONS], "key string, part string, start_op int, end_op int")
    default = next((p, a, z) for n, p, a, z in REGIONS if n in ("", "*", "default"))
    rows = table(spark, sf_dir, "nation").withColumn("key", F.lower("n_name")).join(F.broadcast(known), "key", "left")
    return rows.select("n_nationkey", *(F.coalesce(c, F.lit(d)).alias(c) for c, d in zip(("part", "start_op", "end_op"), default, strict=True)))


SIGNERS = ["Customer#000000012", "customer 0000001", "Customer#00000"]
SIGNER_CASES = " ".join(f"WHEN contains(k, '{s.lower().replace('#', '').replace(' ', '')}') OR contains('{s.lower().replace('#', '').replace(' ', '')}', k) THEN '{s}'" for s in SIGNERS)


@query(f"SELECT c_custkey, CASE {SIGNER_CASES} END AS signer FROM (SELECT *, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS k FROM customer)")
def signer_match(spark, sf_dir):
    """The first of a list of signers that holds the name or is held by it."""
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    rows = table(spark, sf_dir, "customer").withColumn("k", key(F.col("c_name")))
    hit = F.filter(F.array(*map(F.lit, SIGNERS)), lambda s: F.col("k").contains(key(s)) | key(s).contains(F.col("k")))
    return rows.select("c_custkey", F.try_element_at(hit, F.lit(1)).alias("signer"))


@query("WITH V AS (SELECT l_orderkey AS doc, max(l_extendedprice) FILTER (l_linenumber = 1 AND l_quantity > 10) AS jz, max(l_extendedprice) FILTER (l_linenumber = 2 AND l_quantity > 10) AS de, max(l_extendedprice) FILTER (l_linenumber = 3 AND l_quantity > 30) AS cm FROM lineitem GROUP BY l_orderkey) SELECT doc, coalesce(de, jz, cm) AS prefer_de, coalesce(jz, de, cm) AS prefer_jz, coalesce(cm, de, jz) AS final, CASE WHEN cm IS NOT NULL THEN 'CM' WHEN de IS NOT NULL THEN 'DE' WHEN jz IS NOT NULL THEN 'JZ' ELSE 'none' END AS origin FROM V")
def value_choices(spark, sf_dir):
    """One of three amounts, by the orders of choice, and the final value's origin."""
    amount = lambda n, least: F.max(F.when((F.col("l_linenumber") == n) & (F.col("l_quantity") > least), F.col("l_extendedprice")))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(amount(1, 10).alias("jz"), amount(2, 10).alias("de"), amount(3, 30).alias("cm"))
    origin = F.when(F.col("cm").isNotNull(), "CM").when(F.col("de").isNotNull(), "DE").when(F.col("jz").isNotNull(), "JZ").otherwise("none")
    return rows.select("doc", F.coalesce("de", "jz", "cm").alias("prefer_de"), F.coalesce("jz", "de", "cm").alias("prefer_jz"), F.coalesce("cm", "de", "jz").alias("final"), origin.alias("origin"))


@query("WITH E AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS specialty, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS amount, o_orderstatus FROM orders), A(specialty, area, price) AS (VALUES ('1-URGENT', 'E', 100000.0), ('2-HIGH', 'M', 150000.0), ('3-MEDIUM', 'M', 150000.0)) SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'no_fields' WHEN E.specialty IS NULL THEN 'missing_specialty' WHEN amount IS NULL THEN 'missing_amount' WHEN A.area IS NULL OR abs(price - amount) > 0.15 * amount THEN 'no_match' ELSE 'ok' END AS status FROM E LEFT JOIN A USING (specialty)")
def fee_status(spark, sf_dir):
    """The ladder of outcomes of looking an order up in a fee table."""
    fees = spark.createDataFrame([("1-URGENT", "E", 100000.0), ("2-HIGH", "M", 150000.0), ("3-MEDIUM", "M", 150000.0)], "specialty string, area string, price double")
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(key % 5 != 0, F.col("o_orderpriority")).alias("specialty"), F.when(key % 7 != 0, F.col("o_totalprice")).alias("amount"), "o_orderstatus").join(F.broadcast(fees), "specialty", "left")
    far = F.col("area").isNull() | (F.abs(F.col("price") - F.col("amount")) > 0.15 * F.col("amount"))
    return rows.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "no_fields").when(F.col("specialty").isNull(), "missing_specialty").when(F.col("amount").isNull(), "missing_amount").when(far, "no_match").otherwise("ok").alias("status"))


@query("SELECT o_orderkey, least(greatest(CASE WHEN o_orderkey % 3 = 0 THEN 0.9 ELSE 0.5 END, 0.55), 0.9)::DOUBLE AS confidence, CASE WHEN regexp_full_match(replace(n, ' ', ''), '[0-9]{7}-[0-9]{2}') THEN replace(n, ' ', '') END AS number, CASE WHEN length(regexp_replace(id, '[^0-9]', '', 'g')) = 11 THEN id END AS id, CASE WHEN length(trim(c_name)) >= 4 THEN trim(c_name) END AS name FROM (SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 7, '0') || ' - ' || (o_custkey % 100) AS n, repeat('1', (8 + o_orderkey % 4)::INT) AS id, CASE WHEN o_orderkey % 2 = 0 THEN ' ' || o_orderpriority || ' ' ELSE ' ab' END AS c_name FROM orders)")
def post_validation(spark, sf_dir):
    """Numbers must match once blanks are out, ids have eleven digits, names four characters."""
    key = F.col("o_orderkey")
    number = F.regexp_replace(F.concat(F.lpad(key.cast("string"), 7, "0"), F.lit(" - "), (F.col("o_custkey") % 100).cast("string")), " ", "")
    digits = F.expr("repeat('1', cast(8 + o_orderkey % 4 as int))")
    name = F.trim(F.when(key % 2 == 0, F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" "))).otherwise(" ab"))
    confidence = F.least(F.greatest(F.when(key % 3 == 0, 0.9).otherwise(0.5), F.lit(0.55)), F.lit(0.9))
    return table(spark, sf_dir, "orders").select("o_orderkey", confidence.alias("confidence"), F.when(number.rlike("^[0-9]{7}-[0-9]{2}$"), number).alias("number"), F.when(F.length(T.digits_only(digits)) == 11, digits).alias("id"), F.when(F.length(name) >= 4, name).alias("name"))


#: What follows from the five fields that candidates give, however it is listed here.
FOLLOWS = {
    "STATUS": Derived(("LABEL", "NUMBER"), lambda label, number: F.concat_ws(" no. ", label, number), 0.6),
    "LABEL": Derived(("KIND", "YEAR"), lambda kind, year: F.concat(kind, F.lit("/"), year)),
    "YEAR": Derived(("DATE",), lambda date: F.regexp_extract(date, "([0-9]{4})$", 1), 0.8, "part"),
    "KIND": Derived(("NAME", "SIGNER"), lambda name, signer: F.when(name.startswith("Court"), "court").when(signer.isNotNull(), "signed").when(name.isNotNull(), "plain")),
    "ROUNDED": Derived(("AMOUNT", "KIND"), lambda amount, kind: F.when(kind != "court", F.regexp_extract(amount, "([0-9]+)", 1).try_cast("int") - F.regexp_extract(amount, "([0-9]+)", 1).try_cast("int") % 10)),
}
FOLLOWING = f"""{PREFERRED}, G AS (SELECT doc, max(value) FILTER (field = 'NUMBER') AS number, max(value) FILTER (field = 'AMOUNT') AS amount, max(value) FILTER (field = 'NAME') AS name, max(value) FILTER (field = 'DATE') AS date, max(value) FILTER (field = 'SIGNER') AS signer FROM B WHERE {FILLED} GROUP BY doc),
Y AS (SELECT *, nullif(regexp_extract(date, '([0-9]{{4}})$', 1), '') AS year, CASE WHEN starts_with(name, 'Court') THEN 'court' WHEN signer IS NOT NULL THEN 'signed' WHEN name IS NOT NULL THEN 'plain' END AS kind FROM G),
Z AS (SELECT *, kind || '/' || year AS label, CASE WHEN kind <> 'court' THEN (nullif(regexp_extract(amount, '([0-9]+)', 1), '')::INT - nullif(regexp_extract(amount, '([0-9]+)', 1), '')::INT % 10)::VARCHAR END AS rounded FROM Y),
X AS (SELECT *, nullif(concat_ws(' no. ', label, number), '') AS status FROM Z)"""


@query(f"WITH {FOLLOWING} " + " UNION ALL ".join(f"SELECT doc, '{f.upper()}' AS field, {f} AS value, CASE WHEN {f} IS NULL THEN 0.1 ELSE {c} END::DOUBLE AS confidence, CASE WHEN {f} IS NULL THEN 'not_found' ELSE '{m}' END AS method, CASE WHEN {f} IS NULL THEN 'NOT_FOUND' ELSE '{s}' END AS status FROM X" for f, c, m, s in [*((x, 1.0, "given", "OK") for x in ("number", "amount", "name", "date", "signer")), ("year", 0.8, "part", "OK_DERIVED"), ("kind", 0.7, "derived", "OK_DERIVED"), ("label", 0.7, "derived", "OK_DERIVED"), ("rounded", 0.7, "derived", "OK_DERIVED"), ("status", 0.6, "derived", "OK_DERIVED")]))
def derived_fields(spark, sf_dir):
    """Fields that follow from the preferred ones, in the order that they need each other."""
    given = FIELDS[:5]
    rows = wide(preferred(spark, sf_dir).where(_is_filled()), ["doc"], given)
    return listed(rows, ["doc"], given, FOLLOWS)
