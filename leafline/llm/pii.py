"""Personal data by patterns and by information-theoretic sanitisation, on
built-in functions only.

Base spans (e-mail, IP, card and phone numbers) come from patterns: each match is
marked in a copy of the text, the copy is split at the marks, and the lengths of
the pieces give code-point offsets.

Terms near a base span (runs of letters or digits, whole within sixty characters
of it, in any line) may reveal the protected value although no pattern knows them.
The corpus tells how strongly: with n(e), n(t) and n(e,t) the numbers of texts
that hold value e, term t, and t near e, of N texts, the term discloses the share
PMI / IC = log(N n(e,t) / (n(e) n(t))) / log(N / n(e)) of the information in e.
From ``DISCLOSES`` on, given at least two different texts (copies of one text
count once), the term's occurrences in texts with that value are spans too:
generalised, or removed from ``REMOVES`` on.

Defined cases: null counts as empty; spans are start (inclusive) and end
(exclusive) in code points; patterns are ASCII; repeated rows stay repeated;
other columns are ignored (kept by ``sanitised``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled, unused

#: Kinds in the order of ties, and their patterns. Loops are possessive where
#: nothing after them could make them give back, and a number or local part is
#: not tried again from its middle: the same matches in linear time.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be tried.
HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: SQL conditions on a match m; d is its digits.
CHECKS = {
    "email": "true",
    "ip": r"forall(split(m, '[.]'), p -> p rlike '^0*[0-9]{1,3}$' and cast(right(p, 3) as int) <= 255)",
    "card": "length(d) between 12 and 19 and aggregate(sequence(1, length(d)), 0, (a, i) -> a + if(i % 2 = 1, cast(substring(d, length(d) - i + 1, 1) as int), pmod(2 * cast(substring(d, length(d) - i + 1, 1) as int) - 1, 9) + if(substring(d, length(d) - i + 1, 1) = '0', -8, 1))) % 10 = 0",
    "phone": "length(d) between 9 and 15",
}
NEAR = 60
DISCLOSES, REMOVES = 0.5, 0.9
CONTEXTS = 2
BROADCAST_ROWS = 1_000_000
OPEN, CLOSE, OTHER = "\x01", "\x02", "\x03"
SPAN = "struct<start:int,rank:int,kind:string,end:int,value:string>"


def _marked(text: str, pattern: str) -> Column:
    """Pieces of the text: before the first match, then each match, CLOSE and what follows."""
    return F.split(F.regexp_replace(text, f"({pattern})", f"{OPEN}$1{CLOSE}"), OPEN)


def _spans(rank: int, kind: str, check: str, pieces: str) -> str:
    """SQL: the spans of a kind whose match passes the check."""
    match = f"substring_index(p, '{CLOSE}', 1)"
    passes = check.replace("(d)", f"(regexp_replace({match}, '[^0-9]', ''))").replace("(d,", f"(regexp_replace({match}, '[^0-9]', ''),").replace("(m,", f"({match},")
    here = f"named_struct('start', s.at, 'rank', {rank}, 'kind', '{kind}', 'end', s.at + length({match}), 'value', {match})"
    none = f"cast(array() as array<{SPAN}>)"
    return f"aggregate(slice({pieces}, 2, greatest(size({pieces}) - 1, 0)), named_struct('at', length({pieces}[0]), 'found', {none}), (s, p) -> named_struct('at', s.at + length(p) - 1, 'found', if({passes}, array_append(s.found, {here}), s.found)), s -> s.found)"


def base_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text (marks replaced), spans (sorted by start and kind)."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), OPEN + CLOSE, OTHER + OTHER)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    found = []
    for rank, (kind, pattern) in enumerate(KINDS.items()):
        hint = F.col("text").contains(HINTS[kind]) & F.col("text").rlike(r"@" if kind == "email" else "[0-9]")
        rows = rows.withColumn(f"p_{kind}", F.when(hint, _marked("text", pattern)).otherwise(F.array("text")))
        found.append(F.expr(_spans(rank, kind, CHECKS[kind], f"p_{kind}")))
    rows = rows.select("id", "text", *(x.alias(f"f_{kind}") for x, kind in zip(found, KINDS, strict=True)))
    return rows.select("id", "text", F.array_sort(F.concat(*(f"f_{kind}" for kind in KINDS))).alias("spans"))


def _value(span: str) -> str:
    """SQL: what is protected, written alike however it was punctuated."""
    return f"concat({span}.kind, ':', if({span}.kind in ('card', 'phone'), regexp_replace({span}.value, '[^0-9]', ''), lower({span}.value)))"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)


def near_spans() -> Column:
    """entity and near for each span: its value and the text around it,
    without words that go beyond."""
    left = f"regexp_replace(right(concat(' ', substring(text, 1, s.start)), {NEAR + 1}), '^[\\\\p{{L}}\\\\p{{N}}]+', '')"
    right = f"regexp_replace(substring(concat(substring(text, s.end + 1, {NEAR + 1}), ' '), 1, {NEAR + 1}), '[\\\\p{{L}}\\\\p{{N}}]++$', '')"
    return F.expr(f"transform(spans, s -> named_struct('entity', {_value('s')}, 'near', concat({left}, ' ', {right})))")


def contexts(every: DataFrame) -> DataFrame:
    """entity, context (the key of the text), id and terms: those near each span."""
    near = every.select("id", "key", F.explode("near").alias("x")).select("id", "key", "x.entity", "x.near")
    return near.select("id", "entity", F.col("key").alias("context"), F.array_distinct(words(F.col("near"))).alias("terms"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key (of the text) and spans of every row, base ones and terms, in order;
    a term's value is the empty string when it is to be removed. Base spans are
    found in one pass and settled before anything filters on them: a filter above
    would be pushed below and find them again for each mention."""
    found = base_spans(docs, id_col, text_col).withColumn("key", F.xxhash64("text"))
    every = settled(found.select("id", "key", "spans", near_spans().alias("near")))
    held = every.where(F.size("spans") > 0).select("id", "key", "spans")
    whole = every.select("id", "key", "spans")
    pairs = contexts(every).select("id", "entity", "context", F.explode("terms").alias("term")).distinct().groupBy("entity", "term", "context").agg(F.count("*").alias("n"))
    pairs = settled(pairs.groupBy("entity", "term").agg(F.count("*").alias("contexts"), F.sum("n").alias("n_et")).where(F.col("contexts") >= CONTEXTS))
    if pairs.isEmpty():
        return whole
    terms = pairs.select("term").distinct()
    if terms.count() <= BROADCAST_ROWS:
        terms = F.broadcast(terms)
    source = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_t = source.select(F.explode(F.array_distinct(words(F.col("text")))).alias("term")).join(terms, "term").groupBy("term").agg(F.count("*").alias("n_t"))
    values = held.select("id", "key", F.explode("spans").alias("s")).select("id", "key", F.expr(_value("s")).alias("entity")).distinct()
    n_e = values.groupBy("entity").agg(F.count("*").alias("n_e"))
    total = docs.count()
    told = pairs.join(n_e, "entity").join(n_t, "term").withColumn("n_et", F.least("n_et", "n_e", "n_t"))
    share = F.log(F.lit(float(total)) * F.col("n_et") / (F.col("n_e") * F.col("n_t"))) / F.log(F.lit(float(total)) / F.col("n_e"))
    told = settled(told.where(F.col("n_e") < total).withColumn("share", share).where(F.col("share") >= DISCLOSES).select("entity", "term", "share"))
    if told.isEmpty():
        return whole
    same = F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.key") == F.col("b.key"))
    risky = values.join(told, "entity").groupBy("id", "key", "term").agg(F.max("share").alias("share"))
    risky = risky.groupBy("id", "key").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("risk"))
    risky = settled(risky)
    ids = risky.select("id", "key")
    # only ids are broadcast; the maps, of any length, meet the few texts by a shuffle
    chosen = found.select("id", "key", "text").alias("a").join((F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids).alias("b"), same, "left_semi").dropDuplicates(["id", "key"])
    texts = chosen.alias("a").join(risky.alias("b"), same).select("a.id", "a.key", "text", "risk")
    rank = len(KINDS)
    marked = texts.select("id", "key", "risk", _marked("text", r"(?<![\p{L}\p{N}])[\p{L}\p{N}]++").alias("p_term"))
    term_spans = marked.select("id", "key", "risk", F.expr(_spans(rank, "term", "map_contains_key(risk, lower(substring_index(p, '\x02', 1)))", "p_term")).alias("more"))
    term_spans = term_spans.select("id", "key", F.expr(f"transform(more, s -> named_struct('start', s.start, 'rank', s.rank, 'kind', s.kind, 'end', s.end, 'value', if(risk[lower(s.value)] >= {REMOVES}, '', s.value)))").alias("more"))
    both = whole.alias("a").join(term_spans.alias("b"), same, "left")
    return both.select("a.id", "a.key", F.array_sort(F.concat("spans", F.coalesce("more", F.expr(f"cast(array() as array<{SPAN}>)")))).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, counts of base spans, base_sha256 and spans of every row."""
    rows = spans(docs, id_col, text_col)
    base = F.filter("spans", lambda s: s["kind"] != "term")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as long)").alias(f"n_{kind}") for kind in KINDS]
    return rows.select(F.col("id").alias(id_col), *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with spans replaced by their kind in angle brackets, or cut out where
    a term is to be removed; of overlapping spans the first counts. chars_col, if
    there is one, follows the text."""
    at, held, spot, found = (unused(docs, f"pii_{c}") for c in ("key", "id", "at", "spans"))
    key = F.xxhash64(F.translate(F.coalesce(F.col(text_col), F.lit("")), OPEN + CLOSE, OTHER + OTHER))
    with_spans = settled(spans(docs, id_col, text_col).where(F.size("spans") > 0).dropDuplicates(["id", "key"]))
    whole = with_spans.select(F.col("id").alias(held), F.col("key").alias(spot), F.col("spans").alias(found))
    if with_spans.agg(F.count("*") + 4 * F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0] <= BROADCAST_ROWS:
        whole = F.broadcast(whole)
    rows = docs.withColumn(at, key).join(whole, F.col(id_col).eqNullSafe(F.col(held)) & (F.col(at) == F.col(spot)), "left")
    pieces = f"""aggregate({found}, named_struct('at', 0, 'out', cast(array() as array<string>)), (s, x) -> if(x.start < s.at, s,
        named_struct('at', x.end, 'out', array_append(s.out, concat(substring(`{text_col}`, s.at + 1, x.start - s.at), if(x.kind = 'term' and x.value = '', '', concat('<', upper(x.kind), '>')))))),
        s -> concat(array_join(s.out, ''), substring(`{text_col}`, s.at + 1)))"""
    out = rows.withColumn(text_col, F.when(F.col(found).isNull(), F.col(text_col)).otherwise(F.expr(pieces)))
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(F.col(found).isNull(), F.col(chars_col)).otherwise(F.length(text_col).cast(dict(docs.dtypes)[chars_col])))
    return out.select(docs.columns)
