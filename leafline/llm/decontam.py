"""Benchmark decontamination by spaced-seed hashing, on built-in functions only.

Fixed masks over eight words ignore some positions; the words left are hashed.
Hashes of the test items meet those of the training texts at every position. Each
hit names a diagonal (text position less item position), and along it the item is
laid over the text: the best stretch, a point for each equal word and two off for
each other one, must have enough equal words. So substituted words break some
seeds and cost some points, but not the hit.

The seeds of the test items are broadcast while there are at most
``BROADCAST_SEEDS`` (else both sides are shuffled by seed); texts are read again
only for the rows that were hit.

Defined cases: words are runs of letters and digits in lower case; items of six
or seven words match where they stand whole, shorter ones only a text that has
no other words; null texts and items have no words and match
nothing; an overlap needs ``LEAST`` equal words, or four fifths
of a shorter item; rows without an id are never reported (and stay in ``clean``);
repeated rows are reported once for each item, different texts of one id each;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled, unused

#: Positions that count, of eight. Fixed values.
MASKS = ((0, 1, 3, 4, 6, 7), (0, 1, 2, 4, 5, 7), (0, 2, 3, 5, 6, 7), (1, 2, 3, 4, 5, 6), (0, 1, 2, 5, 6, 7))
SPAN = 8
#: Words of an item that may stand among others; shorter ones must be the whole text.
WITHIN = 6
LEAST = 13
SHARE = 0.8
BROADCAST_SEEDS = 2_000_000
BROADCAST_IDS = 2_000_000


def word_hashes(text: str) -> Column:
    """An array with a hash of each word."""
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.hash(w))


def seeds(rows: DataFrame, keys: list[str], hashes: str) -> DataFrame:
    """keys, pos and seed: a row for each mask at each position."""
    n = F.size(hashes) - SPAN + 1
    shifted = [F.slice(hashes, i + 1, F.greatest(n, F.lit(0))).alias(f"h{i}") for i in range(SPAN)]
    at = rows.where(n > 0).select(*keys, F.posexplode(F.arrays_zip(*shifted)).alias("pos", "h"))
    masked = [F.xxhash64(F.lit(m), *(F.col(f"h.h{i}") for i in mask)) for m, mask in enumerate(MASKS)]
    return at.select(*keys, "pos", F.explode(F.array(*masked)).alias("seed"))


def whole_seeds(rows: DataFrame, keys: list[str], hashes: str, lengths: list[int]) -> DataFrame:
    """keys, pos and seed of short items: a row for each run of so many words."""

    def runs(n: int) -> DataFrame:
        own = rows.where(F.size(hashes) >= n if n >= WITHIN else F.size(hashes) == n)
        found = F.transform(F.sequence(F.lit(1), F.size(hashes) - n + 1), lambda i: F.xxhash64(F.lit(100 + n), F.slice(hashes, i, n)))
        return own.select(*keys, F.posexplode(found).alias("pos", "seed"))

    return reduce(DataFrame.unionByName, map(runs, lengths))


def _best(equal: str) -> str:
    """SQL: matched, begin and end of the best stretch of an array of booleans."""
    zero = "named_struct('i', 0, 'run', 0, 'same', 0, 'from', 0, 'best', 0, 'matched', 0, 'begin', 0, 'end', 0)"
    step = """
        named_struct('i', s.i + 1,
          'run', greatest(0, s.run + if(x, 1, -2)),
          'same', if(s.run + if(x, 1, -2) <= 0, 0, s.same + if(x, 1, 0)),
          'from', if(s.run + if(x, 1, -2) <= 0, s.i + 1, s.from),
          'best', greatest(s.best, s.run + if(x, 1, -2)),
          'matched', if(s.run + if(x, 1, -2) > s.best, s.same + if(x, 1, 0), s.matched),
          'begin', if(s.run + if(x, 1, -2) > s.best, s.from, s.begin),
          'end', if(s.run + if(x, 1, -2) > s.best, s.i + 1, s.end))"""
    return f"aggregate({equal}, {zero}, (s, x) -> {step}, s -> named_struct('matched', s.matched, 'begin', s.begin, 'end', s.end))"


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """(id, mark, item, matched, a, b); mark tells the texts of one id apart."""
    items = settled(benchmark.select(F.col(item_col).alias("item"), word_hashes(item_text_col).alias("ih")).where(F.size("ih") > 0))
    size = F.size("ih")
    words, lengths = items.agg(F.coalesce(F.sum(size), F.lit(0)), F.sort_array(F.collect_set(F.when(size < SPAN, size)))).first()
    small = words * len(MASKS) <= BROADCAST_SEEDS
    test = seeds(items, ["item"], "ih")
    for n in lengths:
        test = test.unionByName(whole_seeds(items.where(F.size("ih") == n), ["item"], "ih", [n]))
    test = test.select("item", F.col("pos").alias("ipos"), "seed").distinct()
    if small:
        test = F.broadcast(test)
    known = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    hashed = known.select("id", "mark", word_hashes("text").alias("h"))
    train = seeds(hashed, ["id", "mark"], "h")
    if lengths:
        train = train.unionByName(whole_seeds(hashed, ["id", "mark"], "h", lengths))
    hits = settled(train.join(test, "seed").select("id", "mark", "item", (F.col("pos") - F.col("ipos")).alias("diagonal")).distinct())
    ids = hits.select("id", "mark").distinct()
    if hits.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    # repeated rows lay the same items again; the sum over a pair takes the best of each
    again = known.join(ids, ["id", "mark"]).select("id", "mark", word_hashes("text").alias("h"))
    laid = hits.join(again, ["id", "mark"]).join(F.broadcast(items) if small else items, "item")
    equal = "transform(ih, (x, i) -> coalesce(try_element_at(h, nullif(greatest(diagonal + i + 1, 0), 0)) = x, false))"
    found = laid.select("id", "mark", "item", "diagonal", F.size("ih").alias("n"), F.expr(_best(equal)).alias("m"))
    found = found.where(F.col("m.matched") >= F.least(F.lit(LEAST), F.ceil(F.col("n") * SHARE)))
    best = found.groupBy("id", "mark", "item").agg(F.max(F.struct("m.matched", (F.col("diagonal") + F.col("m.begin")).alias("a"), (F.col("diagonal") + F.col("m.end")).alias("b"))).alias("x"))
    return best.select("id", "mark", "item", "x.matched", "x.a", "x.b")


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item id, matched, words_from, words_until) for each pair of a text and
    an item that it holds: equal words, and where in the text they lie."""
    best = _found(docs, benchmark, id_col, text_col, item_col, item_text_col)
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "matched", F.col("a").alias("words_from"), F.col("b").alias("words_until"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without those that hold test items; other texts of their ids stay."""
    id_, mark = unused(docs, "id_"), unused(docs, "mark_")
    bad = settled(_found(docs, benchmark, id_col, text_col, item_col, item_text_col).select(F.col("id").alias(id_), F.col("mark").alias(mark)).distinct())
    marked = docs.withColumn(mark, F.xxhash64(text_col))
    same = (F.col(id_col) == F.col(id_)) & (marked[mark] == bad[mark])
    return marked.join(F.broadcast(bad) if bad.count() <= BROADCAST_IDS else bad, same, "left_anti").select(docs.columns)
