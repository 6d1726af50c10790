"""Toxicity by class-conditional Kneser-Ney models.

Bigrams of words (lower case) are counted for toxic and ordinary texts over all
labelled rows outside the held-out and the calibration fold: tasks count their
own, Spark adds the counts up by bigram. Each class has an interpolated
Kneser-Ney model; both fall back to the same continuation counts, so expressions
that are rare in either class hardly tell them apart. A text's evidence is the
difference of its log-likelihoods under both models, divided by its length, over
the whole text and over the most telling windows of one, three and eight words. A logistic curve,
fitted on a bounded sample of the calibration fold, makes it a probability.

Bigrams and words met less than ``RARE`` times say nothing about a class: both classes
leave them to the shared counts, which are made of every word and bigram, also those
met once. Words are 64-bit hashes and bigrams 64-bit hashes of two words: among 10**9
distinct bigrams some two share a number with a probability of 3 %, so at most a pair
or so of strangers is added up. Tables go through shuffles as packed columns, sorted,
with bytes of equal weight together, about 10 bytes a bigram.

While there are at most ``BROADCAST_KEYS`` bigrams and words (16 bytes a bigram, 36 a
word: 8 to 18 MB) they are collected and broadcast. Beyond that texts are packed, about
``ROW_WORDS`` words to a row, as the numbers of their words, and dealt into buckets;
each bucket asks each part of the table once for its distinct bigrams and words, in
order, and is sent their counts in that order, without the keys, which it makes again
from its texts: the same counts, so the same scores. Only what a
Bloom filter of the table's keys lets through is asked for (``FILTER_BITS`` bits, 16 MB,
at most): where the keys outgrow it more absent ones pass, and the part leaves them out.

Defined cases: null counts as empty; an empty text has no evidence and gets the
curve's constant; without labels of both classes every score is the share of
label 1 (0 without any); repeated rows stay repeated; other columns are never
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, chunks, held_out, mix, settled, small_batches, word_spans
from .labelled import CALIBRATION_FOLD, logistic, with_labels

DISCOUNT = 0.75
#: What is met less often is left to the shared counts.
RARE = 3
#: Words in the windows whose best mean counts.
WINDOWS = (1, 3, 8)
#: The curve is fitted on so many labelled rows at most.
CALIBRATION_ROWS = 50_000
#: Bigrams and words of a broadcast table.
BROADCAST_KEYS = 500_000
#: Texts of a bucket.
BUCKET_BYTES = 48 << 20
#: Words of a packed row, which lists its distinct words once, and of a slice of it that is looked at together.
ROW_WORDS, SLICE_WORDS = 1 << 20, 1 << 18
#: A part of the table for so many bytes of labelled texts, and of all texts.
PART_BYTES, ASKING_BYTES = 8 << 20, 128 << 20
#: Most bits of the filter before the join, and how many each key is given until then.
FILTER_BITS, BITS_A_KEY = 1 << 27, 16
BLOCK, FILTER_TASKS = 1 << 15, 4
#: Keys that a task holds (8 MB; 32 MB with their counts) while it makes them distinct.
HELD_KEYS = 1 << 20
_FIRST = U64(0x5851F42D4C957F2D)
_PAIR = U64(0x9E3779B97F4A7C15)


def bigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the word before, of the word, index of text); before the first word stands a mark."""
    words, owner, _, _ = word_spans(texts)
    return words_before(words, owner), words, owner


def words_before(words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    return places_before(words, owner, _FIRST)


def places_before(words: np.ndarray, owner: np.ndarray, mark) -> np.ndarray:
    """The word before each, or the mark where a text begins."""
    before = np.empty_like(words)
    if len(words):
        before[1:] = words[:-1]
        first = np.ones(len(words), bool)
        first[1:] = owner[1:] != owner[:-1]
        before[first] = mark
    return before


def pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(before * _PAIR + word)


def distinct(keys: np.ndarray) -> np.ndarray:
    """Each key once, in order. (np.unique hashes numbers first, fifty times slower on these.)"""
    keys = np.sort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return keys[new]


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    """By bits that neither the filter nor the order of keys depend on."""
    return (mix(key ^ _PAIR) % U64(parts)).astype(np.int64)


def packed_columns(*columns: np.ndarray) -> bytes:
    """Columns of equal length, bytes of equal weight together."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(-1, c.dtype.itemsize).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor().compress(b"".join(planes))


def unpacked_columns(blob: bytes, *kinds) -> list[np.ndarray]:
    whole = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n, at, out = len(whole) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for kind in kinds:
        size = n * np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(whole[at : at + size].reshape(-1, n).T).view(kind).ravel())
        at += size
    return out


def packed_pairs(before: np.ndarray, word: np.ndarray, toxic: np.ndarray, plain: np.ndarray) -> bytes:
    """Bigrams in order: their words once, and places among these."""
    names, at = np.unique(np.concatenate([before, word]), return_inverse=True)
    first, second = at[: len(before)].astype(np.uint32), at[len(before) :].astype(np.uint32)
    steps = np.diff(first, prepend=np.uint32(0))  # small where bigrams are in order
    head = np.array([len(names), len(before)], np.uint64)
    return zstandard.ZstdCompressor().compress(head.tobytes() + b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, c.dtype.itemsize).T.tobytes() for c in (names, steps, second, toxic.astype(np.uint32), plain.astype(np.uint32))))


def unpacked_pairs(blob: bytes) -> list[np.ndarray]:
    whole = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    words, n = (int(x) for x in whole[:16].copy().view(np.uint64))
    out, at = [], 16
    for kind, size in ((np.uint64, words), *[(np.uint32, n)] * 4):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(whole[at : at + size * width].reshape(width, size).T).view(kind).ravel())
        at += size * width
    names, steps, second, toxic, plain = out
    first = np.cumsum(steps, dtype=np.uint32)
    return [names[first], names[second], toxic, plain]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct rows of keys in order, with the sums of their counts."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    begins = np.flatnonzero(new)
    return [k[begins] for k in keys], [np.add.reduceat(c[order], begins) if len(order) else c for c in counts]


def _parted(keys: list[np.ndarray], counts: list[np.ndarray], by: np.ndarray, parts: int, pack=packed_columns):
    """(part, blob) for each part that has rows."""
    of = part_of(by, parts)
    order = np.argsort(of, kind="stable")
    columns = [c[order] for c in (*keys, *counts)]
    cuts = np.searchsorted(of[order], np.arange(parts + 1))
    for part in np.flatnonzero(np.diff(cuts)).tolist():
        yield part, pack(*(c[cuts[part] : cuts[part + 1]] for c in columns))


def _counted(parts: int):
    """Bigrams with their counts by class, summed in the task while they are at most
    ``HELD_KEYS``: (part, blob of before, word, toxic, plain)."""

    def blobs(held):
        keys, counts = _summed([np.concatenate(x) for x in held[:2]], [np.concatenate(x) for x in held[2:]])
        return keys, counts

    def leaving(keys, counts):
        made = list(_parted(keys, counts, pair_key(*keys), parts, packed_pairs))
        return pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.binary())], ["part", "blob"])

    def run(batches):
        held, many = ([], [], [], []), 0
        for batch in batches:
            texts = _texts(batch.column(0))
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in chunks(texts, 1 << 22):
                before, word, owner = bigrams(texts[a:b])
                bad = toxic[a:b][owner].astype(np.int64)
                keys, counts = _summed([before, word], [bad, 1 - bad])
                for x, y in zip(held, [*keys, *counts], strict=True):
                    x.append(y)
                many += len(keys[0])
                if many > HELD_KEYS:
                    keys, counts = blobs(held)
                    held, many = tuple([x] for x in (*keys, *counts)), len(keys[0])
                    if many > HELD_KEYS // 2:
                        yield leaving(keys, counts)
                        held, many = ([], [], [], []), 0
        if many:
            yield leaving(*blobs(held))

    return run


#: word; toxic, plain, kinds that follow in toxic, in plain; kinds before it in toxic, in
#: plain, in either; and, until rare words are told, how often it follows.
_WORD_KINDS = (np.uint64, *[np.int64] * 7)


def _merged(parts: int):
    """The blobs of a part as one: (of_pairs, part, blob, n), the bigrams that are not
    rare, and what all of them add to the counts of words, by the words' parts."""

    def run(table: pa.Table) -> pa.Table:
        columns = [unpacked_pairs(b) for b in table.column("blob").to_pylist()]
        keys, counts = _summed([np.concatenate([c[i] for c in columns]) for i in (0, 1)], [np.concatenate([c[i] for c in columns]).astype(np.int64) for i in (2, 3)])
        del columns
        (before, word), (toxic, plain) = keys, counts
        often = toxic + plain >= RARE
        rows = [(True, table.column("part")[0].as_py(), packed_pairs(*(c[often] for c in (before, word, toxic, plain))), int(often.sum()))]
        names, at = np.unique(np.concatenate([before, word]), return_inverse=True)
        as_context, as_follower = at[: len(before)], at[len(before) :]
        total = lambda of, weight: np.bincount(of, weight, minlength=len(names)).astype(np.int64)
        of_words = [total(as_context, toxic), total(as_context, plain), total(as_context, toxic > 0), total(as_context, plain > 0), total(as_follower, toxic > 0), total(as_follower, plain > 0), total(as_follower, None), total(as_follower, toxic + plain)]
        rows += [(False, part, blob, 0) for part, blob in _parted([names], of_words, names, parts)]
        kinds = (pa.bool_(), pa.int64(), pa.binary(), pa.int64())
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["of_pairs", "part", "blob", "n"])

    return run


def _merged_words(table: pa.Table) -> pa.Table:
    """The blobs of a part as one, and what the models' sums need of it."""
    columns = [unpacked_columns(b, *_WORD_KINDS, np.int64) for b in table.column("blob").to_pylist()]
    keys, counts = _summed([np.concatenate([c[0] for c in columns])], [np.concatenate([c[i] for c in columns]) for i in range(1, 9)])
    e, f, g, follows = counts[4:]
    rare = (follows < RARE) & (counts[0] + counts[1] < RARE)
    counts = [np.where(rare, 0, c) for c in counts[:6]] + [g]
    sums = [int(e.sum()), int(f.sum()), int(g.sum()), int((e > 0).sum()), int((f > 0).sum()), len(e)]
    return pa.table([table.column("part").slice(0, 1), pa.array([packed_columns(*keys, *counts)], pa.binary()), pa.array([len(e)], pa.int64()), pa.array([sums], pa.list_(pa.int64()))], ["part", "blob", "n", "sums"])


class Table:
    """Counts by key, one row for each; absent keys have zeros."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys = keys[order]
        self.counts = np.concatenate([counts[order], np.zeros((1, counts.shape[1]))]).astype(np.float32)

    def places(self, key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)  # keys in order are found sooner
        at = np.empty(len(key), np.int64)
        at[order] = np.searchsorted(self.keys, key[order])
        if len(self.keys):
            at[self.keys[np.minimum(at, len(self.keys) - 1)] != key] = len(self.keys)
        return at

    def find(self, key: np.ndarray) -> np.ndarray:
        return self.counts[self.places(key)]


class Models:
    """Log-likelihoods of both classes."""

    def __init__(self, pairs: Table, words: Table, sums: np.ndarray):
        """pairs: toxic, plain. words: as context toxic, plain, kinds that follow
        in toxic, in plain; as follower kinds before it in toxic, plain, either.
        sums: of the last three over all words, and how many words have each."""
        self.pairs, self.words, self.sums = pairs, words, sums

    def lower(self, follows: np.ndarray, k: int) -> np.ndarray:
        shared = (follows[:, 2] + 0.5) / (self.sums[2] + 0.5 * (self.sums[5] + 1))
        return np.maximum(follows[:, k] - DISCOUNT, 0) / self.sums[k] + DISCOUNT * self.sums[3 + k] / self.sums[k] * shared

    def evidence(self, texts: list[str]) -> np.ndarray:
        """For each text: mean log ratio, best means of windows, log of its words."""
        words, owner, _, _ = word_spans(texts)
        return self.evidence_of(*np.unique(words, return_inverse=True), owner, len(texts))

    def evidence_of(self, kinds: np.ndarray, place: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Of texts whose words stand at ``place`` among the distinct ones."""
        size = np.bincount(owner, minlength=n)
        kinds = np.append(kinds, _FIRST)
        before = places_before(place, owner, len(kinds) - 1)
        seen = self.pairs.find(pair_key(kinds[before], kinds[place]))
        of_kinds = self.words.find(kinds)
        logs = []
        for k in range(2):
            total = of_kinds[:, k].astype(np.float64)
            known = total > 0
            safe = np.where(known, total, 1)
            lower = self.lower(of_kinds[:, 4:], k)[place]
            rest = (DISCOUNT * of_kinds[:, 2 + k] / safe)[before] * lower
            logs.append(np.log(np.where(known[before], np.maximum(seen[:, k] - DISCOUNT, 0) / safe[before] + rest, lower)))
        ratio = logs[0] - logs[1]
        mean = np.bincount(owner, weights=ratio, minlength=n) / np.maximum(size, 1)
        sums = np.concatenate([[0.0], np.cumsum(ratio)])
        ends = np.arange(1, len(ratio) + 1)
        starts = np.concatenate([[0], np.cumsum(size)])[owner] if len(ratio) else ends
        best = np.full((n, len(WINDOWS)), -20.0)
        for i, width in enumerate(WINDOWS):
            np.maximum.at(best[:, i], owner, (sums[ends] - sums[np.maximum(ends - width, starts)]) / width)
        best[size == 0] = 0
        return np.column_stack([mean, best, np.log1p(size)])


def _pair_table(blobs: list[bytes]) -> Table:
    columns = [unpacked_pairs(b) for b in blobs]
    before, word, toxic, plain = (np.concatenate([c[i] for c in columns] or [np.zeros(0, k)]) for i, k in enumerate((np.uint64, np.uint64, np.uint32, np.uint32)))
    return Table(pair_key(before, word), np.column_stack([toxic, plain]))


def _word_table(blobs: list[bytes]) -> Table:
    columns = [unpacked_columns(b, *_WORD_KINDS) for b in blobs]
    word, *counts = (np.concatenate([c[i] for c in columns] or [np.zeros(0, k)]) for i, k in enumerate(_WORD_KINDS))
    return Table(word, np.column_stack(counts))


class Fitted:
    """The counts of a corpus: pairs and words in parts of packed columns, and their
    sums. Both tables stay in Spark unless they are small."""

    def __init__(self, pairs: DataFrame, words: DataFrame, sums: np.ndarray, most: int, parts: int):
        self.pairs, self.words, self.sums, self.parts = pairs, words, sums, parts
        self.keys = sum(t.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for t in (pairs, words))
        small = self.keys <= most
        blobs = lambda t: [r.blob for r in t.select("blob").collect()]
        self.shared = pairs.sparkSession.sparkContext.broadcast(Models(_pair_table(blobs(self.pairs)), _word_table(blobs(words)), sums)) if small else None

    @property
    def value(self) -> Models:
        """The models of small tables."""
        return self.shared.value

    def evidence(self, docs: DataFrame) -> DataFrame:
        """docs(id, text) -> id and x, the evidence."""
        shared, kind = self.shared, dict(docs.dtypes)["id"]
        schema = f"id {kind}, x array<double>"
        if shared is not None:

            def found(batches):
                for batch in batches:
                    texts = _texts(batch.column("text"))
                    rows = [shared.value.evidence(texts[a:b]) for a, b in chunks(texts)]
                    yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(np.concatenate(rows) if rows else [])], ["id", "x"])

            return docs.mapInArrow(found, schema)
        table = self.pairs.select(F.lit(True).alias("is_pair"), "part", "blob").unionByName(self.words.select(F.lit(False).alias("is_pair"), "part", "blob"))
        known = _key_filter(table, self.keys)
        absent = _absent(known.value)
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        packed = docs.select("id", "text").mapInArrow(lambda batches: _packed(batches, known.value, absent), f"ids array<{kind}>, sizes array<int>, words binary")
        # dealt once: both uses keep all columns, so Spark shares the shuffle, and the
        # packed texts are written nowhere else
        dealt = packed.withColumn("bucket", F.pmod(F.xxhash64("words", "ids"), F.lit(size // BUCKET_BYTES + 1))).repartition("bucket")
        parts, sums = self.parts, self.sums
        asked = dealt.groupBy("bucket").applyInArrow(lambda rows: _asked(rows, known.value, parts), "bucket long, is_pair boolean, part long, keys binary")

        def answer(asked: pa.Table, table: pa.Table) -> pa.Table:
            """The counts of the keys of each bucket, in the order in which it asks."""
            pair, part = (asked.column(c)[0].as_py() for c in ("is_pair", "part"))
            counts = (_pair_table if pair else _word_table)(table.column("blob").to_pylist())
            blobs = [packed_columns(*counts.find(unpacked_columns(k.as_py(), np.uint64)[0]).astype(np.uint32).T) for k in asked.column("keys")]
            n = len(blobs)
            return pa.table([asked.column("bucket"), pa.array([pair] * n, pa.bool_()), pa.array([part] * n, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "is_pair", "part", "blob"])

        def answered(asked: pa.Table, table: pa.Table) -> pa.Table:
            if asked.num_rows:
                return answer(asked, table)
            return pa.table([pa.array([], kind) for kind in (pa.int64(), pa.bool_(), pa.int64(), pa.binary())], ["bucket", "is_pair", "part", "blob"])

        own = asked.groupBy("is_pair", "part").cogroup(table.groupBy("is_pair", "part")).applyInArrow(answered, "bucket long, is_pair boolean, part long, blob binary")

        def counts_of(keys: np.ndarray, own: pa.Table, pair: bool) -> Table:
            keys, cuts = _by_part(keys, parts)
            blobs = {part: blob for is_pair, part, blob in zip(*(own.column(c).to_pylist() for c in ("is_pair", "part", "blob")), strict=True) if is_pair == pair}
            counts = np.zeros((len(keys), 2 if pair else 7), np.uint32)
            for part in np.flatnonzero(np.diff(cuts)).tolist():
                for k, column in enumerate(unpacked_columns(blobs.pop(part), *[np.uint32] * counts.shape[1])):
                    counts[cuts[part] : cuts[part + 1], k] = column
            if blobs:
                raise ValueError("a bucket was answered what it did not ask")
            return Table(keys, counts)

        def meet(rows: pa.Table, own: pa.Table) -> pa.Table:
            words, pairs = _bucket_keys(rows, known.value)
            models = Models(counts_of(pairs, own, True), counts_of(words, own, False), sums)
            ids = pa.concat_arrays([c.flatten() for c in rows.column("ids").chunks])
            x = [models.evidence_of(*piece) for piece in _unpacked(rows.column("sizes"), rows.column("words"))]
            return pa.Table.from_arrays([ids, _lists(np.concatenate(x) if x else [])], ["id", "x"])

        def none(ids) -> pa.Table:
            return pa.Table.from_arrays([pa.array([], ids), _lists([])], ["id", "x"])

        return dealt.groupBy("bucket").cogroup(own.groupBy("bucket")).applyInArrow(lambda a, b: meet(a, b) if a.num_rows else none(a.schema.field("ids").type.value_type), schema)


def _texts(column) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def _lists(rows) -> pa.Array:
    return pa.array(list(rows), pa.list_(pa.float64()))


def _absent(held: np.ndarray) -> np.uint64 | None:
    """A number that no word of the table has; none where the filter is too full to tell."""
    free = np.flatnonzero(~_holds(held, np.arange(BLOCK, dtype=np.uint64), False))
    return U64(free[0]) if len(free) else None


def _packed(batches, held: np.ndarray, absent: np.uint32 | None):
    """Texts, many to a row whatever their batches: ids, how many words each has, and
    the numbers of the words: how many are distinct, these, and for each word its place
    among them. Words that are not in the table, and so in none of its bigrams, are all
    written as one number: their counts are zero alike."""
    ids, sizes, words, many = [], [], [], 0
    for batch in batches:
        texts = _texts(batch.column("text"))
        for a, b in chunks(texts, 1 << 20):
            _, word, owner = bigrams(texts[a:b])
            ids.append(batch.column("id").slice(a, b - a))
            sizes.append(np.bincount(owner, minlength=b - a).astype(np.int32))
            words.append(word)
            many += len(word) + b - a
            if many >= ROW_WORDS:
                yield _packed_row(ids, sizes, words, held, absent)
                ids, sizes, words, many = [], [], [], 0
    if ids:
        yield _packed_row(ids, sizes, words, held, absent)


def _packed_row(ids: list, sizes: list, words: list, held: np.ndarray, absent: np.uint32 | None) -> pa.RecordBatch:
    kinds, place = np.unique(np.concatenate(words), return_inverse=True)
    if absent is not None:
        kinds, again = np.unique(np.where(_holds(held, kinds, False), kinds, absent), return_inverse=True)
        place = again[place]
    # frequent words first, and bytes of equal weight together: they pack better
    order = np.argsort(-np.bincount(place, minlength=len(kinds)), kind="stable")
    kinds, place = kinds[order], np.argsort(order).astype(np.uint32)[place]
    planes = place.view(np.uint8).reshape(-1, 4).T
    packed = zstandard.ZstdCompressor().compress(np.uint32(len(kinds)).tobytes() + kinds.tobytes() + planes.tobytes())
    ends = pa.array([0, sum(map(len, ids))], pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.concat_arrays(ids)), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sizes)))]
    return pa.RecordBatch.from_arrays([*lists, pa.array([packed], pa.binary())], ["ids", "sizes", "words"])


def _unpacked_row(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of a row, and each word's place among them."""
    whole = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    kinds = int(whole[:4].view(np.uint32)[0])
    place = np.ascontiguousarray(whole[4 + 8 * kinds :].reshape(4, -1).T).view(np.uint32).ravel()
    return whole[4 : 4 + 8 * kinds].copy().view(np.uint64), place


def _unpacked(sizes, words):
    """(distinct words of the row, each word's place among them, index of text, number of
    texts) of slices of the rows that _packed wrote, at most ``SLICE_WORDS`` words or one
    text each."""
    for size, packed in zip(sizes, words, strict=True):
        size = size.values.to_numpy()
        kinds, place = _unpacked_row(packed.as_py())
        ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        a = 0
        while a < len(size):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + SLICE_WORDS, side="right")) - 1)
            yield kinds, place[ends[a] : ends[b]], np.repeat(np.arange(b - a), size[a:b]), b - a
            a = b


def _places(keys: np.ndarray, is_pair: bool, bits: int) -> np.ndarray:
    """The two bits of each key in a filter of so many, a power of two."""
    spread = mix(keys.view(np.uint64) ^ U64(is_pair))
    return np.stack([spread, spread >> U64(32)]) & U64(bits - 1)


def _key_filter(keys: DataFrame, count: int):
    """A broadcast Bloom filter of a table's keys(is_pair, blob); tasks set the bits, Spark joins their blocks."""
    bits = BLOCK
    while bits < min(count * BITS_A_KEY, FILTER_BITS):
        bits *= 2

    def placed(batches):
        for batch in batches:
            for pair, blob in zip(batch.column("is_pair").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                keys = pair_key(*unpacked_pairs(blob)[:2]) if pair else unpacked_columns(blob, *_WORD_KINDS)[0]
                at = distinct(_places(keys, pair, bits).ravel()).astype(np.int64)
                for low in range(0, len(at), 1 << 20):
                    yield pa.RecordBatch.from_arrays([pa.array(at[low : low + (1 << 20)] // BLOCK), pa.array(at[low : low + (1 << 20)] % BLOCK)], ["block", "bit"])

    # each task sends a whole filter, so only a few make it
    blocks = keys.coalesce(FILTER_TASKS).mapInArrow(placed, "block long, bit long").groupBy("block").agg(F.bitmap_construct_agg("bit").alias("held")).collect()
    held = np.zeros((bits // BLOCK, BLOCK // 8), np.uint8)
    for r in blocks:
        held[r.block] = np.frombuffer(r.held, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(held.ravel())


def _holds(held: np.ndarray, keys: np.ndarray, is_pair: bool) -> np.ndarray:
    at = _places(keys, is_pair, len(held) * 8)
    return ((held[at >> U64(3)] >> (at & U64(7)).astype(np.uint8)) & 1).all(axis=0)


def _bucket_keys(rows: pa.Table, held: np.ndarray) -> list[np.ndarray]:
    """The words and the bigrams of a bucket that the filter holds, each once, in order
    (whatever the order of its rows)."""
    words = [_unpacked_row(packed.as_py())[0] for packed in rows.column("words")]
    pairs, many, most = [], 0, HELD_KEYS
    for kinds, place, owner, _ in _unpacked(rows.column("sizes"), rows.column("words")):
        found = distinct(pair_key(words_before(kinds[place], owner), kinds[place]))
        pairs.append(found[_holds(held, found, True)])
        many += len(pairs[-1])
        if many > most:
            pairs = [distinct(np.concatenate(pairs))]
            many = len(pairs[0])
            most = max(HELD_KEYS, 2 * many)
    words = distinct(np.concatenate([*words, np.array([_FIRST])]))
    return [words[_holds(held, words, False)], distinct(np.concatenate(pairs or [np.zeros(0, U64)]))]


def _by_part(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys by part, in order within each, and where each part begins and the last ends."""
    of = part_of(keys, parts)
    order = np.argsort(of, kind="stable")
    return keys[order], np.searchsorted(of[order], np.arange(parts + 1))


def _asked(rows: pa.Table, held: np.ndarray, parts: int) -> pa.Table:
    """(bucket, is_pair, part, keys): what a bucket asks each part of the table."""
    made = []
    for keys, is_pair in zip(_bucket_keys(rows, held), (False, True), strict=True):
        keys, cuts = _by_part(keys, parts)
        made += [(is_pair, part, packed_columns(keys[cuts[part] : cuts[part + 1]])) for part in np.flatnonzero(np.diff(cuts)).tolist()]
    bucket = rows.column("bucket")[0].as_py()
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.binary())
    return pa.table([pa.array([(bucket, *m)[i] for m in made], kind) for i, kind in enumerate(kinds)], ["bucket", "is_pair", "part", "keys"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = BROADCAST_KEYS):
    """(what is counted, weights of the curve, id and evidence x of each row), or
    (None, share of label 1, None)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    labels = labels.select(F.col(id_col).alias("id"), F.col(label).alias("label"))
    share = labels.where((~F.coalesce(held_out("id"), F.lit(True))) & F.col("label").isNotNull()).agg(F.countDistinct("label"), F.avg("label")).first()
    if share[0] < 2:
        return None, float(share[1] or 0), None
    known = with_labels(docs.select("id", "text"), labels, "label", "id")
    counting = known.where(F.col("fold") != CALIBRATION_FOLD).select("text", "label")
    sizes = [t.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] for t in (counting, docs)]
    parts = int(1 + max(sizes[0] // PART_BYTES, sizes[1] // ASKING_BYTES))
    blobs = "part long, blob binary"
    merged = settled(counting.mapInArrow(_counted(parts), blobs).groupBy("part").applyInArrow(_merged(parts), f"of_pairs boolean, {blobs}, n long"))
    pairs = merged.where("of_pairs").drop("of_pairs")
    words = settled(merged.where("not of_pairs").select("part", "blob").groupBy("part").applyInArrow(_merged_words, f"{blobs}, n long, sums array<long>"))
    sums = words.agg(*(F.sum(F.col("sums")[i]) for i in range(6))).first()
    if not sums[5] or not all(sums):
        return None, float(share[1] or 0), None
    fitted = Fitted(pairs, words, np.array(sums, float), most, parts)
    x = settled(fitted.evidence(docs))
    # the curve's rows are chosen among ids
    chosen = with_labels(labels.select("id").distinct(), labels, "label", "id").where(F.col("fold") == CALIBRATION_FOLD).orderBy(F.xxhash64("id"), "id").limit(CALIBRATION_ROWS)
    rows = x.join(F.broadcast(settled(chosen.select("id", "label"))), "id").select("x", "label").collect()
    y = np.array([r.label for r in rows])
    curve = logistic(np.array([r.x for r in rows]), y) if len(set(y.tolist())) == 2 else np.array([1.0] * (1 + len(WINDOWS)) + [0.0, -2.0])
    return fitted, curve, x


def scored(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = BROADCAST_KEYS) -> DataFrame:
    """(id, held_out, score, predicted) of each row."""
    fitted, curve, x = fit(docs, labels, label, id_col, text_col, most)
    if fitted is None:
        out = docs.select(F.col(id_col).alias("id"), F.lit(curve).alias("score"))
    else:
        *weights, constant = curve.tolist()
        at = sum((F.col("x")[i] * w for i, w in enumerate(weights)), F.lit(constant))
        out = x.select("id", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), at))))).alias("score"))
    return out.select(F.col("id").alias(id_col), F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
