"""Near-duplicate classes by DartMinHash.

A text is a weighted set: its shingles of five words (lower case, runs of
letters and digits), each weighted by how often it occurs. The n-th occurrence
is the n-th unit of an element's weight. Every unit owns a strip of ranks into
which hashed darts fall as a Poisson process; a text throws about k (ln k + 2)
of them in all, whatever its length, each dart names one of k coordinates, and
each coordinate keeps its earliest dart. Two texts agree in a coordinate with
the probability of their weighted Jaccard similarity. Texts that agree in a whole band meet in a
bucket.

Each text first picks the largest of its buckets and is compared with one member
that picked the same: that whose own buckets hold most texts. What is linked so
far forms classes. Then, in every bucket that holds several classes, all pairs
across classes are compared, each pair in the first bucket that both texts share,
in blocks of bounded size; a pair that the block has linked already by way of
others is skipped, as it could add no link between classes. So every two texts
that share a bucket are compared or are in one class anyway, whatever the size of
the bucket. Pairs whose signatures agree enough are verified on the exact
weighted shingle sets. Linked texts form a class.

Figures: a pair of similarity 0.8 shares no band with probability 7e-5. Before any
join on bands there is one row a text; the second step grows with the square of
the texts that share a bucket and stay in different classes, those of one class
are not compared with each other.

Defined cases: texts with the same words are copies; texts under five words are
one shingle; null counts as empty; texts without words are copies if equal;
repeated rows are copies; rows of one id may hold different texts: each is of its
text's class, ``classified`` names classes by a key then, as class_id alone (the least
id of a class) can be that of two classes; an empty table gives no rows; other columns,
whatever their names, are ignored (kept by ``deduplicated``).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, chunks, code_points, mix, settled, small_batches, span_hashes, unused, word_spans
from .graph import components, dealt_anew

BANDS, ROWS = 24, 5
K = BANDS * ROWS
SHINGLE = 5
SIMILARITY = 0.8
#: Pairs whose signatures agree less are not verified: 3.8 deviations below 0.8.
AGREEMENT = 0.66
#: Texts and units (16 MB) of a block; two blocks meet in a task's memory.
BLOCK_TEXTS, BLOCK_UNITS = 1024, 1 << 22
#: A broadcast list of ids has at most so many (32 MB); beyond it is a shuffled join.
BROADCAST_IDS = 2_000_000
_STEP, _PLACE, _ID = U64(0x9E3779B97F4A7C15), U64(0xD1B54A32D192ED03), U64(0x8CB92BA72F3D8DD7)


def weighted_shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, index of text), sorted by text and unit, and a key of each text's
    words. A unit is the hash of a shingle and the number of its occurrence."""
    words, owner, _, _ = word_spans(texts)
    n = len(texts)
    counts = np.bincount(owner, minlength=n)
    begins = np.concatenate([[0], np.cumsum(counts)])
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(words) - SHINGLE + 1), U64)
        for i in range(SHINGLE):
            rolled = rolled * U64(0x2545F4914F6CDD1D) + words[i : i + len(rolled)]
        whole = span_hashes((words & U64(0xFFFFFFFF)).astype(np.uint32), begins[:-1], begins[1:])
        for i in np.flatnonzero(counts == 0):
            whole[i] = hash_text(texts[i])
    inside = owner[: len(rolled)] == owner[SHINGLE - 1 :] if len(rolled) else np.zeros(0, bool)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    shingles = np.concatenate([mix(rolled[inside]), whole[short]])
    of = np.concatenate([owner[: len(rolled)][inside], short])
    order = np.lexsort((shingles, of))
    shingles, of = shingles[order], of[order]
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (of[1:] != of[:-1])
    at = np.arange(len(shingles))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    with np.errstate(over="ignore"):
        return mix(shingles + nth.astype(U64) * _STEP), of, whole


def hash_text(text: str) -> np.uint64:
    _, points, starts = code_points([text, "\0"])
    return span_hashes(points, starts[:1], starts[1:2] + 1)[0]


def signatures(units: np.ndarray, of: np.ndarray, n: int, k: int = K) -> np.ndarray:
    """n x k dart numbers; a text without units has zeros."""
    size = np.bincount(of, minlength=n)
    reach = k * (math.log(k) + 2) / np.maximum(size, 1)
    out = np.zeros((n, k), U64)
    best = np.full(n * k, np.inf)
    draw = np.zeros(len(units), U64)
    with np.errstate(over="ignore"):
        rank = -np.log(((mix(units ^ _PLACE) >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53)
    open_units = np.arange(len(units))
    while len(open_units):
        found_at, found_rank, found_id = [], [], []
        falling = open_units[rank[open_units] < reach[of[open_units]]]
        while len(falling):
            with np.errstate(over="ignore"):
                dart = mix(units[falling] + (draw[falling] + U64(1)) * _ID)
                found_at.append(of[falling] * k + (dart % U64(k)).astype(np.int64))
                found_rank.append(rank[falling])
                found_id.append(mix(dart))
                draw[falling] += U64(1)
                gap = (mix((units[falling] ^ _PLACE) + draw[falling] * _STEP) >> U64(11)).astype(np.float64)
            rank[falling] -= np.log((gap + 0.5) * 2.0**-53)
            falling = falling[rank[falling] < reach[of[falling]]]
        if found_at:
            at, ranks, ids = np.concatenate(found_at), np.concatenate(found_rank), np.concatenate(found_id)
            order = np.argsort(-ranks, kind="stable")
            at, ranks, ids = at[order], ranks[order], ids[order]
            first = np.full(n * k, -1, np.int64)
            first[at] = np.arange(len(at))  # the last write has the least rank
            hit = np.flatnonzero(first >= 0)
            hit = hit[ranks[first[hit]] < best[hit]]
            best[hit] = ranks[first[hit]]
            out.ravel()[hit] = ids[first[hit]]
        missing = np.isinf(best.reshape(n, k)).any(axis=1) & (size > 0)
        open_units = open_units[missing[of[open_units]]]
        reach[missing] *= 2
    return out


def _texts(column) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def signed(docs: DataFrame) -> DataFrame:
    """docs(id, text, mark) -> id, mark, key (equal for copies), size (units), bands
    (hashes) and signature (a byte for each coordinate)."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = _texts(batch.column(1))
            keys, sizes, bands, bytes_ = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [], []
            for a, b in chunks(texts):
                units, of, whole = weighted_shingles(texts[a:b])
                sig = signatures(units, of, b - a)
                band = np.zeros((b - a, BANDS), U64)
                with np.errstate(over="ignore"):
                    for i in range(ROWS):
                        band = mix(band * _STEP + sig[:, i::ROWS])
                    band = band * U64(32) + np.arange(BANDS, dtype=U64)
                keys.append(whole)
                sizes.append(np.bincount(of, minlength=b - a))
                bands += list(band.view(np.int64))
                bytes_ += [row.tobytes() for row in (sig & U64(255)).astype(np.uint8)]
                for i in np.flatnonzero(sizes[-1] == 0):
                    bands[a + i] = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(sizes)), pa.array(bands, pa.list_(pa.int64())), pa.array(bytes_, pa.binary())], ["id", "mark", "key", "size", "bands", "signature"])

    return docs.select("id", "text", "mark").mapInArrow(run, f"id {dict(docs.dtypes)['id']}, mark long, key long, size long, bands array<long>, signature binary")


def unit_sets(needed: DataFrame, docs: DataFrame) -> DataFrame:
    """needed(key, first), docs(id, text, mark) -> key and its units, cut to 32 bits and
    sorted: texts are read again where an id names them."""
    if needed.count() <= BROADCAST_IDS:
        needed = F.broadcast(needed)
    chosen = docs.join(needed, docs["id"] == needed["first"]).select("key", "text")

    def run(batches):
        for batch in batches:
            texts = _texts(batch.column(1))
            out, whole = [], [np.zeros(0, U64)]
            for a, b in chunks(texts):
                units, of, keys = weighted_shingles(texts[a:b])
                cut = np.searchsorted(of, np.arange(b - a + 1))
                low = (units >> U64(32)).astype(np.uint32).view(np.int32)
                out += [np.sort(low[i:j]) for i, j in zip(cut, cut[1:], strict=False)]
                whole.append(keys)
            # rows of one id may hold other texts as well
            own = np.concatenate(whole).view(np.int64) == batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["key", "units"]).filter(pa.array(own))

    return chosen.mapInArrow(run, "key long, units array<int>").dropDuplicates(["key"])


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of sorted units; equal 32-bit units count as often as both sides have them."""
    if min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
        return 0.0  # cannot reach the threshold
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / max(1, len(both) - common)


def _bytes(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), K)


def _lists(column) -> list[np.ndarray]:
    values, cut = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[i:j] for i, j in zip(cut, cut[1:], strict=False)]


def _verify(batches):
    """The links among rows (a, sa, ua, b, sb, ub): signatures first, then the sets."""
    for batch in batches:
        if batch.num_rows:
            near = (_bytes(batch.column("sa")) == _bytes(batch.column("sb"))).mean(axis=1) >= AGREEMENT
            batch = batch.filter(pa.array(near))
        keep = [jaccard(x, y) >= SIMILARITY for x, y in zip(_lists(batch.column("ua")), _lists(batch.column("ub")), strict=True)] if batch.num_rows else []
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def buckets(texts: DataFrame) -> DataFrame:
    """(band, key, size, n): the members of the buckets with n > 1 texts."""
    rows = texts.select("key", "size", F.explode("bands").alias("band"))
    full = rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(full, "band").select("band", "key", "size", "n")


def central_links(rows: DataFrame, held: DataFrame) -> DataFrame:
    """(a, b): each text with the most central of those that picked the same
    bucket, if they are similar. One row a text meets one leader."""
    picks = settled(rows.groupBy("key").agg(F.sum("n").alias("meets"), F.max(F.struct("n", "band")).alias("x")).select("key", "meets", "x.band"))
    leaders = picks.groupBy("band").agg(F.max(F.struct("meets", "key")).alias("x")).select("band", F.col("x.key").alias("b"))
    leaders = leaders.join(held.select(F.col("key").alias("b"), F.col("signature").alias("sb"), F.col("units").alias("ub")), "b")
    own = picks.select("band", "key").join(held.select("key", F.col("signature").alias("sa"), F.col("units").alias("ua")), "key")
    met = own.join(leaders, "band").where("key != b")
    return settled(met.select(F.col("key").alias("a"), "sa", "ua", "b", "sb", "ub").mapInArrow(_verify, "a long, b long"))


class _Group:
    """The rows of one meeting of blocks i <= j of a bucket, or of several."""

    def __init__(self, rows: pa.RecordBatch):
        self.key, self.root, self.block, self.band, self.i, self.j = (rows.column(c).to_numpy() for c in ("key", "root", "block", "band", "i", "j"))
        self.signature = _bytes(rows.column("signature"))
        self.bands = rows.column("bands").flatten().to_numpy().reshape(-1, BANDS)
        self.units = _lists(rows.column("units"))
        self.first = (self.bands == self.band[:, None]).argmax(axis=1)
        self.parent: dict[int, int] = {}

    def found(self, root: int) -> int:
        while (up := self.parent.get(root, root)) != root:
            self.parent[root] = root = self.parent.get(up, up)
        return root

    def link(self, xs: np.ndarray, ys: np.ndarray, out: list) -> None:
        """Adds the similar pairs among (xs, ys) that nothing has linked yet."""
        near = self.root[xs] != self.root[ys]
        xs, ys = xs[near], ys[near]
        near = (self.signature[xs] == self.signature[ys]).mean(axis=1) >= AGREEMENT
        xs, ys = xs[near], ys[near]
        # a pair belongs to the first bucket that it shares
        near = (self.bands[xs] == self.bands[ys]).argmax(axis=1) == self.first[xs]
        for x, y in zip(xs[near].tolist(), ys[near].tolist(), strict=True):
            a, b = self.found(int(self.root[x])), self.found(int(self.root[y]))
            if a != b and jaccard(self.units[x], self.units[y]) >= SIMILARITY:
                self.parent[max(a, b)] = min(a, b)
                out.append((self.key[x], self.key[y]))

    def across(self, left: np.ndarray, right: np.ndarray):
        """(one, others): all pairs of left and right, or of left alone if that is
        right, of different roots, each once; the most frequent root is never the one."""
        both = left if left is right else np.concatenate([left, right])
        names, counts = np.unique(self.root[both], return_counts=True)
        largest = names[counts.argmax()]
        rest, most = left[self.root[left] != largest], left[self.root[left] == largest]
        if left is right:
            others = np.concatenate([rest, most])
            for at, x in enumerate(rest):
                yield x, others[at + 1 :]
            return
        for x in rest:
            yield x, right
        for y in right[self.root[right] != largest] if len(most) else ():
            yield y, most

    def links(self) -> list:
        cut = np.flatnonzero((np.diff(self.band) != 0) | (np.diff(self.i) != 0) | (np.diff(self.j) != 0)) + 1
        begins, sizes, out = np.concatenate([[0], cut]), np.diff(np.concatenate([[0], cut, [len(self.key)]])), []
        for size in np.unique(sizes[sizes > 1]).tolist():
            if size <= 48:  # all meetings of one size at once; their blocks are whole buckets, mostly
                left, right = np.triu_indices(size, 1)
                own = begins[sizes == size]
                for some in np.array_split(own, 1 + len(own) * len(left) // 200_000):
                    xs, ys = (some[:, None] + left).ravel(), (some[:, None] + right).ravel()
                    meet = (self.i[xs] == self.j[xs]) | (self.block[xs] != self.block[ys])
                    self.link(xs[meet], ys[meet], out)
                continue
            for begin in begins[sizes == size].tolist():
                rows = np.arange(begin, begin + size)
                left = rows[self.block[rows] == self.i[begin]]
                right = left if self.i[begin] == self.j[begin] else rows[self.block[rows] == self.j[begin]]
                for x, ys in self.across(left, right) if len(left) and len(right) else ():
                    self.link(np.full(len(ys), x), ys, out)
        return out


def _linked(batches):
    """(a, b) of rows sorted by band, i and j; a meeting may go over several batches."""

    def pairs(rows):
        out = np.array(_Group(rows).links(), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(out.min(axis=1) if len(out) else out[:, 0]), pa.array(out.max(axis=1) if len(out) else out[:, 1])], ["a", "b"])

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.column_stack([batch.column(c).to_numpy() for c in ("band", "i", "j")])
        begin = int(np.flatnonzero((at != at[-1]).any(axis=1))[-1]) + 1 if (at != at[-1]).any() else 0
        if begin or (last is not None and (at[0] != last).any()):
            yield pairs(pa.concat_batches([*held, batch.slice(0, begin)]))
            held = []
        held.append(batch.slice(begin))
        last = at[-1]
    if held:
        yield pairs(pa.concat_batches(held))


def crossing_links(rows: DataFrame, held: DataFrame) -> DataFrame:
    """(a, b): links across classes in those buckets of rows(band, key, size, root)
    that hold several; where texts are linked by way of others, only some of their links."""
    mixed = rows.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("size") / BLOCK_UNITS)).cast("int").alias("blocks")).where("low != high")
    met = rows.join(mixed.select("band", "blocks"), "band").withColumn("block", F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "root")
    met = met.join(held, "key").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return settled(met.select("band", "i", "j", "block", "key", "root", "bands", "signature", "units").mapInArrow(_linked, "a long, b long"))


def text_mark(text: str):
    """Tells apart the texts of rows that share an id (64 bits for the texts of one id)."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def classified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, class_key, class_id) for each row: mark tells the texts of one id
    apart, class_key the classes, class_id is the least id of the class."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("mark", text_mark("text"))
    every = settled(signed(docs))
    texts = settled(every.groupBy("key").agg(F.min("id").alias("first"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("signature").alias("signature")))
    rows = settled(buckets(texts))
    shared = texts.join(rows.select("key").distinct(), "key")
    held = settled(unit_sets(shared.select("key", "first"), docs).join(texts.select("key", "bands", "signature"), "key"))
    links = central_links(rows, held)
    roots = settled(components(links))
    rooted = rows.join(roots.withColumnRenamed("node", "key"), "key", "left").select("band", "key", "size", F.coalesce("root", "key").alias("root"))
    more = crossing_links(rooted, held)
    if not more.isEmpty():
        roots = settled(components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))))
    named = texts.select("key", "first").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = named.groupBy("root").agg(F.min("first").alias("class_id"))
    named = named.join(dealt_anew(least, "root"), "root").select("key", "root", "class_id")
    return every.select("id", "mark", "key").join(named, "key").select(F.col("id").alias(id_col), "mark", F.col("root").alias("class_key"), "class_id")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id) for each row; class_id is the least id of the class."""
    return classified(docs, id_col, text_col).select(id_col, "class_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class: that with the least id (of several texts of
    that id, one; of repeated rows, one). Rows without an id stay."""
    id_, mark = unused(docs, "id_"), unused(docs, "mark_")
    kept = settled(classified(docs, id_col, text_col).select(F.col(id_col).alias(id_), F.col("mark").alias(mark), "class_key").where(F.col(id_).isNotNull()))
    first = kept.groupBy("class_key").agg(F.min(F.struct(id_, mark)).alias("first"))
    gone = kept.join(dealt_anew(first, "class_key"), "class_key").where(F.struct(id_, mark) != F.col("first"))
    drop = settled(gone.select(id_, mark).distinct())
    marked = docs.withColumn(mark, text_mark(text_col))
    same = (F.col(id_col) == F.col(id_)) & (marked[mark] == drop[mark])
    out = marked.join(F.broadcast(drop) if drop.count() <= BROADCAST_IDS else drop, same, "left_anti")
    if not kept.groupBy(id_, mark).count().where("count > 1").isEmpty():
        out = out.where(F.col(id_col).isNotNull()).dropDuplicates([id_col, mark]).unionByName(out.where(F.col(id_col).isNull()))
    return out.select(docs.columns)
