"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots: the ``PREFIX`` nearest of
``PIVOTS`` reference vectors, each with its place in that order. Rows are packed into
blocks; a block holds, for every pivot, an inverted file of (row, place), and the
vectors themselves. A query opens the files of its own ``SEARCHED`` nearest pivots in
every block and adds up, per row met there, how much the places agree: the footrule
distance of the two orders (a pivot missing from an order counts as place PREFIX) is
the most there can be less that sum. Each block reranks by exact distance the rows of
the best footrules: a share ``SHARE`` of the block and at least ``LEAST`` rows, with
all that tie with the last of them, and besides every row whose footrule agrees to
``CLOSE`` of what a copy of the query would have, however many those are, so that a
crowd of near copies is compared whole. Blocks report their k nearest, and a rank by
distance and id merges them.

Pivots come from a bounded sample, the ``SAMPLE`` distinct vectors of each length with
the smallest hashes: at most PIVOTS of them, in order of hash, none within ``APART`` of
the sample's median distance to one taken before. So a crowd of near copies gives one
pivot; many equal ones would spend the places of an order on telling the crowd from
all else (recall on a table with such a crowd rose from 0.83 to 0.98). Every row is
indexed. Recall is measured by the tests against brute force (at least 0.9).

Defined cases: rows without an id, with null, empty or zero vectors, or with null or
non-finite components take no part; vectors are compared only with those of equal
length; a query meets no row of its own id; repeated rows are candidates of their own;
equal query rows count once, different vectors of one id are queries of their own with
one query_id; fewer than k candidates: all that are found. Columns besides the two
named are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settled
from .topk import _packed, _rows

PIVOTS, PREFIX, SEARCHED = 256, 128, 64
SAMPLE, APART = 2048, 0.6
SHARE, LEAST, CLOSE = 0.1, 512, 0.7
BLOCK_ROWS, QUERY_ROWS = 4096, 512
#: Groups of blocks: one for so many blocks, between these bounds. Queries are copied to each.
BLOCKS, LEAST_GROUPS, MOST_GROUPS = 16, 16, 8192


def sound(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (doubles) and dim of the rows that take part."""
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = table.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where((F.size(vector_col) > 0) & fine)
    rows = rows.where(F.exists(vector_col, lambda x: x != 0))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.size(vector_col).alias("dim"))


def pivots(rows: DataFrame, most: int = PIVOTS, sample: int = SAMPLE, apart: float = APART) -> dict[int, np.ndarray]:
    """For each length of vectors at most ``most`` of a sample of distinct ones, spread out."""
    found = {}
    for (dim,) in rows.select("dim").distinct().collect():
        # grouped before the order: a vector that many rows share must not fill the sample
        drawn = rows.where(F.col("dim") == dim).groupBy("v").agg(F.first(F.xxhash64("v")).alias("h")).orderBy("h", "v").limit(sample).collect()
        found[dim] = spread(np.array([r.v for r in drawn]), most, apart)
    return found


def spread(drawn: np.ndarray, most: int, apart: float) -> np.ndarray:
    """At most ``most`` of the vectors, in their order, none too near one taken before."""
    x = drawn * np.ldexp(1.0, -int(np.frexp(np.abs(drawn).max())[1]))
    norm = (x * x).sum(1)
    gap = np.sqrt(np.maximum(norm[:, None] + norm[None, :] - 2 * (x @ x.T), 0))
    least, free, taken = apart * np.median(gap), np.ones(len(x), bool), []
    while len(taken) < most and free.any():
        taken.append(int(free.argmax()))
        free &= gap[taken[-1]] >= least
        free[taken[-1]] = False
    return drawn[taken]


def nearest_pivots(vectors: np.ndarray, reference: np.ndarray, most: int) -> np.ndarray:
    """Numbers of the nearest reference vectors, nearest first, ties to the smaller number.
    Both sides are scaled by one power of two, so no square overflows."""
    scale = np.ldexp(1.0, -int(np.frexp(max(np.abs(vectors).max(), np.abs(reference).max()))[1]))
    x, r = vectors * scale, reference * scale
    apart = (r * r).sum(1)[None, :] - 2 * (x @ r.T)
    return np.argsort(apart, axis=1, kind="stable")[:, :most]


def _indexed(reference: dict[int, np.ndarray], prefix: int):
    """Blocks with their inverted files: starts (a pivot's first posting), rows, places."""

    def run(batches):
        for row in _rows(batches):
            vectors = np.frombuffer(row["v"]).reshape(-1, row["dim"])
            own = reference[row["dim"]]
            order = nearest_pivots(vectors, own, prefix)
            place = np.tile(np.arange(order.shape[1], dtype=np.uint8), len(order))
            by = np.lexsort((place, order.ravel()))
            starts = np.searchsorted(order.ravel()[by], np.arange(len(own) + 1)).astype(np.int32)
            columns = [np.repeat(np.arange(len(order), dtype=np.uint16), order.shape[1])[by], place[by]]
            yield pa.RecordBatch.from_arrays([pa.array([row["dim"]], pa.int32()), *(pa.array([x], pa.binary()) for x in (row["id"], row["v"], starts.tobytes(), columns[0].tobytes(), columns[1].tobytes()))], ["dim", "cid", "cv", "starts", "members", "places"])

    return run


def agreements(order: np.ndarray, starts: np.ndarray, members: np.ndarray, places: np.ndarray, rows: int, prefix: int) -> np.ndarray:
    """For each row of a block: the sum of prefix - |difference of places| over the
    pivots of ``order`` in whose inverted files it is (the footrule's complement)."""
    n = starts[order + 1] - starts[order]
    before = np.cumsum(n) - n
    at = np.repeat(starts[order] - before, n) + np.arange(n.sum())
    agree = prefix - np.abs(places[at].astype(np.int32) - np.repeat(np.arange(len(order)), n))
    return np.bincount(members[at], agree, minlength=rows)


def _searched(reference: dict[int, np.ndarray], k: int, prefix: int, searched: int, share: float, least: int, close: float):
    def run(batches):
        for row in _rows(batches):
            dim = row["dim"]
            own, key = np.frombuffer(row["qid"], np.int64), np.frombuffer(row["qkey"], np.int64)
            asked, vectors = (np.frombuffer(row[c]).reshape(-1, dim) for c in ("qv", "cv"))
            ids, starts = np.frombuffer(row["cid"], np.int64), np.frombuffer(row["starts"], np.int32)
            members, places = np.frombuffer(row["members"], np.uint16), np.frombuffer(row["places"], np.uint8)
            orders = nearest_pivots(asked, reference[dim], searched)
            whole = close * prefix * orders.shape[1]
            most = min(len(ids), max(least, int(share * len(ids))))
            out = []
            for q, order in enumerate(orders):
                agree = agreements(order, starts, members, places, len(ids), prefix)
                last = np.partition(agree, len(ids) - most)[len(ids) - most]
                near = np.flatnonzero((agree >= min(last, whole)) & (ids != own[q]))
                apart = vectors[near] - asked[q]  # beyond the range of doubles: inf
                size = np.abs(apart).max(axis=1, initial=0)
                up = np.where(size > 0, size, 1.0)[:, None]
                with np.errstate(over="ignore", under="ignore"):
                    direct = np.sqrt((apart * apart).sum(1))
                # squares of very large or small differences leave the range of doubles
                score = np.where((size > 1e150) | (size < 1e-140), np.sqrt(((apart / up) ** 2).sum(1)) * up[:, 0], direct) if len(near) else direct
                best = np.lexsort((ids[near], score))[:k]
                out.append((np.full(len(best), q), ids[near][best], score[best]))
            q, c, s = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(key[q]), pa.array(c), pa.array(s)], ["id", "key", "cid", "score"])

    return run


def nearest(table: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", most_pivots: int = PIVOTS, prefix: int = PREFIX, searched: int = SEARCHED, share: float = SHARE, least: int = LEAST, close: float = CLOSE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries the k nearest rows of
    table that the index finds, by Euclidean distance on the vectors as they are."""
    if not 0 < prefix <= 255 or not 0 < searched <= prefix:
        raise ValueError("places must fit a byte, and no more pivots can be searched than are indexed")
    rows = settled(sound(table, id_col, vector_col))
    asked = sound(queries, id_col, vector_col).distinct().withColumn("key", F.xxhash64("v"))
    reference = pivots(rows, most_pivots)
    groups = min(MOST_GROUPS, max(LEAST_GROUPS, rows.count() // (BLOCKS * BLOCK_ROWS)))
    blocks = _packed(rows, BLOCK_ROWS, []).mapInArrow(_indexed(reference, prefix), "dim int, cid binary, cv binary, starts binary, members binary, places binary")
    blocks = settled(blocks.withColumn("g", F.pmod(F.xxhash64("cid"), F.lit(groups)).cast("long")))
    packs = _packed(asked.where(F.col("dim").isin([*reference] or [0])), QUERY_ROWS, ["key"])
    packs = packs.select("dim", *(F.col(c).alias(f"q{c}") for c in ("id", "v", "key")), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"))
    met = blocks.join(packs, ["g", "dim"]).select("dim", "cid", "cv", "starts", "members", "places", "qid", "qv", "qkey")
    found = met.mapInArrow(_searched(reference, k, prefix, searched, share, least, close), "id long, key long, cid long, score double")
    best = Window.partitionBy("id", "key").orderBy("score", "cid")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias("query_id"), F.col("rank").cast("int"), F.col("cid").alias("vec_id"), "score")
