"""Centroid clustering by Lloyd's rounds with annulus search.

Vectors are whole numbers. In each round centroids are sorted by norm. A vector takes
the centroid whose norm is nearest its own (found by binary search); the distance to
it is an upper bound u, and a centroid can only be as near if its norm lies within u
of the vector's own: the annulus. A binary search for both its edges gives a range of
centroids, and all of them are compared by exact squared distance, those on the edge
too; ties go to the smaller number. The edges are widened by the rounding of the
square roots, so the range never leaves out a centroid, and results equal those of a
full comparison.

A round is one pass over packed blocks: each task sends, per centroid it met, a count
and the sums of its vectors, which Spark adds up; the driver holds the centroids (as
many as ``k``), never vectors. Sums are added as decimals of 38 digits, so they are
exact.

Defined cases: null vectors, vectors of another length and those with null or
non-finite components are left out; rows without an id take part (their hash sorts
last). Rows that share an id, or whole rows, take part each; equal hashes are started
from in the order of their vectors. Fewer rows than centroids: as many centroids as
rows; none: an empty result. Components from 2**26 on either way are computed with
Python's whole numbers (slow), and a distance or sum of distances beyond what a long
holds is given as the largest long; assignments stay exact. Vectors with a whole number
of 2**45 or more either way are left out. An empty centroid stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled

SCALE, SEED = 1024, 3
BLOCK_ROWS = 4096
LARGEST = (1 << 63) - 1
#: Up to here squared distances of a few thousand components fit a long.
NARROW = 1 << 26
LIMIT = float(1 << 45)
WHOLE = "decimal(38,0)"


def quantised(table: DataFrame, dim: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and v (whole numbers) of the vectors that are kept."""
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < LIMIT / SCALE))
    rows = table.where(F.col(vector_col).isNotNull()).where((F.size(vector_col) == dim) & fine)
    v = F.transform(vector_col, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def starts(rows: DataFrame, k: int, seed: int = SEED) -> list[list[int]]:
    """The k vectors of smallest sha256 of ``seed:id``, in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    return [[int(x) for x in r.v] for r in rows.select(h.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()]


def _whole(v: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and centroids as longs, or as Python's whole numbers where squares might not fit."""
    most = max(float(np.abs(v).max(initial=0)), float(max((abs(x) for c in centroids for x in c), default=0)))
    if 4 * most * most * v.shape[1] < 2.0**62 and most < NARROW:
        return v.astype(np.int64), np.array(centroids, dtype=np.int64)
    return np.array([[int(x) for x in row] for row in v], dtype=object).reshape(v.shape), np.array(centroids, dtype=object)


def assigned(v: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid and squared distance of each vector."""
    v, c = _whole(v, centroids)
    norm = np.sqrt((c * c).sum(1).astype(np.float64))
    by = np.lexsort((np.arange(len(c)), norm))
    ring = norm[by]
    own = np.sqrt((v * v).sum(1).astype(np.float64))
    # the centroid of nearest norm bounds the distance
    right = np.searchsorted(ring, own).clip(0, len(c) - 1)
    left = (right - 1).clip(0)
    guess = np.where(np.abs(ring[left] - own) <= np.abs(ring[right] - own), left, right)
    apart = v - c[by[guess]]
    cluster, distance = by[guess].astype(np.int64), (apart * apart).sum(1)
    bound = np.sqrt(distance.astype(np.float64))
    slack = 1e-9 * (own + bound + ring[-1]) + 1e-9
    low, high = np.searchsorted(ring, own - bound - slack, side="left"), np.searchsorted(ring, own + bound + slack, side="right")
    for place, number in enumerate(by):
        some = np.flatnonzero((low <= place) & (place < high) & (guess != place))
        apart = v[some] - c[number]
        d = (apart * apart).sum(1)
        better = (d < distance[some]) | ((d == distance[some]) & (number < cluster[some]))
        some, d = some[better], d[better]
        cluster[some], distance[some] = number, d
    return cluster, distance


def _matrices(batches, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            some = batch.slice(at, BLOCK_ROWS)
            yield some, some.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _sums(centroids: list[list[int]], dim: int):
    """Per task and centroid: count, sums of components, sum of distances."""

    def run(batches):
        n, total, inertia = [0] * len(centroids), [[0] * dim for _ in centroids], [0] * len(centroids)
        for _, v in _matrices(batches, dim):
            cluster, distance = assigned(v, centroids)
            whole = _whole(v, centroids)[0]
            for i in np.unique(cluster).tolist():
                own = cluster == i
                n[i] += int(own.sum())
                inertia[i] += int(distance[own].astype(object).sum())
                # a block's sums of longs fit a long, whatever the number of blocks
                total[i] = [a + int(b) for a, b in zip(total[i], whole[own].sum(0), strict=True)]
        met = [i for i in range(len(centroids)) if n[i]]
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array([n[i] for i in met], pa.int64()), pa.array([[Decimal(x) for x in total[i]] for i in met], pa.list_(pa.decimal128(38, 0))), pa.array([Decimal(inertia[i]) for i in met], pa.decimal128(38, 0))], ["cluster", "n", "total", "inertia"])

    return run


def _gathered(rows: DataFrame, centroids: list[list[int]], dim: int) -> dict[int, tuple[int, list[int], int]]:
    """cluster -> (count, sums, sum of distances): at most one row for each centroid."""
    parts = rows.select("v").mapInArrow(_sums(centroids, dim), f"cluster int, n long, total array<{WHOLE}>, inertia {WHOLE}")
    # count and inertia travel behind the components: one kind of row, one sum
    each = parts.select("cluster", F.posexplode(F.concat("total", F.array(F.col("n").cast(WHOLE), F.col("inertia")))).alias("at", "x"))
    found: dict[int, dict[int, int]] = {}
    for r in each.groupBy("cluster", "at").agg(F.sum("x").alias("x")).collect():
        found.setdefault(r.cluster, {})[r["at"]] = int(r.x)
    return {i: (s[dim], [s[j] for j in range(dim)], s[dim + 1]) for i, s in found.items()}


def _labels(centroids: list[list[int]], dim: int):
    def run(batches):
        for batch, v in _matrices(batches, dim):
            cluster, distance = assigned(v, centroids)
            long = np.minimum(distance, LARGEST).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster.astype(np.int32)), pa.array(long)], ["id", "cluster", "distance"])

    return run


def clustered(table: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    rows = settled(quantised(table, dim, id_col, vector_col))
    centroids = starts(rows, k, seed)
    if not centroids:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        sums = _gathered(rows, centroids, dim)
        moved = [[t // sums[i][0] for t in sums[i][1]] if i in sums else c for i, c in enumerate(centroids)]
        if moved == centroids:  # every further round would leave them as they are
            break
        centroids = moved
    sums = _gathered(rows, centroids, dim)
    of = {i: min(s[2], LARGEST) for i, s in sums.items()}
    digest = {i: hashlib.sha256(",".join(map(str, centroids[i])).encode()).hexdigest() for i in sums}
    pick = lambda values, kind: F.create_map(*(x for i, v in sorted(values.items()) for x in (F.lit(i), F.lit(v).cast(kind))))[F.col("cluster")]
    found = rows.mapInArrow(_labels(centroids, dim), "id long, cluster int, distance long")
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", pick(of, "long").alias("cluster_inertia"), F.lit(min(sum(s[2] for s in sums.values()), LARGEST)).cast("long").alias("inertia"), pick(digest, "string").alias("centroid_sha256"))
