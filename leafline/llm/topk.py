"""Exact top-k inner products by distributed histogram selection.

Components become integers. Every query is scored against every other row, block
by block; each pass counts, per query, how many scores fall into the bins of the
interval that holds its k-th value, and the counts of all blocks together narrow
that interval until it is one integer wide. A last pass keeps scores at or above
the k-th value, and a rank by score and id breaks ties.

A block reports at most its own k best scores of the interval, since no others
can decide; so a pass moves at most k rows per query and block. Queries are
packed into blocks too and copied to each group of candidate blocks.

Defined cases: null vectors, and vectors with null or non-finite components (or such
of 1e300 and more), take no part, neither do empty ones; vectors are compared only with those of equal
length; a query meets no row of its own id; equal query rows count once; fewer
than k candidates: all are returned. Scores are exact over the whole range of longs:
as doubles where no score of two blocks can pass 2**53, else in whole numbers of any
size (slow, for vectors with components in the thousands and more). A score beyond
2**63 - 1 either way, which no long can hold, counts as that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

SCALE = 256
BINS = 4096
WIDE = "decimal(20,0)"
QUERY_ROWS, CANDIDATE_ROWS = 512, 4096
#: The largest long, either way.
LIMIT = (1 << 63) - 1
#: Below all scores: marks a pair that takes no part.
NONE = np.iinfo(np.int64).min
#: Groups of candidate blocks: one for so many blocks, between these bounds.
BLOCKS, LEAST_GROUPS, MOST_GROUPS = 16, 16, 8192


def quantised(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (whole numbers as doubles) and dim of the rows that take part."""
    x = F.transform(vector_col, lambda x: x.cast("double") * SCALE)
    v = F.transform(x, lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x))  # larger doubles are whole
    sound = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < 1e300))
    rows = table.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where((F.size(vector_col) > 0) & sound)
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(vector_col).alias("dim"))


def _packed(rows: DataFrame, most: int, extra: list[str]) -> DataFrame:
    """Blocks of at most ``most`` rows of one length: dim, n and arrays as bytes."""
    names = ["id", "v", *extra]

    def run(batches):
        held: dict[int, list] = {}

        def block(dim: int, parts: list):
            ids, v, *more = (np.concatenate([p[i] for p in parts]) for i in range(len(names)))
            order = np.argsort(ids, kind="stable")
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), *(pa.array([x[order].tobytes()], pa.binary()) for x in (ids, v, *more))], ["dim", "n", *names])

        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                for at in range(0, own.num_rows, most):
                    some = own.slice(at, most)
                    part = [some.column("id").to_numpy(zero_copy_only=False), some.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)]
                    part += [some.column(c).to_numpy(zero_copy_only=False) for c in extra]
                    parts = held.setdefault(dim, [])
                    if parts and sum(len(p[0]) for p in parts) + len(part[0]) > most:
                        yield block(dim, held.pop(dim))
                        held[dim] = parts = []
                    parts.append(part)
        for dim, parts in held.items():
            if parts:
                yield block(dim, parts)

    return rows.select("dim", *names).mapInArrow(run, "dim int, n int, " + ", ".join(f"{c} binary" for c in names))


def _scores(row: dict, extra: list[str]):
    """ids and extras of the queries, ids of the candidates, scores as whole
    numbers, and where a candidate is the query's own row."""
    dim = row["dim"]
    own, ids = np.frombuffer(row["qid"], np.int64), np.frombuffer(row["cid"], np.int64)
    queries, candidates = (np.frombuffer(row[c], np.float64).reshape(-1, dim) for c in ("qv", "cv"))
    if dim * float(np.abs(queries).max()) * float(np.abs(candidates).max()) < 2.0**53:
        score = (queries @ candidates.T).astype(np.int64)
    else:
        whole = [np.array([[int(x) for x in v] for v in m], dtype=object) for m in (queries, candidates)]
        score = np.clip(whole[0] @ whole[1].T, -LIMIT, LIMIT).astype(np.int64)
    return own, [np.frombuffer(row[f"q{c}"], np.int64) for c in extra], ids, score, own[:, None] == ids[None, :]


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names)}


def _histogram(k: int):
    def run(batches):
        for row in _rows(batches):
            own, (low, width), ids, score, same = _scores(row, ["low", "width"])
            # differences of longs, in 64 bits without a sign
            last = np.array([min(int(w) * BINS, 1 << 64) - 1 for w in width], np.uint64)
            offset = score.view(np.uint64) - low.view(np.uint64)[:, None]
            score[same | (score < low[:, None]) | (offset > last[:, None])] = NONE
            if score.shape[1] > k:
                score = np.partition(score, score.shape[1] - k, axis=1)[:, -k:]
            q, _ = at = np.nonzero(score != NONE)
            bins = ((score[at].view(np.uint64) - low[q].view(np.uint64)) // width[q].astype(np.uint64)).astype(np.int64)
            found, count = np.unique(q * BINS + bins, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own[found // BINS]), pa.array(np.full(len(found), row["dim"]), pa.int32()), pa.array((found % BINS).astype(np.int32)), pa.array(count, pa.int64())], ["id", "dim", "bin", "n"])

    return run


def _keep(k: int):
    def run(batches):
        for row in _rows(batches):
            own, (low,), ids, score, same = _scores(row, ["low"])
            q, c = np.nonzero((score >= low[:, None]) & ~same)
            s = score[q, c]
            order = np.lexsort((c, -s, q))  # candidates of a block are sorted by id
            q, c, s = q[order], c[order], s[order]
            first = np.searchsorted(q, np.arange(len(own)))
            best = np.arange(len(q)) - first[q] < k
            q, c, s = q[best], c[best], s[best]
            yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(np.full(len(q), row["dim"]), pa.int32()), pa.array(ids[c]), pa.array(s)], ["id", "dim", "cid", "score"])

    return run


def top_k(table: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries its k best rows of table."""
    rows = settled(quantised(table, id_col, vector_col))
    asked = settled(quantised(queries, id_col, vector_col).distinct())
    top = rows.agg(F.max(F.array_max(F.transform("v", F.abs)) * F.lit(1.0)), F.max("dim"), F.count("*")).first()
    groups = min(MOST_GROUPS, max(LEAST_GROUPS, top[2] // (BLOCKS * CANDIDATE_ROWS)))
    blocks = _packed(rows, CANDIDATE_ROWS, [])
    blocks = settled(blocks.select(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("long").alias("g"), "dim", *(F.col(c).alias(f"c{c}") for c in ("id", "v"))))
    reach = min(LIMIT, int(top[0] or 0) ** 2 * (top[1] or 0) + 1)
    width = 1  # a power of BINS, so that the bins of a pass fill one bin of the pass before
    while width * BINS < 2 * reach + 1:
        width *= BINS
    state = asked.select("id", "dim", "v", F.lit(-reach).cast("long").alias("low"), F.lit(width).cast("long").alias("width"), F.lit(0).cast("long").alias("above"))

    def against(state: DataFrame, extra: list[str], run, schema: str) -> DataFrame:
        packed = _packed(state, QUERY_ROWS, extra)
        packed = packed.select("dim", *(F.col(c).alias(f"q{c}") for c in ("id", "v", *extra)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"))
        both = blocks.join(packed, ["g", "dim"])
        return both.select("dim", "cid", "cv", *(f"q{c}" for c in ("id", "v", *extra))).mapInArrow(run, schema)

    key = ["id", "dim"]
    while True:
        counts = against(state, ["low", "width"], _histogram(k), "id long, dim int, bin int, n long").groupBy(*key, "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy(*key).orderBy(F.col("bin").desc())
        reached = counts.join(state.select(*key, "above"), key).withColumn("until", F.sum("n").over(down) + F.col("above"))
        holds = reached.where(F.col("until") >= k).groupBy(*key).agg(F.max(F.struct("bin", (F.col("until") - F.col("n")).alias("over"))).alias("x"))
        # fewer than k scores: everything down to the interval's end belongs to the result
        state = state.join(holds, key, "left").select("id", "dim", "v", F.when(F.col("x").isNull(), F.col("low")).otherwise((F.col("low").cast(WIDE) + F.col("x.bin").cast(WIDE) * F.col("width").cast(WIDE)).cast("long")).alias("low"), F.coalesce("x.over", "above").alias("above"))
        state = settled(state.withColumn("width", F.lit(max(1, width // BINS)).cast("long")))
        if width == 1:
            break
        width //= BINS
    kept = against(state, ["low"], _keep(k), "id long, dim int, cid long, score long")
    best = Window.partitionBy(*key).orderBy(F.col("score").desc(), "cid")
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias("query_id"), F.col("rank").cast("int"), F.col("cid").alias("vec_id"), "score")
