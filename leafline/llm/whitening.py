"""Embedding whitening by matrix-free block Lanczos with full reorthogonalisation.

The covariance matrix V of the distinct vectors is never formed. A distributed pass
multiplies it with a block of columns: each task adds up y (y'B) over its vectors,
where y is a vector less the mean, and Spark adds up what tasks send (dimension x
block numbers each). The block Lanczos recurrence runs on the driver: the next block
is what V makes of the last one, orthogonalised twice against the whole basis; a
direction that vanishes there (a breakdown, so the basis holds an invariant space) is
replaced by a fresh random one, which starts the recurrence again beside it. After
each pass the basis's Rayleigh quotient gives Ritz pairs, and the run ends when the
residual |Vz - ez| of every wanted pair is below ``TOLERANCE`` of the largest
eigenvalue, or the basis spans the space.

Centring is exact: sums are whole numbers, and a vector less the mean is a small
whole number (x less the floor of the mean) less a fraction below one. The trace of V,
for the explained shares, comes from exact deviations. The driver holds the basis,
dimension x (components + some blocks), never vectors.

Defined cases: null or empty vectors and those with null or non-finite entries are left
out, and so are those whose length is not the commonest (the greater one of two) or
whose whole numbers pass 2**40 either way. Repeated rows and ids are rows each, and
count once in the fit list if their whole numbers agree. A component whose eigenvalue
is no more than rounding (``NOTHING`` of the largest) has no whitening and is left out:
a fit list of one vector gives no rows. Fewer dimensions than components: as many
components as there are dimensions. A deviation that a long cannot hold is null. The
sign of a component makes its entry of largest magnitude positive.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
BLOCK, TOLERANCE, NOTHING = 16, 1e-14, 1e-13
LIMIT = float(1 << 40)
WHOLE = "decimal(38,0)"
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _kept(table: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """id and v (whole numbers) of the rows that remain, and their dimension."""
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < LIMIT / SCALE))
    rows = table.where(F.col(vector_col).isNotNull()).where((F.size(vector_col) > 0) & fine)
    v = F.transform(vector_col, lambda x: F.floor(x.cast("double") * SCALE) + SHIFT)
    rows = settled(rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(vector_col).alias("dim")))
    top = rows.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = top["dim"] if top else 0
    return rows.where(F.col("dim") == dim).select("id", "v"), dim


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _added(parts: DataFrame, size: int) -> np.ndarray:
    """Sums over tasks of arrays of ``size`` doubles."""
    row = parts.select(F.posexplode("part").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(size)
    for r in row:
        out[r["at"]] = r["x"]
    return out


class Centred:
    """The distinct vectors, their exact sums, and products with their covariance matrix."""

    def __init__(self, fit: DataFrame, dim: int):
        self.fit, self.dim = fit, dim
        sums = fit.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("v")[i].cast("decimal(18,0)")).cast(WHOLE).alias(f"s{i}") for i in range(dim))).first()
        self.n = sums["n"]
        self.sums = [int(sums[f"s{i}"] or 0) for i in range(dim)]
        self.floor = np.array([s // self.n for s in self.sums], dtype=np.int64) if self.n else np.zeros(dim, np.int64)
        self.rest = np.array([(s % self.n) / self.n for s in self.sums]) if self.n else np.zeros(dim)

    def centre(self, x: np.ndarray) -> np.ndarray:
        return (x - self.floor).astype(np.float64) - self.rest

    def _pass(self, of, size: int) -> np.ndarray:
        """The sum over all vectors of ``of(centred matrix)``."""
        dim, floor, rest = self.dim, self.floor, self.rest

        def run(batches):
            total = np.zeros(size)
            for batch in batches:
                y = (_matrix(batch.column("v"), dim) - floor).astype(np.float64) - rest
                total += of(y).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([total])], ["part"])

        return _added(self.fit.mapInArrow(run, "part array<double>"), size)

    def times(self, block: np.ndarray) -> np.ndarray:
        """V times a block of columns."""
        return self._pass(lambda y: y.T @ (y @ block), block.size).reshape(block.shape) / self.n

    def trace(self) -> float:
        """The sum of squared deviations of the fit list over n."""
        return float(self._pass(lambda y: np.array([(y * y).sum()]), 1)[0]) / self.n

    def covariance(self, weights: np.ndarray) -> np.ndarray:
        """The covariance of y'weights, centred before multiplying."""
        m = weights.shape[1]
        mean = self._pass(lambda y: (y @ weights).sum(0), m) / self.n

        def of(y):
            z = y @ weights - mean
            return z.T @ z

        return self._pass(of, m * m).reshape(m, m) / self.n


def _orthonormal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator, scale: float) -> np.ndarray:
    """Columns orthonormal to the basis and each other. One that vanishes is replaced
    by a random direction, as long as the space has any left."""
    out = basis
    for column in block.T:
        if out.shape[1] == len(column):
            break
        was = max(np.linalg.norm(column), scale)
        for tries in range(20):
            for _ in range(2):
                column = column - out @ (out.T @ column)
            if np.linalg.norm(column) > 1e-10 * was:
                column = column / np.linalg.norm(column)
                column = column - out @ (out.T @ column)
                out = np.column_stack([out, column / np.linalg.norm(column)])
                break
            column = rng.standard_normal(len(column))  # breakdown: start again beside the space found
            was = np.linalg.norm(column)
    return out[:, basis.shape[1] :]


def lanczos(times, dim: int, wanted: int, block: int = BLOCK, tolerance: float = TOLERANCE, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues (falling) and unit eigenvectors (columns) of
    the symmetric matrix that ``times(block)`` multiplies with."""
    wanted, rng = min(wanted, dim), np.random.default_rng(seed)
    basis = image = np.zeros((dim, 0))
    fresh = _orthonormal(rng.standard_normal((dim, min(block, dim))), basis, rng, 0.0)
    scale = 0.0
    while True:
        made = times(fresh)
        basis, image = np.column_stack([basis, fresh]), np.column_stack([image, made])
        small = basis.T @ image
        values, inner = np.linalg.eigh((small + small.T) / 2)
        values, inner = values[::-1], inner[:, ::-1]
        scale = max(float(np.abs(values).max()), 0.0)
        vectors = basis @ inner[:, :wanted]
        residual = np.linalg.norm(image @ inner[:, :wanted] - vectors * values[:wanted], axis=0)
        if basis.shape[1] == dim or (basis.shape[1] >= wanted and (residual <= tolerance * scale).all()):
            return values[:wanted], vectors / np.linalg.norm(vectors, axis=0)
        fresh = _orthonormal(made, basis, rng, scale)


def _digest(model: Centred, weights: np.ndarray, components: list[int]):
    dim, n, sums, floor, rest = model.dim, model.n, model.sums, model.floor, model.rest
    most = float(n) * 2 * LIMIT

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("v"), dim)
            off = x - floor
            near = np.abs(off).max(initial=0) + 1
            if n * near < 2**31 and n * near * n * near * dim < 2**62 and most < 2**62:
                apart = n * off - np.array([s % n for s in sums], dtype=np.int64)
                deviation = [int(d) for d in (apart * apart).sum(1)]
            else:
                apart = n * off.astype(object) - np.array([s % n for s in sums], dtype=object)
                deviation = [int(d) if d < 2**63 else None for d in (apart * apart).sum(1)]
            white = (off.astype(np.float64) - rest) @ weights
            m = len(components)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(np.repeat(np.arange(len(x)), m))), pa.array(np.tile(np.array(components, np.int32), len(x))), pa.array([d for d in deviation for _ in range(m)], pa.int64()), pa.array(white.ravel())], ["vec_id", "component", "deviation", "whitened"])

    return run


def whitened(table: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every
    remaining row and component."""
    spark: SparkSession = table.sparkSession
    rows, dim = _kept(table, id_col, vector_col)
    if not dim:
        return spark.createDataFrame([], OUT)
    model = Centred(settled(rows.select("v").distinct()), dim)
    values, vectors = lanczos(model.times, dim, components)
    real = values > NOTHING * max(float(values[0]), 0.0)
    if not real.any():
        return spark.createDataFrame([], OUT)
    values, vectors = values[real], vectors[:, real]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    weights = vectors / np.sqrt(values)
    error = float(np.abs(model.covariance(weights) - np.eye(len(values))).max())
    explained = values / model.trace()
    numbers = list(range(1, len(values) + 1))
    found = rows.mapInArrow(_digest(model, weights, numbers), "vec_id long, component int, deviation long, whitened double")
    share = F.create_map(*(x for i, e in zip(numbers, explained, strict=True) for x in (F.lit(i), F.lit(float(e)))))
    return found.select("vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", share[F.col("component")].alias("explained"), F.lit(error).alias("identity_error"))
