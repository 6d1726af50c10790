"""Helpers shared by the operators of this subpackage.

Python kernels get Arrow batches and cut them into pieces of at most
``CHUNK_CHARS`` code points (one longer text makes a piece of its own), so
memory does not depend on how many rows Spark puts in a batch.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_CHARS = 1 << 19
#: Rows and bytes of an Arrow batch; one longer text makes a batch of its own.
BATCH_ROWS, BATCH_BYTES = 500, 32 << 20
U64 = np.uint64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local
    mode, where every folder is shared, the warehouse serves if that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return folder


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def settled(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends
    there, so a lost executor never repeats what came before. The tables stay
    until whoever owns the folder clears it."""
    spark = df.sparkSession
    path = fresh_path(spark, "settled")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that the kernels get, in rows and bytes. The
    session keeps the setting, as plans read it when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def held_out(doc_id, folds: int = 5):
    """The fold that no model may learn from: crc32(doc_id as text) mod 5 = 0."""
    return fold_of(doc_id, folds) == 0


def fold_of(doc_id, folds: int = 5):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))


def chunks(texts: list, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges whose texts have at most ``limit`` characters together."""
    begin, total = 0, 0
    for i, t in enumerate(texts):
        if i > begin and total + len(t) > limit:
            yield begin, i
            begin, total = i, 0
        total += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def code_points(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The joined text, its code points and where each text starts (one more
    entry at the end)."""
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)), out=starts[1:])
    return joined, points, starts


_TABLES: dict[str, np.ndarray] = {}


def class_table(name: str, build) -> np.ndarray:
    """A value for each code point, built once in a worker by ``build(chr)``."""
    if name not in _TABLES:
        _TABLES[name] = np.fromiter((build(chr(i)) for i in range(0x110000)), dtype=np.uint8, count=0x110000)
    return _TABLES[name]


def word_table() -> np.ndarray:
    return class_table("word", str.isalnum)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK_CHARS + 1)
        up, down = np.full(size, _BASE, dtype=U64), np.full(size, pow(_BASE, -1, 1 << 64), dtype=U64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            _POWERS["up"], _POWERS["down"] = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def span_hashes(points: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of code points, from prefix sums of a polynomial
    over scrambled characters; equal spans have equal hashes anywhere."""
    n = len(points)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, dtype=U64)
    with np.errstate(over="ignore"):
        np.cumsum(mix(points.astype(U64) + U64(1)) * up[:n], dtype=U64, out=sums[1:])
        return mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(U64))


def word_spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of letters and digits, lower case): hash, index of the text,
    begin and end. Lowering is applied first, so offsets are those of
    ``text.lower()``."""
    _, points, starts = code_points([t.lower() for t in texts])
    inside = np.zeros(len(points) + 1, dtype=bool)
    inside[:-1] = word_table()[points] > 0
    before = np.zeros(len(points) + 1, dtype=bool)
    before[1:] = inside[:-1]
    edge = np.zeros(len(points) + 1, dtype=bool)
    edge[starts] = True
    begins = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    return span_hashes(points, begins, ends), np.searchsorted(starts, begins, side="right") - 1, begins, ends


def tokenizer_path(name: str) -> str:
    """A tokenizer file by name; a path is taken as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
