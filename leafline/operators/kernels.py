"""Rows for the kernels in tasks: a batch is taken apart row by row and results leave in
pieces of bounded size, so a worker holds one row's texts, never those of a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Bounds of a batch on its way to a worker, and of a piece on its way back.
ROWS, BYTES = 500, 32 << 20
PIECE_ROWS, PIECE_CHARS = 20_000, 8 << 20


def _value(scalar: pa.Scalar):
    if isinstance(scalar, pa.ListScalar) and scalar.is_valid and pa.types.is_string(scalar.type.value_type):
        return scalar.values.to_numpy(zero_copy_only=False).tolist()
    return scalar.as_py()


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield tuple(_value(column[k]) for column in batch.columns)


def in_pieces(rows: Iterator[tuple], schema: pa.Schema, most: int = PIECE_ROWS, chars: int = PIECE_CHARS) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    texts = [k for k, f in enumerate(schema) if pa.types.is_string(f.type)]

    def piece():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        size += sum(len(row[k] or "") for k in texts)
        if len(held) >= most or size >= chars:
            yield piece()
            held, size = [], 0
    if held:
        yield piece()


def put_together(parts: Iterator[pa.RecordBatch], most: int = PIECE_ROWS, chars: int = PIECE_CHARS) -> Iterator[pa.RecordBatch]:
    """The rows of parts in pieces of as many rows, and bytes of text, at most (a longer row
    is one piece): small parts are put together, large ones are cut."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for part in parts:
        texts = [pc.fill_null(pc.binary_length(c), 0).to_numpy().astype(np.int64) for c in part.columns if pa.types.is_string(c.type)]
        ends = np.cumsum(sum(texts, np.zeros(part.num_rows, np.int64)))
        start = before = 0
        while start < part.num_rows:
            end = min(start + most - rows, int(np.searchsorted(ends, before + chars - size, side="right")))
            if end <= start and not held:
                end = start + 1
            if end > start:
                held.append(part.slice(start, end - start))
                rows, size, before, start = rows + end - start, size + int(ends[end - 1]) - before, int(ends[end - 1]), end
            if start < part.num_rows:
                yield pa.concat_batches(held)
                held, rows, size = [], 0, 0
    if held:
        yield pa.concat_batches(held)


def bounded(frame: DataFrame) -> DataFrame:
    """frame, with the session's batches bounded on their way to workers."""
    frame.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)
    frame.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)
    return frame


def by_row(frame: DataFrame, kernel: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """``kernel`` gets the columns of each row of frame and yields rows of the schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    bounded(frame)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        yield from in_pieces((out for row in rows_of(batches) for out in kernel(*row)), arrow)

    return frame.mapInArrow(run, schema)


def by_arrays(frame: DataFrame, kernel: Callable[..., Iterator[list]], schema: str) -> DataFrame:
    """``kernel`` gets the columns of each row of frame as Arrow's scalars and yields lists of
    columns of the schema, for all rows of a part at once."""
    from pyspark.sql.pandas.types import to_arrow_schema

    bounded(frame)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def parts(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                for columns in kernel(*(column[k] for column in batch.columns)):
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return frame.mapInArrow(lambda batches: put_together(parts(batches)), schema)
