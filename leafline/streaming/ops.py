"""The operators on rows that arrive as files, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.content import line_ops


def file_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files of a folder, each read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def line_op_stream(docs: DataFrame, least_length: int = 2) -> DataFrame:
    """Numbered before the filter, as in batches; no state is kept."""
    return line_ops(docs).where(F.length("text") >= least_length)


def event_windows(events: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts of each key in windows of ``width``; rows later than ``late`` are
    left out, which bounds the state."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n")).select("w.start", "w.end", *keys, "n")


def append_to(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends all that has arrived to a Parquet folder, then stops; a restart
    with the same checkpoint goes on where it ended."""
    return rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
