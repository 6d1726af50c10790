"""Sinks: nested results of documents, listings and rejects, as files of Spark's writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nested(candidates: DataFrame, keys: list[str], field: str, values: list[str]) -> DataFrame:
    """One row a document: ``fields`` maps each field to its value and evidence.
    Candidates hold one row a document and field, as ``best`` leaves them; fields
    stand in the order of their names."""
    entry = F.struct(F.col(field).alias("field"), F.struct(*values).alias("found"))
    rows = candidates.where(F.col(field).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_entries"))
    return rows.withColumn("fields", F.map_from_entries("_entries")).drop("_entries")


def write_json(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, nulls kept, so that each field is present in every document."""
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; quotes and line ends inside values survive reading back."""
    rows.write.mode(mode).option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)


def read_csv(spark, path: str, schema) -> DataFrame:
    """Files of ``write_csv`` or catalogs of that form (line ends inside quotes)."""
    return spark.read.schema(schema).option("header", "true").option("escape", '"').option("multiLine", "true").csv(path)


#: Bands of a page from the top down. Fixed values.
BANDS = ("header", "subheader", "title", "body", "footer")


def write_bands(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """rows(file, page, band, text) as a folder of JSON lines a file: pages in order, and the
    text of each page's bands from the top down; bands of other names come last, by name."""
    rank = F.coalesce(*(F.when(F.col("band") == b, i) for i, b in enumerate(BANDS)), F.lit(len(BANDS)))
    held = F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "band", "text")))
    pages = rows.groupBy("file", "page").agg(held.alias("b"))
    pages = pages.select("file", "page", F.array_join(F.transform("b", lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("page_text"), F.transform("b", lambda x: F.struct(x["band"].alias("band"), x["text"].alias("text"))).alias("bands"))
    pages.repartition("file").sortWithinPartitions("file", "page").write.mode(mode).partitionBy("file").option("ignoreNullFields", "false").json(path)
