"""The corpus pipeline: quality, near-duplicates, contamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the
last return the columns of documents. Filtering stages drop rows: those that the
quality classifier rejects, all but one of each near-duplicate class, and those
that hold benchmark items. The stage on personal data rewrites texts (and n_chars).
The last one returns token ids with their byte offsets and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafline.llm import bpe_codec, decontam, near_dedup, pii, quality
from leafline.llm.common import read_table, settled


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitised(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_codec.encode(docs)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", sanitise),
    ("bpe", tokenise),
]
#: Neither the classifier nor the tokenizer can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
