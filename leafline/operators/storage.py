"""Where operators in several rounds keep what they have made so far."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode,
    where every folder is shared, the warehouse serves if that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return folder.rstrip("/")


class Rounds:
    """Tables written between the rounds of an operator. A table ends the lineage of
    what follows, so a lost executor repeats one round at most. ``drop`` removes the
    tables that a later one has replaced."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}", {}

    def kept(self, rows: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.paths)}"
        rows.write.parquet(path)
        table = self.spark.read.schema(rows.schema).parquet(path)
        self.paths[id(table)] = (path, table)
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Deletes the files of tables that nothing will read any more."""
        for table in tables:
            if id(table) in self.paths:
                where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.paths[id(table)][0])
                where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
