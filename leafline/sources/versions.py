"""Tables that are changed by key: folders of buckets, and a manifest a version.

A version is a manifest that names, for each bucket of keys, the folder that holds it.
An upsert reads and writes only the buckets that its rows fall into, under a fresh
name, and then creates the next manifest. That is the commit: a file system creates a
file of one name once, so of two writers one fails and nothing of it is seen. Readers
take the last manifest, so they see one version whole, whatever a writer that was
killed has left behind. ``vacuum`` removes folders that no kept manifest names."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
_BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was to make."""


class Versions:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        where = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return where.getFileSystem(self._conf), where

    def numbers(self) -> list[int]:
        """The committed versions, rising."""
        fs, where = self._at("manifests")
        if not fs.exists(where):
            return []
        return sorted(int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(where) if f.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        found = self.numbers()
        if not found:
            return {"version": 0, "schema": None, "keys": None, "folders": {}, "buckets": self.buckets}
        if version is None:
            version = found[-1]
        text = self.spark.read.text(f"{self.path}/manifests/{version:020d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the last, if none is named)."""
        held = self.manifest(version)
        if held["schema"] is None:
            raise ValueError(f"{self.path} has no version")
        return self._rows(held, held["folders"])

    def _rows(self, held: dict, folders: dict) -> DataFrame:
        schema = StructType.fromJson(json.loads(held["schema"]))
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{folder}" for folder in sorted(folders.values())))

    def upsert(self, rows: DataFrame, keys: list[str], order: list[str] | None = None) -> int:
        """Puts rows in place of those of equal keys, and beside the others; returns the
        version made. Of several rows of a key the last by ``order`` counts (any one, if
        none is given). Keys may be null; equal nulls are equal."""
        held = self.manifest()
        if held["keys"] not in (None, keys):
            raise ValueError(f"the table's keys are {held['keys']}")
        n = held["buckets"]
        bucket = F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
        best = [F.col(c).desc() for c in order or []] or [F.lit(1)]
        new = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where("_r = 1").drop("_r")
        schema = rows.schema.json()
        folder = f"data/{held['version'] + 1:020d}-{uuid.uuid4().hex}"
        staged = f"{folder}/new"
        new.withColumn(_BUCKET, bucket).write.partitionBy(_BUCKET).parquet(f"{self.path}/{staged}")
        touched = self._parts(staged)
        was = {b: f for b, f in held["folders"].items() if b in touched}
        if was:
            fresh = self.spark.read.schema(rows.schema).parquet(*(f"{self.path}/{f}" for f in touched.values()))
            old = self._rows(held, was)
            if held["schema"] != schema:
                old = old.select(*(F.col(c).cast(k) if c in old.columns else F.lit(None).cast(k).alias(c) for c, k in rows.dtypes))
            same = [fresh[k].eqNullSafe(old[k]) for k in keys]
            kept = old.join(fresh.select(*keys), same, "left_anti")
            merged = f"{folder}/merged"
            fresh.unionByName(kept).withColumn(_BUCKET, bucket).write.partitionBy(_BUCKET).parquet(f"{self.path}/{merged}")
            touched = self._parts(merged)
        if held["schema"] not in (None, schema):
            missing = set(json.loads(held["schema"])["fields"][i]["name"] for i in range(len(json.loads(held["schema"])["fields"]))) - set(rows.columns)
            if missing:
                raise ValueError(f"rows lack the columns {sorted(missing)}")
        made = {"version": held["version"] + 1, "schema": schema, "keys": keys, "buckets": n, "folders": {**held["folders"], **touched}}
        self._commit(made)
        return made["version"]

    def _parts(self, folder: str) -> dict[str, str]:
        fs, where = self._at(folder)
        names = [f.getPath().getName() for f in fs.listStatus(where)]
        return {x.split("=")[1]: f"{folder}/{x}" for x in names if x.startswith(f"{_BUCKET}=")}

    def _commit(self, made: dict) -> None:
        fs, where = self._at(f"manifests/{made['version']:020d}.json")
        fs.mkdirs(where.getParent())
        hidden = self._jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{uuid.uuid4().hex}")
        out = fs.create(hidden, False)
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        # a rename never replaces a file, so a manifest is whole or is not there
        taken = fs.exists(where)
        if taken or not fs.rename(hidden, where):
            fs.delete(hidden, False)
            raise Conflict(f"version {made['version']} of {self.path} is there already")

    def vacuum(self, keep: int = 1) -> int:
        """Drops all but the last ``keep`` versions, and folders that none of these
        name; returns how many folders went."""
        numbers = self.numbers()
        for version in numbers[:-keep]:
            fs, where = self._at(f"manifests/{version:020d}.json")
            fs.delete(where, False)
        named = {f for v in numbers[-keep:] for f in self.manifest(v)["folders"].values()}
        gone = 0
        fs, where = self._at("data")
        for version in fs.listStatus(where) if fs.exists(where) else []:
            for stage in fs.listStatus(version.getPath()):
                for part in fs.listStatus(stage.getPath()):
                    at = "/".join(part.getPath().toString().split("/")[-4:])
                    if part.isDirectory() and at not in named:
                        fs.delete(part.getPath(), True)
                        gone += 1
        return gone
