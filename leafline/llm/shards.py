"""Sharding by fixed virtual slots.

Records hash into a fixed number of virtual slots; a versioned map assigns slots
to shards. Growing by one shard, or evening out bytes, edits the map: a record's
virtual slot never changes. Only ids, sizes and checksums are shuffled, never
texts; positions within shards come from counts per virtual slot, so no task
holds a shard.

Defined cases: a null text has 0 bytes (size 1) and the checksum of no bytes;
repeated rows each get a position of their own; an empty table gives no rows;
rows without an id go to the slot of their text's checksum, so that they do not meet in one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, settled

SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """One version of the map: ``shard_of[slot]``."""

    version: int
    shard_of: tuple[int, ...]

    @property
    def shards(self) -> int:
        return max(self.shard_of) + 1

    def table(self, spark: SparkSession) -> DataFrame:
        """One row for each slot (their number is fixed), so it may be broadcast."""
        return spark.createDataFrame([(i, s, self.version) for i, s in enumerate(self.shard_of)], "virtual_slot int, shard int, version int")


def store(spark: SparkSession, versions: list[SlotMap], path: str | None = None) -> str:
    """Writes versions of the map, (version, virtual_slot, shard), and returns where."""
    path = path or fresh_path(spark, "slot-map")
    reduce(DataFrame.unionByName, (m.table(spark) for m in versions)).coalesce(1).write.mode("append").parquet(path)
    return path


def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """One version of a stored map; the latest if none is named."""
    table = spark.read.parquet(path)
    version = table.agg(F.max("version")).first()[0] if version is None else version
    rows = table.where(F.col("version") == version).orderBy("virtual_slot").collect()  # as many as slots
    return SlotMap(version, tuple(r.shard for r in rows))


def first_map(shards: int, slots: int = SLOTS) -> SlotMap:
    return SlotMap(1, tuple(i % shards for i in range(slots)))


def grown(old: SlotMap) -> SlotMap:
    """The next version with one more shard: every old shard gives it an even
    share of its slots, and no slot moves between old shards."""
    n = old.shards
    out, give = list(old.shard_of), len(old.shard_of) // (n + 1)
    owned = [[i for i, s in enumerate(old.shard_of) if s == k] for k in range(n)]
    for j in range(give):
        out[max(owned, key=len).pop()] = n
    return SlotMap(old.version + 1, tuple(out))


def rebalanced(old: SlotMap, slot_bytes: dict[int, int], tolerance: float = 0.02) -> SlotMap:
    """The next version, after moving slots from the fullest to the emptiest
    shard while that narrows the gap and it exceeds ``tolerance`` of the mean.
    slot_bytes has at most one entry for each virtual slot."""
    out, load = list(old.shard_of), [0] * old.shards
    for i, s in enumerate(out):
        load[s] += slot_bytes.get(i, 0)
    mean = sum(load) / len(load)
    for _ in range(len(out)):
        full, low = load.index(max(load)), load.index(min(load))
        gap = load[full] - load[low]
        movable = [i for i, s in enumerate(out) if s == full and 0 < slot_bytes.get(i, 0) < gap]
        if gap <= tolerance * mean or not movable:
            break
        best = min(movable, key=lambda i: abs(gap - 2 * slot_bytes[i]))
        out[best] = low
        load[full] -= slot_bytes[best]
        load[low] += slot_bytes[best]
    return SlotMap(old.version + 1, tuple(out))


def virtual_slot(key: Column, slots: int = SLOTS, instead: Column | None = None) -> Column:
    """The slot of a key; rows without one go by ``instead``, so that they don't meet in one slot."""
    own = F.xxhash64(key) if instead is None else F.when(key.isNull(), F.xxhash64(instead)).otherwise(F.xxhash64(key))
    return F.pmod(own, F.lit(slots)).cast("int")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """id, size (UTF-8 bytes and 1), text_crc32 and virtual_slot."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), virtual_slot(F.col(id_col), slots, F.crc32(text)).alias("virtual_slot"))


def slot_bytes(rows: DataFrame) -> DataFrame:
    """Rows and bytes of each virtual slot that has any."""
    return rows.groupBy("virtual_slot").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def assign(rows: DataFrame, versions: SlotMap | DataFrame, later: SlotMap | DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """rows of sized() with shard, slot (place in the shard, from 0 and without
    gaps) and, by a later map, grown_shard. A map may be given by its stored rows."""
    versions, later = (m.table(rows.sparkSession) if isinstance(m, SlotMap) else m for m in (versions, later))
    table = versions.select("virtual_slot", "shard")
    if later is not None:
        table = table.join(later.select("virtual_slot", F.col("shard").alias("grown_shard")), "virtual_slot")
    else:
        table = table.withColumn("grown_shard", F.lit(None).cast("int"))
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    table = table.join(slot_bytes(rows).select("virtual_slot", "rows"), "virtual_slot", "left").withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows")
    inner = Window.partitionBy("virtual_slot").orderBy(id_col, "text_crc32", "size")
    placed = rows.withColumn("place", F.row_number().over(inner) - 1)
    return placed.join(F.broadcast(table), "virtual_slot").withColumn("slot", (F.col("before") + F.col("place")).cast("long")).drop("before", "place")


def placed(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id, size, text_crc32, virtual_slot, shard, slot, grown_shard (with one more
    shard) and balanced_shard (after evening out the bytes of slots). Three
    versions of the map are stored, and read back to place the records: the first,
    the grown one, and the first edited by the bytes of each slot."""
    spark = docs.sparkSession
    rows = settled(sized(docs, id_col, text_col))
    first = first_map(shards)
    bytes_of = {r.virtual_slot: r.bytes for r in slot_bytes(rows).collect()}  # one row a slot, of a fixed number
    even = rebalanced(first, bytes_of)
    path = store(spark, [first, grown(first), SlotMap(3, even.shard_of)], path)
    stored = spark.read.parquet(path)
    version = lambda n: stored.where(F.col("version") == n)
    out = assign(rows, version(1), version(2), id_col)
    balanced = version(3).select("virtual_slot", F.col("shard").alias("balanced_shard"))
    return out.join(F.broadcast(balanced), "virtual_slot")
