"""WARC archives in seekable Zstandard bundles.

Records go into files of independent frames: a frame holds whole records up to
about 256 kB, a bundle ends with a skippable frame that lists the compressed and
plain size of every frame (the seekable format), and an index maps each record to
its bundle, frame and place in the frame. Reading seeks to the frames that are
asked for by the seek table alone.

Tasks write bundles under fresh names straight to the shared folder and return
index rows; the index table is committed by Spark, so bundles of lost or repeated
attempts are never referred to. Payload digests meet without payloads: equal
payloads are settled on (digest, id) pairs, which AQE can split, and only the ids
and digests of revisits are joined to the pages.

Defined cases: null html is an empty payload; all payloads of at least
``least_bytes`` bytes count for revisits; rows that repeat a page_id are each a
record, named by id and payload, so rows that repeat both are alike: all
responses or all revisits; rows without a page_id are responses; a null url is
written as an empty target; an empty table writes no bundle; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, settled, small_batches

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
LEVEL = 3
# Fixed values of the seekable format: the skippable frame's magic number and the footer's.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

INDEX = "page_id long, record_id string, payload_bytes long, payload_digest string, bundle string, frame int, place int, size int"


def record(kind: str, record_id: str, url: str, date: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; a revisit has no payload and names its response."""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", "".join(url.split())), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Bytes", str(len(payload)))]
    if kind == "revisit":
        fields += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    body = payload if kind == "response" else b""
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame, from the file's end."""
    file.seek(0, io.SEEK_END)
    end = file.tell()
    file.seek(end - 9)
    n, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    file.seek(end - 9 - 8 * n)
    out, offset = [], 0
    for packed, plain in struct.iter_unpack("<II", file.read(8 * n)):
        out.append((offset, packed, plain))
        offset += packed
    return out


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder's address with its scheme: where none is given, Hadoop's default
    file system has it, as for Spark's own readers and writers."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


#: Hadoop's names of stores that the other library calls differently. Fixed values.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfss": "abfs"}


def store_address(uri: str) -> str:
    """A folder's address as pyarrow's file systems call it."""
    scheme, colon, rest = uri.partition("://")
    return SCHEMES.get(scheme, scheme) + colon + rest


def open_folder(uri: str):
    """pyarrow file system and path of a folder's full address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(store_address(uri))


class Bundle:
    """Writes one bundle."""

    def __init__(self, file_system, path: str):
        self.file = file_system.open_output_stream(path, compression=None)
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.frames: list[tuple[int, int]] = []
        self.held, self.held_bytes, self.written = [], 0, 0

    def add(self, raw: bytes) -> tuple[int, int]:
        """Frame of the record and its place in it."""
        if self.held and self.held_bytes + len(raw) > FRAME_BYTES:
            self.flush()
        at = (len(self.frames), self.held_bytes)
        self.held.append(raw)
        self.held_bytes += len(raw)
        return at

    def flush(self) -> None:
        if self.held:
            packed = self.packer.compress(b"".join(self.held))
            self.file.write(packed)
            self.frames.append((len(packed), self.held_bytes))
            self.written += len(packed)
            self.held, self.held_bytes = [], 0

    def close(self) -> None:
        self.flush()
        self.file.write(seek_table(self.frames))
        self.file.close()


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}"


def payload(html):
    return F.coalesce(F.col(html), F.lit("")).cast("binary")


def revisits(pages: DataFrame, id_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """(id, digest, refers_to) of the records that revisit another."""
    body = payload(html_col)
    rows = settled(pages.select(F.col(id_col).alias("page_id"), F.sha1(body).alias("digest")).where(F.octet_length(body) >= least_bytes))
    first = rows.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    return rows.join(first, "digest").where("page_id != refers_to").select("page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes bundles below ``folder`` and returns the index, committed as a table."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload(html_col).alias("body")).withColumn("digest", F.sha1("body"))
    rows = rows.join(revisits(pages, id_col, html_col, least_bytes), ["page_id", "digest"], "left").drop("digest")
    folder = qualified(pages.sparkSession, folder)
    open_folder(folder)[0].create_dir(open_folder(folder)[1], recursive=True)

    def run(batches):
        file_system, root = open_folder(folder)
        bundle, name = None, ""
        for batch in batches:
            out = []
            for page_id, url, body, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "body", "refers_to")), strict=True):
                if bundle is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    bundle = Bundle(file_system, f"{root}/{name}")
                digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
                kind = "response" if refers_to is None else "revisit"
                own = record_id(page_id, digest)
                raw = record(kind, own, url, date, body, digest, None if refers_to is None else record_id(refers_to, digest))
                frame, place = bundle.add(raw)
                out.append((page_id, own, len(body), digest, name, frame, place, len(raw)))
                if bundle.written > BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            if out:
                columns = list(zip(*out, strict=True))
                types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in INDEX.split(", ")])
        if bundle is not None:
            bundle.close()

    return settled(rows.mapInArrow(run, INDEX))


def read(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records that index rows name, read from their bundles: page_id,
    record_type, record_id, refers_to_record, payload_bytes, payload_digest (both
    of the payload read, for revisits of the headers) and, if asked for, payload.
    A frame is unpacked once for all its records, a bundle opened once a task."""
    frames = index.groupBy("bundle", "frame").agg(F.array_sort(F.collect_list(F.struct("place", "size", "page_id"))).alias("records"))
    frames = frames.repartition("bundle", (F.col("frame") / 16).cast("int"))
    folder = qualified(index.sparkSession, folder)

    def run(batches):
        file_system, root = open_folder(folder)
        name, file, table = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["bundle"] != name:
                    if file is not None:
                        file.close()
                    name = row["bundle"]
                    file = file_system.open_input_file(f"{root}/{name}")
                    table = read_seek_table(file)
                offset, packed, plain = table[row["frame"]]
                file.seek(offset)
                frame = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=plain)
                out = []
                for r in row["records"]:
                    fields, body = parse(frame[r["place"] : r["place"] + r["size"]])
                    kind, digest, size = fields["WARC-Type"], fields["WARC-Payload-Digest"][5:], int(fields["X-Payload-Bytes"])
                    if kind == "response":
                        size, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
                    refers = fields.get("WARC-Refers-To")
                    out.append((r["page_id"], kind, fields["WARC-Record-ID"][1:-1], refers and refers[1:-1], size, digest, body if with_payload and kind == "response" else None))
                columns = list(zip(*out, strict=True))
                types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["page_id", "record_type", "record_id", "refers_to_record", "payload_bytes", "payload_digest", "payload"])
        if file is not None:
            file.close()

    return frames.mapInArrow(run, "page_id long, record_type string, record_id string, refers_to_record string, payload_bytes long, payload_digest string, payload binary")


def archived(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Writes all pages, reads every record back and names the page that each
    revisit refers to."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    index = write(pages, folder, least_bytes=least_bytes)
    found = read(index, folder)
    once = found.where("refers_to_record is not null").select(F.col("refers_to_record").alias("record_id")).distinct()
    names = index.select("record_id", F.col("page_id").alias("refers_to")).join(once, "record_id").distinct().withColumnRenamed("record_id", "refers_to_record")
    out = found.join(names, "refers_to_record", "left")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
