"""WARC records in seekable Zstandard bundles.

Records are grouped into frames that decompress on their own. A bundle is such frames and a skippable frame with a
seek table (the size of every frame, compressed and not, and a fixed footer), as the seekable Zstandard format has it; any
Zstandard reader can read it whole. An index maps each record's identifier to its frame and the offset in that frame.

Bundles are written by Spark's own writer as rows (bundle, data, index), so they can be on any storage that Spark
can write, and a task that is run again replaces what it wrote; `export_bundles` makes single .warc.zst files of them.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm.common import byte_view, cut, join_facts, released, small_batches, text_of, without

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # fixed values of the seekable format
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 16 << 20  # uncompressed bytes after which a frame, a bundle is closed
DATE = b"1970-01-01T00:00:00Z"  # records are reproducible: no clock
BUNDLES = "bundle string, data binary, index array<struct<record_id: string, frame: int, offset: int, length: int>>"


def record(record_id: str, uri: str, digest: str, size: int, payload: bytes | None, refers_to: str | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or (payload None) a revisit of refers_to."""
    lines = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"response" if payload is not None else b"revisit"),
        b"WARC-Record-ID: <urn:record:" + record_id.encode() + b">",
        b"WARC-Date: " + DATE,
        b"WARC-Target-URI: " + " ".join(uri.split()).encode("utf-8", "replace"),
        b"WARC-Payload-Digest: sha256:" + digest.encode(),
        b"X-Payload-Length: " + str(size).encode(),
    ]
    if payload is None:
        lines.append(b"WARC-Refers-To: <urn:record:" + refers_to.encode() + b">")
        lines.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    body = payload or b""
    lines += [b"Content-Type: text/html", b"Content-Length: " + str(len(body)).encode(), b"", b""]
    return b"\r\n".join(lines) + body + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """The headers, block and offset of each record of a decompressed frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *rest = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record begins at {at}")
        headers = dict(line.split(": ", 1) for line in rest)
        size = int(headers["Content-Length"])
        yield headers, data[end + 4 : end + 4 + size], at
        at = end + 4 + size + 4


class BundleWriter:
    """Collects records and gives a bundle's bytes and index; holds one bundle at a time."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self._packer, self._limit = zstandard.ZstdCompressor(level=level, write_checksum=True), frame_bytes
        self._frames, self._table, self._open, self._size, self.index, self.total = [], [], [], 0, [], 0

    def add(self, record_id: str, data: bytes) -> None:
        if self._size and self._size + len(data) > self._limit:
            self._close()
        self.index.append({"record_id": record_id, "frame": len(self._frames), "offset": self._size, "length": len(data)})
        self._open.append(data)
        self._size += len(data)
        self.total += len(data)

    def _close(self) -> None:
        packed = self._packer.compress(b"".join(self._open))
        self._frames.append(packed)
        self._table.append(struct.pack("<II", len(packed), self._size))
        self._open, self._size = [], 0

    def finish(self) -> bytes:
        if self._size:
            self._close()
        table = b"".join(self._table) + struct.pack("<IBI", len(self._frames), 0, SEEKABLE)
        return b"".join(self._frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of each frame, from the footer alone."""
    count, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end")
    width = 12 if flags & 0x80 else 8
    table, out, at = data[-9 - count * width : -9], [], 0
    for i in range(count):
        packed, size = struct.unpack_from("<II", table, i * width)
        out.append((at, packed, size))
        at += packed
    return out


def read_frame(data: bytes, frame: int) -> bytes:
    at, packed, size = seek_table(data)[frame]
    return zstandard.ZstdDecompressor().decompress(data[at : at + packed], max_output_size=size) if size else b""


def read_record(data: bytes, frame: int, offset: int, length: int) -> bytes:
    """One record by its place in the index: only its frame is decompressed."""
    return read_frame(data, frame)[offset : offset + length]


def with_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least_bytes: int = 100) -> DataFrame:
    """pages with payload_bytes, payload_digest, record_type and refers_to.

    Of records with equal payloads (SHA-256) of least_bytes or more, the one with the smallest id is the response, the others
    revisit it. Rows repeated with that id are all responses, as are rows of a group without any id.
    """
    rows = without(pages, "payload_bytes", "payload_digest", "record_type", "refers_to")
    payload = text_of(payload_col).cast("binary")
    rows = rows.withColumns({"payload_bytes": F.octet_length(payload).cast("long"), "payload_digest": F.sha2(payload, 256)})
    groups = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min(id_col).alias("__first"), F.count("*").alias("__n"))
    groups = cut(groups.where("__n > 1"))
    met = join_facts(rows, groups, "payload_digest", "__n", [id_col], pages.count())
    revisit = F.col("__first").isNotNull() & ~F.col("__first").eqNullSafe(F.col(id_col))
    return met.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("__first"))}).drop("__first", "__n")


def write_bundles(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes a record of every row of `with_revisits` pages to bundles at `path`; gives the bundles as read from there.

    A null payload is written as an empty one, a null url as an empty one, a null id as 'null'. An empty table
    writes no bundle. A payload larger than a frame gets a frame to itself. A task holds one bundle and one batch.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, prefix, number = BundleWriter(frame_bytes), "", 0

        def done() -> pa.RecordBatch:
            row = {"bundle": f"{prefix}-{number:05d}", "data": writer.finish(), "index": writer.index}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("bundle", pa.string()), ("data", pa.binary()), ("index", pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())])))]))

        for batch in batches:
            ids, urls, digests, sizes, types, refers, parts = (batch.column(i) for i in range(7))
            prefix = prefix or f"bundle-{parts[0].as_py():05d}"
            raw, at = byte_view(batch.column(7))
            for i, (record_id, uri, digest, size, kind, ref) in enumerate(zip(ids.to_pylist(), urls.to_pylist(), digests.to_pylist(), sizes.to_pylist(), types.to_pylist(), refers.to_pylist(), strict=True)):
                payload = raw[at[i] : at[i + 1]].tobytes() if kind == "response" else None
                writer.add(record_id, record(record_id, uri, digest, size, payload, ref))
                if writer.total >= bundle_bytes:
                    yield done()
                    writer, number = BundleWriter(frame_bytes), number + 1
        if writer.total:
            yield done()

    small_batches(pages.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    payload = F.when(F.col("record_type") == "response", text_of(payload_col)).otherwise("").cast("binary")
    rows = pages.select(text(id_col), text_of(url_col), "payload_digest", "payload_bytes", "record_type", F.col("refers_to").cast("string"), F.spark_partition_id(), payload)
    rows.mapInArrow(released(pack), BUNDLES).write.mode("overwrite").parquet(path)
    return pages.sparkSession.read.schema(BUNDLES).parquet(path)


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles, frame by frame: record_id, uri, payload_bytes, payload_digest, record_type, refers_to, payload.

    Of responses, size and digest are those of the payload that is read, and a digest that differs from the header's raises an
    error; of revisits (payload null) they are the headers'.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("record_id", "uri", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
        schema = pa.schema(list(zip(names, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()), strict=True)))
        bare = lambda x: x[len("<urn:record:") : -1]
        for batch in batches:
            for data in batch.column(0):
                data = data.as_py()
                for frame in range(len(seek_table(data))):
                    rows = []
                    for h, block, _ in parse_records(read_frame(data, frame)):
                        digest, size, kind = h["WARC-Payload-Digest"].removeprefix("sha256:"), int(h["X-Payload-Length"]), h["WARC-Type"]
                        if kind == "response" and (len(block) != size or hashlib.sha256(block).hexdigest() != digest):
                            raise ValueError(f"record {h['WARC-Record-ID']} is damaged")
                        rows.append((bare(h["WARC-Record-ID"]), h.get("WARC-Target-URI", ""), size, digest, kind, bare(h["WARC-Refers-To"]) if kind == "revisit" else None, block if kind == "response" else None))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return bundles.select("data").mapInArrow(released(unpack), "record_id string, uri string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")


def export_bundles(spark: SparkSession, path: str, folder: str) -> int:
    """Writes every bundle as a .warc.zst file of its own in a folder that all machines mount; gives their number.

    Each is written by the task that reads it, under a name for work until it is whole, so a task may run again.
    """
    Path(folder).mkdir(parents=True, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(*batch.columns, strict=True):
                target = Path(folder, f"{name.as_py()}.warc.zst")
                part = target.with_name(f".{target.name}.{uuid.uuid4().hex}.part")
                part.write_bytes(data.as_py())
                part.replace(target)
            yield pa.record_batch({"n": pa.array([len(batch)], pa.int64())})

    found = spark.read.schema(BUNDLES).parquet(path).select("bundle", "data").mapInArrow(released(write), "n long")
    return found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def seek_record(file: Path, frame: int, offset: int, length: int) -> bytes:
    """One record of an exported bundle by its place in the index: the seek table and one frame are read, nothing else."""
    with file.open("rb") as f:
        size = f.seek(-9, 2) + 9
        count, flags, _ = struct.unpack("<IBI", f.read(9))
        footer = 8 + count * (12 if flags & 0x80 else 8) + 9  # with the head of the skippable frame that it is
        f.seek(size - footer)
        at, packed, whole = seek_table(f.read(footer))[frame]
        f.seek(at)
        data = f.read(packed)
    return zstandard.ZstdDecompressor().decompress(data, max_output_size=whole)[offset : offset + length] if whole else b""
