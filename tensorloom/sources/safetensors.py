"""Safetensors files as tables: strict headers, a partitioned reader, and a writer of whole shards.

A row is (tensor, row_id, raw): one step along the first dimension, its bytes as they are. Reading and writing go by
ranges of bounded size, so that neither a tensor nor a shard has to fit in memory. Rows are written to their places wherever
they are, and digests are put together from pieces that are hashed side by side, so that no row is exchanged for either.
"""

from __future__ import annotations

import json
import math
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from tensorloom.errors import AlreadyExists, InvalidArtifact, InvalidJson, InvalidTensor, MissingTensor, PathEscape, UnsupportedDType
from tensorloom.functions.blake3 import PIECE, blake3, joined_digest, piece_value
from tensorloom.functions.scalars import WIDTHS

#: Fixed values of the format.
HEADER_LIMIT = 64 << 20
CONFIG, SINGLE, INDEX = "config.json", "model.safetensors", "model.safetensors.index.json"
SIDECARS = ("generation_config.json", "tokenizer.json", "tokenizer_config.json", "special_tokens_map.json", "vocab.json", "merges.txt")
EMBEDDING, HEAD = "model.embed_tokens.weight", "lm_head.weight"

RANGE_BYTES = 64 << 20  # of a reader's partition
BATCH_BYTES = 4 << 20
SCHEMA = "tensor string, row_id bigint, raw binary"


def local(path: str) -> str:
    """The path on this machine of a plain path or a file URL; other storage is not read by this source."""
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        return unquote(parsed.path) if parsed.scheme else path
    raise InvalidArtifact(f"{path}: only local and mounted files are read")


def strict_json(text: bytes | str, where: str):
    """JSON in which no object, at any depth, has a key twice."""

    def once(pairs: list) -> dict:
        out = dict(pairs)
        if len(out) < len(pairs):
            raise InvalidJson(f"{where}: a key is repeated")
        return out

    try:
        return json.loads(text, object_pairs_hook=once)
    except ValueError as error:
        raise InvalidJson(f"{where}: {error}") from error


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@dataclass(frozen=True)
class Tensor:
    name: str
    dtype: str
    shape: tuple[int, ...]
    shard: str = ""
    offset: int = 0  # of the payload in its file

    @property
    def elements(self) -> int:
        return math.prod(self.shape)

    @property
    def byte_length(self) -> int:
        return self.elements * WIDTHS[self.dtype]

    @property
    def rows(self) -> int:
        return self.shape[0] if self.shape else 1

    @property
    def row_bytes(self) -> int:
        return math.prod(self.shape[1:]) * WIDTHS[self.dtype]

    def matrix_row_bytes(self) -> int:
        """Bytes of a row of a matrix whose rows are to be moved."""
        if len(self.shape) != 2:
            raise InvalidTensor(f"{self.name}: {len(self.shape)} dimensions where a matrix is needed")
        if not self.shape[1]:
            raise InvalidTensor(f"{self.name}: rows without values")
        return self.row_bytes


def encode_header(tensors: list[Tensor]) -> bytes:
    """The header of a file that holds these tensors one after another, with its length before it."""
    entries: dict = {"__metadata__": {"format": "pt"}}
    at = 0
    for t in tensors:
        entries[t.name] = {"dtype": t.dtype, "shape": list(t.shape), "data_offsets": [at, at + t.byte_length]}
        at += t.byte_length
    text = canonical_json(entries).encode()
    text += b" " * (-len(text) % 8)
    return struct.pack("<Q", len(text)) + text


def parse_header(data: bytes, file_size: int, shard: str) -> tuple[list[Tensor], str | None]:
    """The tensors of a file's header, which must tile its payload exactly, and the format that it claims."""
    if file_size < 8 or len(data) < 8:
        raise InvalidArtifact(f"{shard}: too short for a header")
    (size,) = struct.unpack("<Q", data[:8])
    if size > HEADER_LIMIT or 8 + size > file_size:
        raise InvalidArtifact(f"{shard}: header of {size} bytes")
    entries = strict_json(data[8 : 8 + size].rstrip(b" \t\r\n"), shard)
    if not isinstance(entries, dict):
        raise InvalidArtifact(f"{shard}: the header is no object")
    payload, tensors = file_size - 8 - size, []
    metadata = entries.pop("__metadata__", {})
    for name, entry in entries.items():
        if not name or "\0" in name:
            raise InvalidTensor(f"{shard}: a name is empty or has a zero byte")
        try:
            dtype, shape, (begin, end) = entry["dtype"], tuple(entry["shape"]), entry["data_offsets"]
        except (KeyError, TypeError, ValueError) as error:
            raise InvalidTensor(f"{name}: its entry is incomplete") from error
        if dtype not in WIDTHS:
            raise UnsupportedDType(f"{name}: {dtype}")
        if not all(type(x) is int and x >= 0 for x in (*shape, begin, end)):
            raise InvalidTensor(f"{name}: a dimension or offset is no natural number")
        tensor = Tensor(name, dtype, shape, shard, 8 + size + begin)
        if begin > end or end > payload or tensor.byte_length != end - begin:
            raise InvalidTensor(f"{name}: range {begin}-{end} of {payload} for {tensor.byte_length} bytes")
        tensors.append(tensor)
    tensors.sort(key=lambda t: (t.offset, t.byte_length, t.name))
    reached = 8 + size
    for t in tensors:
        if t.offset != reached:
            raise InvalidArtifact(f"{shard}: a hole or an overlap before {t.name}")
        reached += t.byte_length
    if reached != file_size:
        raise InvalidArtifact(f"{shard}: bytes that belong to no tensor")
    return tensors, metadata.get("format") if isinstance(metadata, dict) else None


def read_header(path: Path, shard: str) -> tuple[list[Tensor], str | None]:
    size = path.stat().st_size
    with path.open("rb") as f:
        first = f.read(8)
        length = struct.unpack("<Q", first)[0] if len(first) == 8 else 0
        return parse_header(first + (f.read(length) if length <= HEADER_LIMIT else b""), size, shard)


def inside(root: Path, name: str) -> Path:
    """root / name, which may not lead out of root, through links either."""
    if not name or os.path.isabs(name) or ".." in Path(name).parts:
        raise PathEscape(name)
    path = (root / name).resolve()
    if not path.is_relative_to(root):
        raise PathEscape(name)
    return path


@dataclass
class Artifact:
    """A model's folder: its config as written and parsed, its tensors by name, its sidecars and tied weights."""

    root: str
    config_bytes: bytes
    config: dict
    tensors: list[Tensor]
    sidecars: list[str]
    aliases: dict[str, str] = field(default_factory=dict)

    @property
    def architecture(self) -> str:
        named = self.config.get("architectures")
        first = named[0] if isinstance(named, list) and named else None
        return next((x for x in (self.config.get("model_type"), first) if isinstance(x, str)), "unknown")

    def tensor(self, name: str) -> Tensor | None:
        return next((t for t in self.tensors if t.name == name), None)

    def required(self, name: str) -> Tensor:
        tensor = self.tensor(name)
        if tensor is None:
            raise MissingTensor(name)
        return tensor


def open_artifact(path: str) -> Artifact:
    """Opens and validates a folder with a config and either one weights file or an index of several."""
    root = Path(local(path)).resolve()
    if not root.is_dir():
        raise InvalidArtifact(f"{path}: no folder")
    config_path, single, index_path = (root / n for n in (CONFIG, SINGLE, INDEX))
    if not config_path.is_file():
        raise InvalidArtifact(f"{path}: no {CONFIG}")
    if single.is_file() == index_path.is_file():
        raise InvalidArtifact(f"{path}: needs either {SINGLE} or {INDEX}")
    config_bytes = config_path.read_bytes()
    config = strict_json(config_bytes, CONFIG)
    if not isinstance(config, dict):
        raise InvalidArtifact(f"{path}: {CONFIG} is no object")
    index = strict_json(index_path.read_bytes(), INDEX) if index_path.is_file() else None
    wanted = {name: inside(root, shard) for name, shard in index["weight_map"].items()} if index else {}
    files = sorted(set(wanted.values())) if index else [single.resolve()]
    tensors: dict[str, Tensor] = {}
    formats = set()
    for file in files:
        found, claimed = read_header(file, str(file.relative_to(root)))
        formats |= {claimed} - {None}
        for t in found:
            if t.name in tensors:
                raise InvalidTensor(f"{t.name}: in two shards")
            tensors[t.name] = t
    if len(formats) > 1:
        raise InvalidArtifact(f"{path}: shards claim the formats {sorted(formats)}")
    if index:
        if wanted.keys() != tensors.keys():
            raise InvalidArtifact(f"{path}: the index and the shards differ in {sorted(wanted.keys() ^ tensors.keys())[:5]}")
        if moved := [n for n, f in wanted.items() if str(f.relative_to(root)) != tensors[n].shard]:
            raise InvalidArtifact(f"{path}: the index has another shard for {moved[:5]}")
        total = index.get("metadata", {}).get("total_size")
        if total is not None and total != sum(t.byte_length for t in tensors.values()):
            raise InvalidArtifact(f"{path}: the index has another total size")
    aliases = {HEAD: EMBEDDING} if config.get("tie_word_embeddings") is True and HEAD not in tensors and EMBEDDING in tensors else {}
    return Artifact(str(root), config_bytes, config, [tensors[n] for n in sorted(tensors, key=str.encode)], [n for n in sorted(SIDECARS) if (root / n).is_file()], aliases)


def inventory(spark: SparkSession, artifact: Artifact) -> DataFrame:
    rows = [(t.name, t.dtype, list(t.shape), t.shard, t.offset, t.byte_length) for t in artifact.tensors]
    return spark.createDataFrame(rows, "name string, dtype string, shape array<bigint>, shard string, offset bigint, byte_length bigint")


@dataclass
class RowRange(InputPartition):
    tensor: str
    path: str
    offset: int
    row_bytes: int
    first: int
    last: int  # one past


class SafetensorsReader(DataSourceReader):
    """Partitions are ranges of rows of RANGE_BYTES at most; tensors that are not asked for are never opened."""

    def __init__(self, root: str, names: list[str] | None, first: int = 0, last: int | None = None) -> None:
        self.root, self.names = root, None if names is None else set(names)
        self.first, self.last = first, last  # row ids that are asked for

    def partitions(self) -> list[RowRange]:
        artifact, out = open_artifact(self.root), []
        for t in artifact.tensors:
            if self.names is None or t.name in self.names:
                step = max(1, RANGE_BYTES // max(1, t.row_bytes))
                path = str(Path(artifact.root) / t.shard)
                stop = t.rows if self.last is None else min(t.rows, self.last + 1)
                out += [RowRange(t.name, path, t.offset, t.row_bytes, a, min(stop, a + step)) for a in range(max(0, self.first), stop, step)]
        return out

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, RowRange):  # an artifact without rows has one empty partition
            return
        p, step = partition, max(1, BATCH_BYTES // max(1, partition.row_bytes))
        with open(p.path, "rb") as f:
            f.seek(p.offset + p.first * p.row_bytes)
            for a in range(p.first, p.last, step):
                n = min(p.last, a + step) - a
                data = f.read(n * p.row_bytes)
                if len(data) != n * p.row_bytes:
                    raise InvalidTensor(f"{p.tensor}: the file ends early")
                rows = [data[i * p.row_bytes : (i + 1) * p.row_bytes] for i in range(n)]
                yield pa.record_batch({"tensor": pa.array([p.tensor] * n), "row_id": pa.array(range(a, a + n), pa.int64()), "raw": pa.array(rows, pa.binary())})


class PruningReader(SafetensorsReader):
    """Also leaves out tensors and rows that filters rule out. Every filter is handed back and applied above the scan too.

    For a table that a query scans once: all scans of one load() share their reader's state in Spark 4.1, so that of two
    with different filters one would lose rows.
    """

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            self._narrow(f)
            yield f

    def _narrow(self, f: Filter) -> None:
        column = getattr(f, "attribute", None)
        if column == ("tensor",) and isinstance(f, EqualTo | In):
            wanted = set(f.value if isinstance(f, In) else (f.value,))
            self.names = wanted if self.names is None else self.names & wanted
        elif column == ("row_id",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
            if not isinstance(f, LessThan | LessThanOrEqual):
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
            if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                upto = f.value - isinstance(f, LessThan)
                self.last = upto if self.last is None else min(self.last, upto)


class SafetensorsSource(DataSource):
    """spark.read.format('safetensors').load(folder): the rows of every tensor, or of those in the option 'tensors' (JSON),
    all of their rows or those of the option 'rows' (JSON: first and last row_id).

    With the option 'pushdown' (and spark.sql.python.filterPushdown.enabled) filters on tensor and row_id prune what is read
    of a table that a query scans once.
    df.write.format('safetensors') takes rows of the tensors in the option 'tensors' (JSON: [name, dtype, shape] each), at most
    'max_shard' bytes a shard, and an option 'config' (JSON text of the config); the folder must not hold an artifact.
    """

    @classmethod
    def name(cls) -> str:
        return "safetensors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SafetensorsReader:
        kind = PruningReader if self.options.get("pushdown") == "true" else SafetensorsReader
        first, last = json.loads(self.options.get("rows", "[0, null]"))
        return kind(self.options["path"], json.loads(self.options.get("tensors", "null")), first, last)

    def writer(self, schema, overwrite: bool) -> SafetensorsWriter:
        if [f.name for f in schema.fields] != ["tensor", "row_id", "raw"]:
            raise InvalidTensor("rows to be written are (tensor, row_id, raw)")
        if overwrite:
            raise AlreadyExists("artifacts are never overwritten: use the mode 'append' on a new folder")
        tensors = [Tensor(name, dtype, tuple(shape)) for name, dtype, shape in json.loads(self.options["tensors"])]
        return SafetensorsWriter(self.options["path"], plan_shards(tensors, int(self.options.get("max_shard", 4 << 30))), self.options.get("config", "{}"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SafetensorsSource)


def read_rows(spark: SparkSession, path: str, tensors: list[str] | None = None, rows: tuple[int, int | None] = (0, None), pushdown: bool = False) -> DataFrame:
    """The rows of some or all tensors, from the first to the last row_id of `rows`; see SafetensorsSource for pushdown."""
    register(spark)
    reader = spark.read.format("safetensors").option("tensors", json.dumps(tensors)).option("rows", json.dumps(rows))
    if pushdown:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        reader = reader.option("pushdown", "true")
    return reader.load(path)


@dataclass(frozen=True)
class Shard:
    filename: str
    tensors: tuple[Tensor, ...]

    @property
    def header(self) -> bytes:
        return encode_header(list(self.tensors))

    @property
    def payload(self) -> int:
        return sum(t.byte_length for t in self.tensors)


def plan_shards(tensors: list[Tensor], max_shard: int) -> list[Shard]:
    """Next-fit packing by falling alignment, then name; see operators.layout for the same on a table."""
    groups: list[list[Tensor]] = []
    used, closed = 0, True
    for t in sorted(tensors, key=lambda t: (-WIDTHS[t.dtype], t.name.encode())):
        if closed or used + t.byte_length > max_shard:
            groups.append([])
            used = 0
        groups[-1].append(t)
        used += t.byte_length
        closed = t.byte_length > max_shard
    groups = groups or [[]]
    names = [SINGLE] if len(groups) == 1 else [f"model-{i + 1:05d}-of-{len(groups):05d}.safetensors" for i in range(len(groups))]
    return [Shard(n, tuple(g)) for n, g in zip(names, groups, strict=True)]


def runs(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where rows in a row have the same keys: [a, b)."""
    if len(keys[0]):
        new = np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
        first = np.flatnonzero(new)
        yield from zip(first.tolist(), np.append(first[1:], len(new)).tolist(), strict=True)


def joined(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of a binary column, one after another, and the offsets of its rows; nothing is copied."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return memoryview(data or b"")[int(ends[0]) : int(ends[-1])], ends


Place = tuple[str, int, int, int]  # file, where the tensor begins in it, bytes of a row, rows


def prepared(shards: list[Shard], folder: str) -> dict[str, Place]:
    """Makes every shard's file at its full length, with its header, under a name for work; gives the tensors' places."""
    root, places = Path(local(folder)), {}
    root.mkdir(parents=True, exist_ok=True)
    for shard in shards:
        path, at = root / f".{shard.filename}.part", len(shard.header)
        with path.open("wb") as f:
            f.write(shard.header)
            f.truncate(at + shard.payload)
        for t in shard.tensors:
            places[t.name] = (str(path), at, t.row_bytes, t.rows)
            at += t.byte_length
    return places


def put_rows(batches: Iterator[pa.RecordBatch], places: dict[str, Place]) -> dict[str, list[int]]:
    """Writes rows to their places; gives for each tensor the number of rows, and the sums of their ids and of the squares.

    The same row may be written again by a task that runs again: it goes to the same place. Rows of other tensors are left out.
    """
    files, seen = {}, {}
    try:
        for batch in batches:
            names = np.asarray(batch.column(0).to_pylist(), object)
            ids = np.asarray(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.int64)
            group = np.cumsum(np.append(0, np.diff(ids) != 1)) if len(ids) else ids
            for a, b in runs(names, group):
                if names[a] not in places:
                    continue
                path, at, width, rows = places[names[a]]
                data, ends = joined(batch.column(2).slice(a, b - a))
                if ids[a] < 0 or ids[b - 1] >= rows or (np.diff(ends) != width).any():
                    raise InvalidTensor(f"{names[a]}: rows {ids[a]} to {ids[b - 1]} of {rows}, or of another length than {width}")
                if path not in files:
                    files[path] = os.open(path, os.O_WRONLY)
                start = at + int(ids[a]) * width
                while data:
                    n = os.pwrite(files[path], data, start)
                    data, start = data[n:], start + n
                note = seen.setdefault(names[a], [0, 0, 0])
                for k, x in enumerate((b - a, sum(ids[a:b].tolist()), sum(i * i for i in ids[a:b].tolist()))):
                    note[k] += x
        for fd in files.values():
            os.fsync(fd)
    finally:
        for fd in files.values():
            os.close(fd)
    return seen


def published(shards: list[Shard], folder: str, notes: list[dict[str, list[int]]]) -> None:
    """Gives the shards' files their names, if every row of every tensor was written once, by what the tasks noted."""
    total: dict[str, list[int]] = {}
    for note in notes:
        for name, sums in note.items():
            total[name] = [x + y for x, y in zip(total.get(name, (0, 0, 0)), sums, strict=True)]
    for shard in shards:
        for t in shard.tensors:
            n = t.rows
            if total.get(t.name, [0, 0, 0]) != [n, n * (n - 1) // 2, (n - 1) * n * (2 * n - 1) // 6]:
                raise InvalidTensor(f"{t.name}: rows are missing or repeated ({total.get(t.name, [0])[0]} of {n})")
    root = Path(local(folder))
    for shard in shards:
        os.replace(root / f".{shard.filename}.part", root / shard.filename)


@dataclass
class Noted(WriterCommitMessage):
    rows: dict[str, list[int]]


class SafetensorsWriter(DataSourceArrowWriter):
    """Every task puts its rows where they belong in files of full length, which get their names when all rows are there."""

    def __init__(self, folder: str, shards: list[Shard], config: str) -> None:
        self.folder, self.shards, self.config = folder, shards, config
        root = Path(local(folder))
        if root.is_dir() and any((root / n).exists() for n in (CONFIG, SINGLE, INDEX)):
            raise AlreadyExists(folder)
        strict_json(config, CONFIG)
        self.places = prepared(shards, folder)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Noted:
        return Noted(put_rows(iterator, self.places))

    def commit(self, messages: list[Noted | None]) -> None:
        published(self.shards, self.folder, [m.rows for m in messages if m is not None])
        root = Path(local(self.folder))
        if index := index_of(self.shards):
            (root / INDEX).write_text(index, encoding="utf-8")
        (root / CONFIG).write_text(self.config, encoding="utf-8")

    def abort(self, messages: list[Noted | None]) -> None:
        for shard in self.shards:
            Path(local(self.folder), f".{shard.filename}.part").unlink(missing_ok=True)


def write_rows(rows: DataFrame, shards: list[Shard], folder: str) -> DataFrame:
    """Writes rows (tensor, row_id, raw) to the shards' files; gives (filename, tensor, digest, byte_length) of what is there.

    Rows are written by the tasks that have them, so none are exchanged. A row that is missing, repeated or of another length
    is an error, and then no file gets its name. Digests (BLAKE3) are of the files, read back.
    """
    spark, places = rows.sparkSession, prepared(shards, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = put_rows(batches, places)
        if seen:
            yield pa.record_batch({"tensor": pa.array(list(seen)), "sums": pa.array([json.dumps(x) for x in seen.values()])})

    noted = rows.select("tensor", "row_id", "raw").mapInArrow(write, "tensor string, sums string").collect()  # a row a task and tensor
    published(shards, folder, [{r["tensor"]: json.loads(r["sums"])} for r in noted])
    found = shard_digests(spark, shards, Path(local(folder)))
    return spark.createDataFrame([(s.filename, t.name, found[t.name], t.byte_length) for s in shards for t in s.tensors], "filename string, tensor string, digest string, byte_length bigint")


SPAN = 64 * PIECE  # bytes that one row of work stands for


def range_digests(spark: SparkSession, ranges: list[tuple[str, str, int, int]]) -> dict[str, str]:
    """The BLAKE3 digest of each range (name, path, offset, length) of a file.

    Ranges are hashed in spans by as many tasks as there are; of a span only its pieces' values, 32 bytes a MiB, are exchanged.
    """
    out = {name: blake3(b"").hexdigest() for name, _, _, n in ranges if not n}
    ranges = [r for r in ranges if r[3]]
    if not ranges:
        return out
    total = sum(-(-r[3] // SPAN) for r in ranges)
    rows = spark.createDataFrame(ranges, "name string, path string, offset bigint, length bigint")
    spans = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {SPAN}"))).alias("span"))
    spans = spans.repartition(min(total, 4 * spark.sparkContext.defaultParallelism + total // 16), "name", "span")

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, path, offset, length, span in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = []
                with open(path, "rb") as f:
                    f.seek(offset + span * SPAN)
                    for a in range(span * SPAN, min(length, (span + 1) * SPAN), PIECE):
                        data = f.read(min(PIECE, length - a))
                        if len(data) != min(PIECE, length - a):
                            raise InvalidTensor(f"{name}: the file ends early")
                        found.append(piece_value(data, a // PIECE) if length > PIECE else blake3(data).digest())
                yield pa.record_batch({"name": pa.array([name]), "span": pa.array([span], pa.int64()), "values": pa.array([b"".join(found)], pa.binary())})

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole = b"".join(part["values"] for part in parts)
                yield pa.record_batch({"name": pa.array([name]), "digest": pa.array([joined_digest(whole) if len(whole) > 32 else whole.hex()])})

    hashed = spans.mapInArrow(values, "name string, span bigint, values binary")
    hashed = hashed.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("span", "values"))).alias("parts"))
    return out | {r["name"]: r["digest"] for r in hashed.mapInArrow(fold, "name string, digest string").collect()}  # a row a range


def tensor_digests(spark: SparkSession, artifact: Artifact, names: list[str] | None = None) -> dict[str, str]:
    """The BLAKE3 digest of every tensor, or of some."""
    some = [t for t in artifact.tensors if names is None or t.name in names]
    return range_digests(spark, [(t.name, str(Path(artifact.root) / t.shard), t.offset, t.byte_length) for t in some])


def shard_digests(spark: SparkSession, shards: list[Shard], folder: Path) -> dict[str, str]:
    """The BLAKE3 digest of every tensor of shards whose files are in a folder."""
    ranges = []
    for shard in shards:
        at = len(shard.header)
        for t in shard.tensors:
            ranges.append((t.name, str(folder / shard.filename), at, t.byte_length))
            at += t.byte_length
    return range_digests(spark, ranges)


def index_of(shards: list[Shard]) -> str | None:
    """The index of several shards, as canonical JSON; one alone has none."""
    if len(shards) < 2:
        return None
    return canonical_json({"metadata": {"total_size": sum(s.payload for s in shards)}, "weight_map": {t.name: s.filename for s in shards for t in s.tensors}})
