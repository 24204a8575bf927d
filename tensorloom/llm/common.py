"""What the operators share: table access, lineage cuts, byte views of Arrow columns, joins safe against hot keys."""

from __future__ import annotations

import contextlib
import ctypes
import inspect
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.functions.joins import join_facts, join_salted
from tensorloom.storage import cut, shared_path

__all__ = ["cut", "join_facts", "join_salted", "shared_path"]  # the operators' way to these

# Python workers stay alive between tasks: what a batch took goes back to the system at once.
pa.set_memory_pool(pa.system_memory_pool())

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch that goes to Python: each worker holds a few times this, whatever the texts' sizes.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by BATCH_BYTES, unless a smaller bound is set already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(re.sub(r"\D", "", spark.conf.get(name)) or 0) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def _trim() -> None:
    """Gives free memory back: the C library keeps what large arrays took, and workers outlive their tasks."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def released(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task for mapInArrow that gives its worker's free memory back when it ends."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            _trim()

    return run


def arrow(f: Callable[..., pa.Array], kind: str) -> Callable[..., Column]:
    """An Arrow UDF of one or two columns that gives its worker's free memory back after every batch."""

    def one(a: pa.Array) -> pa.Array:
        try:
            return f(a)
        finally:
            _trim()

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        try:
            return f(a, b)
        finally:
            _trim()

    return F.arrow_udf(one if len(inspect.signature(f).parameters) == 1 else two, kind)


def narrow(df: DataFrame, rows: int, rows_a_task: int = 25_000) -> DataFrame:
    """df in no more partitions than so many (small) rows are worth, without an exchange; with many rows, as it is.

    A task gets six partitions of an exchange at most: the sorts of each hold their memory until the task ends.
    """
    spark = df.sparkSession
    return df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // rows_a_task), int(spark.conf.get("spark.sql.shuffle.partitions")) // 6))


def set_aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with its columns of these names renamed, and what gives a result of it the columns of df back, and no others."""
    taken = {n.lower() for n in names}
    own = {c: f"__own_{i}" if c.lower() in taken else c for i, c in enumerate(df.columns)}
    aside = df.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()])
    return aside, lambda out: out.select(*[F.col(f"`{n}`").alias(c) for c, n in own.items()])


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns that an operator's own output names would clash with."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows in them; null counts as empty. No copy unless needed."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]
