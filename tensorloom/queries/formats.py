"""Queries that go through files: safetensors written and read back, headers, and a stream that is stopped and goes on."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.functions.scalars import little_endian, little_endian_bytes
from tensorloom.queries.base import matrix, registry, table
from tensorloom.sources import safetensors as st
from tensorloom.storage import shared_path
from tensorloom.streaming.resume import copy_available

QUERIES, SQL, query = registry()


def float_bytes(vectors: pa.Array) -> pa.Array:
    """The little-endian bytes of each vector of 32-bit floats."""
    values = np.asarray(vectors.flatten(), "<f4")
    ends = 4 * np.concatenate([[0], np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(ends), pa.py_buffer(values.tobytes())])


def byte_floats(raw: pa.Array) -> pa.Array:
    """The vectors of 32-bit floats of which each cell has the bytes."""
    data, ends = st.joined(raw)
    return pa.ListArray.from_arrays(pa.array((ends - ends[0]) // 4, pa.int32()), pa.array(np.frombuffer(data, "<f4")))


@query("SELECT vec_id AS row_id, embedding AS v, CAST(label AS BIGINT) AS label FROM embeddings")
def safetensors_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding and its labels, written as an artifact of two shards through the source and read back from it."""
    rows = table(spark, sf_dir, "embeddings")
    n, width = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    tensors = [("embedding", "F32", [n, width]), ("label", "I32", [n])]
    cell = lambda name, raw: F.struct(F.lit(name).alias("tensor"), raw.alias("raw"))
    raw = F.arrow_udf(float_bytes, "binary")(F.col("embedding"))
    cells = rows.select(F.col("vec_id").alias("row_id"), raw.alias("raw"), little_endian_bytes(F.col("label"), 4).alias("other"))
    cells = cells.select("row_id", F.inline(F.array(cell("embedding", F.col("raw")), cell("label", F.col("other"))))).select("tensor", "row_id", "raw")
    folder = shared_path(spark, "artifact")
    st.register(spark)
    cells.write.format("safetensors").option("tensors", json.dumps(tensors)).option("max_shard", 4 * n * width).mode("append").save(folder)
    back = st.read_rows(spark, folder, ["embedding"]).select("row_id", F.arrow_udf(byte_floats, "array<float>")(F.col("raw")).alias("v"))
    return back.join(st.read_rows(spark, folder, ["label"]).select("row_id", little_endian(F.col("raw"), 4).cast("long").alias("label")), "row_id")


@query("SELECT vec_id AS row_id, embedding AS v FROM embeddings WHERE vec_id BETWEEN 100 AND 299")
def safetensors_row_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one tensor that a filter picks: the source reads their ranges alone."""
    rows = matrix(spark, sf_dir)
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    folder = shared_path(spark, "artifact")
    st.register(spark)
    cells = rows.select(F.lit("embedding").alias("tensor"), "row_id", F.arrow_udf(float_bytes, "binary")(F.col("v")).alias("raw"))
    cells.write.format("safetensors").option("tensors", json.dumps([("embedding", "F32", [n, width])])).mode("append").save(folder)
    some = st.read_rows(spark, folder, pushdown=True).where("tensor = 'embedding' AND row_id >= 100 AND row_id < 300")
    return some.select("row_id", F.arrow_udf(byte_floats, "array<float>")(F.col("raw")).alias("v"))


@query("SELECT event_id, user_id, event_type FROM events")
def stream_copy_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events, copied as a stream that was run before its source was whole, and once more with nothing to do."""
    source, target, checkpoint = (shared_path(spark, n) for n in ("source", "copy", "progress"))
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    events.where("event_id % 2 = 0").write.parquet(source)
    copy_available(spark, source, events.schema, target, checkpoint)
    events.where("event_id % 2 = 1").write.mode("append").parquet(source)
    copy_available(spark, source, events.schema, target, checkpoint)
    return copy_available(spark, source, events.schema, target, checkpoint)
