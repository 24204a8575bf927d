"""Inventories of tensors: name, dtype, shape, byte_length, and the shard that each is in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tensorloom.functions.scalars import byte_length, dtype_width, element_count

SCHEMA = "name string, dtype string, shape array<bigint>, shard string"
#: The dtype in which a column's values are a tensor's elements.
DTYPES = {T.DoubleType: "F64", T.FloatType: "F32", T.LongType: "I64", T.IntegerType: "I32", T.ShortType: "I16", T.ByteType: "I8", T.BooleanType: "BOOL"}
CHUNK = 4 << 20  # the most bytes of a copying step
TENSOR_BYTES, TOKEN_BYTES = 256, 8  # what a plan charges for a tensor's metadata and for a vocabulary entry


def columns_as_tensors(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """The numeric columns of tables as tensors 'table.column' of shape [rows], arrays of numbers as [rows, width].

    Rows are counted by the scan of each table's metadata; the width is that of the longest array. One job counts all tables;
    what it gives, a row a tensor, is a document of the driver, so that a plan that uses it often doesn't scan again.
    """
    parts = []
    for name, df in tables.items():
        flat = [(f.name, DTYPES[type(f.dataType)]) for f in df.schema if type(f.dataType) in DTYPES]
        deep = [(f.name, DTYPES[type(f.dataType.elementType)]) for f in df.schema if isinstance(f.dataType, T.ArrayType) and type(f.dataType.elementType) in DTYPES]
        if not flat and not deep:
            continue
        sums = df.agg(F.count("*").alias("n"), *[F.coalesce(F.max(F.size(c)), F.lit(0)).cast("long").alias(f"w_{c}") for c, _ in deep])
        entries = [F.struct(F.lit(f"{name}.{c}").alias("name"), F.lit(d).alias("dtype"), F.array(F.col("n")).alias("shape"), F.lit(name).alias("shard")) for c, d in flat]
        entries += [F.struct(F.lit(f"{name}.{c}").alias("name"), F.lit(d).alias("dtype"), F.array(F.col("n"), F.col(f"w_{c}")).alias("shape"), F.lit(name).alias("shard")) for c, d in deep]
        parts.append(sums.select(F.inline(F.array(*entries))))
    if not parts:
        return with_sizes(spark.createDataFrame([], SCHEMA))
    rows = [(r["name"], r["dtype"], r["shape"], r["shard"]) for r in reduce(DataFrame.unionByName, parts).collect()]
    return with_sizes(spark.createDataFrame(rows, SCHEMA).coalesce(1))


def with_sizes(inventory: DataFrame) -> DataFrame:
    return inventory.withColumn("byte_length", byte_length(F.col("shape"), F.col("dtype")))


def elements(inventory: DataFrame) -> DataFrame:
    return inventory.select("name", "dtype", element_count(F.col("shape")).alias("elements"), dtype_width(F.col("dtype")).alias("width"), byte_length(F.col("shape"), F.col("dtype")).alias("byte_length"))


def inspect(inventory: DataFrame) -> DataFrame:
    """One row: tensors, their bytes, and the shards in order, as one string."""
    return inventory.agg(
        F.count("*").alias("tensor_count"),
        F.coalesce(F.sum("byte_length"), F.lit(0)).cast("long").alias("payload_bytes"),
        F.array_join(F.array_sort(F.collect_set("shard")), ",").alias("shards"),
    )


def transform_totals(source: DataFrame, output: DataFrame) -> DataFrame:
    """One row: tensors and bytes of a transform's source and output."""
    one = lambda df, p: df.agg(F.count("*").alias(f"{p}_tensors"), F.coalesce(F.sum("byte_length"), F.lit(0)).cast("long").alias(f"{p}_bytes"))
    return one(source, "source").crossJoin(one(output, "output"))  # one row each


def memory_estimate(inventory: DataFrame, limit: int, vocabulary: int = 0) -> DataFrame:
    """One row: what a plan that copies every tensor once would hold. `fits` is false where the limit doesn't exceed the metadata."""
    out = inventory.agg(F.count("*").alias("n"), F.coalesce(F.sum("byte_length"), F.lit(0)).cast("long").alias("payload"))
    state = F.lit(TOKEN_BYTES * vocabulary).cast("long")
    metadata = (F.lit(TENSOR_BYTES) * (F.col("n") + F.col("n")) + state).cast("long")
    out = out.withColumns({"limit_bytes": F.lit(limit).cast("long"), "metadata_bytes": metadata})
    out = out.withColumn("fits", F.col("limit_bytes") > F.col("metadata_bytes"))
    out = out.withColumn("buffer_bytes", F.when(F.col("fits"), F.least(F.col("limit_bytes") - F.col("metadata_bytes"), F.lit(CHUNK).cast("long"))))
    io = F.least(F.col("buffer_bytes"), F.greatest("payload", F.lit(1).cast("long")))
    io = F.when(F.col("fits"), io)
    return out.select("limit_bytes", "metadata_bytes", "fits", "buffer_bytes", (F.col("metadata_bytes") + F.col("buffer_bytes")).alias("peak_bytes"), io.alias("input_buffer_bytes"), io.alias("output_buffer_bytes"), state.alias("scratch_bytes"))
