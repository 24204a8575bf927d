"""Exact deduplication by two passes over a Bloom filter.

Pass one: every task notes the filter positions of its rows' hashes and whether it met them once or more; merged by slices
of the filter, this gives the positions that two rows or more share. Pass two: a row all of whose positions are shared is
possibly repeated. Only such rows are shuffled, to find the groups of equal texts; all others pass straight through.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.bloom import MOST_BITS, filter_bits, holds, shared_positions, words_of_hex
from tensorloom.llm.common import arrow, byte_view, cut, join_facts, small_batches, without

OUT = ("keep_id", "group_size", "kept", "text_sha256")


def lowered_sha256(texts: pa.Array) -> pa.Array:
    """SHA-256, in hex, of each text with A-Z lower-cased; null counts as empty."""
    raw, at = byte_view(pc.ascii_lower(texts))
    view = memoryview(raw)
    return pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, most_bits: int = MOST_BITS) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of equal texts the row with the
    largest id stays. Rows without an id stay only if their whole group has none; of rows repeated with that id all count as
    kept, being one row. Input columns named like an output column are replaced. An empty table gives none.

    The filter has bits_per_row bits a row and at most most_bits (128 MB), which bounds what is broadcast; beyond that
    more rows that are not repeated are shuffled, with the same result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = without(docs, *OUT).withColumn("text_sha256", arrow(lowered_sha256, "string")(F.col(text_col)))
    n_rows = docs.count()
    bits = filter_bits(n_rows, bits_per_row, most_bits)
    shared = spark.sparkContext.broadcast(shared_positions(rows.select("text_sha256"), bits, words_of_hex))

    def possibly_repeated(digests: pa.Array) -> pa.Array:
        return pa.array(holds(shared.value, words_of_hex(digests), bits))

    rows = rows.withColumn("__maybe", arrow(possibly_repeated, "boolean")(F.col("text_sha256")))
    maybe, single = rows.where("__maybe").drop("__maybe"), rows.where("NOT __maybe").drop("__maybe")
    groups = cut(maybe.groupBy("text_sha256").agg(F.max(id_col).alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"))
    met = join_facts(maybe, groups, "text_sha256", "group_size", [id_col], n_rows)
    met = met.withColumns({"keep_id": F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("keep_id")), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
    single = single.withColumns({"keep_id": F.col(id_col), "group_size": F.lit(1).cast("long")})
    kept = [c for c in docs.columns if c.lower() not in OUT]
    out = met.select(*[F.col(f"`{c}`") for c in kept], "keep_id", "group_size", "text_sha256").unionByName(single.select(*[F.col(f"`{c}`") for c in kept], "keep_id", "group_size", "text_sha256"))
    return out.withColumn("kept", F.col("keep_id").eqNullSafe(F.col(id_col)))
