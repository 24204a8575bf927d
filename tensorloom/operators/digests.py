"""Ordered digests of tensors that are tables of rows.

A tensor's digest is that of its rows' digests in order of the row. Rows are first hashed where they are; the digests
of each block of BLOCK rows become one, in order, and the blocks' digests the tensor's: a tree of bounded nodes, so that no
task holds more than a block, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 4096


def row_digests(rows: DataFrame, row_id: str, text: Column) -> DataFrame:
    """(row_id, digest) of each row's canonical text."""
    return rows.select(F.col(row_id).alias("row_id"), F.sha2(text, 256).alias("digest"))


def vector_text(value: str) -> Column:
    """A vector as text that does not depend on how floats are printed: millionths, rounded, joined by commas."""
    return F.array_join(F.transform(F.col(value), lambda x: F.round(x.cast("double") * 1000000).cast("long").cast("string")), ",")


def ordered(parts: DataFrame, group: list[str], order: str, digest: str = "digest") -> DataFrame:
    """(*group, digest): the digest of a group's digests, one after another in order."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(digest).alias("d")))), lambda s: s["d"]), "")
    return parts.groupBy(*group).agg(F.sha2(joined, 256).alias(digest))


def tensor_digest(rows: DataFrame, block: int = BLOCK, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, digest) for row digests (*by, row_id, digest), by way of blocks of row numbers: one row a tensor."""
    blocks = ordered(rows.withColumn("block", F.floor(F.col("row_id") / block)), [*by, "block"], "row_id")
    top = ordered(blocks.withColumn("super", F.floor(F.col("block") / block)), [*by, "super"], "block")
    return ordered(top, [*by], "super")


def artifact_digest(config: str, tensors: DataFrame) -> DataFrame:
    """One row (fingerprint) of a config and tensors (name, dtype, shape, byte_length, digest); where they are stored has no part in it."""
    shape = F.array_join(F.transform("shape", lambda d: d.cast("string")), ",")
    line = F.concat_ws("|", "name", "dtype", shape, F.col("byte_length").cast("string"), "digest")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", line.alias("line")))), lambda s: s["line"]), "\n")
    return tensors.agg(F.sha2(F.concat(F.lit(config + "\n"), lines), 256).alias("fingerprint"))


def commitment(perm: DataFrame, method: str, version: str, fingerprint: str, nonce: str, block: int = BLOCK) -> DataFrame:
    """One row (commitment) that binds a permutation and its inverse to a method, an artifact and a nonce."""
    def side(key: str, value: str) -> DataFrame:
        rows = perm.select(F.col(key).alias("row_id"), F.col(value).cast("string").alias("digest"))
        return tensor_digest(rows.withColumn("digest", F.sha2("digest", 256)), block)

    forth, back = side("orig", "obf").toDF("forth"), side("obf", "orig").toDF("back")
    n = perm.agg(F.count("*").alias("n"))
    one = n.crossJoin(forth).crossJoin(back)  # one row each
    return one.select(F.sha2(F.concat_ws("|", F.lit(method), F.lit(version), F.lit(fingerprint), F.lit(nonce), F.col("n").cast("string"), "forth", "back"), 256).alias("commitment"))
