"""Joins with facts, one row a key, that no hot key slows down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group is hot when it holds more than one row in HOT_SHARE; there are at most HOT_SHARE such groups.
HOT_SHARE = 1000


def join_facts(rows: DataFrame, facts: DataFrame, key: str, size: str, spread: list[str], n_rows: int) -> DataFrame:
    """rows with the columns of facts (one row a key, with the key's row count in `size`), null where there are none.

    Keys with more than n_rows / HOT_SHARE rows number HOT_SHARE at most, so they are broadcast whatever the input's
    size; their rows are dealt by `spread` and meet no other row. All other keys are joined by a shuffle.
    """
    names = [c for c in facts.columns if c != key]
    is_hot = F.col(size) > F.lit(max(1, n_rows // HOT_SHARE))
    hot = facts.where(is_hot).select(F.col(key).alias("__hot_key"), *[F.col(c).alias(f"__hot_{c}") for c in names])
    cold = facts.where(~is_hot).select(F.col(key).alias("__cold_key"), *[F.col(c).alias(f"__cold_{c}") for c in names])
    apart = F.concat(F.lit("#"), F.xxhash64(*spread).cast("string"))
    met = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot_key"), "left")
    met = met.withColumn("__key", F.when(F.col("__hot_key").isNotNull() | F.col(key).isNull(), apart).otherwise(F.col(key).cast("string")))
    met = met.join(cold.withColumn("__cold_key", F.col("__cold_key").cast("string")), F.col("__key") == F.col("__cold_key"), "left")
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.coalesce(f"__hot_{c}", f"__cold_{c}").alias(c) for c in names])


def join_salted(rows: DataFrame, facts: DataFrame, key: str, size: str, spread: list[str], n_rows: int) -> DataFrame:
    """As join_facts, for facts that may be too large to broadcast: those of a hot key are repeated, once a share of its rows.

    What is broadcast is the names of hot keys, HOT_SHARE at most; the repeats number HOT_SHARE more than the keys at most.
    """
    share = max(1, n_rows // HOT_SHARE)
    names = [c for c in facts.columns if c != key]
    facts = facts.withColumn("__salts", F.ceil(F.col(size) / F.lit(share)).cast("int"))
    hot = facts.where(F.col("__salts") > 1).select(F.col(key).alias("__hot_key"), F.col("__salts").alias("__hot_salts"))
    dealt = facts.select(F.col(key).alias("__fact_key"), *[F.col(c).alias(f"__fact_{c}") for c in names], F.explode(F.sequence(F.lit(0), F.col("__salts") - 1)).alias("__fact_salt"))
    met = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot_key"), "left")
    met = met.withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("__hot_salts")).cast("int"), F.lit(0)))
    met = met.join(dealt, (F.col(key) == F.col("__fact_key")) & (F.col("__salt") == F.col("__fact_salt")), "left")
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.col(f"__fact_{c}").alias(c) for c in names])
