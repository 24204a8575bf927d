"""Transforms of tensors that are tables of rows, and of their inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def copy(rows: DataFrame) -> DataFrame:
    """Every row as it is."""
    return rows.select("*")


def pad_columns(rows: DataFrame, value: str, expansion: int) -> DataFrame:
    """rows with 2 * expansion zeros after each value."""
    return rows.withColumn(value, F.concat(F.col(value), F.array_repeat(F.lit(0).cast("float"), 2 * expansion)))


def rename_outputs(inventory: DataFrame) -> DataFrame:
    """Tensors named X.source.weight are named X.target.weight; all others keep their name."""
    return inventory.withColumn("name", F.regexp_replace("name", r"\.source\.weight$", ".target.weight"))


def with_alias(inventory: DataFrame, target: str, alias: str, tied: bool = True) -> DataFrame:
    """The inventory and, where weights are tied and only `target` is there, `alias` as a view of it: alias_of says of what."""
    plain = inventory.withColumn("alias_of", F.lit(None).cast("string"))
    if not tied:
        return plain
    present = F.col("name") == alias
    views = plain.where((F.col("name") == target)).join(plain.where(present).select(F.lit(target).alias("__t")), F.col("name") == F.col("__t"), "left_anti")
    return plain.unionByName(views.withColumns({"alias_of": F.lit(target), "name": F.lit(alias)}))


def padded_inventory(inventory: DataFrame, hidden: int, expansion: int) -> DataFrame:
    """The output inventory of padding: two-dimensional tensors as wide as `hidden` get 2 * expansion columns more."""
    wide = (F.size("shape") == 2) & (F.get("shape", F.lit(1)) == hidden)
    shape = F.when(wide, F.array(F.get("shape", F.lit(0)), F.get("shape", F.lit(1)) + 2 * expansion)).otherwise(F.col("shape"))
    return inventory.withColumn("shape", shape)


def content_mismatch(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """(*key, reason) where two tables with the same columns differ: in rows or in any column. Keys are distinct."""
    values = [c for c in left.columns if c not in key]
    a = left.select(*[F.col(k).alias(f"__l_{k}") for k in key], F.struct(*values).alias("__a"))
    b = right.select(*[F.col(k).alias(f"__r_{k}") for k in key], F.struct(*[F.col(c) for c in values]).alias("__b"))
    on = [F.col(f"__l_{k}") == F.col(f"__r_{k}") for k in key]
    met = a.join(b, on, "full")
    reason = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "extra").when(~F.col("__a").eqNullSafe(F.col("__b")), "different")
    return met.select(*[F.coalesce(f"__l_{k}", f"__r_{k}").alias(k) for k in key], reason.alias("reason")).where("reason IS NOT NULL")
