"""Contiguous shards of near equal bytes, cut from global prefix sums.

Rows are put in order of (id, crc32 of the text). Quantiles of the id split that order into ranges, and the crc32 those of
an id that many rows have, or that lack one; one exchange deals the rows to their ranges, where a running sum gives each row its place; the totals of the ranges, one row each, give
every range its start. A row goes to the shard in which the middle of its bytes falls. Only built-in functions are used.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.llm.common import text_of, without

OUT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
RANGE_ROWS, MOST_RANGES = 50_000, 10_000  # rows of a range, until there are so many ranges


def _range_of(bounds: list[int], value: Column) -> Column:
    """How many bounds are at most the value: found among every step-th one first, then among the step that follows."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*[F.lit(b[0]).cast("long") for b in blocks])
    rest = F.array(*[F.array(*[F.lit(x).cast("long") for x in b]) for b in blocks])
    block = F.size(F.filter(heads, lambda b: b <= value))
    inner = F.size(F.filter(F.element_at(rest, F.greatest(block, F.lit(1))), lambda b: b <= value))
    return F.coalesce(F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + inner), F.lit(0))


def _spread_ids(marks: list[int], nulls: int, n: int, ranges: int) -> tuple[list[int], dict[int | None, int]]:
    """Bounds of the ranges, and into how many parts those of ids that fill a range or more are split (None: rows without one)."""
    times = Counter(marks)
    parts: dict[int | None, int] = {v: k + 1 for v, k in times.items() if k > 1}  # two quantiles alike: a range's worth of rows
    bounds = sorted({*times, *(v + 1 for v in parts)})
    if nulls * ranges > n:
        parts[None] = nulls * ranges // n + 1
    return bounds, parts


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """docs with size, text_crc32, law ('bytes'), shard, slot and grown_shard (null under this law).

    size: the text's UTF-8 bytes (null: none) plus 1. slot: the row's number in its shard, from 0 without gaps.
    Shards are contiguous in (id, crc32) order and differ from total / n_shards by one row's size at most. Rows without
    an id come first. Repeated rows are rows of their own and take neighbouring slots. An empty table gives none.
    Input columns named like an output column are replaced. Ids are whole numbers; others raise an error. `ranges` bounds the
    rows that one task sorts, also where a third of all rows have one id or none, but for rows that are alike in id, text
    and size; the totals of the ranges are the only thing that is broadcast. By default there
    are as many as shuffle partitions, or as make RANGE_ROWS rows each, up to MOST_RANGES.
    """
    rows = without(docs, *OUT).withColumns({"size": F.octet_length(text_of(text_col)).cast("long") + 1, "text_crc32": F.crc32(text_of(text_col).cast("binary"))})
    key = F.col(id_col).cast("long")
    n, nulls = docs.agg(F.count("*"), F.count_if(F.col(id_col).isNull())).first()
    if ranges is None:
        ranges = max(32, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, n // RANGE_ROWS))
    marks = F.percentile_approx(key, F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), F.lit(50 * ranges))
    bounds, parts = _spread_ids(docs.agg(marks.alias("m")).first()["m"] or [], nulls, n, ranges)  # at most 2 * ranges numbers
    most, without_id = max(parts.values(), default=1), parts.pop(None, 1)
    if parts:  # a row for every hot id, half of the ranges at most
        hot = docs.sparkSession.createDataFrame(list(parts.items()), "__hot long, __parts long")
        rows = rows.join(F.broadcast(hot), key == F.col("__hot"), "left")
        part = F.when(key.isNull(), without_id).otherwise(F.coalesce("__parts", F.lit(1)))
    else:
        part = F.when(key.isNull(), without_id).otherwise(1)
    part = F.floor(F.col("text_crc32") * part / F.lit(float(1 << 32)))
    base = F.when(key.isNull(), F.lit(0)).otherwise(_range_of(bounds, key) + 1)
    rows = rows.withColumn("__range", base.cast("long") * most + part.cast("long"))

    upto = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    starts = rows.groupBy("__range").agg(F.sum("size").alias("__bytes")).select("__range", F.coalesce(F.sum("__bytes").over(upto), F.lit(0)).alias("__start"), F.sum("__bytes").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__total"))
    order = Window.partitionBy("__range").orderBy(F.col(id_col).asc_nulls_first(), "text_crc32", "size")
    placed = (
        rows.repartition(ranges, "__range")
        .withColumns({"__before": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"), "__row": F.row_number().over(order)})
        .join(F.broadcast(starts), "__range")
    )
    middle = F.col("__start") + F.col("__before") + F.col("size") / F.lit(2.0)
    placed = placed.withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / F.col("__total"))).cast("int"))

    part = placed.groupBy("__range", "shard").agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))  # ranges + shards rows at most
    earlier = Window.partitionBy("shard").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = part.select("__range", "shard", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__base"))
    numbered = placed.join(F.broadcast(base), ["__range", "shard"]).withColumns({"law": F.lit("bytes"), "slot": (F.col("__base") + F.col("__row")).cast("long"), "grown_shard": F.lit(None).cast("int")})
    kept = [c for c in docs.columns if c.lower() not in OUT]
    return numbered.select(*[F.col(f"`{c}`") for c in kept], *OUT)
