"""The layout of an output: which tensor goes to which shard, and where in it.

An inventory has one row a tensor, thousands at most, whatever the tensors' sizes, so it is packed by one fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.errors import InvalidPlan
from tensorloom.functions.scalars import dtype_width

_PLACED = "array<struct<name: string, byte_length: bigint, shard: bigint, offset: bigint>>"


def next_fit(inventory: DataFrame, max_shard: int) -> DataFrame:
    """(name, byte_length, shard, offset): tensors by falling alignment, then name, packed into shards one after another.

    A shard is closed when the next tensor would take it over max_shard, and right after a tensor that is larger than
    that alone. A shard's tensors follow each other from 0.
    """
    if max_shard <= 0:
        raise InvalidPlan("the largest shard must have a size above zero")
    ordered = inventory.select(F.struct((-dtype_width(F.col("dtype"))).alias("order"), "name", "byte_length").alias("t"))
    ordered = ordered.agg(F.array_sort(F.collect_list("t")).alias("ts"))
    limit = F.lit(max_shard).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("used"), F.lit(True).alias("empty"), F.array().cast(_PLACED).alias("placed"))

    def step(acc: Column, t: Column) -> Column:
        size = t["byte_length"]
        closes = ~acc["empty"] & (acc["used"] + size > limit)
        shard = F.when(closes, acc["shard"] + 1).otherwise(acc["shard"])
        used = F.when(closes, F.lit(0).cast("long")).otherwise(acc["used"])
        full = size > limit
        placed = F.concat(acc["placed"], F.array(F.struct(t["name"].alias("name"), size.alias("byte_length"), shard.alias("shard"), used.alias("offset"))))
        return F.struct(F.when(full, shard + 1).otherwise(shard).alias("shard"), F.when(full, F.lit(0).cast("long")).otherwise(used + size).alias("used"), full.alias("empty"), placed.alias("placed"))

    return ordered.select(F.inline(F.aggregate("ts", start, step, lambda acc: acc["placed"])))


def shard_names(layout: DataFrame) -> DataFrame:
    """(shard, payload_bytes, tensor_count, filename); one shard alone has a plain name."""
    shards = layout.groupBy("shard").agg(F.sum("byte_length").cast("long").alias("payload_bytes"), F.count("*").alias("tensor_count"))
    total = layout.agg((F.max("shard") + 1).alias("total"))
    name = F.when(F.col("total") == 1, "model.safetensors").otherwise(F.format_string("model-%05d-of-%05d.safetensors", F.col("shard") + 1, F.col("total")))
    return shards.crossJoin(F.broadcast(total)).select("shard", "payload_bytes", "tensor_count", name.alias("filename"))  # one row


def index_entries(layout: DataFrame) -> DataFrame:
    """(name, filename, total_size): the weight map of an index; no rows where one shard needs no index."""
    names = shard_names(layout)
    total = layout.agg(F.sum("byte_length").cast("long").alias("total_size"), F.max("shard").alias("last")).where("last > 0")
    return layout.join(names, "shard").crossJoin(F.broadcast(total)).select("name", "filename", "total_size")  # one row


def headers(layout: DataFrame, inventory: DataFrame) -> DataFrame:
    """(shard, header, file_bytes): the header text of each shard's file, keys sorted, padded to a multiple of eight bytes."""
    rows = layout.join(inventory.select("name", "dtype", "shape"), "name")
    span = F.array("offset", F.col("offset") + F.col("byte_length"))
    quoted = F.to_json(F.array("name"))
    quoted = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    entry = F.concat(quoted, F.lit(":"), F.to_json(F.struct(span.alias("data_offsets"), "dtype", "shape")))
    listed = rows.groupBy("shard").agg(F.sum("byte_length").alias("payload"), F.array_sort(F.collect_list(F.struct("name", entry.alias("entry")))).alias("entries"))
    text = F.concat(F.lit('{"__metadata__":{"format":"pt"}'), F.array_join(F.transform("entries", lambda e: F.concat(F.lit(","), e["entry"])), ""), F.lit("}"))
    size = F.octet_length("text")
    padded = listed.withColumn("text", text).withColumn("header", F.concat("text", F.repeat(F.lit(" "), F.pmod(-size, F.lit(8)))))
    return padded.select("shard", "header", (8 + F.octet_length("header") + F.col("payload")).cast("long").alias("file_bytes"))


def overlaps(layout: DataFrame) -> DataFrame:
    """(shard, name, next_name) where a tensor goes over the place of the next of its shard."""
    after = Window.partitionBy("shard").orderBy("offset", F.col("offset") + F.col("byte_length"), "name")
    rows = layout.withColumns({"next_offset": F.lead("offset").over(after), "next_name": F.lead("name").over(after)})
    return rows.where("next_offset < offset + byte_length").select("shard", "name", "next_name")


def layout_violations(layout: DataFrame, shards: DataFrame, inventory: DataFrame) -> DataFrame:
    """(subject, reason): what a stored layout (name, byte_length, shard, offset) and its shards (shard, payload_bytes) break."""
    l, s, i = layout.alias("l"), shards.alias("s"), inventory.alias("i")
    met = l.join(i, F.col("l.name") == F.col("i.name"), "full")
    found = met.select(
        F.coalesce("l.name", "i.name").alias("subject"),
        F.when(F.col("i.name").isNull(), "not in the inventory").when(F.col("l.name").isNull(), "not in the layout").when(F.col("l.byte_length") != F.col("i.byte_length"), "another size than the inventory's").alias("reason"),
    ).where("reason IS NOT NULL")
    outside = l.join(s, F.col("l.shard") == F.col("s.shard"), "left").select(F.col("l.name").alias("subject"), F.when(F.col("s.shard").isNull(), "in no shard").when(F.col("l.offset") + F.col("l.byte_length") > F.col("s.payload_bytes"), "outside its shard").alias("reason")).where("reason IS NOT NULL")
    sums = layout.groupBy("shard").agg(F.sum("byte_length").alias("total"))
    totals = shards.join(sums, "shard", "left").where(F.col("payload_bytes") != F.coalesce("total", F.lit(0))).select(F.concat(F.lit("shard "), F.col("shard").cast("string")).alias("subject"), F.lit("its size is not its tensors' sum").alias("reason"))
    over = overlaps(layout).select(F.col("name").alias("subject"), F.lit("goes over the next").alias("reason"))
    return found.unionByName(outside).unionByName(totals).unionByName(over)


def self_violations(layout: DataFrame, shards: DataFrame, entries: DataFrame, index: DataFrame, claimed: DataFrame) -> DataFrame:
    """(subject, reason): where a stored layout is not sound by itself, before any file is there.

    layout: name, dtype, shape, byte_length, shard, offset; shards: shard, filename, header_bytes, payload_bytes, file_bytes;
    entries (of headers): shard, name, dtype, shape, begin, end; index: name, filename; claimed: total_size (a row or none).
    """
    shard = lambda c="shard": F.concat(F.lit("shard "), F.col(c).cast("string"))
    total = shards.agg(F.count("*").alias("n"))
    numbered = shards.crossJoin(F.broadcast(total))  # one row
    out = numbered.where("shard < 0 OR shard >= n").select(shard().alias("subject"), F.lit("ids are not dense").alias("reason"))
    twice = shards.groupBy("shard").count().where("count > 1").select(shard().alias("subject"), F.lit("id used twice").alias("reason"))
    sums = layout.groupBy(F.col("shard").alias("of")).agg(F.sum("byte_length").alias("held"), F.count("*").alias("tensors"))
    met = shards.join(sums, F.col("shard") == F.col("of"), "left")
    sizes = met.select(shard().alias("subject"), F.explode(F.array_compact(F.array(F.when(F.col("payload_bytes") != F.coalesce("held", F.lit(0)), "payload is not its tensors' sum"), F.when(F.col("file_bytes") != 8 + F.col("header_bytes") + F.col("payload_bytes"), "file is not header and payload")))).alias("reason"))
    e, l = entries.alias("e"), layout.alias("l")
    held = e.join(l, (F.col("e.shard") == F.col("l.shard")) & (F.col("e.name") == F.col("l.name")), "full")
    differs = (F.col("e.dtype") != F.col("l.dtype")) | (F.col("e.shape") != F.col("l.shape")) | (F.col("e.begin") != F.col("l.offset")) | (F.col("e.end") != F.col("l.offset") + F.col("l.byte_length"))
    headers = held.select(F.coalesce("l.name", "e.name").alias("subject"), F.when(F.col("l.name").isNull(), "in a header but not planned").when(F.col("e.name").isNull(), "not in its header").when(differs, "another entry in the header").alias("reason"))
    names = layout.join(shards.select(F.col("shard").alias("of"), F.col("filename").alias("file")), F.col("shard") == F.col("of"), "left")
    i = index.select(F.col("name").alias("i_name"), F.col("filename").alias("i_file"))
    mapped = names.join(i, F.col("name") == F.col("i_name"), "full").select(F.coalesce("name", "i_name").alias("subject"), F.when(F.col("name").isNull(), "in the index but not planned").when(F.col("i_name").isNull(), "not in the index").when(F.col("file") != F.col("i_file"), "another shard in the index").alias("reason"))
    actual = layout.agg(F.coalesce(F.sum("byte_length"), F.lit(0)).alias("actual"))
    totals = claimed.crossJoin(F.broadcast(actual)).where("total_size IS DISTINCT FROM actual").select(F.lit("index").alias("subject"), F.lit("another total").alias("reason"))  # one row
    for part in (twice, sizes, headers.where("reason IS NOT NULL"), mapped.where("reason IS NOT NULL"), totals):
        out = out.unionByName(part)
    return out


def layout_digest(layout: DataFrame) -> DataFrame:
    """One row (digest) of a layout (name, byte_length, shard, offset): SHA-256 of its places in order of shard and offset."""
    line = F.concat_ws("|", F.col("shard").cast("string"), F.col("offset").cast("string"), "name", F.col("byte_length").cast("string"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("shard", "offset", "name", line.alias("line")))), lambda s: s["line"]), "\n")
    return layout.agg(F.sha2(lines, 256).alias("digest"))


def plan_summary(inventory: DataFrame, layout: DataFrame, method: str) -> DataFrame:
    """One row: what a plan of the method on an inventory (name, byte_length) comes to, whose outputs have this layout."""
    source = inventory.agg(F.count("*").alias("source_tensors"), F.coalesce(F.sum("byte_length"), F.lit(0)).cast("long").alias("source_bytes"))
    shards = layout.groupBy("shard").agg(F.sum("byte_length").alias("bytes"), F.count("*").alias("tensors"))
    output = shards.agg(F.coalesce(F.sum("tensors"), F.lit(0)).cast("long").alias("output_tensors"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("output_bytes"), F.count("*").alias("shards"), F.coalesce(F.max("bytes"), F.lit(0)).cast("long").alias("largest_shard"))
    return source.crossJoin(output).withColumn("method", F.lit(method))  # one row each
