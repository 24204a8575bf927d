"""Queries on output layouts: packing, offsets, names, the index, and what validation finds in a damaged layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.operators import layout as op
from tensorloom.queries.base import INVENTORY_SQL, registry, tensors

QUERIES, SQL, query = registry()

MAX_SHARD = 500_000

#: Next-fit packing as a recursion over the tensors in order: what a shard holds so far decides on each.
_LAYOUT = f"""inv AS MATERIALIZED ({INVENTORY_SQL}),
    seq AS (SELECT name, byte_length, row_number() OVER (ORDER BY CASE dtype WHEN 'F64' THEN 8 WHEN 'I64' THEN 8 ELSE 4 END DESC, encode(name)) AS k FROM inv),
    walk AS (
        SELECT k, name, byte_length, CAST(0 AS BIGINT) AS shard, CAST(0 AS BIGINT) AS offs, byte_length AS used FROM seq WHERE k = 1
        UNION ALL
        SELECT s.k, s.name, s.byte_length,
            CASE WHEN w.used + s.byte_length > {MAX_SHARD} THEN w.shard + 1 ELSE w.shard END,
            CASE WHEN w.used + s.byte_length > {MAX_SHARD} THEN 0 ELSE w.used END,
            CASE WHEN w.used + s.byte_length > {MAX_SHARD} THEN s.byte_length ELSE w.used + s.byte_length END
        FROM walk w JOIN seq s ON s.k = w.k + 1),
    lay AS (SELECT name, byte_length, shard, offs AS "offset" FROM walk)"""


def _layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.next_fit(tensors(spark, sf_dir), MAX_SHARD)


@query(f"WITH RECURSIVE {_LAYOUT} SELECT name, byte_length, shard FROM lay")
def layout_next_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layout(spark, sf_dir).select("name", "byte_length", "shard")


@query(f"WITH RECURSIVE {_LAYOUT} SELECT * FROM lay")
def shard_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layout(spark, sf_dir)


@query(f"""WITH RECURSIVE {_LAYOUT} SELECT shard, CAST(sum(byte_length) AS BIGINT) AS payload_bytes, count(*) AS tensor_count,
    printf('model-%05d-of-%05d.safetensors', shard + 1, (SELECT max(shard) + 1 FROM lay)) AS filename FROM lay GROUP BY shard""")
def shard_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.shard_names(_layout(spark, sf_dir))


@query(f"""WITH RECURSIVE {_LAYOUT} SELECT name, printf('model-%05d-of-%05d.safetensors', shard + 1, (SELECT max(shard) + 1 FROM lay)) AS filename,
    (SELECT CAST(sum(byte_length) AS BIGINT) FROM lay) AS total_size FROM lay""")
def index_weight_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.index_entries(_layout(spark, sf_dir))


_DAMAGED = """bad AS (SELECT name, byte_length, CASE WHEN name LIKE '%.l_tax' THEN 99 ELSE shard END AS shard,
    CASE WHEN name LIKE '%key' AND "offset" > 0 THEN "offset" - 8 ELSE "offset" END AS "offset" FROM lay WHERE name NOT LIKE 'nation.%')"""


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _layout(spark, sf_dir).where(~F.col("name").like("nation.%"))
    moved = F.when(F.col("name").like("%key") & (F.col("offset") > 0), F.col("offset") - 8).otherwise(F.col("offset"))
    return rows.select("name", "byte_length", F.when(F.col("name").like("%.l_tax"), F.lit(99).cast("long")).otherwise(F.col("shard")).alias("shard"), moved.alias("offset"))


_OVERLAPS = """over AS (SELECT shard, name, next_name FROM (SELECT *, lead(name) OVER w AS next_name, lead("offset") OVER w AS next_offset FROM bad
    WINDOW w AS (PARTITION BY shard ORDER BY "offset", "offset" + byte_length, encode(name))) WHERE next_offset < "offset" + byte_length)"""


@query(f"WITH RECURSIVE {_LAYOUT}, {_DAMAGED}, {_OVERLAPS} SELECT * FROM over")
def layout_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.overlaps(_damaged(spark, sf_dir))


@query(f"""WITH RECURSIVE {_LAYOUT}, {_DAMAGED}, {_OVERLAPS},
    sh AS (SELECT shard, CAST(sum(byte_length) AS BIGINT) AS payload_bytes FROM lay GROUP BY shard)
    SELECT name AS subject, 'not in the layout' AS reason FROM inv WHERE name NOT IN (SELECT name FROM bad)
    UNION ALL SELECT name, 'in no shard' FROM bad WHERE shard NOT IN (SELECT shard FROM sh)
    UNION ALL SELECT name, 'outside its shard' FROM bad JOIN sh USING (shard) WHERE "offset" + byte_length > payload_bytes
    UNION ALL SELECT 'shard ' || shard, 'its size is not its tensors'' sum' FROM sh LEFT JOIN (SELECT shard, sum(byte_length) AS total FROM bad GROUP BY shard) USING (shard) WHERE payload_bytes <> coalesce(total, 0)
    UNION ALL SELECT name, 'goes over the next' FROM over""")
def layout_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a layout whose tensors were partly moved, sent to no shard, or lost."""
    good = _layout(spark, sf_dir)
    shards = op.shard_names(good).select("shard", "payload_bytes")
    return op.layout_violations(_damaged(spark, sf_dir), shards, tensors(spark, sf_dir))


@query(f"""WITH RECURSIVE {_LAYOUT}, small AS (SELECT name, byte_length, shard, "offset" FROM lay),
    one AS (SELECT name, byte_length, CAST(sum(byte_length) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS o FROM seq)
    SELECT s.name, s.byte_length, s.shard AS from_shard, s."offset" AS from_offset, CAST(0 AS BIGINT) AS to_shard, coalesce(one.o, 0) AS to_offset FROM small s JOIN one USING (name)""")
def repack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each tensor goes when many shards are packed into one."""
    inventory = tensors(spark, sf_dir)
    a = op.next_fit(inventory, MAX_SHARD).select("name", "byte_length", F.col("shard").alias("from_shard"), F.col("offset").alias("from_offset"))
    b = op.next_fit(inventory, 1 << 60).select("name", F.col("shard").alias("to_shard"), F.col("offset").alias("to_offset"))
    return a.join(b, "name")


@query(f"""WITH RECURSIVE {_LAYOUT}, e AS (SELECT shard, name, byte_length, '"' || name || '":{{"data_offsets":[' || "offset" || ',' || ("offset" + byte_length) || '],"dtype":"' || dtype || '","shape":[' || array_to_string(shape, ',') || ']}}' AS entry
        FROM lay JOIN (SELECT name, dtype, shape FROM inv) USING (name)),
    t AS (SELECT shard, sum(byte_length) AS payload, '{{"__metadata__":{{"format":"pt"}}' || string_agg(',' || entry, '' ORDER BY encode(name)) || '}}' AS text FROM e GROUP BY shard)
    SELECT shard, text || repeat(' ', CAST((8 - strlen(text) % 8) % 8 AS INTEGER)) AS header, CAST(8 + strlen(text) + (8 - strlen(text) % 8) % 8 + payload AS BIGINT) AS file_bytes FROM t""")
def shard_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.headers(_layout(spark, sf_dir), tensors(spark, sf_dir))


#: A layout with its files, of which the last shard's file is too short, a header lost a tensor and changed another's dtype, the
#: index moved one, and claims another total.
_FILES = """sh AS (SELECT shard, CAST(sum(byte_length) AS BIGINT) AS payload, printf('model-%05d-of-%05d.safetensors', shard + 1, (SELECT max(shard) + 1 FROM lay)) AS filename FROM lay GROUP BY shard),
    files AS (SELECT CASE WHEN shard = 1 THEN 77 ELSE shard END AS shard, filename, 800 AS header, payload, 808 + payload - CASE WHEN shard = (SELECT max(shard) FROM sh) THEN 8 ELSE 0 END AS file FROM sh),
    l AS (SELECT lay.*, dtype, shape FROM lay JOIN inv USING (name)),
    e AS (SELECT shard, name, CASE name WHEN 'part.p_size' THEN 'F32' ELSE dtype END AS dtype, shape, "offset" AS b, "offset" + byte_length AS f FROM l WHERE name <> 'orders.o_custkey' UNION ALL SELECT 0, 'nowhere', 'U8', [1], 0, 1),
    idx AS (SELECT name, CASE name WHEN 'labels.toxic' THEN 'elsewhere' ELSE filename END AS filename FROM lay JOIN sh USING (shard) WHERE name <> 'events.value')"""


@query(f"""WITH RECURSIVE {_LAYOUT}, {_FILES}
    SELECT 'shard ' || shard AS subject, 'ids are not dense' AS reason FROM files WHERE shard < 0 OR shard >= (SELECT count(*) FROM files)
    UNION ALL SELECT 'shard ' || shard, 'payload is not its tensors'' sum' FROM files LEFT JOIN (SELECT shard, sum(byte_length) AS held FROM l GROUP BY shard) USING (shard) WHERE payload <> coalesce(held, 0)
    UNION ALL SELECT 'shard ' || shard, 'file is not header and payload' FROM files WHERE file <> 8 + header + payload
    UNION ALL SELECT coalesce(l.name, e.name), CASE WHEN l.name IS NULL THEN 'in a header but not planned' WHEN e.name IS NULL THEN 'not in its header' ELSE 'another entry in the header' END
        FROM e FULL JOIN l ON e.shard = l.shard AND e.name = l.name WHERE l.name IS NULL OR e.name IS NULL OR e.dtype <> l.dtype OR e.shape <> l.shape OR b <> "offset" OR f <> "offset" + byte_length
    UNION ALL SELECT coalesce(l.name, idx.name), CASE WHEN idx.name IS NULL THEN 'not in the index' ELSE 'another shard in the index' END FROM (SELECT l.name, files.filename FROM l LEFT JOIN files USING (shard)) l FULL JOIN idx ON l.name = idx.name WHERE idx.name IS NULL OR l.filename <> idx.filename
    UNION ALL SELECT 'index', 'another total' WHERE 12345 <> (SELECT sum(byte_length) FROM l)""")
def layout_self_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a layout by itself: its shards' ids and lengths, its headers, and its index."""
    inventory = tensors(spark, sf_dir)
    good = op.next_fit(inventory, MAX_SHARD)
    names = op.shard_names(good)
    layout = good.join(inventory.select("name", "dtype", "shape"), "name")
    last = names.agg(F.max("shard").alias("last"))
    cut = F.when(F.col("shard") == F.col("last"), 8).otherwise(0)
    files = names.crossJoin(last).select(F.when(F.col("shard") == 1, F.lit(77).cast("long")).otherwise(F.col("shard")).alias("shard"), "filename", F.lit(800).alias("header_bytes"), "payload_bytes", (808 + F.col("payload_bytes") - cut).alias("file_bytes"))  # one row
    entries = layout.where("name <> 'orders.o_custkey'").select("shard", "name", F.when(F.col("name") == "part.p_size", "F32").otherwise(F.col("dtype")).alias("dtype"), "shape", F.col("offset").alias("begin"), (F.col("offset") + F.col("byte_length")).alias("end"))
    more = spark.createDataFrame([(0, "nowhere", "U8", [1], 0, 1)], "shard long, name string, dtype string, shape array<bigint>, begin long, `end` long")
    index = good.join(names.select("shard", "filename"), "shard").where("name <> 'events.value'").select("name", F.when(F.col("name") == "labels.toxic", "elsewhere").otherwise(F.col("filename")).alias("filename"))
    return op.self_violations(layout, files, entries.unionByName(more), index, spark.createDataFrame([(12345,)], "total_size long"))


@query(f"""WITH RECURSIVE {_LAYOUT} SELECT sha256(string_agg(concat_ws('|', shard, "offset", name, byte_length), chr(10) ORDER BY shard, "offset", encode(name))) AS digest FROM lay""")
def layout_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.layout_digest(_layout(spark, sf_dir))


@query(f"""WITH RECURSIVE {_LAYOUT}, sh AS (SELECT shard, sum(byte_length) AS bytes, count(*) AS n FROM lay GROUP BY shard)
    SELECT 'identity' AS method, (SELECT count(*) FROM inv) AS source_tensors, (SELECT CAST(sum(byte_length) AS BIGINT) FROM inv) AS source_bytes, CAST(sum(n) AS BIGINT) AS output_tensors, CAST(sum(bytes) AS BIGINT) AS output_bytes, count(*) AS shards, CAST(max(bytes) AS BIGINT) AS largest_shard FROM sh""")
def plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    inventory = tensors(spark, sf_dir)
    return op.plan_summary(inventory, op.next_fit(inventory, MAX_SHARD), "identity")
