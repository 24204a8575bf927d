"""Queries on inventories: what tensors there are, how large they are, and what a plan on them would hold in memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.functions import scalars
from tensorloom.operators import inventory as op
from tensorloom.operators import tensors as tf
from tensorloom.queries.base import INVENTORY_SQL, registry, table, tensors

QUERIES, SQL, query = registry()

_INV = f"inv AS ({INVENTORY_SQL})"


@query(INVENTORY_SQL)
def tensor_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensors(spark, sf_dir)


@query(f"WITH {_INV} SELECT name, dtype, CAST(list_product(shape) AS BIGINT) AS elements, CAST(CASE dtype WHEN 'F64' THEN 8 WHEN 'I64' THEN 8 ELSE 4 END AS BIGINT) AS width, byte_length FROM inv")
def element_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.elements(tensors(spark, sf_dir))


@query(f"WITH {_INV} SELECT count(*) AS tensor_count, CAST(sum(byte_length) AS BIGINT) AS payload_bytes, string_agg(DISTINCT shard, ',' ORDER BY shard) AS shards FROM inv")
def inspect_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.inspect(tensors(spark, sf_dir))


@query(f"""WITH {_INV}, a AS (SELECT count(*) AS n, CAST(sum(byte_length) AS BIGINT) AS payload, (SELECT count(*) FROM embeddings) AS vocab FROM inv),
    b AS (SELECT *, CAST(1048576 AS BIGINT) AS limit_bytes, CAST(256 * 2 * n + 8 * vocab AS BIGINT) AS metadata_bytes FROM a),
    c AS (SELECT *, CAST(least(limit_bytes - metadata_bytes, 4194304) AS BIGINT) AS buffer_bytes FROM b)
    SELECT limit_bytes, metadata_bytes, limit_bytes > metadata_bytes AS fits, buffer_bytes, metadata_bytes + buffer_bytes AS peak_bytes,
        least(buffer_bytes, payload) AS input_buffer_bytes, least(buffer_bytes, payload) AS output_buffer_bytes, CAST(8 * vocab AS BIGINT) AS scratch_bytes FROM c""")
def memory_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a plan of all tensors with the embedding's vocabulary would hold under a limit of 1 MiB."""
    return op.memory_estimate(tensors(spark, sf_dir), 1 << 20, table(spark, sf_dir, "embeddings").count())


@query(f"""WITH {_INV}, o AS (SELECT *, CASE WHEN len(shape) = 2 AND shape[2] = 64 THEN byte_length // 64 * 70 ELSE byte_length END AS wide FROM inv)
    SELECT count(*) AS source_tensors, CAST(sum(byte_length) AS BIGINT) AS source_bytes, count(*) AS output_tensors, CAST(sum(wide) AS BIGINT) AS output_bytes FROM o""")
def transform_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a transform that pads every matrix 64 wide by an expansion of 3."""
    source = tensors(spark, sf_dir)
    return op.transform_totals(source, op.with_sizes(tf.padded_inventory(source, 64, 3)))


@query(f"""WITH {_INV}, r AS (SELECT CASE WHEN shard = 'part' THEN name || '.source.weight' WHEN shard = 'orders' THEN name || '.source.weights' ELSE name END AS name, byte_length FROM inv)
    SELECT regexp_replace(name, '\\.source\\.weight$', '.target.weight') AS name, byte_length FROM r""")
def rename_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output names where a part of the tensors ends in .source.weight and some only nearly so."""
    named = F.when(F.col("shard") == "part", F.concat("name", F.lit(".source.weight"))).when(F.col("shard") == "orders", F.concat("name", F.lit(".source.weights"))).otherwise(F.col("name"))
    return tf.rename_outputs(tensors(spark, sf_dir).withColumn("name", named)).select("name", "byte_length")


@query(f"WITH {_INV} SELECT name, byte_length, CAST(NULL AS VARCHAR) AS alias_of FROM inv UNION ALL SELECT 'lm_head.weight', byte_length, name FROM inv WHERE name = 'embeddings.embedding'")
def tied_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory with a head that is a view of the embedding."""
    return tf.with_alias(tensors(spark, sf_dir), "embeddings.embedding", "lm_head.weight").select("name", "byte_length", "alias_of")


_SIZES = ("4GiB", "256MiB", " 12 KiB", "7 GB", "100MB", "9KB", "15 B", "42", "1.5GiB", "3gib", "-1", "", "99999999999GiB", "12 XB", "10000000000GiB")


@query(f"""WITH s AS (SELECT doc_id, list_extract({list(_SIZES)}, doc_id % {len(_SIZES)} + 1) AS size FROM documents),
    p AS (SELECT *, regexp_extract(trim(size), '^([0-9]+) *(GiB|MiB|KiB|GB|MB|KB|B|)$', 1) AS n, regexp_extract(trim(size), '^([0-9]+) *(GiB|MiB|KiB|GB|MB|KB|B|)$', 2) AS u FROM s),
    b AS (SELECT *, CAST(nullif(n, '') AS HUGEINT) * CASE u WHEN 'GiB' THEN 1073741824 WHEN 'MiB' THEN 1048576 WHEN 'KiB' THEN 1024 WHEN 'GB' THEN 1000000000 WHEN 'MB' THEN 1000000 WHEN 'KB' THEN 1000 ELSE 1 END AS bytes FROM p)
    SELECT doc_id, size, CASE WHEN bytes <= 18446744073709551615 THEN CAST(bytes AS DECIMAL(20, 0)) END AS bytes FROM b""")
def parse_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = F.array(*[F.lit(s) for s in _SIZES])
    rows = table(spark, sf_dir, "documents").select("doc_id", F.element_at(sizes, (F.col("doc_id") % len(_SIZES) + 1).cast("int")).alias("size"))
    return rows.withColumn("bytes", scalars.parse_size(F.col("size")))


@query("""SELECT event_id, lower(hex(encode(props))) AS encoded, decode(unhex(hex(encode(props)))) = props AS same,
    regexp_matches(CASE WHEN event_id % 3 = 0 THEN sha256(props) WHEN event_id % 3 = 1 THEN upper(sha256(props)) ELSE substr(sha256(props), 1, 63) END, '^[0-9a-f]{64}$') AS is_nonce FROM events""")
def hex_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hexadecimal there and back, and the strict form that a nonce must have."""
    digest = F.sha2("props", 256)
    shown = F.when(F.col("event_id") % 3 == 0, digest).when(F.col("event_id") % 3 == 1, F.upper(digest)).otherwise(F.substring(digest, 1, 63))
    encoded = scalars.hex_encode(F.col("props").cast("binary"))
    return table(spark, sf_dir, "events").select("event_id", encoded.alias("encoded"), (F.unhex(encoded).cast("string") == F.col("props")).alias("same"), scalars.is_hex_32(shown).alias("is_nonce"))


@query("SELECT event_id, least(greatest(user_id * 100000 - 5000000, 1), 4194304) AS chunk FROM events")
def chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of a copying step where so many bytes are available."""
    return table(spark, sf_dir, "events").select("event_id", scalars.chunk_bytes(F.col("user_id") * 100000 - 5000000).alias("chunk"))
