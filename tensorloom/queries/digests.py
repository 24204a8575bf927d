"""Queries on ordered digests: rows, tensors, whole artifacts, and the commitment to a permutation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.operators import digests as op
from tensorloom.operators import permutation as perm_op
from tensorloom.queries.base import COLUMNS, INVENTORY_SQL, PERM_SQL, matrix, permutation, registry, table, tensors

QUERIES, SQL, query = registry()

CONFIG = '{"model_type":"llama"}'
_ROWS = "SELECT vec_id AS row_id, sha256(array_to_string(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT)), ',')) AS digest FROM embeddings"
#: The tree of a tensor's digests: blocks of 4096 rows, then of 4096 blocks, then all.
_TREE = """SELECT sha256(string_agg(digest, '' ORDER BY s)) AS digest FROM (SELECT s, sha256(string_agg(digest, '' ORDER BY b)) AS digest FROM
    (SELECT row_id // 4096 AS b, row_id // 4096 // 4096 AS s, sha256(string_agg(digest, '' ORDER BY row_id)) AS digest FROM ({rows}) GROUP BY ALL) GROUP BY s)"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.row_digests(matrix(spark, sf_dir), "row_id", op.vector_text("v"))


@query(_ROWS)
def row_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir)


@query(_TREE.format(rows=_ROWS))
def tensor_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.tensor_digest(_rows(spark, sf_dir))


@query(f"""WITH a AS ({_TREE.format(rows=_ROWS)}), p AS ({PERM_SQL}), m AS (SELECT p.obf AS row_id, r.digest FROM ({_ROWS}) r JOIN p ON r.row_id = p.orig), b AS ({_TREE.format(rows="SELECT * FROM m")})
    SELECT a.digest AS before, b.digest AS after, a.digest <> b.digest AS changed FROM a, b""")
def permutation_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding's digest before and after the permutation: equal digests would be an error."""
    before = op.tensor_digest(_rows(spark, sf_dir)).toDF("before")
    moved = perm_op.permute_rows(_rows(spark, sf_dir), permutation(spark, sf_dir), "row_id")
    return before.crossJoin(op.tensor_digest(moved).toDF("after")).withColumn("changed", F.col("before") != F.col("after"))  # one row each


#: Tables that have a key of whole numbers, which orders the rows of their tensors.
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "embeddings": "vec_id", "documents": "doc_id", "pages": "page_id", "benchmark": "item_id"}


def _payload_sql() -> str:
    """(name, row_id, digest) of every row of every tensor of these tables; numbers as whole numbers or millionths."""
    parts = []
    for entry in COLUMNS.replace("\n", " ").split(","):
        name, dtype = entry.split()
        shard, column = name.split(".")
        if shard in KEYS and name != "embeddings.embedding":
            value = f"CAST(round({column} * 1000000) AS BIGINT)" if dtype == "F64" else column
            parts.append(f"SELECT '{name}' AS name, {KEYS[shard]} AS row_id, sha256(coalesce(CAST({value} AS VARCHAR), 'null')) AS digest FROM {shard}")
    parts.append(f"SELECT 'embeddings.embedding', row_id, digest FROM ({_ROWS})")
    return " UNION ALL ".join(parts)


def _payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As _payload_sql: each table is read once, and gives a row for each of its values."""
    out = None
    for entry in KEYS.items():
        shard, key = entry
        rows = table(spark, sf_dir, shard)
        cells = []
        for f in rows.schema:
            kind = f.dataType.simpleString()
            text = F.round(F.col(f.name) * 1000000).cast("long") if kind == "double" else F.col(f.name)
            if kind in ("int", "bigint", "double"):
                cells.append(F.struct(F.lit(f"{shard}.{f.name}").alias("name"), F.coalesce(text.cast("string"), F.lit("null")).alias("text")))
            elif kind == "array<float>":
                cells.append(F.struct(F.lit(f"{shard}.{f.name}").alias("name"), op.vector_text(f.name).alias("text")))
        part = rows.select(F.col(key).cast("long").alias("row_id"), F.inline(F.array(*cells))).select("name", "row_id", F.sha2("text", 256).alias("digest"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH inv AS MATERIALIZED ({INVENTORY_SQL}), r AS ({_payload_sql()}),
    x AS (SELECT name, row_id // 4096 AS b, sha256(string_agg(digest, '' ORDER BY row_id)) AS digest FROM r GROUP BY ALL),
    y AS (SELECT name, b // 4096 AS s, sha256(string_agg(digest, '' ORDER BY b)) AS digest FROM x GROUP BY ALL), z AS (SELECT name, sha256(string_agg(digest, '' ORDER BY s)) AS digest FROM y GROUP BY name),
    t AS (SELECT name, concat_ws('|', name, dtype, array_to_string(shape, ','), byte_length, digest) AS line FROM inv JOIN z USING (name))
    SELECT sha256('{CONFIG}' || chr(10) || string_agg(line, chr(10) ORDER BY encode(name))) AS fingerprint FROM t""")
def artifact_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of all tensors of the tables that have a key: names, dtypes, shapes and every value; shards have no part in it."""
    return op.artifact_digest(CONFIG, tensors(spark, sf_dir).join(op.tensor_digest(_payload(spark, sf_dir), by=("name",)), "name"))


@query(f"""WITH p AS ({PERM_SQL}), f AS ({_TREE.format(rows="SELECT orig AS row_id, sha256(CAST(obf AS VARCHAR)) AS digest FROM p")}), b AS ({_TREE.format(rows="SELECT obf AS row_id, sha256(CAST(orig AS VARCHAR)) AS digest FROM p")})
    SELECT sha256(concat_ws('|', 'token-permutation', '0.1', 'fp', 'nonce', (SELECT count(*) FROM p), f.digest, b.digest)) AS commitment FROM f, b""")
def secret_commitment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.commitment(permutation(spark, sf_dir), "token-permutation", "0.1", "fp", "nonce")
