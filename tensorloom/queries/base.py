"""What the query modules share: reading the driver's tables, and the projection of tables onto tensors."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.operators.inventory import columns_as_tensors
from tensorloom.operators.permutation import keyed_permutation

SEED = "vocabulary"
#: Tables whose numeric columns are taken as tensors.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "documents", "labels", "conversations", "pages", "benchmark")

#: The permutation of the embedding's rows, in SQL.
PERM_SQL = f"SELECT vec_id AS orig, CAST(row_number() OVER (ORDER BY md5('{SEED}:' || vec_id), vec_id) - 1 AS BIGINT) AS obf FROM embeddings"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding matrix as rows (row_id, v)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("v"))


def permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_permutation(table(spark, sf_dir, "embeddings").select("vec_id"), SEED)


def registry():
    """The queries of a module by name, the SQL of those that SQL can express, and the decorator that adds to both."""
    queries: dict = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return add

    return queries, sql, query


def tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory of every numeric column of every table; the tables' footers are read side by side."""
    with ThreadPoolExecutor(len(TABLES)) as pool:
        found = list(pool.map(lambda name: table(spark, sf_dir, name), TABLES))
    return columns_as_tensors(spark, dict(zip(TABLES, found, strict=True)))


#: The numeric columns of the driver's tables and their dtypes.
COLUMNS = """region.r_regionkey I32, nation.n_nationkey I32, nation.n_regionkey I32, customer.c_custkey I64, customer.c_nationkey I32, customer.c_acctbal F64,
supplier.s_suppkey I64, supplier.s_nationkey I32, supplier.s_acctbal F64, part.p_partkey I64, part.p_size I32, part.p_retailprice F64,
orders.o_orderkey I64, orders.o_custkey I64, orders.o_totalprice F64, lineitem.l_orderkey I64, lineitem.l_partkey I64, lineitem.l_suppkey I64,
lineitem.l_linenumber I32, lineitem.l_quantity F64, lineitem.l_extendedprice F64, lineitem.l_discount F64, lineitem.l_tax F64,
events.event_id I64, events.user_id I64, events.value F64, embeddings.vec_id I64, embeddings.embedding F32, embeddings.label I32,
documents.doc_id I64, documents.n_chars I64, labels.doc_id I64, labels.quality I32, labels.toxic I32,
conversations.conv_id I64, conversations.turn I64, pages.page_id I64, benchmark.item_id I64"""


def _inventory_sql() -> str:
    parts = []
    for entry in COLUMNS.replace("\n", " ").split(","):
        name, dtype = entry.split()
        shard = name.split(".")[0]
        shape = f"[(SELECT count(*) FROM {shard})" + (", 64]" if name == "embeddings.embedding" else "]")
        parts.append(f"SELECT '{name}' AS name, '{dtype}' AS dtype, {shape} AS shape, '{shard}' AS shard")
    return "SELECT *, CAST(list_product(shape) * CASE dtype WHEN 'F64' THEN 8 WHEN 'I64' THEN 8 ELSE 4 END AS BIGINT) AS byte_length FROM (" + " UNION ALL ".join(parts) + ")"


INVENTORY_SQL = _inventory_sql()
