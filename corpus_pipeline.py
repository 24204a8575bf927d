"""A training corpus from raw documents: quality, near copies, benchmark leaks, mixture, shards.

Every stage works on all rows its predecessor kept. Between stages the rows are written to the folder that the cluster
shares and read again, as each operator passes over them more than once.

All stages but the last hand on the columns of documents as they are, also those that are named like an operator's own; the
last one replaces such columns by its own. Null and empty texts count as empty: the classifier scores them like others, they
are copies of nothing, hold no leak, and are in the mix once if they have no words. Texts of any length are read whole. Rows
that are repeated are rows of their own, except that near copies take rows with one id as one document. An empty table
stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tensorloom.llm import mixing, quality as scoring
from tensorloom.llm.common import set_aside, shared_path, table
from tensorloom.llm.decontaminate import decontaminate
from tensorloom.llm.near_dedup import near_dedup
from tensorloom.llm.sharding import shard_by_bytes


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of these documents, doesn't reject."""
    rows, restored = set_aside(docs, ("held_out", *scoring.OUT))
    return restored(scoring.classify(rows, table(spark, sf_dir, "labels")).where("predicted = 1"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return near_dedup(docs, width=5, percent=80)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources to their target weights takes it, three times at most."""
    rows, restored = set_aside(docs, mixing.OUT)
    return restored(mixing.expand(mixing.mix(rows), rows.columns))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, and each row's place in one of 16 contiguous shards of near equal bytes."""
    return shard_by_bytes(docs, 16)


STAGES = [("quality", quality), ("near_copies", near_copies), ("leaks", leaks), ("mixture", mixture), ("shards", shards)]

#: SQL can express neither the classifier nor the near copies.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
