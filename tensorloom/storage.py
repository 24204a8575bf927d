"""The folder that the machines of a cluster share: where lineage is cut and tables between steps are kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tensorloom.errors import Unsupported


def shared_root(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only on one machine (a local master) a temporary folder may take its place."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise Unsupported("a cluster needs spark.checkpoint.dir, a folder that its machines share")
        root = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        context.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for a written table or a folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder; its lineage ends there, so they survive the loss of executors."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)
