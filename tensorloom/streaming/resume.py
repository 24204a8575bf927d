"""Resumable copying as a stream: what a checkpoint says is done is not done again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def copy_available(spark: SparkSession, source: str, schema, target: str, checkpoint: str, files_a_batch: int = 1) -> DataFrame:
    """Copies those files of the Parquet folder `source` that the checkpoint doesn't have yet; gives the whole target.

    Each batch is committed once: a run that was stopped goes on after its last whole batch, and one that has nothing to do
    writes nothing. The target's own log says which of its files count.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(target)
