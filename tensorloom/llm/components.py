"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import cut, narrow

ONE_TASK = 1 << 19  # links that one task may hold


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, label) for every node of links (a, b), label being the least node that links lead to. Nulls are no nodes.

    Up to one_task links (a bound on memory, 8 MB of integers) go through one executor task; more are labelled in rounds over
    the cluster. Both give the same labels.
    """
    links = cut(links.select("a", "b").where("a <> b").distinct())
    n = links.count()
    integer = links.schema["a"].dataType.simpleString() in ("bigint", "int")
    return cut(_joined(links)) if n <= one_task and integer else _in_rounds(narrow(links, n), n)


def _joined(links: DataFrame) -> DataFrame:
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)], axis=1) for b in batches]
        if not pairs:
            return
        nodes, flat = np.unique(np.concatenate(pairs), return_inverse=True)
        above = list(range(len(nodes)))
        for a, b in flat.reshape(-1, 2).tolist():
            while above[a] != a:
                above[a] = a = above[above[a]]
            while above[b] != b:
                above[b] = b = above[above[b]]
            above[max(a, b)] = min(a, b)
        for i, x in enumerate(above):  # what is above is less, so it is done already
            above[i] = above[x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[np.array(above)])], ["node", "label"])

    kind = links.schema["a"].dataType.simpleString()
    return links.coalesce(1).mapInArrow(join, f"node {kind}, label {kind}")


def _in_rounds(links: DataFrame, n: int) -> DataFrame:
    """Each round takes the least label among a node and its neighbours, then the label of that label, so that the number
    of rounds grows with the logarithm of the longest way. Labels are summed up before they are exchanged; every round's
    labels are written to the shared folder, which is also how the end is seen.
    """
    both = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(narrow(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), n))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("__near"))
        low = labels.join(near, "node").select("node", F.col("label").alias("__was"), F.least("label", "__near").alias("label"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("__far"))
        step = low.join(far, "label", "left").select("node", "__was", F.least("label", F.coalesce("__far", "label")).alias("label"))
        step = cut(narrow(step, n))
        done = step.where(F.col("__was") != F.col("label")).isEmpty()
        labels = step.select("node", "label")
        if done:
            return labels
