"""Client-side inference on a model with a permuted vocabulary: aligning its logits, choosing tokens, comparing results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.storage import cut

BLOCK = 256  # rows of a matrix that are multiplied at once
RTOL, ATOL = 1e-4, 1e-5  # fixed values: the tolerance in which logits count as equal


def align(logits: DataFrame, perm: DataFrame, token: str = "token") -> DataFrame:
    """Logits by permuted token as logits by original token."""
    back = logits.join(perm, F.col(token) == F.col("obf"))
    return back.select(*[F.col("orig").alias(c) if c == token else F.col(c) for c in logits.columns])


def top_token(logits: DataFrame, by: list[str], token: str = "token", logit: str = "logit") -> DataFrame:
    """(*by, token, logit): the token with the largest logit; of equal ones that with the smallest number."""
    best = F.min_by(F.struct(token, logit), F.struct((-F.col(logit)).alias("l"), F.col(token).alias("t")))
    return logits.groupBy(*by).agg(best.alias("b")).select(*by, F.col(f"b.{token}").alias(token), F.col(f"b.{logit}").alias(logit))


def closeness(found: DataFrame, expected: DataFrame, key: list[str], value: str) -> DataFrame:
    """One row: n, max_difference, all_close and all_finite of values that two tables hold under the same keys."""
    a, b = found.select(*key, F.col(value).alias("a")), expected.select(*key, F.col(value).alias("b"))
    rows = a.join(b, key, "full")
    difference = F.abs(F.col("a") - F.col("b"))
    finite = lambda c: ~F.isnan(c) & (F.abs(c) != float("inf"))
    return rows.agg(
        F.count("*").alias("n"),
        F.max(difference).alias("max_difference"),
        F.coalesce(F.bool_and(F.coalesce((difference <= ATOL + RTOL * F.abs("b")) & ~F.isnan(difference), F.lit(False))), F.lit(True)).alias("all_close"),
        F.coalesce(F.bool_and(F.coalesce(finite(F.col("a")) & finite(F.col("b")), F.lit(False))), F.lit(True)).alias("all_finite"),
    )


def _blocks(rows: DataFrame, n: int) -> DataFrame:
    """Rows (orig, w) in blocks of about BLOCK."""
    block = F.pmod(F.xxhash64("orig"), F.lit(max(1, -(-n // BLOCK))))
    return rows.groupBy(block.alias("block")).agg(F.collect_list(F.struct("orig", "w")).alias("rows"))


def successors(asked: DataFrame, served: DataFrame) -> DataFrame:
    """(a, b): for each asked row (orig, w) the original token with the largest logit, the smallest of equal ones.

    Logits are the products of an asked row with every served row (orig, w), rows being arrays of whole numbers, so that sums
    are exact in any order. The query set meets the matrix in blocks of BLOCK by BLOCK; a block gives a row for each of its
    asked tokens, never its pairs.
    """
    some, every = _blocks(asked, asked.count()), _blocks(served, served.count())

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(cell: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
            tokens, w = np.asarray(cell.values.field(0)), cell.values.field(1)
            matrix = np.asarray(w.flatten()).reshape(len(tokens), -1).astype(np.int64)
            order = np.argsort(tokens)
            return tokens[order], matrix[order]

        for batch in batches:
            for mine, theirs in zip(*batch.columns, strict=True):
                (a, x), (b, y) = rows_of(mine), rows_of(theirs)
                logits = x @ y.T
                top = logits.argmax(axis=1)  # the first of equal ones, so the smallest token
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b[top]), pa.array(logits.max(axis=1))], ["a", "b", "logit"])

    pairs = some.select(F.col("rows").alias("mine")).crossJoin(every.select(F.col("rows").alias("theirs")))
    return top_token(pairs.mapInArrow(best, "a bigint, b bigint, logit bigint"), ["a"], "b").select("a", "b")


def greedy(prompts: DataFrame, matrix: DataFrame, perm: DataFrame, eos: list[int], steps: int) -> DataFrame:
    """(batch, row, tokens) that greedy decoding appends to prompts (batch, row, last), in original tokens.

    The model is run on the permuted matrix (token, w) and its logits depend on the last token. Each step encodes the last
    tokens, aligns the logits and takes the largest, the smallest original token of equal ones. All rows of a batch end after
    row 0 has appended a token of eos, or after `steps`. Each step looks at the distinct last tokens alone, and is written
    to the shared folder before the next.
    """
    served = cut(matrix.join(perm, F.col("token") == F.col("obf")).select("orig", "w"))
    state = prompts.select("batch", "row", "last", F.array().cast("array<bigint>").alias("tokens"), F.lit(False).alias("done"))
    known = None  # successors found so far
    for _ in range(steps):
        asked = state.where("NOT done").select(F.col("last").alias("orig")).distinct()
        if known is not None:
            asked = asked.join(known.select(F.col("a").alias("orig")), "orig", "left_anti")
        asked = cut(served.join(asked, "orig", "left_semi"))
        if not asked.isEmpty():
            found = successors(asked, served)
            known = cut(found if known is None else known.unionByName(found))
        met = state.join(known, F.col("last") == F.col("a"), "left")
        first = met.where("row = 0").select("batch", F.col("b").isin(eos).alias("__ends"))
        met = met.join(first, "batch", "left")
        state = cut(met.select("batch", "row", F.when(F.col("done"), F.col("last")).otherwise(F.col("b")).alias("last"), F.when(F.col("done"), F.col("tokens")).otherwise(F.concat("tokens", F.array("b"))).alias("tokens"), (F.col("done") | F.coalesce("__ends", F.lit(False))).alias("done")))
    return state.select("batch", "row", "tokens")


def equivalence(close: DataFrame, plain: DataFrame, served: DataFrame) -> DataFrame:
    """One row: whether logits are close (as `closeness` says) and the appended tokens (batch, row, tokens) the same."""
    a = plain.select("batch", "row", F.col("tokens").alias("a"))
    b = served.select("batch", "row", F.col("tokens").alias("b"))
    same = a.join(b, ["batch", "row"], "full").agg(F.coalesce(F.bool_and(F.col("a").eqNullSafe(F.col("b"))), F.lit(True)).alias("tokens_equal"))
    row = close.crossJoin(same)  # one row each
    logits = F.col("all_close") & F.col("all_finite")
    return row.select("max_difference", logits.alias("logits_equal"), "tokens_equal", (logits & F.col("tokens_equal")).alias("equivalent"))
