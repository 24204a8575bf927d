"""Permutations of vocabulary rows and of what refers to them.

A permutation is a table perm(orig, obf): row `orig` of a matrix becomes row `obf`. Joins carry no hints: the planner
broadcasts a permutation only under its size threshold, and shuffles a larger one.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.errors import InvalidPlan
from tensorloom.functions.ranking import with_rank


def keyed_permutation(ids: DataFrame, seed: str) -> DataFrame:
    """perm(orig, obf) of a one-column table of distinct ids: their order by md5(seed:id). The same seed gives the same."""
    (name,) = ids.columns
    keyed = ids.select(F.col(name).alias("orig")).withColumn("__digest", F.md5(F.concat(F.lit(f"{seed}:"), F.col("orig").cast("string"))))
    return with_rank(keyed, "obf", F.substring("__digest", 1, 3), F.col("__digest"), F.col("orig")).select("orig", "obf")


def secret_permutation(spark: SparkSession, size: int) -> tuple[DataFrame, str]:
    """A permutation of 0 .. size - 1 drawn with the system's randomness, never the identity, and its 32-byte nonce in hex."""
    if size < 2:
        raise InvalidPlan("a permutation needs two rows or more")
    nonce = secrets.token_hex(32)
    while True:
        perm = keyed_permutation(spark.range(size).toDF("id"), secrets.token_hex(32)).persist()
        if not perm.where("orig <> obf").isEmpty():
            return perm, nonce
        perm.unpersist()


def inverse(perm: DataFrame) -> DataFrame:
    return perm.select(F.col("obf").alias("orig"), F.col("orig").alias("obf"))


def bijection_report(perm: DataFrame) -> DataFrame:
    """One row: n, whether both sides are exactly 0 .. n - 1, and whether the permutation moves anything."""
    whole = lambda c: (F.countDistinct(c) == F.count("*")) & (F.min(c) == 0) & (F.max(c) == F.count("*") - 1)
    return perm.agg(
        F.count("*").alias("n"),
        F.coalesce(whole("orig"), F.lit(False)).alias("orig_complete"),
        F.coalesce(whole("obf"), F.lit(False)).alias("obf_complete"),
        F.coalesce(F.bool_or(F.col("orig") != F.col("obf")), F.lit(False)).alias("moves"),
    )


def secret_violations(perm: DataFrame, inv: DataFrame) -> DataFrame:
    """(orig, obf, reason) wherever a permutation and its stored inverse break a rule; no rows if both are sound."""
    n = perm.agg(F.count("*").alias("n"), F.coalesce(F.bool_or(F.col("orig") != F.col("obf")), F.lit(False)).alias("moves"))
    rows = perm.crossJoin(F.broadcast(n))  # one row
    outside = rows.where("obf < 0 OR obf >= n OR orig < 0 OR orig >= n").select("orig", "obf", F.lit("outside the vocabulary").alias("reason"))
    twice = perm.groupBy("obf").agg(F.count("*").alias("c"), F.min("orig").alias("orig")).where("c > 1").select("orig", "obf", F.lit("two rows become one").alias("reason"))
    back = inv.select(F.col("orig").alias("b"), F.col("obf").alias("a"))
    wrong = perm.join(back, (F.col("obf") == F.col("b")) & (F.col("orig") == F.col("a")), "left_anti").select("orig", "obf", F.lit("the inverse differs").alias("reason"))
    still = n.where("NOT moves").select(F.lit(None).cast("long").alias("orig"), F.lit(None).cast("long").alias("obf"), F.lit("it moves nothing").alias("reason"))
    return outside.unionByName(twice).unionByName(wrong).unionByName(still)


def permute_rows(rows: DataFrame, perm: DataFrame, row_id: str) -> DataFrame:
    """rows with their row_id permuted: row obf of the result is row orig of the input. Rows outside the permutation fail the join."""
    names = rows.columns
    moved = rows.join(perm, F.col(row_id) == F.col("orig"))
    return moved.select(*[F.col("obf").alias(c) if c == row_id else F.col(c) for c in names])


def vocabulary(words: DataFrame) -> DataFrame:
    """(word, id, n) of a one-column table: distinct words numbered in byte order, and how often each is there."""
    (name,) = words.columns
    counted = words.groupBy(F.col(name).alias("word")).agg(F.count("*").alias("n"))
    return with_rank(counted, "id", F.substring("word", 1, 4), F.col("word")).select("word", "id", "n")


def encode(tokens: DataFrame, perm: DataFrame, token: str = "token") -> DataFrame:
    """tokens with the permuted id in place of the original."""
    return permute_rows(tokens, perm, token)


def decode(tokens: DataFrame, perm: DataFrame, token: str = "token") -> DataFrame:
    return permute_rows(tokens, inverse(perm), token)


def outside_vocabulary(tokens: DataFrame, size: int, token: str = "token") -> DataFrame:
    return tokens.where(F.col(token).isNull() | (F.col(token) < 0) | (F.col(token) >= size))


def prompt_violations(prompts: DataFrame, size: int) -> DataFrame:
    """(the prompts' other columns, reason) of prompts (tokens: an array) that a model of `size` tokens can't be asked."""
    keep = [c for c in prompts.columns if c != "tokens"]
    bad = F.exists("tokens", lambda t: t.isNull() | (t < 0) | (t >= size))
    empty = F.when(F.coalesce(F.size("tokens"), F.lit(0)) <= 0, "empty")
    return prompts.select(*keep, F.explode(F.array_compact(F.array(empty, F.when(bad, "outside the vocabulary")))).alias("reason"))


def relationship_mismatch(before: DataFrame, after: DataFrame, perm: DataFrame, row_id: str, value: str) -> DataFrame:
    """(row_id, reason) where `after` is not `before` with its rows permuted: rows that are missing, extra or different."""
    expected = permute_rows(before, perm, row_id).select(F.col(row_id).alias("e_id"), F.col(value).alias("e"))
    found = after.select(F.col(row_id).alias("f_id"), F.col(value).alias("f"))
    met = expected.join(found, F.col("e_id") == F.col("f_id"), "full")
    reason = F.when(F.col("f_id").isNull(), "missing").when(F.col("e_id").isNull(), "extra").when(~F.col("e").eqNullSafe(F.col("f")), "different")
    return met.select(F.coalesce("e_id", "f_id").alias(row_id), reason.alias("reason")).where("reason IS NOT NULL")


def moved_share(before: DataFrame, after: DataFrame, row_id: str, value: str) -> DataFrame:
    """One row: n, and how many rows hold another value after than before; a guard against a transform that changes nothing."""
    met = before.select(F.col(row_id).alias("a_id"), F.col(value).alias("a")).join(after.select(F.col(row_id).alias("b_id"), F.col(value).alias("b")), F.col("a_id") == F.col("b_id"))
    return met.agg(F.count("*").alias("n"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_changed"))
