"""Queries on permutations: maps, permuted matrices, tokens, and the relations that verify them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.functions.joins import join_salted
from tensorloom.operators import permutation as op
from tensorloom.operators import tensors
from tensorloom.queries.base import PERM_SQL, matrix, permutation, registry, table
from tensorloom.storage import cut

QUERIES, SQL, query = registry()


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every turn: (conv_id, turn, pos, word)."""
    words = F.posexplode(F.split("text", " ")).alias("pos", "word")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", words)


def _encoded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tokens with their original id, and the permutation of the vocabulary."""
    tokens = _tokens(spark, sf_dir)
    ids = cut(op.vocabulary(tokens.select("word")))
    perm = op.keyed_permutation(ids.select("id"), "tokens")
    # few words are a large part of all tokens: what these are joined with is repeated
    met = join_salted(tokens, ids, "word", "n", ["conv_id", "turn", "pos"], ids.agg(F.sum("n")).first()[0] or 0)
    return met.select("conv_id", "turn", "pos", F.col("id").alias("token")), perm


_TOKENS_SQL = """t AS (
    SELECT conv_id, turn, CAST(unnest(range(len(w))) AS INTEGER) AS pos, unnest(w) AS word
    FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)),
v AS (SELECT word, CAST(row_number() OVER (ORDER BY encode(word)) - 1 AS BIGINT) AS id FROM (SELECT DISTINCT word FROM t)),
p AS (SELECT id AS orig, CAST(row_number() OVER (ORDER BY md5('tokens:' || id), id) - 1 AS BIGINT) AS obf FROM v)"""


@query(f"WITH p AS ({PERM_SQL}) SELECT p.obf AS row_id, e.embedding AS v FROM embeddings e JOIN p ON e.vec_id = p.orig")
def token_permute_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.permute_rows(matrix(spark, sf_dir), permutation(spark, sf_dir), "row_id")


@query(f"WITH p AS ({PERM_SQL}) SELECT p.obf AS row_id, list_transform(e.embedding, lambda x: -x) AS v FROM embeddings e JOIN p ON e.vec_id = p.orig")
def token_permute_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An untied head (the embedding's negation) under the same permutation."""
    head = matrix(spark, sf_dir).withColumn("v", F.transform("v", lambda x: -x))
    return op.permute_rows(head, permutation(spark, sf_dir), "row_id")


@query(PERM_SQL)
def permutation_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation(spark, sf_dir)


@query(f"WITH p AS ({PERM_SQL}) SELECT obf AS orig, orig AS obf FROM p")
def inverse_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.inverse(permutation(spark, sf_dir))


@query(f"""WITH p AS ({PERM_SQL}) SELECT count(*) AS n, count(DISTINCT orig) = count(*) AND min(orig) = 0 AND max(orig) = count(*) - 1 AS orig_complete,
    count(DISTINCT obf) = count(*) AND min(obf) = 0 AND max(obf) = count(*) - 1 AS obf_complete, bool_or(orig <> obf) AS moves FROM p""")
def bijection_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.bijection_report(permutation(spark, sf_dir))


@query(f"""WITH p AS ({PERM_SQL}),
    bad AS (SELECT orig, CASE WHEN orig = 7 THEN (SELECT obf FROM p WHERE orig = 9) WHEN orig = 11 THEN (SELECT count(*) FROM p) ELSE obf END AS obf FROM p),
    twice AS (SELECT min(orig) AS orig, obf, 'two rows become one' AS reason FROM bad GROUP BY obf HAVING count(*) > 1)
    SELECT orig, obf, 'outside the vocabulary' AS reason FROM bad WHERE obf >= (SELECT count(*) FROM bad)
    UNION ALL SELECT * FROM twice
    UNION ALL SELECT bad.orig, bad.obf, 'the inverse differs' FROM bad ANTI JOIN p ON bad.orig = p.orig AND bad.obf = p.obf""")
def secret_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is found in a permutation of which two rows were tampered with, its inverse being intact."""
    perm = permutation(spark, sf_dir)
    n = perm.agg(F.count("*").alias("n"))
    ninth = perm.where("orig = 9").select(F.col("obf").alias("ninth"))
    bad = perm.crossJoin(n).crossJoin(ninth)  # one row each
    bad = bad.select("orig", F.when(F.col("orig") == 7, F.col("ninth")).when(F.col("orig") == 11, F.col("n")).otherwise(F.col("obf")).alias("obf"))
    return op.secret_violations(bad, op.inverse(perm))


@query(f"WITH {_TOKENS_SQL} SELECT conv_id, turn, pos, p.obf AS token FROM t JOIN v USING (word) JOIN p ON v.id = p.orig")
def encode_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens, perm = _encoded(spark, sf_dir)
    return op.encode(tokens, perm)


@query(f"WITH {_TOKENS_SQL} SELECT conv_id, turn, pos, p.obf AS sent, p.orig AS token FROM t JOIN v USING (word) JOIN p ON v.id = p.orig")
def decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens as they are sent, permuted, and as they are after they were permuted back."""
    tokens, perm = _encoded(spark, sf_dir)
    return op.decode(op.encode(tokens, perm).withColumn("sent", F.col("token")), perm)


@query(f"WITH {_TOKENS_SQL} SELECT conv_id, turn, pos, id AS token FROM t JOIN v USING (word) WHERE id >= 1000")
def tokens_outside_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that a model with a vocabulary of 1000 would not know."""
    tokens, _ = _encoded(spark, sf_dir)
    return op.outside_vocabulary(tokens, 1000)


@query(f"""WITH {_TOKENS_SQL}, q AS (SELECT conv_id, turn, CASE WHEN conv_id % 9 = 4 THEN [] ELSE list(id) END AS ids FROM t JOIN v USING (word) GROUP BY conv_id, turn)
    SELECT conv_id, turn, 'empty' AS reason FROM q WHERE len(ids) = 0
    UNION ALL SELECT conv_id, turn, 'outside the vocabulary' FROM q WHERE len(list_filter(ids, lambda x: x >= 1000)) > 0""")
def prompt_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as prompts of a model with 1000 tokens: those without any token, and those with one that it doesn't know."""
    tokens, _ = _encoded(spark, sf_dir)
    prompts = tokens.groupBy("conv_id", "turn").agg(F.collect_list("token").alias("tokens"))
    none = F.array().cast("array<bigint>")
    return op.prompt_violations(prompts.withColumn("tokens", F.when(F.col("conv_id") % 9 == 4, none).otherwise(F.col("tokens"))), 1000)


@query(f"""WITH p AS ({PERM_SQL}), good AS (SELECT p.obf AS row_id, embedding AS v FROM embeddings JOIN p ON vec_id = p.orig),
    served AS (SELECT row_id, CASE WHEN row_id % 97 = 5 THEN list_transform(v, lambda x: -x) ELSE v END AS v FROM good WHERE row_id % 101 <> 3)
    SELECT coalesce(g.row_id, s.row_id) AS row_id, CASE WHEN s.row_id IS NULL THEN 'missing' WHEN g.row_id IS NULL THEN 'extra' ELSE 'different' END AS reason
    FROM good g FULL JOIN served s ON g.row_id = s.row_id WHERE s.row_id IS NULL OR g.row_id IS NULL OR g.v <> s.v""")
def weight_relationship_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What verification finds in a permuted matrix of which some rows were dropped and some negated."""
    before, perm = matrix(spark, sf_dir), permutation(spark, sf_dir)
    after = op.permute_rows(before, perm, "row_id").where("row_id % 101 <> 3")
    after = after.withColumn("v", F.when(F.col("row_id") % 97 == 5, F.transform("v", lambda x: -x)).otherwise(F.col("v")))
    return op.relationship_mismatch(before, after, perm, "row_id", "v")


@query(f"""WITH p AS ({PERM_SQL}), a AS (SELECT p.obf AS row_id, e.embedding AS v FROM embeddings e JOIN p ON e.vec_id = p.orig)
    SELECT count(*) AS n, count(*) FILTER (WHERE a.v <> e.embedding) AS n_changed FROM a JOIN embeddings e ON e.vec_id = a.row_id""")
def embedding_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of the matrix differ from before the permutation: none would be an error."""
    before = matrix(spark, sf_dir)
    return op.moved_share(before, op.permute_rows(before, permutation(spark, sf_dir), "row_id"), "row_id", "v")


@query("SELECT * FROM part")
def identity_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensors.copy(table(spark, sf_dir, "part"))


@query("""WITH other AS (SELECT * REPLACE (CASE WHEN p_partkey % 97 = 2 THEN p_size + 1 ELSE p_size END AS p_size) FROM part WHERE p_partkey % 211 <> 1 UNION ALL (SELECT * REPLACE (-1 AS p_partkey) FROM part LIMIT 1))
    SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN b.p_partkey IS NULL THEN 'missing' WHEN a.p_partkey IS NULL THEN 'extra' ELSE 'different' END AS reason
    FROM part a FULL JOIN other b ON a.p_partkey = b.p_partkey WHERE a IS DISTINCT FROM b""")
def byte_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a copy differs from its source that lost rows, changed values and gained one."""
    source = table(spark, sf_dir, "part")
    other = source.where("p_partkey % 211 <> 1").withColumn("p_size", F.when(F.col("p_partkey") % 97 == 2, F.col("p_size") + 1).otherwise(F.col("p_size")))
    extra = source.limit(1).withColumn("p_partkey", F.lit(-1).cast("long"))
    return tensors.content_mismatch(source, other.unionByName(extra), ["p_partkey"])


@query("SELECT vec_id AS row_id, list_concat(embedding, CAST([0, 0, 0, 0, 0, 0] AS FLOAT[])) AS v FROM embeddings")
def pad_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensors.pad_columns(matrix(spark, sf_dir), "v", 3)
