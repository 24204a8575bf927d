"""Queries on client-side inference with a permuted vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.operators import inference as op
from tensorloom.operators import permutation as perm_op
from tensorloom.queries.base import PERM_SQL, matrix, permutation, registry, table

QUERIES, SQL, query = registry()

_PERM = f"p AS ({PERM_SQL})"
STEPS, BATCH, EOS = 6, 4, [49, 99, 149, 199]


def _served(spark: SparkSession, sf_dir: str, perm: DataFrame, logit: Column) -> DataFrame:
    """Logits (token, position, logit) of a model whose rows are permuted; `logit` is made of obf, position and value."""
    rows = perm_op.permute_rows(matrix(spark, sf_dir), perm, "row_id")
    rows = rows.select(F.col("row_id").alias("obf"), F.posexplode("v").alias("position", "value")).withColumn("value", F.col("value").cast("double"))
    return rows.select(F.col("obf").alias("token"), "position", logit.alias("logit"))


@query(f"WITH {_PERM}, e AS (SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS position, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings) SELECT vec_id AS token, position, value + p.obf AS logit FROM e JOIN p ON vec_id = p.orig")
def logits_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits by original token, of a model that adds each served token's number to them: another order would show."""
    perm = permutation(spark, sf_dir)
    return op.align(_served(spark, sf_dir, perm, F.col("value") + F.col("obf")), perm)


@query(f"""WITH {_PERM}, l AS (SELECT orig % 7 AS position, orig AS token, CAST(obf * 13 % 17 AS DOUBLE) AS logit FROM p)
    SELECT position, token, logit FROM (SELECT *, row_number() OVER (PARTITION BY position ORDER BY logit DESC, token) AS r FROM l) WHERE r = 1""")
def argmax_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top original tokens among logits that are made of the served tokens, many of them equal."""
    perm = permutation(spark, sf_dir)
    served = perm.select(F.col("obf").alias("token"), (F.col("obf") * 13 % 17).cast("double").alias("logit"))
    return op.top_token(op.align(served, perm).withColumn("position", F.col("token") % 7), ["position"])


_OFF = "CASE WHEN p.obf % 50 = 0 THEN value * 1.001 ELSE value * 1.000001 END"


@query(f"""WITH {_PERM}, e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings), c AS (SELECT value AS b, {_OFF} AS a FROM e JOIN p ON vec_id = p.orig)
    SELECT count(*) AS n, max(abs(a - b)) AS max_difference, bool_and(abs(a - b) <= 1e-5 + 1e-4 * abs(b)) AS all_close, bool_and(isfinite(a) AND isfinite(b)) AS all_finite FROM c""")
def allclose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned logits against the plain model's, some served tokens' being off by more than the tolerance."""
    perm = permutation(spark, sf_dir)
    return op.closeness(op.align(_served(spark, sf_dir, perm, F.when(F.col("obf") % 50 == 0, F.col("value") * 1.001).otherwise(F.col("value") * 1.000001)), perm), _plain(spark, sf_dir), ["token", "position"], "logit")


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matrix(spark, sf_dir).select(F.col("row_id").alias("token"), F.posexplode("v").alias("position", "logit"))
    return rows.withColumn("logit", F.col("logit").cast("double"))


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a model in whole numbers."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("token"), F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long")).alias("w"))


def _decoded(weights: DataFrame, perm: DataFrame) -> DataFrame:
    """What is appended to every token as a prompt, BATCH of them a batch, through a model permuted by perm."""
    k = F.col("token")
    prompts = weights.select(F.floor(k / BATCH).cast("long").alias("batch"), (k % BATCH).alias("row"), k.alias("last"))
    return op.greedy(prompts, perm_op.encode(weights, perm), perm, EOS, STEPS)


_WEIGHTS = "SELECT vec_id AS token, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT)) AS w FROM embeddings"


def _greedy_sql(name: str, weights: str) -> str:
    """CTEs that end with `name` (batch, row, tokens): decoding by the model of the rows `weights` (token, w)."""
    return f"""{name}_w AS ({weights}),
    {name}_s AS (SELECT a.token AS a, b.token AS b, list_inner_product(CAST(a.w AS DOUBLE[]), CAST(b.w AS DOUBLE[])) AS logit FROM {name}_w a, {name}_w b),
    {name}_next AS MATERIALIZED (SELECT a, arg_min(b, (-logit, b)) AS b FROM {name}_s GROUP BY a),
    {name}_run AS (SELECT token // {BATCH} AS batch, token % {BATCH} AS row, token AS last, token // {BATCH} * {BATCH} AS lead, CAST([] AS BIGINT[]) AS tokens, 0 AS step, FALSE AS done FROM {name}_w
        UNION ALL SELECT batch, row, x.b, y.b, list_append(tokens, x.b), step + 1, y.b IN {tuple(EOS)} FROM {name}_run r JOIN {name}_next x ON x.a = r.last JOIN {name}_next y ON y.a = r.lead WHERE step < {STEPS} AND NOT done),
    {name} AS (SELECT batch, row, tokens FROM {name}_run WHERE done OR step = {STEPS})"""


@query(f"WITH RECURSIVE {_greedy_sql('run', _WEIGHTS)} SELECT * FROM run")
def greedy_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What greedy decoding appends to every token as a prompt, through a permuted model; batches end with their first row."""
    return _decoded(_weights(spark, sf_dir), permutation(spark, sf_dir))


@query(f"""WITH RECURSIVE {_PERM}, e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings), c AS (SELECT value AS b, value * (1 + p.obf * 1e-8) AS a FROM e JOIN p ON vec_id = p.orig),
    l AS (SELECT max(abs(a - b)) AS max_difference, bool_and(abs(a - b) <= 1e-5 + 1e-4 * abs(b)) AND bool_and(isfinite(a) AND isfinite(b)) AS logits_equal FROM c),
    {_greedy_sql('plain', _WEIGHTS)}, {_greedy_sql('served', f"SELECT token, CASE WHEN token % 100 = 7 THEN list_transform(w, lambda x: -x) ELSE w END AS w FROM ({_WEIGHTS})")},
    t AS (SELECT bool_and(a.tokens = b.tokens) AS tokens_equal FROM plain a JOIN served b USING (batch, row))
    SELECT max_difference, logits_equal, tokens_equal, logits_equal AND tokens_equal AS equivalent FROM l, t""")
def equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on a permuted model of which some rows were negated, with logits that are close: other tokens are appended."""
    perm, weights = permutation(spark, sf_dir), _weights(spark, sf_dir)
    still = perm.select("orig", F.col("orig").alias("obf"))
    close = op.closeness(op.align(_served(spark, sf_dir, perm, F.col("value") * (1 + F.col("obf") * 1e-8)), perm), _plain(spark, sf_dir), ["token", "position"], "logit")
    other = weights.withColumn("w", F.when(F.col("token") % 100 == 7, F.transform("w", lambda x: -x)).otherwise(F.col("w")))
    return op.equivalence(close, _decoded(weights, still), _decoded(other, perm))
