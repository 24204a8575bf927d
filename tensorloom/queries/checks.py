"""Queries on the rules of artifacts and plans: what each finds in inputs that were damaged in a known way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tensorloom.functions import scalars
from tensorloom.operators import checks as op
from tensorloom.queries.base import INVENTORY_SQL, matrix, registry, table, tensors

QUERIES, SQL, query = registry()

_INV = f"inv AS MATERIALIZED ({INVENTORY_SQL})"


@query("""SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN '{"k": 1, "a": 2, "k": 3}' WHEN event_id % 13 = 1 THEN '{"k": {"a": 1}, "a": 2}' ELSE props END AS props FROM events)
    WHERE len(json_keys(props)) <> len(list_distinct(json_keys(props)))""")
def duplicate_json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose outermost object has a key twice; a key that is repeated at another depth is not."""
    text = F.when(F.col("event_id") % 13 == 0, '{"k": 1, "a": 2, "k": 3}').when(F.col("event_id") % 13 == 1, '{"k": {"a": 1}, "a": 2}').otherwise(F.col("props"))
    return table(spark, sf_dir, "events").where(scalars.repeats_keys(text)).select("event_id")


@query("""SELECT name, reason FROM (SELECT CASE WHEN n_nationkey = 3 THEN '' WHEN n_nationkey = 5 THEN n_name || chr(0) || 'x' ELSE n_name END AS name, CASE n_nationkey WHEN 3 THEN 'empty' WHEN 5 THEN 'has a zero byte' END AS reason FROM nation) WHERE reason IS NOT NULL""")
def bad_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("n_nationkey") == 3, "").when(F.col("n_nationkey") == 5, F.concat("n_name", F.char(F.lit(0)), F.lit("x"))).otherwise(F.col("n_name"))
    return op.bad_names(table(spark, sf_dir, "nation").select(name.alias("name")))


@query(f"""WITH {_INV}, idx AS (SELECT CASE WHEN name LIKE 'nation.%' THEN name || '.x' ELSE name END AS name, CASE WHEN name LIKE 'labels.%' THEN 'elsewhere' WHEN length(name) % 2 = 0 THEN './' || shard ELSE shard END AS shard
        FROM inv WHERE name NOT LIKE 'part.%')
    SELECT coalesce(i.name, t.name) AS name, CASE WHEN t.name IS NULL THEN 'no such tensor' WHEN i.name IS NULL THEN 'not in the index' ELSE 'in another shard' END AS reason
    FROM idx i FULL JOIN inv t ON i.name = t.name WHERE t.name IS NULL OR i.name IS NULL OR regexp_replace(i.shard, '^(\\./)+', '') <> t.shard""")
def weight_map_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that renamed some tensors, left some out and moved some; half of its shards are written with './'."""
    physical = tensors(spark, sf_dir).select("name", "shard")
    index = physical.where(~F.col("name").like("part.%"))
    name = F.when(F.col("name").like("nation.%"), F.concat("name", F.lit(".x"))).otherwise(F.col("name"))
    shard = F.when(F.col("name").like("labels.%"), "elsewhere").when(F.length("name") % 2 == 0, F.concat(F.lit("./"), "shard")).otherwise(F.col("shard"))
    return op.weight_map_mismatch(index.select(name.alias("name"), shard.alias("shard")), physical)


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header entries of a file a table, its tensors one after another by name, of which some are damaged."""
    order = Window.partitionBy("shard").orderBy("name")
    rows = tensors(spark, sf_dir).withColumn("begin", F.coalesce(F.sum("byte_length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumns({"end": F.col("begin") + F.col("byte_length"), "data_bytes": F.sum("byte_length").over(Window.partitionBy("shard"))})
    damage = F.when(F.col("name") == "orders.o_orderkey", -8).when(F.col("name") == "supplier.s_nationkey", 8).otherwise(0)
    longer = F.when(F.col("name") == "lineitem.l_tax", 16).otherwise(0)
    return rows.select("shard", "name", "dtype", "shape", (F.col("begin") + damage).alias("begin"), (F.col("end") + damage).alias("end"), (F.col("data_bytes") + F.when(F.col("shard") == "pages", 4).otherwise(0)).alias("data_bytes"), longer.alias("longer"))


_ENTRIES = f"""{_INV}, e0 AS (SELECT *, CAST(coalesce(sum(byte_length) OVER (PARTITION BY shard ORDER BY encode(name) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b, CAST(sum(byte_length) OVER (PARTITION BY shard) AS BIGINT) AS d FROM inv),
    e AS (SELECT shard, name, b + x AS b, b + byte_length + x AS f, d + CASE shard WHEN 'pages' THEN 4 ELSE 0 END AS d, byte_length
        FROM (SELECT *, CASE name WHEN 'orders.o_orderkey' THEN -8 WHEN 'supplier.s_nationkey' THEN 8 ELSE 0 END AS x FROM e0))"""


@query(f"""WITH {_ENTRIES}, r AS (SELECT *, coalesce(max(f) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached, lead(name) OVER w IS NULL AS is_last FROM e WINDOW w AS (PARTITION BY shard ORDER BY b, f, encode(name)))
    SELECT shard, name, 'hole' AS reason FROM r WHERE b > reached UNION ALL SELECT shard, name, 'overlap' FROM r WHERE b < reached
    UNION ALL SELECT shard, name, 'payload goes on' FROM r WHERE is_last AND greatest(f, reached) < d""")
def header_tiling_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.tiling_violations(_entries(spark, sf_dir))


@query(f"""WITH {_ENTRIES}, h AS (SELECT e.shard, e.name, b, f + y AS f, d + 16 * y AS d, CASE WHEN e.name = 'part.p_size' THEN 'F8' ELSE inv.dtype END AS dtype, inv.shape FROM (SELECT *, CASE name WHEN 'lineitem.l_tax' THEN 16 ELSE 0 END AS y FROM e) e JOIN inv USING (name)),
    x AS (SELECT *, list_product(shape) * CASE dtype WHEN 'F64' THEN 8 WHEN 'I64' THEN 8 WHEN 'F32' THEN 4 WHEN 'I32' THEN 4 END AS expected FROM h)
    SELECT shard, name, 'range outside the payload' AS reason FROM x WHERE b > f OR f > d
    UNION ALL SELECT shard, name, 'unknown dtype' FROM x WHERE expected IS NULL UNION ALL SELECT shard, name, 'shape and range differ' FROM x WHERE expected <> f - b""")
def header_range_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of which one has an unknown dtype and one a range that is longer than its shape."""
    rows = _entries(spark, sf_dir).withColumns({"end": F.col("end") + F.col("longer"), "data_bytes": F.col("data_bytes") + 16 * F.col("longer"), "dtype": F.when(F.col("name") == "part.p_size", "F8").otherwise(F.col("dtype"))})
    return op.range_violations(rows)


@query(f"""WITH {_INV}, d AS (SELECT name, shard FROM inv UNION ALL SELECT name, shard FROM inv WHERE shard = 'part' UNION ALL SELECT name, 'other' FROM inv WHERE name LIKE '%key')
    SELECT name, count(*) AS copies, count(DISTINCT shard) AS shards FROM d GROUP BY name HAVING count(*) > 1""")
def duplicate_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tensors(spark, sf_dir).select("name", "shard")
    twice = rows.unionByName(rows.where("shard = 'part'")).unionByName(rows.where("name LIKE '%key'").withColumn("shard", F.lit("other")))
    return op.duplicate_tensors(twice)


@query(f"WITH {_INV} SELECT c.total_size, a.actual FROM (SELECT CAST(sum(byte_length) AS BIGINT) AS actual FROM inv) a, (VALUES (CAST(1 AS BIGINT)), (NULL), (CAST(2 AS BIGINT))) c(total_size) WHERE c.total_size <> a.actual")
def index_total_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    claimed = spark.createDataFrame([(1,), (None,), (2,)], "total_size long")
    return op.total_mismatch(tensors(spark, sf_dir), claimed)


@query("SELECT string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS formats FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders) HAVING count(DISTINCT o_orderstatus) > 1")
def format_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards that claim different formats; one without a claim agrees with any."""
    shards = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("shard"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("format"))
    return op.format_conflicts(shards)


_PATHS = "CASE doc_id % 5 WHEN 0 THEN '/' || source || '/x' WHEN 1 THEN source || '/../x' WHEN 2 THEN '' WHEN 3 THEN source || '/..x' ELSE source END"


@query(f"""WITH p AS (SELECT {_PATHS} AS path FROM documents) SELECT path, 'empty' AS reason FROM p WHERE path = '' UNION ALL SELECT path, 'absolute' FROM p WHERE starts_with(path, '/')
    UNION ALL SELECT path, 'goes up' FROM p WHERE list_contains(string_split(path, '/'), '..')""")
def path_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.path_violations(table(spark, sf_dir, "documents").select(F.expr(_PATHS).alias("path")))


@query("""WITH p AS (SELECT '/' || source AS "left", CASE doc_id % 3 WHEN 0 THEN '/' || source || '/' || doc_id WHEN 1 THEN '/' || source || doc_id ELSE '/' END AS "right" FROM documents)
    SELECT * FROM p WHERE starts_with(rtrim("left", '/') || '/', rtrim("right", '/') || '/') OR starts_with(rtrim("right", '/') || '/', rtrim("left", '/') || '/')""")
def nested_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of input and output of which one is within the other; a name that only begins alike is not."""
    right = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("/"), "source", F.col("doc_id").cast("string"))).otherwise("/")
    return op.nested_paths(table(spark, sf_dir, "documents").select(F.concat(F.lit("/"), "source").alias("left"), right.alias("right")))


#: Model configs made from the customers: most are sound, some lack a dimension or have ones that don't go together.
_CONFIG_SQL = """c AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'llama' WHEN 1 THEN 'llama' WHEN 2 THEN 'gpt2' ELSE 'Llama' END AS kind,
    CASE WHEN c_custkey % 11 = 0 THEN 7 ELSE 8 END AS hidden, CASE WHEN c_custkey % 13 = 0 THEN 0 ELSE 4 END AS heads, CASE c_custkey % 17 WHEN 0 THEN 5 WHEN 1 THEN 0 WHEN 2 THEN 3 ELSE 2 END AS kv, c_custkey % 7 <> 0 AS has_vocab FROM customer)"""


def _configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    kind = F.when(k % 4 <= 1, "llama").when(k % 4 == 2, "gpt2").otherwise("Llama")
    hidden = F.when(k % 11 == 0, 7).otherwise(8)
    heads = F.when(k % 13 == 0, 0).otherwise(4)
    kv = F.when(k % 17 == 0, 5).when(k % 17 == 1, 0).when(k % 17 == 2, 3).otherwise(2)
    config = F.struct(kind.alias("model_type"), hidden.alias("hidden_size"), heads.alias("num_attention_heads"), kv.alias("num_key_value_heads"), F.lit(16).alias("intermediate_size"), F.lit(2).alias("num_hidden_layers"), F.when(k % 7 != 0, 32).when(k % 14 == 0, -32).alias("vocab_size"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.to_json(config).alias("config"))


@query(f"WITH {_CONFIG_SQL} SELECT id, CAST(kind = 'llama' AS INTEGER) AS matches, CASE WHEN kind = 'llama' THEN 'ok' ELSE 'unsupported' END AS verdict FROM c")
def detect_architecture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.detect_architecture(_configs(spark, sf_dir), {"llama": "llama", "other": "mistral"})


@query(f"""WITH {_CONFIG_SQL}, j AS (SELECT id, CASE WHEN id % 5 = 1 THEN NULL ELSE kind END AS model_type, CASE WHEN id % 3 = 1 THEN [] WHEN id % 3 = 0 THEN ['For' || kind, 'second'] END AS architectures FROM c)
    SELECT id, coalesce(model_type, architectures[1], 'unknown') AS label FROM j""")
def architecture_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configs of which some have no model type, and of these some no architectures either, or an empty list."""
    k, kind = F.col("id"), F.get_json_object("config", "$.model_type")
    named = F.when(k % 3 == 1, F.array().cast("array<string>")).when(k % 3 == 0, F.array(F.concat(F.lit("For"), kind), F.lit("second")))
    config = F.to_json(F.struct(F.when(k % 5 != 1, kind).alias("model_type"), named.alias("architectures")))
    return _configs(spark, sf_dir).select("id", scalars.architecture_label(config).alias("label"))


@query(f"""WITH {_CONFIG_SQL} SELECT id, 'no vocab_size' AS reason FROM c WHERE NOT has_vocab UNION ALL SELECT id, 'no heads' FROM c WHERE heads = 0 UNION ALL SELECT id, 'no key-value heads' FROM c WHERE kv = 0
    UNION ALL SELECT id, 'more key-value heads than heads' FROM c WHERE kv > heads UNION ALL SELECT id, 'heads don''t divide the hidden size' FROM c WHERE heads > 0 AND hidden % heads <> 0""")
def dimension_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.dimension_violations(_configs(spark, sf_dir))


#: A model a supplier: two layers; some lack a tensor, some have one in another shape, some are untied without a head.
def _models(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("s_suppkey")
    lit = lambda v: F.lit(v).cast("long")
    models = table(spark, sf_dir, "supplier").select(k.alias("id"), lit(2).alias("layers"), lit(8).alias("hidden"), lit(16).alias("inner"), lit(4).alias("kv"), lit(32).alias("vocab"), (k % 3 == 0).alias("tied"))
    expected = op.expected_tensors(models)
    there = expected.where(~((F.col("id") % 5 == 1) & (F.col("name") == "model.layers.1.mlp.up_proj.weight")) & ~(F.col("optional") | ((F.col("id") % 7 == 2) & (F.col("name") == "lm_head.weight"))))
    shape = F.when((F.col("id") % 4 == 2) & (F.col("name") == "model.layers.0.self_attn.k_proj.weight"), F.array(lit(8), lit(4))).otherwise(F.col("shape"))
    return expected, there.select("id", "name", shape.alias("shape"))


_LAYER_SQL = ", ".join(f"('{name}', {list(shape)})" for name, shape in op.LAYER.items()).replace('"', "'")
_WHOLE_SQL = ", ".join(f"('{name}', {list(shape)})" for name, shape in op.WHOLE.items()).replace('"', "'")


@query(f"""WITH m AS (SELECT s_suppkey AS id, s_suppkey % 3 = 0 AS tied FROM supplier), dims AS (SELECT MAP {{'hidden': 8, 'inner': 16, 'kv': 4, 'vocab': 32}} AS d),
    wanted AS (SELECT id, 'model.layers.' || layer || '.' || suffix AS name, list_transform(names, lambda n: d[n]) AS shape, FALSE AS optional FROM m, dims, range(2) r(layer), (VALUES {_LAYER_SQL}) l(suffix, names)
        UNION ALL SELECT id, name, list_transform(names, lambda n: d[n]), name = 'lm_head.weight' AND tied FROM m, dims, (VALUES {_WHOLE_SQL}) w(name, names)),
    there AS (SELECT id, name, CASE WHEN id % 4 = 2 AND name = 'model.layers.0.self_attn.k_proj.weight' THEN [8, 4] ELSE shape END AS shape FROM wanted
        WHERE NOT (id % 5 = 1 AND name = 'model.layers.1.mlp.up_proj.weight') AND NOT optional AND NOT (id % 7 = 2 AND name = 'lm_head.weight'))
    SELECT w.id, w.name, CASE WHEN t.name IS NULL THEN 'missing' ELSE 'another shape' END AS reason FROM wanted w LEFT JOIN there t ON w.id = t.id AND w.name = t.name WHERE t.name IS NULL AND NOT optional OR t.shape <> w.shape""")
def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.schema_violations(*_models(spark, sf_dir))


_VOCABULARY_SQL = """v AS (SELECT count(*) AS n FROM embeddings), t AS (
        SELECT p_partkey AS id, 'model.embed_tokens.weight' AS name, CASE p_size % 4 WHEN 0 THEN 'F32' WHEN 1 THEN 'F16' WHEN 2 THEN 'BF16' ELSE 'I32' END AS dtype, CASE WHEN p_partkey % 7 = 0 THEN n + 1 ELSE n END AS rows FROM part, v
        UNION ALL SELECT p_partkey, 'lm_head.weight', CASE WHEN p_size % 5 = 0 THEN 'F64' ELSE 'F32' END, CASE WHEN p_partkey % 6 = 1 THEN 0 ELSE n END FROM part, v WHERE p_partkey % 3 <> 0
        UNION ALL SELECT p_partkey, 'lm_head.bias', 'F32', n FROM part, v WHERE p_partkey % 11 = 2
        UNION ALL SELECT p_partkey, 'model.norm.weight', 'I8', 3 FROM part)"""


@query(f"""WITH {_VOCABULARY_SQL}, m AS (SELECT * FROM t WHERE name IN ('model.embed_tokens.weight', 'lm_head.weight'))
    SELECT id, name, 'a head with a bias' AS reason FROM t WHERE name = 'lm_head.bias' UNION ALL SELECT id, name, 'dtype of a vocabulary' FROM m WHERE dtype NOT IN ('F32', 'F16', 'BF16')
    UNION ALL SELECT id, name, 'rows are not the vocabulary' FROM m, v WHERE rows <> n""")
def token_method_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models, one a part, around the vocabulary of the embeddings: heads with a bias, of other dtypes and of other lengths."""
    n = table(spark, sf_dir, "embeddings").count()
    k, size, rows = F.col("p_partkey"), F.col("p_size"), table(spark, sf_dir, "part")
    entry = lambda name, dtype, count: F.struct(F.lit(name).alias("name"), dtype.alias("dtype"), F.array(count.cast("long"), F.lit(64).cast("long")).alias("shape"))
    embedding = entry("model.embed_tokens.weight", F.element_at(F.array(*[F.lit(d) for d in ("F32", "F16", "BF16", "I32")]), (size % 4 + 1).cast("int")), F.when(k % 7 == 0, n + 1).otherwise(n))
    head = F.when(k % 3 != 0, entry("lm_head.weight", F.when(size % 5 == 0, "F64").otherwise("F32"), F.when(k % 6 == 1, 0).otherwise(n)))
    bias = F.when(k % 11 == 2, entry("lm_head.bias", F.lit("F32"), F.lit(n)))
    norm = entry("model.norm.weight", F.lit("I8"), F.lit(3))
    tensors_of = rows.select(k.alias("id"), F.inline(F.array_compact(F.array(embedding, head, bias, norm))))
    return op.token_method_violations(tensors_of, n, ["id"])


@query("""WITH head AS (SELECT vec_id, CASE WHEN vec_id % 37 = 4 THEN list_reverse(embedding) ELSE embedding END AS v FROM embeddings WHERE vec_id % 41 <> 6)
    SELECT coalesce(e.vec_id, h.vec_id) AS row_id FROM embeddings e FULL JOIN head h ON e.vec_id = h.vec_id WHERE e.vec_id IS NULL OR h.vec_id IS NULL OR e.embedding <> h.v""")
def tied_weight_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tied head that lost some rows and holds others wrongly."""
    rows = matrix(spark, sf_dir)
    head = rows.where("row_id % 41 <> 6").withColumn("v", F.when(F.col("row_id") % 37 == 4, F.reverse("v")).otherwise(F.col("v")))
    return op.tied_mismatch(rows, head, "row_id", "v")


@query("""WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 1 THEN 2 ELSE 1 END AS workers, CASE WHEN o_orderkey % 8 = 3 THEN 'F16' ELSE 'preserve' END AS dtype,
        CASE o_orderkey % 4 WHEN 0 THEN 'identity' WHEN 1 THEN 'token-permutation' WHEN 2 THEN 'expand-test' ELSE 'other' END AS method, CASE WHEN o_orderkey % 3 = 0 THEN 'secret' END AS secret, o_orderkey % 5 AS vocab FROM orders)
    SELECT id, 'workers' AS reason FROM c WHERE workers <> 1 UNION ALL SELECT id, 'dtype' FROM c WHERE dtype <> 'preserve' UNION ALL SELECT id, 'unknown method' FROM c WHERE method = 'other'
    UNION ALL SELECT id, 'no secret' FROM c WHERE method = 'token-permutation' AND secret IS NULL UNION ALL SELECT id, 'a secret without use' FROM c WHERE method <> 'token-permutation' AND secret IS NOT NULL
    UNION ALL SELECT id, 'vocabulary too small' FROM c WHERE method = 'token-permutation' AND vocab < 2""")
def config_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    method = F.element_at(F.array(*[F.lit(m) for m in ("identity", "token-permutation", "expand-test", "other")]), (k % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 9 == 1, 2).otherwise(1).alias("workers"), F.when(k % 8 == 3, "F16").otherwise("preserve").alias("dtype"), method.alias("method"), F.when(k % 3 == 0, "secret").alias("secret"), (k % 5).alias("vocab"))
    return op.config_violations(rows)


_OPS_SQL = f"""{_INV}, o AS (SELECT row_number() OVER (ORDER BY encode(name)) - 1 AS position, name FROM inv),
    ops AS (SELECT position, CASE WHEN position = 6 THEN 5 ELSE position END AS op_id,
        CASE position WHEN 3 THEN [] WHEN 4 THEN [name, name] WHEN 7 THEN ['nowhere'] ELSE [name] END AS inputs, CASE position WHEN 8 THEN 'unplanned' WHEN 10 THEN (SELECT name FROM o WHERE position = 9) ELSE name END AS output,
        CASE position WHEN 11 THEN [12] WHEN 12 THEN [999] WHEN 13 THEN [13] WHEN 14 THEN [0, 1] ELSE [] END AS deps FROM o)"""


def _ops(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    inventory = tensors(spark, sf_dir)
    o = inventory.select("name", (F.row_number().over(Window.orderBy("name")) - 1).cast("long").alias("position"), F.lag("name").over(Window.orderBy("name")).alias("previous"))
    p, name = F.col("position"), F.col("name")
    none = F.array().cast("array<string>")
    inputs = F.when(p == 3, none).when(p == 4, F.array(name, name)).when(p == 7, F.array(F.lit("nowhere"))).otherwise(F.array(name))
    longs = lambda *v: F.array(*[F.lit(x).cast("long") for x in v])
    deps = F.when(p == 11, longs(12)).when(p == 12, longs(999)).when(p == 13, longs(13)).when(p == 14, longs(0, 1)).otherwise(F.array().cast("array<bigint>"))
    output = F.when(p == 8, "unplanned").when(p == 10, F.col("previous")).otherwise(name)
    return o.select("position", F.when(p == 6, F.lit(5).cast("long")).otherwise(p).alias("op_id"), inputs.alias("inputs"), output.alias("output"), deps.alias("dependencies")), inventory


@query(f"""WITH {_OPS_SQL},
    d AS (SELECT op_id, position, unnest(deps) AS dep FROM ops), places AS (SELECT op_id, max(position) AS place FROM ops GROUP BY op_id)
    SELECT op_id, 'id used twice' AS reason FROM ops GROUP BY op_id HAVING count(*) > 1
    UNION ALL SELECT op_id, 'no inputs' FROM ops WHERE len(inputs) = 0
    UNION ALL SELECT op_id, 'input listed twice' FROM ops WHERE len(list_distinct(inputs)) < len(inputs)
    UNION ALL SELECT op_id, 'unknown input' FROM (SELECT op_id, unnest(list_distinct(inputs)) AS i FROM ops) WHERE i NOT IN (SELECT name FROM inv)
    UNION ALL SELECT op_id, 'unknown output' FROM ops WHERE output NOT IN (SELECT name FROM inv)
    UNION ALL SELECT min(op_id), 'output produced twice' FROM ops GROUP BY output HAVING count(*) > 1
    UNION ALL SELECT d.op_id, CASE WHEN place IS NULL THEN 'unknown dependency' ELSE 'depends on a later operation' END FROM d LEFT JOIN places ON d.dep = places.op_id WHERE place IS NULL OR place >= d.position
    UNION ALL SELECT NULL, 'output without a producer' FROM inv WHERE name NOT IN (SELECT output FROM ops)""")
def plan_graph_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops, inventory = _ops(spark, sf_dir)
    return op.graph_violations(ops, inventory, inventory)


@query("""WITH c AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'identity' WHEN 1 THEN 'token-permutation' WHEN 2 THEN 'expand-test' ELSE 'nothing' END AS method,
        CASE WHEN p_partkey % 7 = 1 THEN 'own' ELSE 'huggingface' END AS runtime, p_partkey % 4 <> 2 OR p_partkey % 5 = 0 AS standard, CASE WHEN p_partkey % 4 = 2 AND p_partkey % 3 <> 0 THEN 3 WHEN p_partkey % 4 <> 2 AND p_partkey % 10 = 0 THEN 1 END AS expansion,
        CAST(8 AS BIGINT) AS logical, CAST(CASE WHEN p_partkey % 4 = 2 THEN 14 ELSE 8 END + CASE WHEN p_partkey % 6 = 0 THEN 1 ELSE 0 END AS BIGINT) AS physical FROM part)
    SELECT id, 'unknown method' AS reason FROM c WHERE method = 'nothing'
    UNION ALL SELECT id, 'a standard method keeps the runtime' FROM c WHERE method IN ('identity', 'token-permutation') AND (NOT standard OR runtime <> 'huggingface' OR expansion IS NOT NULL)
    UNION ALL SELECT id, 'a standard method keeps the dimensions' FROM c WHERE method IN ('identity', 'token-permutation') AND logical <> physical
    UNION ALL SELECT id, 'no expansion' FROM c WHERE method IN ('expand-test', 'nothing') AND coalesce(expansion, 0) <= 0
    UNION ALL SELECT id, 'a padded model is not standard' FROM c WHERE method IN ('expand-test', 'nothing') AND standard
    UNION ALL SELECT id, 'padded width' FROM c WHERE method IN ('expand-test', 'nothing') AND physical <> logical + 2 * expansion""")
def runtime_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    method = F.element_at(F.array(*[F.lit(m) for m in ("identity", "token-permutation", "expand-test", "nothing")]), (k % 4 + 1).cast("int"))
    physical = F.when(k % 4 == 2, 14).otherwise(8) + F.when(k % 6 == 0, 1).otherwise(0)
    rows = table(spark, sf_dir, "part").select(
        k.alias("id"),
        method.alias("method"),
        F.when(k % 7 == 1, "own").otherwise("huggingface").alias("runtime"),
        ((k % 4 != 2) | (k % 5 == 0)).alias("standard"),
        F.when((k % 4 == 2) & (k % 3 != 0), 3).when((k % 4 != 2) & (k % 10 == 0), 1).alias("expansion"),
        F.create_map(F.lit("hidden_size"), F.lit(8).cast("long")).alias("logical"),
        F.create_map(F.lit("hidden_size"), physical.cast("long")).alias("physical"),
    )
    return op.runtime_violations(rows)


@query("""WITH o AS (SELECT s_suppkey AS op_id, CASE s_suppkey % 3 WHEN 0 THEN 'expand-test' WHEN 1 THEN 'token-permutation' ELSE 'identity' END AS method, CASE s_suppkey % 5 WHEN 0 THEN 'copy' WHEN 1 THEN 'permute' ELSE 'pad' END AS kind,
        CASE WHEN s_suppkey % 7 = 0 THEN 4 ELSE 6 END AS extra, CASE s_suppkey % 4 WHEN 0 THEN [3, 9] WHEN 1 THEN [8] ELSE [3, 8] END AS ss, CASE WHEN s_suppkey % 5 <= 1 AND s_suppkey % 2 = 0 THEN [3, 8] ELSE [3, 14] END AS ts, CASE WHEN s_suppkey % 11 = 0 THEN 'F16' ELSE 'F32' END AS td FROM supplier)
    SELECT op_id, 'must keep name, shape and dtype' AS reason FROM o WHERE kind IN ('copy', 'permute') AND (ss <> ts OR td <> 'F32')
    UNION ALL SELECT op_id, 'permutation without its method' FROM o WHERE kind = 'permute' AND method <> 'token-permutation'
    UNION ALL SELECT op_id, 'padding without its method' FROM o WHERE kind = 'pad' AND method <> 'expand-test'
    UNION ALL SELECT op_id, 'padding of another width' FROM o WHERE kind = 'pad' AND extra <> 6
    UNION ALL SELECT op_id, 'padding of another kind of tensor' FROM o WHERE kind = 'pad' AND (len(ss) <> 2 OR td <> 'F32')
    UNION ALL SELECT op_id, 'padding of another dimension' FROM o WHERE kind = 'pad' AND coalesce(ss[2], -1) <> 8
    UNION ALL SELECT op_id, 'padded shape' FROM o WHERE kind = 'pad' AND ts <> [ss[1], ss[2] + extra]""")
def method_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    shape = lambda *v: F.array(*[F.lit(x).cast("long") for x in v])
    tensor = lambda dtype, s: F.struct(F.lit("w").alias("name"), dtype.alias("dtype"), s.alias("shape"))
    rows = table(spark, sf_dir, "supplier").select(
        k.alias("op_id"),
        F.when(k % 3 == 0, "expand-test").when(k % 3 == 1, "token-permutation").otherwise("identity").alias("method"),
        F.when(k % 5 == 0, "copy").when(k % 5 == 1, "permute").otherwise("pad").alias("kind"),
        F.when(k % 7 == 0, 4).otherwise(6).cast("long").alias("extra"),
        F.lit(3).cast("long").alias("expansion"),
        F.lit(8).cast("long").alias("hidden"),
        tensor(F.lit("F32"), F.when(k % 4 == 0, shape(3, 9)).when(k % 4 == 1, shape(8)).otherwise(shape(3, 8))).alias("source"),
        tensor(F.when(k % 11 == 0, "F16").otherwise("F32"), F.when((k % 5 <= 1) & (k % 2 == 0), shape(3, 8)).otherwise(shape(3, 14))).alias("target"),
    )
    return op.method_violations(rows)


@query("""WITH o AS (SELECT event_id - (SELECT min(event_id) FROM events) AS position, event_id - (SELECT min(event_id) FROM events) < 700 OR event_type = 'purchase' AS done FROM events),
    a AS (SELECT count(*) AS n, count(*) FILTER (WHERE done) AS n_done, max(position) FILTER (WHERE done) AS last_done, min(position) FILTER (WHERE NOT done) AS next_position FROM o)
    SELECT *, n_done = 0 OR n_done = last_done + 1 AS contiguous FROM a""")
def resume_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a run whose log says that its first 700 operations are done, and some later ones too."""
    events = table(spark, sf_dir, "events")
    first = events.agg(F.min("event_id").alias("first"))
    ops = events.crossJoin(F.broadcast(first)).select((F.col("event_id") - F.col("first")).alias("position"), "event_type")  # one row
    return op.resume_state(ops.select("position", ((F.col("position") < 700) | (F.col("event_type") == "purchase")).alias("done")))


#: The fields of a checkpoint's contract, and the customers whose stored one differs in each.
_FIELDS = {"version": 4, "source_fingerprint": 6, "plan_hash": 7, "layout_hash": 8, "method": 5, "secret_key_id": 11, "secret_id": 9, "runtime": 10}


@query(f"""WITH e AS (SELECT c_custkey AS id, {", ".join(f"CASE WHEN '{f}' LIKE 'secret%' THEN NULL ELSE c_name || '{f}' END AS {f}" for f in _FIELDS)} FROM customer),
    s AS (SELECT id, {", ".join(f"CASE WHEN id % {n} = 0 THEN 'another' ELSE {f} END AS {f}" for f, n in _FIELDS.items())} FROM e)
    {" UNION ALL ".join(f"SELECT id, '{f}' AS field FROM s JOIN e USING (id) WHERE s.{f} IS DISTINCT FROM e.{f}" for f in _FIELDS)}""")
def checkpoint_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields in which stored checkpoints differ from the run that wants to go on with them."""
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    expected = table(spark, sf_dir, "customer").select(k.alias("id"), *[(none if f.startswith("secret") else F.concat("c_name", F.lit(f))).alias(f) for f in _FIELDS])
    stored = expected.select("id", *[F.when(F.col("id") % n == 0, "another").otherwise(F.col(f)).alias(f) for f, n in _FIELDS.items()])
    return op.contract_differences(stored, expected, list(_FIELDS))


@query("""SELECT DISTINCT k AS "key" FROM (SELECT unnest(json_keys(props)) AS k FROM events WHERE event_id % 3 <> 1 UNION ALL SELECT 'extra' FROM events WHERE event_id % 7 = 0) WHERE k <> 'k'""")
def unexpected_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of documents that aren't among those that may be missing from a model."""
    events = table(spark, sf_dir, "events")
    keys = events.where("event_id % 3 <> 1").select(F.explode(F.json_object_keys("props")).alias("key")).unionByName(events.where("event_id % 7 = 0").select(F.lit("extra").alias("key")))
    return op.unexpected_keys(keys, spark.createDataFrame([("k",)], "key string"))


@query("""WITH d AS (SELECT n_name AS name, n_nationkey % 6 AS k, sha256(n_name || '|' || n_nationkey) AS digest FROM nation), m AS (SELECT name, digest FROM d WHERE k <> 3),
    a AS (SELECT name, CASE WHEN k = 1 THEN reverse(digest) ELSE digest END AS digest FROM d WHERE k <> 2)
    SELECT coalesce(m.name, a.name) AS name, CASE WHEN a.name IS NULL THEN 'missing' WHEN m.name IS NULL THEN 'unexpected' ELSE 'corrupted' END AS reason
    FROM m FULL JOIN a ON m.name = a.name WHERE m.digest IS DISTINCT FROM a.digest""")
def manifest_tamper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What verification finds when payloads were changed, lost or added after the manifest was written."""
    k = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation")
    digest = F.sha2(F.concat_ws("|", "n_name", k.cast("string")), 256)
    manifest = rows.where(k % 6 != 3).select(F.col("n_name").alias("name"), digest.alias("digest"))
    actual = rows.where(k % 6 != 2).select(F.col("n_name").alias("name"), F.when(k % 6 == 1, F.reverse(digest)).otherwise(digest).alias("digest"))
    return op.digest_differences(manifest, actual)
