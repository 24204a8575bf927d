"""The rules of artifacts and plans: each gives the rows that break it, so that no rows means the rule holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.errors import EngineError, InvalidArtifact
from tensorloom.functions.scalars import byte_length, natural_field

#: The dimensions that a config must have.
REQUIRED = ("hidden_size", "intermediate_size", "num_attention_heads", "num_hidden_layers", "vocab_size")
VOCABULARY_DTYPES = ("F32", "F16", "BF16")


def require_none(violations: DataFrame, error: type[EngineError] = InvalidArtifact) -> None:
    """Raises the error with some of the violations, if there are any."""
    found = violations.limit(5).collect()
    if found:
        raise error("; ".join(" ".join(str(v) for v in row if v is not None) for row in found))


def _reasons(df: DataFrame, keep: list[str], *rules: tuple[Column, str]) -> DataFrame:
    """A row (*keep, reason) for every rule that a row of df breaks; a rule that is null is not broken."""
    found = F.array_compact(F.array(*[F.when(rule, F.lit(text)) for rule, text in rules]))
    return df.select(*keep, F.explode(found).alias("reason"))


def bad_names(tensors: DataFrame) -> DataFrame:
    return _reasons(tensors, ["name"], (F.col("name") == "", "empty"), (F.instr("name", "\0") > 0, "has a zero byte"))


def duplicate_tensors(tensors: DataFrame) -> DataFrame:
    """(name, copies, shards): tensors that are there more than once, in one shard or several."""
    groups = tensors.groupBy("name").agg(F.count("*").alias("copies"), F.countDistinct("shard").alias("shards"))
    return groups.where("copies > 1")


def range_violations(entries: DataFrame) -> DataFrame:
    """(shard, name, reason) of header entries (shard, name, dtype, shape, begin, end, data_bytes) whose range is wrong."""
    expected = byte_length(F.col("shape"), F.col("dtype"))
    return _reasons(entries, ["shard", "name"], ((F.col("begin") > F.col("end")) | (F.col("end") > F.col("data_bytes")), "range outside the payload"), (expected.isNull(), "unknown dtype"), (expected != F.col("end") - F.col("begin"), "shape and range differ"))


def tiling_violations(entries: DataFrame) -> DataFrame:
    """(shard, name, reason) where the entries of a shard leave a hole, overlap, or end before its payload does.

    In order of (begin, end, name) each must begin where those before have ended. Empty entries are allowed.
    """
    order = Window.partitionBy("shard").orderBy("begin", "end", "name")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = entries.withColumns({"reached": F.coalesce(F.max("end").over(before), F.lit(0)), "is_last": F.lead("name").over(order).isNull()})
    rules = ((F.col("begin") > F.col("reached"), "hole"), (F.col("begin") < F.col("reached"), "overlap"), (F.col("is_last") & (F.greatest("end", "reached") < F.col("data_bytes")), "payload goes on"))
    return _reasons(rows, ["shard", "name"], *rules)


def weight_map_mismatch(index: DataFrame, tensors: DataFrame) -> DataFrame:
    """(name, reason) where an index (name, shard) and the physical tensors (name, shard) differ; './x' is the file x."""
    plain = lambda c: F.regexp_replace(c, r"^(\./)+", "")
    a = index.select(F.col("name").alias("a"), plain("shard").alias("a_shard"))
    b = tensors.select(F.col("name").alias("b"), plain("shard").alias("b_shard"))
    reason = F.when(F.col("b").isNull(), "no such tensor").when(F.col("a").isNull(), "not in the index").when(F.col("a_shard") != F.col("b_shard"), "in another shard")
    return a.join(b, F.col("a") == F.col("b"), "full").select(F.coalesce("a", "b").alias("name"), reason.alias("reason")).where("reason IS NOT NULL")


def format_conflicts(shards: DataFrame) -> DataFrame:
    """(formats): the formats that shards (shard, format) claim, where they claim more than one."""
    return shards.agg(F.array_join(F.array_sort(F.collect_set("format")), ",").alias("formats"), F.countDistinct("format").alias("n")).where("n > 1").select("formats")


def total_mismatch(tensors: DataFrame, claimed: DataFrame) -> DataFrame:
    """(total_size, actual) where an index claims (total_size; null claims nothing) another total than the tensors'."""
    actual = tensors.agg(F.coalesce(F.sum("byte_length"), F.lit(0)).cast("long").alias("actual"))
    return claimed.crossJoin(F.broadcast(actual)).where("total_size <> actual").select("total_size", "actual")  # one row


def path_violations(paths: DataFrame) -> DataFrame:
    """(path, reason) of relative paths that would leave their root, by their text alone."""
    parts = F.split("path", "/")
    return _reasons(paths, ["path"], (F.col("path") == "", "empty"), (F.col("path").startswith("/"), "absolute"), (F.array_contains(parts, ".."), "goes up"))


def nested_paths(pairs: DataFrame) -> DataFrame:
    """(left, right) of absolute, normalised paths of which one is or holds the other."""
    slash = lambda c: F.concat(F.rtrim(F.col(c), F.lit("/")), F.lit("/"))
    return pairs.where(F.startswith(slash("left"), slash("right")) | F.startswith(slash("right"), slash("left")))


def detect_architecture(configs: DataFrame, known: dict[str, str]) -> DataFrame:
    """(id, matches, verdict) of configs (id, config): 'ok' if one known model type is the config's, else why not."""
    kind = F.get_json_object("config", "$.model_type")
    matches = F.array_compact(F.array(*[F.when(kind == value, F.lit(name)) for name, value in sorted(known.items())]))
    rows = configs.withColumn("matches", F.size(matches))
    verdict = F.when(F.col("matches") == 1, "ok").when(F.col("matches") == 0, "unsupported").otherwise("ambiguous")
    return rows.select("id", "matches", verdict.alias("verdict"))


def dimension_violations(configs: DataFrame) -> DataFrame:
    """(id, reason) of configs (id, config) whose dimensions are missing or don't go together."""
    get = lambda name: natural_field(F.col("config"), name)
    rows = configs.withColumns({name: get(name) for name in REQUIRED} | {"kv": F.coalesce(get("num_key_value_heads"), get("num_attention_heads")), "head": get("head_dim")})
    heads, hidden = F.col("num_attention_heads"), F.col("hidden_size")
    rows = rows.withColumn("head", F.coalesce("head", F.when((heads > 0) & (hidden % F.when(heads > 0, heads) == 0), F.floor(hidden / F.when(heads > 0, heads)))))
    rules = [(F.col(name).isNull(), f"no {name}") for name in REQUIRED]
    rules += [
        (heads == 0, "no heads"),
        (F.col("kv") == 0, "no key-value heads"),
        (F.col("kv") > heads, "more key-value heads than heads"),
        (hidden % F.when(heads > 0, heads) != 0, "heads don't divide the hidden size"),
        (heads * F.col("head") != hidden, "heads times their width is not the hidden size"),
    ]
    return _reasons(rows, ["id"], *rules)


#: The tensors of a layer and the dimensions of their shape.
LAYER = {
    "input_layernorm.weight": ("hidden",),
    "mlp.down_proj.weight": ("hidden", "inner"),
    "mlp.gate_proj.weight": ("inner", "hidden"),
    "mlp.up_proj.weight": ("inner", "hidden"),
    "post_attention_layernorm.weight": ("hidden",),
    "self_attn.k_proj.weight": ("kv", "hidden"),
    "self_attn.o_proj.weight": ("hidden", "hidden"),
    "self_attn.q_proj.weight": ("hidden", "hidden"),
    "self_attn.v_proj.weight": ("kv", "hidden"),
}
WHOLE = {"model.embed_tokens.weight": ("vocab", "hidden"), "model.norm.weight": ("hidden",), "lm_head.weight": ("vocab", "hidden")}


def expected_tensors(models: DataFrame) -> DataFrame:
    """(id, name, shape, optional) that models (id, layers, hidden, inner, kv, vocab, tied) must have; a tied head may lack."""
    dims = lambda names: F.array(*[F.col(n).cast("long") for n in names])
    layer = F.array(*[F.struct(F.lit(name).alias("suffix"), dims(shape).alias("shape")) for name, shape in LAYER.items()])
    rows = models.where("layers > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("layers") - 1)).alias("layer")).select("id", "layer", F.inline(layer))
    rows = rows.select("id", F.format_string("model.layers.%d.%s", "layer", "suffix").alias("name"), "shape", F.lit(False).alias("optional"))
    whole = F.array(*[F.struct(F.lit(name).alias("name"), dims(shape).alias("shape"), (F.lit(name == "lm_head.weight") & F.col("tied")).alias("optional")) for name, shape in WHOLE.items()])
    return rows.unionByName(models.select("id", F.inline(whole)))


def schema_violations(expected: DataFrame, tensors: DataFrame) -> DataFrame:
    """(id, name, reason) where a model's tensors (id, name, shape) lack one, or have it in another shape. More tensors are allowed."""
    t = tensors.select(F.col("id").alias("t_id"), F.col("name").alias("t_name"), F.col("shape").alias("t_shape"))
    met = expected.join(t, (F.col("id") == F.col("t_id")) & (F.col("name") == F.col("t_name")), "left")
    reason = F.when(F.col("t_name").isNull() & ~F.col("optional"), "missing").when(F.col("t_shape") != F.col("shape"), "another shape")
    return met.select("id", "name", reason.alias("reason")).where("reason IS NOT NULL")


def token_method_violations(tensors: DataFrame, vocab: int, by: list[str] | None = None) -> DataFrame:
    """(*by, name, reason) of tensors (*by, name, dtype, shape) that keep a vocabulary from being permuted."""
    matrix = F.col("name").isin("model.embed_tokens.weight", "lm_head.weight")
    return _reasons(
        tensors,
        [*(by or []), "name"],
        (F.col("name") == "lm_head.bias", "a head with a bias"),
        (matrix & ~F.col("dtype").isin(*VOCABULARY_DTYPES), "dtype of a vocabulary"),
        (matrix & (F.coalesce(F.get("shape", F.lit(0)), F.lit(-1)) != vocab), "rows are not the vocabulary"),
    )


def tied_mismatch(embedding: DataFrame, head: DataFrame, row_id: str, value: str) -> DataFrame:
    """(row_id) of rows in which a tied head differs from the embedding, or that one of them lacks."""
    a = embedding.select(F.col(row_id).alias("a"), F.col(value).alias("x"))
    b = head.select(F.col(row_id).alias("b"), F.col(value).alias("y"))
    met = a.join(b, F.col("a") == F.col("b"), "full")
    return met.where(F.col("a").isNull() | F.col("b").isNull() | ~F.col("x").eqNullSafe(F.col("y"))).select(F.coalesce("a", "b").alias(row_id))


def config_violations(configs: DataFrame) -> DataFrame:
    """(id, reason) of plan requests (id, workers, dtype, method, secret, vocab) that no plan is made for."""
    token = F.col("method") == "token-permutation"
    return _reasons(
        configs,
        ["id"],
        (F.col("workers") != 1, "workers"),
        (F.col("dtype") != "preserve", "dtype"),
        (~F.col("method").isin("identity", "token-permutation", "expand-test"), "unknown method"),
        (token & F.col("secret").isNull(), "no secret"),
        (~token & F.col("secret").isNotNull(), "a secret without use"),
        (token & (F.col("vocab") < 2), "vocabulary too small"),
    )


def graph_violations(ops: DataFrame, sources: DataFrame, outputs: DataFrame) -> DataFrame:
    """(op_id, reason) of plan operations (position, op_id, inputs, output, dependencies) that break the plan's graph.

    sources and outputs are inventories (name). op_id is null where an output has no producer.
    """
    keep = ["op_id"]
    twice = ops.groupBy("op_id").agg(F.count("*").alias("n")).where("n > 1").select("op_id", F.lit("id used twice").alias("reason"))
    plain = _reasons(ops, keep, (F.size("inputs") == 0, "no inputs"), (F.size(F.array_distinct("inputs")) < F.size("inputs"), "input listed twice"))
    inputs = ops.select("op_id", F.explode(F.array_distinct("inputs")).alias("name"))
    unknown = inputs.join(sources.select("name"), "name", "left_anti").select("op_id", F.lit("unknown input").alias("reason"))
    extra = ops.select("op_id", F.col("output").alias("name")).join(outputs.select("name"), "name", "left_anti").select("op_id", F.lit("unknown output").alias("reason"))
    producers = ops.groupBy("output").agg(F.count("*").alias("n"), F.min("op_id").alias("op_id")).where("n > 1").select("op_id", F.lit("output produced twice").alias("reason"))
    places = ops.groupBy("op_id").agg(F.max("position").alias("at"))
    depends = ops.select("op_id", "position", F.explode("dependencies").alias("on")).join(places.select(F.col("op_id").alias("on"), "at"), "on", "left")
    late = depends.select("op_id", F.when(F.col("at").isNull(), "unknown dependency").when(F.col("at") >= F.col("position"), "depends on a later operation").alias("reason")).where("reason IS NOT NULL")
    unmade = outputs.select("name").join(ops.select(F.col("output").alias("name")), "name", "left_anti").select(F.lit(None).cast("long").alias("op_id"), F.lit("output without a producer").alias("reason"))
    out = twice
    for part in (plain, unknown, extra, producers, late, unmade):
        out = out.unionByName(part)
    return out


def runtime_violations(contracts: DataFrame) -> DataFrame:
    """(id, reason) of runtime contracts (id, method, runtime, standard, expansion, logical, physical: maps of dimensions)."""
    standard = F.col("method").isin("identity", "token-permutation")
    hidden = F.lit("hidden_size")
    pairs = lambda c: F.array_sort(F.map_entries(c))
    wide = F.get(F.filter(F.map_entries("physical"), lambda e: e["key"] == hidden), F.lit(0))["value"]
    plain = F.get(F.filter(F.map_entries("logical"), lambda e: e["key"] == hidden), F.lit(0))["value"]
    return _reasons(
        contracts,
        ["id"],
        (~standard & (F.col("method") != "expand-test"), "unknown method"),
        (standard & (~F.col("standard") | (F.col("runtime") != "huggingface") | F.col("expansion").isNotNull()), "a standard method keeps the runtime"),
        (standard & (pairs("logical") != pairs("physical")), "a standard method keeps the dimensions"),
        (~standard & (F.coalesce("expansion", F.lit(0)) <= 0), "no expansion"),
        (~standard & F.col("standard"), "a padded model is not standard"),
        (~standard & (wide != plain + 2 * F.col("expansion")), "padded width"),
    )


def method_violations(ops: DataFrame) -> DataFrame:
    """(op_id, reason) of operations (op_id, method, kind, extra, expansion, hidden, source, target) that their method doesn't allow.

    source and target are structs (name, dtype, shape).
    """
    same = F.col("source") == F.col("target")
    s, t = F.col("source"), F.col("target")
    pads = F.col("kind") == "pad"
    return _reasons(
        ops,
        ["op_id"],
        (F.col("kind").isin("copy", "permute") & ~same, "must keep name, shape and dtype"),
        ((F.col("kind") == "permute") & (F.col("method") != "token-permutation"), "permutation without its method"),
        (pads & (F.col("method") != "expand-test"), "padding without its method"),
        (pads & (F.col("extra") != 2 * F.col("expansion")), "padding of another width"),
        (pads & ((F.size(s["shape"]) != 2) | (s["dtype"] != t["dtype"])), "padding of another kind of tensor"),
        (pads & (F.coalesce(F.get(s["shape"], F.lit(1)), F.lit(-1)) != F.col("hidden")), "padding of another dimension"),
        (pads & (t["shape"] != F.array(F.get(s["shape"], F.lit(0)), F.get(s["shape"], F.lit(1)) + F.col("extra"))), "padded shape"),
    )


def resume_state(ops: DataFrame) -> DataFrame:
    """One row on operations (position, done): how many are done, up to where, and whether these are a first part without gaps."""
    out = ops.agg(F.count("*").alias("n"), F.count_if("done").alias("n_done"), F.max(F.when(F.col("done"), F.col("position"))).alias("last_done"), F.min(F.when(~F.col("done"), F.col("position"))).alias("next_position"))
    whole = (F.col("n_done") == 0) | (F.col("n_done") == F.col("last_done") + 1)
    return out.withColumn("contiguous", whole)


def contract_differences(stored: DataFrame, expected: DataFrame, fields: list[str]) -> DataFrame:
    """(id, field): fields of one contract a row that are not the same (null being like null) as those expected of the id."""
    a, b = stored.alias("a"), expected.alias("b")
    met = a.join(b, F.col("a.id") == F.col("b.id"), "left")
    found = F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]))
    return met.select(F.col("a.id").alias("id"), F.explode(found).alias("field"))


def unexpected_keys(missing: DataFrame, allowed: DataFrame) -> DataFrame:
    """The distinct keys (key) that are missing and not among those that may be."""
    return missing.select("key").subtract(allowed.select("key"))


def digest_differences(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """(name, reason) where digests (name, digest) that a manifest has and those of what is there differ."""
    a = manifest.select(F.col("name").alias("a"), F.col("digest").alias("x"))
    b = actual.select(F.col("name").alias("b"), F.col("digest").alias("y"))
    reason = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unexpected").when(F.col("x") != F.col("y"), "corrupted")
    return a.join(b, F.col("a") == F.col("b"), "full").select(F.coalesce("a", "b").alias("name"), reason.alias("reason")).where("reason IS NOT NULL")
