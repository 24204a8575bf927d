"""Tool calls of conversations: linked to their results, ordered, checked and written as canonical JSON.

Calls and results meet by identifier in a hash join, results having been reduced to one row an identifier before; what
an identifier that very many calls share is joined with is repeated, and its calls are dealt among the repeats. Calls
without an identifier are never exchanged. The dependencies between calls give each its level, the longest way to a call
that depends on none. Pointers to single parents are doubled, so that a conversation of n calls takes log2(n) rounds;
only calls with several parents are then ordered among each other, level by level. Only built-in functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import cut, join_facts, join_salted

#: What schema_of_variant() calls a value of each type of a JSON schema.
TYPES = {
    "string": ("STRING",),
    "boolean": ("BOOLEAN",),
    "null": ("VOID",),
    "integer": ("BIGINT",),
    "number": ("BIGINT", "DOUBLE", "DECIMAL"),
    "array": ("ARRAY",),
    "object": ("OBJECT",),
}

#: Of each tool its arguments: (type, required) or (type, required, limits), limits being a JSON schema's minLength, maxLength
#: (in characters), minimum, maximum and enum.
Schemas = dict[str, dict[str, tuple]]


def _broken(value: Column, key: str, kind: str, limits: dict) -> list[Column]:
    """A message for every limit that the value of a fitting type goes beyond."""
    path, out = f"$['{key}']", []
    text, number = F.char_length(F.try_variant_get(value, path, "string")), F.try_variant_get(value, path, "double")
    for name, limit in limits.items():
        if name in ("minLength", "maxLength"):
            wrong = text < limit if name == "minLength" else text > limit
            out.append(F.when(wrong, F.lit(f"{'shorter' if name == 'minLength' else 'longer'} than {limit}: {key}")))
        elif name in ("minimum", "maximum"):
            wrong = number < limit if name == "minimum" else number > limit
            out.append(F.when(wrong, F.lit(f"{'below' if name == 'minimum' else 'above'} {limit}: {key}")))
        elif name == "enum":
            out.append(F.when(~F.try_variant_get(value, path, "string").isin([str(x) for x in limit]), F.lit(f"none of its values: {key}")))
        else:
            raise ValueError(f"{name} is no limit of a {kind}")
    return out


def canonical(json_text: Column) -> Column:
    """JSON with sorted keys and no spaces; null where the text is not JSON."""
    return F.to_json(F.try_parse_json(json_text))


def problems_of(tool: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with the arguments, by the tool's schema {name: (type, required)}: sorted messages, none if valid.

    The schemas are part of the program, so the expression has a term for each of their names.
    """
    value = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    out = F.array(F.lit("unknown tool"))
    for name, schema in schemas.items():
        terms = [F.lit(None).cast("string")]
        for key, (kind, required, *limits) in schema.items():
            found = F.schema_of_variant(F.try_variant_get(value, f"$['{key}']", "variant"))
            fits = F.lit(False)
            for start in TYPES[kind]:
                fits = fits | found.startswith(start)
            absent = F.lit(f"missing {key}") if required else F.lit(None).cast("string")
            terms.append(F.when(found.isNull(), absent).when(~fits, F.lit(f"not {kind}: {key}")))
            terms += [F.when(fits, wrong) for wrong in _broken(value, key, kind, limits[0] if limits else {})]
        extra = F.array_except(F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>")), F.array(*[F.lit(k) for k in schema]) if schema else F.array().cast("array<string>"))
        found = F.concat(F.array_compact(F.array(*terms)), F.transform(extra, lambda k: F.concat(F.lit("unexpected "), k)))
        out = F.when(tool == name, F.when(is_object, F.array_sort(found)).otherwise(F.array(F.lit("arguments are no object")))).otherwise(out)
    return out


def _doubled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root, level, stuck) where each node has one parent at most: its first ancestor and the way to it.

    Pointers jump twice as far each round. Nodes on or behind a circle reach no ancestor without a parent: these are stuck.
    """
    parent = edges.select(F.col("child").alias("id"), F.col("parent").alias("to"))
    state = nodes.join(parent, "id", "left").select("id", "to", F.coalesce("to", "id").alias("root"), F.when(F.col("to").isNotNull(), 1).otherwise(0).cast("long").alias("level"))
    state = cut(state)
    n = state.count()
    for _ in range(math.ceil(math.log2(max(2, n))) + 1):
        if state.where("to IS NOT NULL").isEmpty():
            break
        # many nodes may point to one: those are joined apart
        sizes = state.where("to IS NOT NULL").groupBy(F.col("to").alias("id")).agg(F.count("*").alias("__n"))
        aims = state.select("id", F.col("to").alias("__to"), F.col("root").alias("__root"), F.col("level").alias("__more")).join(sizes, "id").withColumnRenamed("id", "to")
        met = join_facts(state, aims, "to", "__n", ["id"], n)
        state = cut(met.select("id", F.col("__to").alias("to"), F.coalesce("__root", "root").alias("root"), (F.col("level") + F.coalesce("__more", F.lit(0))).alias("level")))
    return state.select("id", "root", "level", F.col("to").isNotNull().alias("stuck"))


def _peeled(several: DataFrame) -> DataFrame:
    """(id, level) of nodes with several parents; null on or behind a circle.

    several: (id, root, way, stuck, joins): for each parent of a node that parent's first ancestor, the way from there, and
    whether that ancestor has several parents itself. Each round takes the nodes all of whose parents' levels are known.
    """
    known = F.max(F.when(~F.col("joins"), F.col("way"))).alias("best")
    state = cut(several.groupBy("id").agg(F.count_if(F.col("joins") | F.col("stuck")).alias("open"), F.coalesce(known, F.lit(0).cast("long")).alias("best")).withColumn("round", F.when(F.col("open") == 0, 0)))
    edges = cut(several.where("joins AND NOT stuck").groupBy("root", "id").agg(F.max("way").alias("way"), F.count("*").alias("n")))
    done = 0
    while not (front := state.where(F.col("round") == done)).isEmpty():
        met = edges.join(front.select(F.col("id").alias("root"), F.col("best").alias("__at")), "root")
        met = met.groupBy("id").agg(F.max(F.col("__at") + F.col("way")).alias("__best"), F.sum("n").alias("__met"))
        done += 1
        left = F.col("open") - F.coalesce("__met", F.lit(0))
        state = cut(state.join(met, "id", "left").select("id", left.alias("open"), F.greatest("best", F.coalesce("__best", "best")).alias("best"), F.when(F.col("round").isNull() & (left == 0), F.lit(done)).otherwise(F.col("round")).alias("round")))
    return state.select("id", F.when(F.col("round").isNotNull(), F.col("best")).alias("level"))


def levels(calls: DataFrame) -> DataFrame:
    """(id, level) of every distinct call_id: 0 without (known) dependencies, else one more than the highest of them."""
    nodes = cut(calls.where("call_id IS NOT NULL").groupBy(F.col("call_id").alias("id")).agg(F.count("*").alias("__rows")).select("id"))
    edges = cut(calls.select(F.col("call_id").alias("child"), F.explode("depends_on").alias("parent")).where("child IS NOT NULL AND parent IS NOT NULL").distinct())
    n = edges.count()
    asked = edges.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("__n"))
    there = asked.join(nodes, "id").select(F.col("id").alias("parent"), "__n", F.lit(True).alias("__there"))
    edges = cut(join_facts(edges, there, "parent", "__n", ["child"], n).where("__there").select("child", "parent"))
    joins = cut(edges.groupBy(F.col("child").alias("id")).agg(F.count("*").alias("__p")).where("__p > 1").select("id"))
    if joins.isEmpty():
        return _doubled(nodes, edges).select("id", F.when(~F.col("stuck"), F.col("level")).alias("level"))

    single = edges.join(joins.withColumnRenamed("id", "child"), "child", "left_anti")
    forest = cut(_doubled(nodes, single))  # nodes with several parents begin trees of their own
    n = max(1, forest.count())
    many = joins.select(F.col("id").alias("root"), F.lit(True).alias("__joins"))
    sizes = forest.groupBy("root").agg(F.count("*").alias("__n"))
    forest = cut(join_facts(forest, many.join(sizes, "root"), "root", "__n", ["id"], n).select("id", "root", "level", "stuck", F.coalesce("__joins", F.lit(False)).alias("joins")))
    parents = edges.join(joins.withColumnRenamed("id", "child"), "child", "left_semi")
    asked = parents.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("__n")).join(forest, "id").withColumnRenamed("id", "parent")
    several = join_facts(parents, asked, "parent", "__n", ["child"], max(1, n)).select(F.col("child").alias("id"), "root", (F.col("level") + 1).alias("way"), "stuck", (F.col("joins") & ~F.col("stuck")).alias("joins"))
    tops = _peeled(cut(several)).select(F.col("id").alias("root"), F.col("level").alias("__top"))
    met = join_facts(forest, tops.join(sizes, "root"), "root", "__n", ["id"], n)
    level = F.when(F.col("joins"), F.col("__top") + F.col("level")).otherwise(F.col("level"))
    return met.select("id", F.when(~F.col("stuck"), level).alias("level"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row for every call, and one for every identifier that only results have.

    calls: call_id, position, tool, arguments (JSON text), depends_on (array of call_id); results: call_id, position, content.
    Gives call_id, position, tool, status, level, n_results, result_position, valid, problems and json.

    status: 'linked', 'pending' (no result) or 'orphan' (no call). Of several results the one with the smallest
    (position, content) is linked, and n_results counts all. Calls that share an identifier stay rows of their own, with
    the same result and level. A null identifier is linked to nothing: such calls are pending at level 0, such
    results are left out. Dependencies on unknown calls are passed over. Calls on or behind a circle have level null and the
    problem 'circular'. Sorting by (level, position) is a topological order. json has sorted keys, no spaces, and the
    arguments in canonical form (null where they are no JSON). Other columns of the inputs are not carried.
    """
    found = results.where("call_id IS NOT NULL").groupBy("call_id").agg(F.min(F.struct("position", "content")).alias("__r"), F.count("*").alias("n_results"))
    mine = calls.select("call_id", "position", "tool", "arguments", F.lit(True).alias("__call"))
    named = mine.where("call_id IS NOT NULL")
    shared = named.groupBy("call_id").agg(F.count("*").alias("__n"))
    facts = shared.join(levels(calls).select(F.col("id").alias("call_id"), F.col("level").alias("__level")), "call_id", "left").join(found, "call_id", "full")
    facts = cut(facts.withColumn("__found", F.col("n_results").isNotNull()))  # one row an identifier
    linked = join_salted(named, facts.where("__n IS NOT NULL"), "call_id", "__n", ["position", "arguments"], named.count())
    bare = lambda rows: rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in linked.schema])
    met = linked.unionByName(bare(mine.where("call_id IS NULL"))).unionByName(bare(facts.where("__n IS NULL")))
    is_call = F.col("__call").isNotNull()
    circular = is_call & F.col("call_id").isNotNull() & F.col("__level").isNull()
    problems = F.concat(problems_of(F.col("tool"), F.col("arguments"), schemas), F.when(circular, F.array(F.lit("circular"))).otherwise(F.array().cast("array<string>")))
    out = met.select(
        "call_id",
        "position",
        "tool",
        F.when(~is_call, "orphan").when(F.col("__found"), "linked").otherwise("pending").alias("status"),
        F.when(is_call & F.col("call_id").isNull(), F.lit(0).cast("long")).otherwise(F.col("__level")).alias("level"),
        F.coalesce("n_results", F.lit(0).cast("long")).alias("n_results"),
        F.col("__r.position").alias("result_position"),
        F.when(is_call, problems).alias("problems"),
        F.col("__r.content").alias("__content"),
        F.try_parse_json("arguments").alias("__arguments"),
    )
    record = F.struct(F.col("__arguments").alias("arguments"), F.col("call_id").alias("id"), "level", "problems", F.col("__content").alias("result"), "status", "tool")
    out = out.withColumns({"valid": F.size("problems") == 0, "json": F.to_json(record, {"ignoreNullFields": "false"})})
    return out.select("call_id", "position", "tool", "status", "level", "n_results", "result_position", "valid", "problems", "json")
