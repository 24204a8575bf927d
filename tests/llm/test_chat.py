import json
import random

import pytest
from pyspark.sql import functions as F

from tensorloom.llm import chat

CALLS = "call_id string, position bigint, tool string, arguments string, depends_on array<string>"
RESULTS = "call_id string, position bigint, content string"
SCHEMAS = {"add": {"x": ("integer", True), "y": ("number", False), "tags": ("array", False)}, "ping": {}}


def link(spark, calls, results=()):
    frame = chat.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(list(results), RESULTS), SCHEMAS)
    return {(r["call_id"], r["position"]): r for r in frame.collect()}


def test_links(spark):
    calls = [("a", 1, "ping", "{}", []), ("b", 2, "ping", "{}", ["a"]), ("b", 3, "ping", "{}", ["a"]), (None, 4, "ping", "{}", None)]
    results = [("a", 9, "late"), ("a", 5, "z"), ("a", 5, "é\n"), ("x", 6, "lost"), (None, 7, "nobody")]
    found = link(spark, calls, results)
    assert len(found) == 5
    a = found["a", 1]
    assert (a["status"], a["n_results"], a["result_position"], a["level"], a["valid"]) == ("linked", 3, 5, 0, True)
    assert a["json"] == '{"arguments":{},"id":"a","level":0,"problems":[],"result":"z","status":"linked","tool":"ping"}'
    assert [found["b", p]["level"] for p in (2, 3)] == [1, 1] and found["b", 2]["status"] == "pending"
    assert found[None, 4]["level"] == 0 and found[None, 4]["status"] == "pending"
    assert found["x", None]["status"] == "orphan" and found["x", None]["problems"] is None


@pytest.mark.parametrize(
    ("tool", "arguments", "problems"),
    [
        ("add", '{"y": 1.5, "x": 2, "tags": ["t"]}', []),
        ("add", '{"x": "2"}', ["not integer: x"]),
        ("add", '{"x": 1.5, "z": 0}', ["not integer: x", "unexpected z"]),
        ("add", "{}", ["missing x"]),
        ("add", "[1]", ["arguments are no object"]),
        ("add", "{broken", ["arguments are no object"]),
        ("add", None, ["arguments are no object"]),
        ("ping", '{"a": null}', ["unexpected a"]),
        ("other", "{}", ["unknown tool"]),
    ],
)
def test_schemas(spark, tool, arguments, problems):
    found = link(spark, [("a", 1, tool, arguments, [])])["a", 1]
    assert found["problems"] == problems and found["valid"] == (not problems)


def test_canonical_json(spark):
    text = '{ "b" : [1, {"z": 1, "a": "\\u00e9"}], "a": null }'
    found = spark.range(1).select(chat.canonical(F.lit(text)).alias("j"), chat.canonical(F.lit("{x")).alias("n")).first()
    assert found["j"] == json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert found["n"] is None


def plain_levels(edges, nodes):
    level = dict.fromkeys(nodes)
    for _ in nodes:
        for n in nodes:
            above = [p for c, p in edges if c == n and p in level]
            if level[n] is None and all(level[p] is not None for p in above):
                level[n] = 1 + max((level[p] for p in above), default=-1)
    return level


def test_limits_of_schemas(spark):
    schemas = {"say": {"text": ("string", True, {"minLength": 2, "maxLength": 4}), "n": ("integer", False, {"minimum": 0, "maximum": 9}), "mood": ("string", False, {"enum": ["glad", "sad"]})}}
    cases = [('{"text": "ab", "n": 9, "mood": "sad"}', []), ('{"text": "é"}', ["shorter than 2: text"]), ('{"text": "abcde", "n": -1}', ["below 0: n", "longer than 4: text"]), ('{"text": "abc", "n": 10, "mood": "so"}', ["above 9: n", "none of its values: mood"]), ('{"text": 5, "n": "x"}', ["not integer: n", "not string: text"])]
    calls = [(f"c{i}", i, "say", arguments, []) for i, (arguments, _) in enumerate(cases)]
    frame = chat.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), schemas)
    assert {r["position"]: r["problems"] for r in frame.collect()} == {i: p for i, (_, p) in enumerate(cases)}
    with pytest.raises(ValueError, match="no limit"):
        chat.problems_of(F.lit("t"), F.lit("{}"), {"t": {"x": ("string", True, {"pattern": "a"})}})


def test_hot_identifiers_long_texts_and_more_columns(spark):
    """A third of all calls share an identifier, a third have none; one result is very long; the inputs have other columns."""
    calls = [("hot" if i % 3 == 0 else None if i % 3 == 1 else f"c{i}", i, "ping", "{}", ["hot"] if i % 3 == 2 else []) for i in range(3000)]
    long = "word " * 200_000
    results = [("hot", 1, long), ("hot", 2, "x"), ("c2", 3, ""), (None, 4, "x")]
    more = spark.createDataFrame(calls, CALLS).withColumns({"status": F.lit("mine"), "json": F.lit(1), "__n": F.lit(2)})
    found = chat.link_calls(more, spark.createDataFrame(results, RESULTS).withColumn("level", F.lit(9)), SCHEMAS)
    assert found.columns == ["call_id", "position", "tool", "status", "level", "n_results", "result_position", "valid", "problems", "json"]
    got = found.select("call_id", "position", "status", "level", "n_results", F.length("json").alias("n")).collect()
    assert sorted(r["position"] for r in got) == list(range(3000))
    for r in got:
        kind = r["position"] % 3
        assert r["status"] == ("linked" if kind == 0 or r["call_id"] == "c2" else "pending")
        assert (r["level"], r["n_results"]) == ((0, 2) if kind == 0 else (0, 0) if kind == 1 else (1, int(r["call_id"] == "c2")))
        assert (r["n"] > len(long)) == (kind == 0)


@pytest.mark.parametrize("seed", range(2))
def test_order_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(60)]
    edges = list({(rng.choice(nodes[1:]), rng.choice(nodes)) for _ in range(70)})
    calls = [(n, i, "ping", "{}", [p for c, p in edges if c == n]) for i, n in enumerate(nodes)]
    found = {r["id"]: r["level"] for r in chat.levels(spark.createDataFrame(calls, CALLS)).collect()}
    assert found == plain_levels(edges, nodes)


@pytest.mark.parametrize("several", [False, True])
def test_order(spark, several):
    """A long chain, a star, a diamond, circles and what hangs behind one, and a call that is nowhere."""
    edges = [(f"c{i}", f"c{i - 1}") for i in range(1, 40)] + [(f"s{i}", "c0") for i in range(30)] + [("x", "y"), ("y", "x"), ("z", "x"), ("me", "me"), ("q", "nowhere")]
    edges += [("d1", "c3"), ("d2", "c5"), ("d", "d1"), ("d", "d2")] if several else []
    nodes = sorted({c for c, _ in edges} | {"c0"})
    calls = [(n, i, "ping", "{}", [p for c, p in edges if c == n]) for i, n in enumerate(nodes)]
    found = {r["id"]: r["level"] for r in chat.levels(spark.createDataFrame(calls, CALLS)).collect()}
    assert found == plain_levels(edges, nodes)
    assert link(spark, calls)["z", nodes.index("z")]["problems"] == ["circular"]


def test_no_calls(spark):
    assert link(spark, []) == {}
    assert list(link(spark, [], [("r", 1, "x")])) == [("r", None)]
