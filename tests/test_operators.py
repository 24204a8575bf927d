import pytest
from pyspark.sql import functions as F

from tensorloom.errors import InvalidArtifact, InvalidPlan
from tensorloom.operators import checks, inference, layout, permutation, tensors

ROWS = "row_id bigint, v array<float>"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_permuted_rows(spark):
    matrix = spark.createDataFrame([(0, [10.0, 11.0]), (1, [20.0, 21.0]), (2, [30.0, 31.0])], ROWS)
    perm = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "orig bigint, obf bigint")  # the inverse is [2, 0, 1]
    moved = permutation.permute_rows(matrix, perm, "row_id")
    assert rows(moved) == [(0, [30.0, 31.0]), (1, [10.0, 11.0]), (2, [20.0, 21.0])]
    assert rows(permutation.decode(moved, perm, "row_id")) == rows(matrix)
    assert permutation.relationship_mismatch(matrix, moved, perm, "row_id", "v").isEmpty()


def test_secret_permutation_moves_something(spark):
    perm, nonce = permutation.secret_permutation(spark, 2)
    assert rows(perm) == [(0, 1), (1, 0)]
    assert len(nonce) == 64
    with pytest.raises(InvalidPlan):
        permutation.secret_permutation(spark, 1)


def test_identity_is_no_secret(spark):
    same = spark.createDataFrame([(0, 0), (1, 1)], "orig bigint, obf bigint")
    assert [r["reason"] for r in permutation.secret_violations(same, same).collect()] == ["it moves nothing"]


def test_padding_and_renaming(spark):
    matrix = spark.createDataFrame([(0, [1.0, 2.0])], ROWS)
    assert rows(tensors.pad_columns(matrix, "v", 1)) == [(0, [1.0, 2.0, 0.0, 0.0])]
    names = spark.createDataFrame([("a.source.weight",), ("source.weight",), ("a.source.weight.x",)], "name string")
    assert sorted(r["name"] for r in tensors.rename_outputs(names).collect()) == ["a.source.weight.x", "a.target.weight", "source.weight"]


def test_alias_only_where_the_head_is_absent(spark):
    names = spark.createDataFrame([("embed",), ("x",)], "name string")
    assert rows(tensors.with_alias(names, "embed", "head").select("name", F.coalesce("alias_of", F.lit("")))) == [("embed", ""), ("head", "embed"), ("x", "")]
    both = names.unionByName(spark.createDataFrame([("head",)], "name string"))
    assert tensors.with_alias(both, "embed", "head").where("alias_of IS NOT NULL").isEmpty()


def pack(spark, sizes, limit):
    inventory = spark.createDataFrame([(f"t{i}", "U8", n) for i, n in enumerate(sizes)], "name string, dtype string, byte_length bigint")
    return [(r["shard"], r["offset"]) for r in layout.next_fit(inventory, limit).orderBy("name").collect()]


def test_packing(spark):
    assert pack(spark, [9, 1], 4) == [(0, 0), (1, 0)]  # too large alone, then afresh
    assert pack(spark, [6, 6], 6) == [(0, 0), (1, 0)]  # equality fits
    assert pack(spark, [2, 0, 2, 1], 4) == [(0, 0), (0, 2), (0, 2), (1, 0)]
    assert pack(spark, [1, 9, 0], 4) == [(0, 0), (1, 0), (2, 0)]
    with pytest.raises(InvalidPlan):
        pack(spark, [1], 0)


def test_empty_layout(spark):
    inventory = spark.createDataFrame([], "name string, dtype string, byte_length bigint")
    assert layout.next_fit(inventory, 4).isEmpty()


def test_tiling(spark):
    schema = "shard string, name string, begin bigint, end bigint, data_bytes bigint"
    good = [("s", "a", 0, 4, 8), ("s", "b", 4, 8, 8), ("s", "z", 8, 8, 8), ("e", "n", 0, 0, 0)]
    assert checks.tiling_violations(spark.createDataFrame(good, schema)).isEmpty()
    bad = [("h", "a", 0, 2, 8), ("h", "b", 4, 8, 8), ("o", "a", 0, 6, 8), ("o", "b", 4, 8, 8), ("l", "a", 0, 4, 8)]
    assert rows(checks.tiling_violations(spark.createDataFrame(bad, schema))) == [("h", "b", "hole"), ("l", "a", "payload goes on"), ("o", "b", "overlap")]


def test_resume_needs_a_first_part_without_gaps(spark):
    state = lambda *done: checks.resume_state(spark.createDataFrame([(i, d) for i, d in enumerate(done)], "position bigint, done boolean")).first()["contiguous"]
    assert state(True, True, False) and state(False, False) and state(True, True)
    assert not state(True, False, True)
    assert not state(False, True)


def test_require_none(spark):
    checks.require_none(spark.range(0))
    with pytest.raises(InvalidArtifact, match="0"):
        checks.require_none(spark.range(1))


def test_top_token_takes_the_lowest_of_equal_ones(spark):
    logits = spark.createDataFrame([(0, t, x) for t, x in enumerate([2.0, 2.0, 1.0, 0.0])], "position int, token bigint, logit double")
    assert rows(inference.top_token(logits, ["position"])) == [(0, 0, 2.0)]


def test_greedy_stops_after_eos_of_the_first_row(spark):
    perm = spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "orig bigint, obf bigint")
    matrix = spark.createDataFrame([(0, [1, 0]), (1, [0, 1]), (2, [3, 1])], "token bigint, w array<bigint>")
    prompts = spark.createDataFrame([(7, 0, 0), (7, 1, 1), (8, 0, 1), (8, 1, 0)], "batch bigint, row bigint, last bigint")
    found = {(b, r): t for b, r, t in rows(inference.greedy(prompts, permutation.encode(matrix, perm), perm, [2], 4))}
    assert found == {(7, 0): [2], (7, 1): [1], (8, 0): [1, 1, 1, 1], (8, 1): [2, 2, 2, 2]}
    assert rows(inference.greedy(prompts, matrix, perm, [2], 0))[0] == (7, 0, [])


def test_equivalence(spark):
    tokens = spark.createDataFrame([(0, 0, [1, 2])], "batch int, row int, tokens array<int>")
    other = spark.createDataFrame([(0, 0, [1, 3])], "batch int, row int, tokens array<int>")
    logits = spark.createDataFrame([(0, 1.0)], "k int, x double")
    far = spark.createDataFrame([(0, 2.0)], "k int, x double")
    near, off = inference.closeness(logits, logits, ["k"], "x"), inference.closeness(logits, far, ["k"], "x")
    found = [inference.equivalence(c, tokens, t).first()["equivalent"] for c, t in ((near, tokens), (near, other), (off, tokens), (near, tokens.where("false")))]
    assert found == [True, False, False, False]


def test_closeness(spark):
    a = spark.createDataFrame([(0, 1.0), (1, 2.0)], "k int, x double")
    b = spark.createDataFrame([(0, 1.00001), (1, float("nan"))], "k int, x double")
    assert inference.closeness(a, a, ["k"], "x").first()["all_close"]
    found = inference.closeness(a, b, ["k"], "x").first()
    assert not found["all_close"] and not found["all_finite"]


def test_whole_inference_takes_every_row_and_position(spark):
    import numpy as np
    from oracle import DATA

    from tensorloom import catalog
    from tensorloom.queries.inference import BATCH, EOS, STEPS

    found = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect())
    tokens, weights = np.array([r[0] for r in found]), np.array([r[1] for r in found])
    scaled = weights * 1000
    whole = (np.sign(scaled) * np.floor(np.abs(scaled) + 0.5)).astype(np.int64)
    after = dict(zip(tokens.tolist(), tokens[(whole @ whole.T).argmax(axis=1)].tolist(), strict=True))
    expected = {}
    for batch in range(-(-len(tokens) // BATCH)):
        lasts = [t for t in range(BATCH * batch, BATCH * batch + BATCH) if t in after]
        out = [[] for _ in lasts]
        for _ in range(STEPS):
            lasts = [after[t] for t in lasts]
            for some, t in zip(out, lasts, strict=True):
                some.append(t)
            if lasts[0] in EOS:
                break
        expected |= {(batch, k): some for k, some in enumerate(out)}
    queries = catalog.queries()
    assert {(r["batch"], r["row"]): r["tokens"] for r in queries["greedy_decode"](spark, DATA).collect()} == expected
    assert queries["logits_align"](spark, DATA).count() == weights.size
    assert queries["allclose"](spark, DATA).first()["n"] == weights.size
