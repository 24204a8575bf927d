import math
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.llm import mixing
from tensorloom.llm.mixing import expand, mix, round_off, tilts, water_fill
from tensorloom.llm.sharding import _spread_ids, shard_by_bytes


def plain_targets(sizes, weights, most=3):
    """{source: target}: shares by weight, what is over most * size being shared again until none is above."""
    total, free, out = sum(sizes.values()), set(sizes), {}
    while free:
        left = total - sum(out.values())
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return out | share
        out |= {s: most * sizes[s] for s in over}
        free -= over
    return out


@pytest.mark.parametrize("sizes", [[5, 100, 7, 1000, 0, 3], [10, 10, 10], [0, 0], [1], [1, 1, 1, 1, 1, 1, 10**9], [9, 2, 2, 2]])
def test_targets(spark, sizes):
    names = [f"s{i}" for i in range(len(sizes))]
    weights = {n: (1, 2, 3)[i % 3] for i, n in enumerate(names)}
    frame = spark.createDataFrame([(n, s, weights[n]) for n, s in zip(names, sizes, strict=True)], "source string, source_size long, weight long")
    found = {r["source"]: r["target"] for r in water_fill(frame).collect()}
    expected = plain_targets(dict(zip(names, sizes, strict=True)), weights)
    assert all(math.isclose(found[n], expected[n], rel_tol=1e-9, abs_tol=1e-9) for n in names)


def plain_tilt(sizes, target):
    """The tilt of a source's documents, by halving."""
    mean = sum(sizes) / len(sizes)
    got = lambda t: sum(s * min(3.0, math.exp(min(50.0, t * s / mean))) for s in sizes)
    low, high = -1e9, 1e9
    for _ in range(200):
        tilt = (low + high) / 2
        low, high = (tilt, high) if got(tilt) < target else (low, tilt)
    return (low + high) / 2


def plain_copies(docs, weights=(1, 2, 3)):
    """{id: copies} of (id, text, source) rows with different ids."""
    size = {d[0]: len(brute.words(d[1])) for d in docs}
    tie = {d[0]: zlib.crc32(brute.raw(d[1])) for d in docs}
    sources = sorted({d[2] for d in docs if d[2] is not None}, key=str.encode) + [None] * any(d[2] is None for d in docs)
    members = {s: [d[0] for d in docs if d[2] == s] for s in sources}
    total = {s: sum(size[i] for i in members[s]) for s in sources}
    targets = plain_targets(total, {s: weights[k % 3] for k, s in enumerate(sources)})
    out = {}
    for s in sources:
        ids = [i for i in members[s] if size[i]]
        out |= {i: 1 for i in members[s] if not size[i]}
        if not ids:
            continue
        mean = total[s] / len(members[s])
        full = targets[s] >= 3 * total[s] * (1 - 1e-7)
        tilt = None if full else plain_tilt([size[i] for i in ids], targets[s]) * mean / (total[s] / len(ids))
        owed = 0.0
        for z in sorted({size[i] for i in ids}, reverse=True):
            same = sorted((i for i in ids if size[i] == z), key=lambda i: (i, tie[i]))
            owed += (3 if full else min(3.0, math.exp(tilt * z / mean))) * z * len(same)
            copies = min(3 * len(same), max(0, int(np.rint(owed / z))))
            owed -= copies * z
            n, whole, more = len(same), copies // len(same), copies % len(same)
            out |= {i: whole + (k * more + n // 2) // n - ((k - 1) * more + n // 2) // n for k, i in enumerate(same, 1)}
    return out


@pytest.mark.parametrize("shares", [(0.01, 0.5), (1.0, 1.7), (2.9, 2.999), (3.0, 0.9)])
@pytest.mark.parametrize("few", [10, 0])
def test_newton_meets_the_targets(spark, monkeypatch, shares, few):
    monkeypatch.setattr(mixing, "FEW", few)
    rng = np.random.default_rng(1)
    sizes = {s: [int(x) for x in np.unique(rng.lognormal(5, 1.5, 150).astype(int) + 1)] for s in ("a", "b")}
    classes = spark.createDataFrame([(s, z, 1) for s, zs in sizes.items() for z in zs], "source string, size long, n long")
    rows = [(s, sum(zs), share * sum(zs), sum(zs) / len(zs)) for (s, zs), share in zip(sizes.items(), shares, strict=True)]
    sources = spark.createDataFrame(rows, "source string, source_size long, target double, mean double")
    found = {r["source"]: r for r in tilts(classes, sources, 2).collect()}
    for s, zs in sizes.items():
        r = found[s]
        got = sum(3 * z if r["tilt"] is None else z * min(3.0, math.exp(min(50.0, r["tilt"] * z / r["mean"]))) for z in zs)
        assert abs(got - r["target"]) <= 2e-7 * max(1, r["target"])


def test_rounding_stays_within_the_smallest_size():
    rng = np.random.default_rng(2)
    rows = rng.integers(1, 9, 40).astype(float)
    size = np.sort(rng.integers(1, 5000, 40)).astype(float)
    rate = rng.uniform(0.1, 2.9, 40)
    copies = round_off(rate, size, rows)
    assert abs(copies @ size - (rate * rows) @ size) <= size[0] + size[1]
    assert (copies <= 3 * rows).all()


def test_copies_equal_a_plain_solver(docs, documents):
    found = {r["doc_id"]: r["copies"] for r in mix(docs).select("doc_id", "copies").collect()}
    assert found == plain_copies([(d[0], d[1], d[3]) for d in documents])


def test_mix_of_one_size(spark, monkeypatch):
    """All documents of one length, most in one source: they are numbered in parts, and the targets are met all the same."""
    monkeypatch.setattr(mixing, "PART_ROWS", 100)
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("source"))
    found = mix(rows).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count("*").alias("n"), F.max("copies").alias("most")).collect()
    for r in found:
        assert r["most"] <= 3 and abs(r["taken"] - r["target"]) <= 0.01 * r["target"]
    assert {r["source"]: r["n"] for r in found} == {"a": 2700, "b": 300}


def test_mix(docs, documents, spark):
    rows = mix(docs).collect()
    assert len(rows) == len(documents)
    sizes = {d[0]: len(brute.words(d[1])) for d in documents}
    assert {r["doc_id"]: r["size"] for r in rows} == sizes
    sources = sorted({d[3] for d in documents if d[3] is not None}, key=str.encode) + [None]
    total = {s: sum(sizes[d[0]] for d in documents if d[3] == s) for s in sources}
    expected = plain_targets(total, {s: (1, 2, 3)[i % 3] for i, s in enumerate(sources)})
    source = {d[0]: d[3] for d in documents}
    taken = dict.fromkeys(sources, 0)
    for r in rows:
        assert r["source_size"] == total[source[r["doc_id"]]]
        assert math.isclose(r["target"], expected[source[r["doc_id"]]], rel_tol=1e-9)
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    largest = {s: max(sizes[d[0]] for d in documents if d[3] == s) for s in sources}
    assert all(abs(taken[s] - expected[s]) <= 0.05 * expected[s] + 0.2 * largest[s] for s in sources)
    again = {r["doc_id"]: r["copies"] for r in mix(docs.repartition(3)).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in rows}
    whole = expand(mix(docs), docs.columns)
    assert whole.columns == docs.columns and whole.count() == sum(r["copies"] for r in rows)


def test_mix_on_odd_tables(spark, empty):
    assert mix(empty).count() == 0
    rows = spark.createDataFrame([(1, None, None, 1), (1, None, None, 2), (2, "a b", "s", 3), (2, "a b", "s", 4), (None, "c", "s", 5)], "doc_id bigint, text string, source string, TAKEN int")
    found = mix(rows)
    assert [c.lower() for c in found.columns].count("taken") == 1
    got = found.collect()
    assert sorted(r["size"] for r in got) == [0, 0, 1, 2, 2]
    assert all(r["copies"] == 1 and r["taken"] == 0 for r in got if r["size"] == 0)
    assert sum(r["taken"] for r in got) == 5


@pytest.mark.parametrize("ranges", [None, 2, 40])
def test_shards(docs, documents, ranges):
    rows = sorted(shard_by_bytes(docs, 16, ranges=ranges).collect(), key=lambda r: r["doc_id"])
    text = {d[0]: brute.raw(d[1]) for d in documents}
    assert len(rows) == len(documents)
    assert all(r["size"] == len(text[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) and r["law"] == "bytes" and r["grown_shard"] is None for r in rows)
    shards = [r["shard"] for r in rows]
    assert shards == sorted(shards)  # contiguous
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    slots, held = {}, {}
    for r in rows:
        assert r["slot"] == slots.get(r["shard"], 0)
        slots[r["shard"]] = r["slot"] + 1
        held[r["shard"]] = held.get(r["shard"], 0) + r["size"]
    assert all(abs(held.get(s, 0) - total / 16) <= largest for s in range(16))


def test_shards_on_odd_tables(spark, empty):
    assert shard_by_bytes(empty).count() == 0
    rows = spark.createDataFrame([(None, "a", 1), (None, None, 2), (5, "b", 3), (5, "b", 4), (-7, "", 5)], "doc_id bigint, text string, slot int")
    found = shard_by_bytes(rows, 3)
    assert found.columns.count("slot") == 1
    got = found.collect()
    assert sorted(r["size"] for r in got) == [1, 1, 2, 2, 2]
    for s in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert shard_by_bytes(rows.withColumn("doc_id", F.lit(1).cast("long")), 2).count() == 5


def plain_shards(rows, n_shards):
    """(size, crc32, shard, slot) of (id, text) rows, in order."""
    rows = sorted(((r[0] is not None, r[0] or 0, zlib.crc32(brute.raw(r[1])), len(brute.raw(r[1])) + 1) for r in rows))
    total, before, slots, out = sum(r[3] for r in rows), 0, {}, []
    for _, _, crc, size in rows:
        shard = min(n_shards - 1, int((before + size / 2) * n_shards // total))
        out.append((size, crc, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        before += size
    return out


def test_shards_equal_plain(docs, documents):
    found = [(r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in shard_by_bytes(docs).orderBy("doc_id").collect()]
    assert found == plain_shards([(d[0], d[1]) for d in documents], 16)


def test_shards_where_ids_are_hot(spark):
    """A third of the rows have one id, a third none: no task has them all, and the order is the same."""
    texts = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, f"text {i} " * (i % 5)) for i in range(3000)]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    out = shard_by_bytes(frame, 8, ranges=32)
    found = sorted((r["shard"], r["slot"], r["size"], r["text_crc32"]) for r in out.collect())
    assert found == sorted((shard, slot, size, crc) for size, crc, shard, slot in plain_shards(texts, 8))
    bounds, parts = _spread_ids([7] * 11 + [20, 30, 40], 1000, 3000, 32)
    assert parts == {7: 12, None: 11} and bounds == [7, 8, 20, 30, 40]
