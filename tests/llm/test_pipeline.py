import brute
from pyspark.sql import functions as F

import corpus_pipeline
from tensorloom.llm import decontaminate, mixing, near_dedup, quality, sharding

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    """Each stage gives what its operator, applied alone to its input, decides on every row."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, n = docs.columns, {}
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], SF).cache())
        n[name] = frames[-1].count()
    assert all(f.columns == names for f in frames[:-1])
    raw, good, single, clean, mixed, placed = ([r.asDict() for r in f.collect()] for f in frames)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = {r["doc_id"]: r["predicted"] for r in quality.classify(docs, labels).collect()}
    assert sorted(r["doc_id"] for r in good) == sorted(i for i, p in scored.items() if p)
    plain = brute.near_groups({r["doc_id"]: r["text"] for r in good}, 5, 80)
    assert sorted(r["doc_id"] for r in single) == sorted(i for i, x in plain.items() if x[2])
    leaked = {r["doc_id"] for r in decontaminate.find_leaks(frames[2], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert sorted(r["doc_id"] for r in clean) == sorted(r["doc_id"] for r in single if r["doc_id"] not in leaked)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(frames[3]).collect()}
    assert sorted(r["doc_id"] for r in mixed) == sorted(i for i, k in copies.items() for _ in range(k))
    assert sorted(r["doc_id"] for r in placed) == sorted(r["doc_id"] for r in mixed)
    assert {r["shard"] for r in placed} <= set(range(16)) and len(placed) == sharding.shard_by_bytes(frames[4]).count()
    assert near_dedup.near_dedup(frames[1]).count() == len(single)
    assert len(raw) >= len(good) >= len(single) >= len(clean)


def test_run_is_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    key = lambda r: (r["doc_id"], r["shard"], r["slot"])
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, docs.collect()))


def test_stages_bear_odd_rows_and_clashing_names(spark, docs, documents):
    """Null, empty, very long and repeated texts, in rows with columns that are named like the operators' own."""
    clash = {c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in ("score", "predicted", "held_out", "size", "target", "taken", "copies", "source_size", "n_shingles", "component_id", "kept", "id")}
    frame = docs.unionByName(docs.where("doc_id > 9000")).withColumns(clash).cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, SF).cache()
        assert out.columns == frame.columns, name
        wrong = out.where(" OR ".join(f"{c} <> concat('{c} of ', doc_id)" for c in clash))
        assert wrong.isEmpty() and not out.isEmpty(), name
        frame = out
    out = corpus_pipeline.STAGES[-1][1](spark, frame, SF)
    assert out.count() == frame.count() and out.columns.count("size") == 1
    assert out.where("score <> concat('score of ', doc_id)").isEmpty()


def test_stages_on_an_empty_table(spark, empty):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, SF)
        assert out.count() == 0 and set(empty.columns) <= set(out.columns), name
