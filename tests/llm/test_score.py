import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tensorloom.llm import decontaminate as dc
from tensorloom.llm import quality
from tensorloom.llm.common import byte_view
from tensorloom.llm.queries import op8_quality

SF = "/root/testdata/sf0.01"


def pack(rows):
    return np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


@pytest.mark.parametrize("held", [1 << 18, 20])
def test_gradients(held, monkeypatch):
    monkeypatch.setattr(quality, "STEP_BLOCKS", held)
    rng = np.random.default_rng(0)
    raw, at = pack([rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (5, 300, 0, 130, 64, 200)])
    labels = np.array([0, 1, 1, 0, 1, 0], np.float32)
    net = quality.Network(*[p.astype(np.float64) for p in quality.fresh(1).parameters()])
    net.bias += 0.1 * rng.normal(size=net.bias.shape)
    net.inner += 0.1

    blocks, begin = quality.blocks_of(raw, at)

    def loss():
        logit = quality._gradients(net, blocks, begin, labels)[1]
        return np.mean(np.logaddexp(0, logit) - labels * logit)

    for p, g in zip(net.parameters(), quality._gradients(net, blocks, begin, labels)[0], strict=True):
        for _ in range(4):
            i = tuple(rng.integers(0, n) for n in p.shape)
            old, step = p[i], 1e-5
            p[i] = old + step
            up = loss()
            p[i] = old - step
            down = loss()
            p[i] = old
            assert abs((up - down) / (2 * step) - g[i]) < 1e-4


def plain_score(net, text):
    """The score of one text, chunk by chunk, as the network is described."""
    n = max(1, -(-len(text) // 4))
    data = list(text) + [256] * (4 * n - len(text))
    y = []
    for i in range(n):
        x = np.concatenate([net.vectors[b] for b in data[4 * i : 4 * i + 4]]).astype(float) @ net.left
        if i + 1 < n:
            x = x + np.concatenate([net.vectors[b] for b in data[4 * i + 4 : 4 * i + 8]]).astype(float) @ net.right
        y.append(x)
    halves = [np.max(y[k : k + 16], axis=0) for k in range(0, n, 16)]
    chunks = [np.maximum(a, b) for a, b in zip(halves, halves[1:], strict=False)] or halves
    unit = np.mean([np.maximum(np.maximum(c + net.bias, 0) @ net.hidden + net.inner, 0) for c in chunks], axis=0)
    return 1 / (1 + np.exp(-(unit @ net.out + net.base[0])))


def test_scores_equal_a_plain_forward_pass():
    rng = np.random.default_rng(5)
    rows = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (0, 1, 4, 5, 63, 64, 65, 128, 129, 1000)]
    net = quality.fresh(3)
    found = quality.scores(quality.scorer(net), *pack(rows))
    assert np.allclose(found, [plain_score(net, r) for r in rows], atol=2e-6)


@pytest.mark.parametrize("step", [1 << 18, 64])
def test_scores_do_not_depend_on_batches(step, monkeypatch):
    """One by one, in sevens and all at once, whole or in pieces: the same to the last digit."""
    rng = np.random.default_rng(1)
    rows = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (4000, 3, 1024, 0, *rng.integers(0, 3000, 200))]
    net = quality.scorer(quality.fresh(2))
    whole = quality.scores(net, *pack(rows))
    monkeypatch.setattr(quality, "STEP_BLOCKS", step)
    monkeypatch.setattr(quality, "CACHED", 96)
    for size in (1, 7, len(rows)):
        assert np.array_equal(np.concatenate([quality.scores(net, *pack(rows[i : i + size])) for i in range(0, len(rows), size)]), whole)


def test_sample_takes_whole_texts_within_its_bounds(spark):
    texts = [(i, "x" * (10 * i)) for i in range(1, 21)] + [(5, "again"), (None, "no id")]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 21)], "doc_id bigint, quality int")
    everything = quality.labelled_sample(frame, labels, 100, 1 << 20).collect()
    assert sorted((r["__id"], bytes(r["__bytes"]).decode()) for r in everything) == sorted(t for t in texts if t[0])
    some = quality.labelled_sample(frame, labels, 8, 500).collect()
    assert len(some) <= 8 and sum(len(r["__bytes"]) for r in some) <= 500
    assert {(r["__id"], bytes(r["__bytes"]).decode()) for r in some} <= set(texts)


def test_held_out_accuracy(spark):
    rows = op8_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    out = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == brute.held_out(r["doc_id"]) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in out]) > 0.9
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_scores_on_odd_tables(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 1), (None, 1, 1), (3, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.classify(empty, labels).count() == 0
    plain = quality.classify(docs.withColumn("score", F.lit("x")), labels.where("false"))
    assert plain.columns.count("score") == 1
    found = plain.collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    again = {r["doc_id"]: r["score"] for r in quality.classify(docs.repartition(2), labels).collect()}
    assert again == {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}


ITEM = "The quick brown fox jumps over the lazy dog while seven wizards, quietly, count their golden rings by moonlight."
OTHER = "An entirely different question about rivers and bridges which nobody would confuse with the first of these items."


def edited(text, n):
    out = list(text)
    for k in range(n):
        out[3 + 11 * k] = "q"
    return "".join(out)


def test_leaks_are_found_and_clean_texts_left(spark):
    noise = " ".join(f"plain{i} words{i * 7 % 31}" for i in range(400))
    docs = {1: noise, 2: noise + ITEM + noise, 3: ITEM.upper().replace(",", ";"), 4: noise + edited(ITEM, 4), 5: ITEM[:60] + noise + ITEM[60:], 6: ITEM + OTHER, 7: None, 8: "", 9: noise * 200 + ITEM, 10: ITEM[5:], 11: edited(ITEM, 10) + noise}
    frame = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    items = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, None), (4, "short one"), (1, ITEM)], "item_id bigint, text string")
    found = sorted({(r["doc_id"], r["item_id"]) for r in dc.find_leaks(frame, items).collect()})
    assert found == [(2, 1), (3, 1), (4, 1), (6, 1), (6, 2), (9, 1), (10, 1)]
    assert dc.find_leaks(frame, items).where("doc_id = 2").count() == 2  # an item that is there twice counts twice
    extra = frame.withColumn("item_id", F.lit(0))
    assert sorted(r["doc_id"] for r in dc.decontaminate(extra, items).collect()) == [1, 5, 7, 8, 11]
    assert dc.decontaminate(frame, items.where("false")).count() == len(docs)
    assert dc.find_leaks(frame.where("false"), items).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_windows_match_plain_edit_distance(seed):
    """Whatever has a place within the edit budget is found, and nothing else is."""
    rng = np.random.default_rng(seed)
    letters = "abcdefghijklmnop "
    say = lambda n: "".join(rng.choice(list(letters), n))
    items = [say(n) for n in (40, 96, 97, 150)]
    texts = []
    for _ in range(60):
        item = items[rng.integers(len(items))]
        a = int(rng.integers(0, max(1, len(item) - 40)))
        part = list(item[a : a + int(rng.integers(30, 120))])
        for _ in range(int(rng.integers(0, 9))):
            k = int(rng.integers(len(part)))
            part[k : k + 1] = [["", rng.choice(list(letters)), part[k] + rng.choice(list(letters))][rng.integers(3)]]
        texts.append(say(int(rng.integers(0, 60))) + "".join(part) + say(int(rng.integers(0, 60))))
    w = dc.windows_of(pa.array(items))
    raw, at = dc.normalised(pa.array(texts))
    expected = set()
    for row in range(len(texts)):
        text = raw[at[row] : at[row + 1]].tobytes()
        for v in range(len(w.item)):
            if brute.edit_distance_within(w.data[v, : w.length[v]].tobytes(), text) <= w.edits[v]:
                expected.add((row, int(w.item[v])))
    assert {(h[0], h[1]) for _, hits in dc.leaks([w], pa.array(texts)) for h in hits} == expected


@pytest.mark.parametrize("held", [16, 1])
def test_blocks_of_items(spark, monkeypatch, held):
    """Two blocks, one of which is a single longer item, in one pass and in two."""
    monkeypatch.setattr(dc, "BLOCK_BYTES", 100)
    monkeypatch.setattr(dc, "HELD", held)
    items = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, None)], "item_id bigint, text string")
    assert len(list(dc.blocks_of_items(items, "item_id", "text"))) == 2
    frame = spark.createDataFrame([(1, ITEM + OTHER), (2, "nothing"), (3, OTHER)], "doc_id bigint, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in dc.find_leaks(frame, items).collect()) == [(1, 1), (1, 2), (3, 2)]
    assert [r["doc_id"] for r in dc.decontaminate(frame, items).collect()] == [2]


def test_short_items_match_whole(spark):
    """Between borders of words and without a change; items of under eight bytes match nothing."""
    items = spark.createDataFrame([(1, "Golden rings."), (2, "seven wizards count"), (3, "lazy"), (4, "  ")], "item_id bigint, text string")
    docs = {1: "golden rings", 2: "a marigolden rings", 3: "golden ringside", 4: "SEVEN wizards, count!", 5: "seven wizard count", 6: "lazy", 7: "x " * 4000 + "(golden rings)"}
    frame = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    assert sorted((r["doc_id"], r["item_id"], r["edits"]) for r in dc.find_leaks(frame, items).collect()) == [(1, 1, 0), (4, 2, 0), (7, 1, 0)]


def test_leaks_of_tables_with_clashing_columns(spark):
    frame = spark.createDataFrame([(1, ITEM, 5, "x")], "doc_id bigint, text string, n_found int, item_id string")
    items = spark.createDataFrame([(7, ITEM, 9)], "item_id bigint, text string, doc_id int")
    found = dc.find_leaks(frame, items)
    assert found.columns == ["doc_id", "item_id", "n_windows", "n_found", "edits", "begin", "end"]
    assert [(r["doc_id"], r["item_id"]) for r in found.collect()] == [(1, 7)]


def test_normalised():
    raw, at = byte_view(pa.array(["x"]))
    assert len(raw) == 1 and at.tolist() == [0, 1]
    raw, at = dc.normalised(pa.array(["A,  b\n", None, "", "--", "É9"]))
    assert [raw[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:], strict=True)] == ["a b ", "", "", "", "é9"]
