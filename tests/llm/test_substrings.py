import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from tensorloom.llm import substrings
from tensorloom.llm.substrings import kept_text, remove_repeats


def found(df, key="doc_id"):
    return {r[key]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(df).collect()}


def test_equals_plain(docs, documents):
    assert found(docs) == brute.without_repeats({d[0]: d[1] for d in documents})


def test_passages_at_every_place(spark, monkeypatch):
    """Shared passages at the begin and end, over each other, of just 50 and just 49 bytes, in few letters, with zero bytes."""
    rng = random.Random(1)
    noise = lambda n, letters="abcdefgh ": "".join(rng.choice(letters) for _ in range(n))
    p, q = noise(80), noise(50)
    texts = [p + noise(40) + q, noise(30) + p, q + noise(10), noise(20) + q[:49], p + p, p[:60] + q, q, q + q, noise(300, "ab"), noise(300, "ab"), "ab" * 100, "ab" * 90 + "c", "x" * 200, "y" + "x" * 120, noise(30) + "\0" * 60, "\0" * 55, "é" * 40, "z" + "é" * 30, q[:49], "", None]
    docs = dict(enumerate(texts))
    frame = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(3)
    assert found(frame) == brute.without_repeats(docs)


def test_long_rows_in_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    row = rng.integers(0, 4, 5000).astype(np.uint8)
    at = np.array([0, 5000])
    begin, end, _ = substrings.segments(row, at)
    assert begin[0] == 0 and end[-1] == 5000 - 49 and (begin[1:] == end[:-1]).all()
    monkeypatch.setattr(substrings, "PIECE", 700)
    windows = []
    for pieces in substrings._pieces(at):
        for _, a, b in pieces:
            windows += range(a, b - 49)
    assert sorted(windows) == list(range(5000 - 49))


def runs(rng, n, letters=3):
    """A text of runs, each followed by a place for its end, and these places."""
    rows = [rng.integers(0, letters, rng.integers(1, 200)).astype(np.uint8) for _ in range(n)]
    return np.concatenate([np.append(r, 0).astype(np.uint8) for r in rows]), np.cumsum([len(r) + 1 for r in rows]) - 1


@pytest.mark.parametrize("letters", [1, 2, 5])
def test_suffix_order(letters):
    rng = np.random.default_rng(letters)
    text, ends = runs(rng, 12, letters)
    end_of = np.repeat(ends, np.diff(np.append(-1, ends)))
    plain = sorted(range(len(text)), key=lambda p: [(1, int(c)) for c in text[p : end_of[p]]] + [(0, int(end_of[p]))])
    assert substrings.suffix_order(text, ends).tolist() == plain


def shard(rng, n):
    """Segments of random runs, and their transform: what a task sends."""
    text, ends = runs(rng, n, 2)
    spans = [(a, min(a + int(rng.integers(50, 77)), e)) for e, lo in zip(ends, np.append(0, ends[:-1] + 1), strict=True) for a in range(lo, e - 50, 13)]
    begin, stop = (np.array(x, np.int64) for x in zip(*spans, strict=True))
    stop = np.maximum.accumulate(stop)
    keep = np.append(True, stop[1:] > stop[:-1])
    begin, stop = begin[keep], stop[keep]
    segment, place, symbol = substrings.transform(text, ends, begin, stop)
    opens, closes = np.empty(len(begin), np.int64), np.empty(len(begin), np.int64)
    for where, out in ((begin, opens), (stop, closes)):
        here = np.flatnonzero(place == where[segment])
        out[segment[here]] = here
    return [text[a:b].tobytes() for a, b in zip(begin, stop, strict=True)], symbol, opens, closes


def test_transforms_hold_the_segments_and_merge():
    """The last-to-first mapping reads every segment backwards, and the interleave of three shards finds all equal windows."""
    rng = np.random.default_rng(4)
    shards = [shard(rng, n) for n in (5, 1, 9)]
    sizes = [len(s[1]) for s in shards]
    base = np.cumsum(sizes) - sizes
    symbol = np.concatenate([s[1] for s in shards])
    opens, closes = (np.concatenate([s[k] + b for s, b in zip(shards, base, strict=True)]) for k in (2, 3))
    before = substrings.last_to_first(symbol, np.repeat(np.arange(3), sizes), opens, closes)
    texts = [t for s in shards for t in s[0]]
    spots, keys = [], []
    for text, first, at in zip(texts, opens, closes, strict=True):
        for k in range(len(text) - 1, -1, -1):
            if k >= 49:
                spots.append(at)  # what follows the window that ends here
                keys.append(text[k - 49 : k + 1])
            assert symbol[at] == text[k]
            at = before[at]
        assert at == first
    spots, owner = np.array(spots), rng.integers(0, 99, len(spots))
    best = {}
    for k, o in zip(keys, owner, strict=True):
        best[k] = min(best.get(k, 99), o)
    assert len(best) < len(keys)
    assert substrings.interleave(symbol, before, np.argsort(spots, kind="stable"), spots, owner).tolist() == [best[k] for k in keys]


def test_places_of_a_hot_string_are_settled_in_their_shard(spark):
    """Of a passage that a third of the documents has, only the earliest documents' places go to where shards meet."""
    passage = "this passage is said by very many of the documents, word for word, without any change at all"
    docs = {i: (f"document {i} begins. " * 3) + (passage if i % 3 == 0 else f"nothing of it {i}") for i in range(300)}
    frame = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(3)
    assert found(frame) == brute.without_repeats(docs)


def test_odd_tables(spark, empty):
    assert remove_repeats(empty).count() == 0
    text = "a passage that is longer than fifty bytes, and that is all of it"
    rows = spark.createDataFrame([(5, text, 1), (5, text, 2), (6, "x" + text, 3), (None, text, 4), (5, "another", 5)], "doc_id bigint, text string, n_spans int")
    got = remove_repeats(rows)
    assert got.columns.count("n_spans") == 1
    n = len(text)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got.collect()) == [("5", 7, 0, 0), ("5", n, 0, 0), ("5", n, 0, 0), ("6", n + 1, n, 1), ("None", n, n, 1)]


def test_kept_text():
    spans = np.array([[2, 4]], np.int64).tobytes()
    assert kept_text(pa.array(["abcdef", None]), pa.array([spans, b""])).to_pylist() == ["abef", ""]
    assert kept_text(pa.array(["aéb"]), pa.array([np.array([[0, 2]], np.int64).tobytes()])).to_pylist() == ["�b"]


@pytest.mark.parametrize("seed", range(3))
def test_random_copies(spark, seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcd") for _ in range(rng.randint(45, 140))) for _ in range(12)]
    docs = {i: "".join(rng.choice(pool)[rng.randint(0, 20) :] + rng.choice(["", "-", "+"]) for _ in range(rng.randint(0, 5))) for i in range(80)}
    frame = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(4)
    assert found(frame) == brute.without_repeats(docs)
