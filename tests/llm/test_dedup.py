import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tensorloom.llm import components, words
from tensorloom.llm.exact_dedup import exact_dedup
from tensorloom.llm.near_dedup import near_dedup, near_groups


def columns(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_exact_equals_plain(docs, documents):
    found = exact_dedup(docs, bits_per_row=2)
    assert columns(found, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute.exact([(d[0], d[1]) for d in documents])
    assert set(docs.columns) <= set(found.columns)


def test_exact_with_a_filter_that_is_far_too_small(docs, documents):
    found = exact_dedup(docs, bits_per_row=1, most_bits=1 << 20)
    assert columns(found, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute.exact([(d[0], d[1]) for d in documents])


def test_exact_on_odd_tables(spark, empty):
    assert exact_dedup(empty).count() == 0
    rows = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, "A", "y"), (None, "a", "z"), (None, "b", "z"), (None, "b", "z")], "doc_id bigint, text string, KEEP_ID string")
    found = exact_dedup(rows)
    assert [c.lower() for c in found.columns].count("keep_id") == 1
    got = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in found.collect())
    assert got == [("1", "2", 4, False), ("1", "2", 4, False), ("2", "2", 4, True), ("None", "2", 4, False), ("None", "None", 2, True), ("None", "None", 2, True)]


def test_exact_with_one_group_of_a_third(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    found = exact_dedup(rows).groupBy("keep_id", "group_size").count().where("group_size > 1").collect()
    assert [tuple(r) for r in found] == [(5997, 2000, 2000)]


@pytest.mark.parametrize("width", [4, 5])
def test_near_equals_plain(docs, documents, width):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_groups(docs, width, 80).collect()}
    assert found == brute.near_groups({d[0]: d[1] for d in documents}, width, 80)


def variants(n, seed, length=120, edits=3):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**9)}" for _ in range(length)]
    out = []
    for _ in range(n):
        text = list(base)
        for k in rng.sample(range(length), rng.randint(0, edits)):
            text[k] = f"x{rng.randrange(10**9)}"
        out.append(" ".join(text))
    return out


def test_near_in_one_large_group(spark):
    """Copies that differ from each other: regions are split, and what a split leaves alone is found again."""
    texts = dict(enumerate(variants(260, 5) + variants(30, 6, 60, 2) + [f"text number {i} alone" for i in range(60)]))
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_groups(frame, 4, 80).collect()}
    assert found == brute.near_groups(texts, 4, 80)


def star(copies, seed, length=143, edits=3):
    """A text and copies of it that are 0.80 similar to it in five-word shingles, and less to each other."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**9)}"
    base = [word() for _ in range(length)]
    out = []
    for _ in range(copies):
        text = list(base)
        for k in rng.sample(range(4, length - 4, 5), edits):
            text[k] = word()
        out.append(" ".join(text))
    return " ".join(base), out


def test_near_in_stars_of_unsplit_regions(spark):
    """Copies with their only link to one text that isn't the first: no neighbour in order, and no region so large that it is split."""
    texts = {}
    for k in range(8):
        middle, copies = star(60 + 5 * k, 40 + k)
        texts |= {1000 * k + i: t for i, t in enumerate([*copies[:30], middle, *copies[30:]])}
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_groups(frame, 5, 80).collect()}
    assert found == brute.near_groups(texts, 5, 80)


def test_near_with_a_chain_below_a_star(spark):
    """Copies of one text that a chain of versions leads away from, to the smallest id, which is like none of the copies."""
    rng = random.Random(3)
    middle, copies = star(300, 50)
    chain = [middle.split()]
    for step in range(6):
        text = list(chain[-1])
        for k in range(6 + 20 * step, 6 + 20 * step + 15, 5):
            text[k] = f"v{rng.randrange(10**9)}"
        chain.append(text)
    texts = dict(enumerate([" ".join(t) for t in reversed(chain)] + copies))
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_groups(frame, 5, 80).collect()}
    assert found == brute.near_groups(texts, 5, 80)


def templates(n, copies, seed, length=603):
    """Texts from n templates: each has one partner at a similarity of 0.807, all others of its template are under 0.8."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**9)}"
    out = []
    for _ in range(n):
        base = [word() for _ in range(length)]
        for _ in range(copies // 2):
            places = rng.sample(range(4, length - 4, 5), 20)
            pair = list(base)
            for k in places[:4]:
                pair[k] = word()
            for own in (places[4:12], places[12:]):
                text = list(pair)
                for k in own:
                    text[k] = word()
                out.append(" ".join(text))
    return out


def test_near_in_templates(spark):
    """Regions of texts that are nearly similar enough: the only link of each is to its partner, and none is lost."""
    texts = dict(enumerate(templates(6, 90, 11)))
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_groups(frame, 4, 80).collect()}
    expected = brute.near_groups(texts, 4, 80)
    assert sum(not e[2] for e in expected.values()) == 270
    assert found == expected


def test_near_with_few_equal_signature_values(spark):
    """Pairs of similarity 0.8 of whose 60 signature values 36 or 35 are equal, which happens once in thousands."""
    found_in = {3: [2483], 4: [930, 1178]}
    texts = {}
    for seed, places in found_in.items():
        middle, copies = star(4000, seed, 139)
        texts |= {100 * seed + i: t for i, t in enumerate([middle, *[copies[k] for k in places]])}
    assert len(texts) == 5
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_groups(frame, 5, 80).collect()}
    assert found == brute.near_groups(texts, 5, 80)
    assert [r[1] for _, r in sorted(found.items())] == [300, 300, 400, 400, 400]


def test_near_on_odd_tables(spark, empty):
    assert near_groups(empty).count() == 0
    rows = spark.createDataFrame([(1, "a b c d e f", 1), (1, "a b c d e f", 2), (2, "A B c d e f", 3), (None, "a b c d e f", 4), (None, None, 5), (3, None, 6), (4, "", 7)], "doc_id bigint, text string, component_id int")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in near_groups(rows).collect())
    assert got == [("1", 2, "1", True), ("1", 2, "1", True), ("2", 2, "1", False), ("3", 0, "3", True), ("4", 0, "4", True), ("None", 0, "None", True), ("None", 2, "1", False)]
    kept = near_dedup(rows)
    assert kept.columns == rows.columns
    assert sorted(r["component_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 2, 6, 7]


def test_near_keeps_clean_documents(docs, documents):
    plain = brute.near_groups({d[0]: d[1] for d in documents}, 5, 80)
    assert sorted(r["doc_id"] for r in near_dedup(docs).collect()) == sorted(i for i, x in plain.items() if x[2])


@pytest.mark.parametrize("one_task", [0, 1 << 19])
def test_components(spark, one_task):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(7, 7)]
    above = {}

    def top(x):
        above.setdefault(x, x)
        while above[x] != x:
            x = above[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((top(a), top(b)))
            above[b] = a
    found = components.components(spark.createDataFrame(links, "a bigint, b bigint"), one_task)
    assert dict(columns(found, "node", "label")) == {x: top(x) for x in above}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint"), one_task).count() == 0


def test_words_never_go_over_rows():
    texts = ["a b", "c", None, "", " d  e\tf\n", "é x y"]
    assert words.count_words(pa.array(texts)).to_pylist() == [len(brute.words(t)) for t in texts]
    assert words.count_words(pa.array([], pa.string())).to_pylist() == []
    sets = words.shingle_sets(*words.byte_view(pa.array(["a b c d", "a b c d e", "a b c", "d", None, "a b c d"])), 4)
    assert [len(s) for s in sets] == [1, 2, 1, 1, 0, 1]
    assert np.array_equal(sets[0], sets[5]) and sets[0][0] in sets[1]
    assert sets[2][0] != sets[0][0]


def test_long_words_that_are_made_to_collide():
    """The two words of Thue and Morse have equal polynomials modulo 2**64, whatever the base."""
    bits = [bin(i).count("1") & 1 for i in range(1 << 12)]
    one, two = (bytes(97 + (b ^ flip) for b in bits) for flip in (0, 1))
    raw = np.frombuffer(one + b" " + two + b" " + one, np.uint8)
    starts, stops, _ = words.word_bounds(raw, np.array([0, len(raw)]))
    a, b, c = words.word_hashes(raw, starts, stops).tolist()
    assert a == c != b
