"""MinHash near-deduplication by an LSH forest.

Documents with equal shingle sets are one class from the start. Every class stands in TREES sorted orders, each by its
own rotation of the MinHash signature. Classes that share a prefix of DEPTHS[0] values in an order are a region; a region
of more than REGION classes is split by deeper prefixes, each to its own depth. Candidates are a class and the head of its
region, and its nearest neighbours in the order, which are those with the longest common prefixes. Links count only when the
whole sets confirm them: first that of each class with its most similar head, then those candidates that are still in
different components, at last all pairs of a region (before any split) that are still in different components, block by
block.
So a group of copies costs about one comparison a copy, and no pairs within groups are listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.llm.bloom import filter_bits, holds, key_filter, possibly, shared_positions, words_of_hash
from tensorloom.llm.common import arrow, byte_view, cut, join_facts, narrow, released, small_batches
from tensorloom.llm.components import components
from tensorloom.llm.words import mixed, pieces_of, shingle_sets

TREES, DEPTHS = 20, (3, 6, 9, 15)  # orders; prefix lengths that a region may have
VALUES = TREES * DEPTHS[0]  # of a signature
REGION, NEAR, BLOCK = 64, 8, 64  # classes of a region that is not split; neighbours on either side; classes that are compared at once
MISS = 1e-7  # chance that least_agreeing rules a pair of the threshold's similarity out
_MULTIPLIERS = mixed(np.arange(101, 101 + VALUES, dtype=np.uint64)) | np.uint64(1)
_CHUNK = 1 << 15  # shingles that are hashed at once, to stay in the processor's cache


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the least of VALUES hash functions over it, as 32-bit words; empty sets have the largest word."""
    out = np.full((len(sets), VALUES), 0xFFFFFFFF, np.uint32)
    a = 0
    while a < len(sets):
        b, n = a, 0
        while b < len(sets) and (b == a or n + len(sets[b]) <= _CHUNK):
            n += len(sets[b])
            b += 1
        rows = [i for i in range(a, b) if len(sets[i])]
        if rows:
            flat = np.concatenate([sets[i] for i in rows])
            begin = np.concatenate([[0], np.cumsum([len(sets[i]) for i in rows])[:-1]])
            held = np.empty_like(flat)
            for k in range(VALUES):
                np.multiply(flat, _MULTIPLIERS[k], out=held)
                out[rows, k] = np.minimum.reduceat(held, begin) >> np.uint64(32)
        a = b
    return out


def _slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """The rows in turn, lower-cased, so many at once that what is made of them stays small; the first row's number too."""
    if len(texts):
        for a, b in pieces_of(byte_view(texts)[1]):
            yield a, pc.ascii_lower(texts.slice(a, b - a))


def _sketches(width: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in _slices(batch.column(1)):
                sets = shingle_sets(*byte_view(texts), width)
                marks = signatures(sets)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, len(sets)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets], pa.string()),
                    pa.array([m.tobytes() if len(s) else None for s, m in zip(sets, marks, strict=True)], pa.binary()),
                ], ["id", "n_shingles", "set_key", "signature"])

    return sketch


def agreement(left: pa.Array, right: pa.Array) -> pa.Array:
    """Equal signature values, of VALUES."""
    a, b = (np.frombuffer(byte_view(x)[0], np.uint32).reshape(-1, VALUES) for x in (left, right))
    return pa.array((a == b).sum(axis=1), pa.int64())


def least_agreeing(percent: int) -> int:
    """Equal signature values that a pair of percent / 100 similarity has, but for a chance of MISS at most."""
    share, k, chance = percent / 100, -1, 0.0
    while chance <= MISS:
        k += 1
        chance += comb(VALUES, k) * share**k * (1 - share) ** (VALUES - k)
    return k


def common_shingles(left: pa.Array, right: pa.Array) -> pa.Array:
    """Shingles that two sets share, the sets being sorted hashes without repeats."""
    (a, a_at), (b, b_at) = byte_view(left), byte_view(right)
    out = np.zeros(len(left), np.int64)
    for i in range(len(left)):
        x, y = a[a_at[i] : a_at[i + 1]].view(np.uint64), b[b_at[i] : b_at[i + 1]].view(np.uint64)
        both = np.concatenate([x, y])
        both.sort(kind="stable")  # two runs that are merged
        out[i] = np.count_nonzero(both[1:] == both[:-1])
    return pa.array(out, pa.int64())


def _regions(classes: DataFrame, n_rows: int) -> tuple[DataFrame, DataFrame]:
    """Every class in each of its regions of two or more (region, id, head, rest, __n), rest being the order within.

    Also those of regions of more than NEAR + 1 classes (region, tree, id, __n), before any split: in smaller ones all are neighbours.
    """
    rows = classes.select("id", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    prefix = lambda depth: F.expr(f"substring(concat(signature, signature), {4 * DEPTHS[0]} * tree + 1, {4 * depth})")
    rows = rows.select("id", F.hex(F.xxhash64("tree", prefix(DEPTHS[0]))).alias("region"), "tree", prefix(DEPTHS[-1]).alias("rest"))
    # regions of one class are most; only rows whose region is possibly shared are exchanged
    bits = filter_bits(n_rows * TREES, 8)
    shared = classes.sparkSession.sparkContext.broadcast(shared_positions(rows.select(F.xxhash64("region")), bits, words_of_hash))

    def possibly_shared(regions: pa.Array) -> pa.Array:
        return pa.array(holds(shared.value, words_of_hash(regions), bits))

    rows = cut(rows.where(arrow(possibly_shared, "boolean")(F.xxhash64("region"))))
    out = wide = None
    for deeper in (*DEPTHS[1:], None):
        sizes = rows.groupBy("region").agg(F.count("*").alias("__n"), F.min("id").alias("head")).where("__n > 1")
        known = cut(narrow(join_facts(rows, sizes, "region", "__n", ["id"], n_rows * TREES).where("__n IS NOT NULL"), n_rows))
        small = known if deeper is None else known.where(F.col("__n") <= REGION)
        out = small if out is None else out.unionByName(small)
        large = known.where(F.col("__n") > REGION)
        wide = known.where(F.col("__n") > NEAR + 1).select("region", "tree", "id", "__n") if wide is None else wide
        if deeper is None or large.isEmpty():
            return out, wide
        rows = large.select("id", F.hex(F.xxhash64("tree", F.expr(f"substring(rest, 1, {4 * deeper})"))).alias("region"), "tree", "rest")
    return out, wide


def _sets(ids: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(id, set) for a table of distinct ids: the sorted hashes of their shingles. Only texts that are named are read again."""
    ids = cut(ids)
    n = ids.count()
    ids = narrow(ids, n)
    is_named = key_filter(ids.select(F.xxhash64("id")), n)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(is_named(batch.column(2))))
            for a, texts in _slices(batch.column(1)):
                sets = [s.tobytes() for s in shingle_sets(*byte_view(texts), width)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(sets)), pa.array(sets, pa.binary())], ["id", "set"])

    sets = docs.select("id", "text", F.xxhash64("id")).mapInArrow(released(sets_of), f"id {docs.schema['id'].dataType.simpleString()}, set binary")
    return cut(narrow(sets.join(ids, "id", "left_semi"), n, 5_000))


def _confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of ids whose whole sets are similar enough."""
    sets = _sets(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), docs, width)
    met = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    both = arrow(common_shingles, "bigint")("set_a", "set_b")
    met = met.select("a", "b", (F.octet_length("set_a") / 8 + F.octet_length("set_b") / 8).cast("long").alias("__sum"), both.alias("__both"))
    return cut(met.where(100 * F.col("__both") >= percent * (F.col("__sum") - F.col("__both"))).select("a", "b"))


def common_matrix(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Shingles that each set of one block shares with each of another: products of their incidence, some shingles at a time."""
    sets = [np.frombuffer(s, np.uint64) for s in (*left, *right)]
    token, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.int64)
    for a in range(0, len(token), 8192):
        some = slice(*np.searchsorted(column, [a, a + 8192]))
        held = np.zeros((len(sets), 8192), np.float32)
        held[row[some], column[some] - a] = 1
        out += np.rint(held[: len(left)] @ held[len(left) :].T).astype(np.int64)
    return out


def _apart(regions: DataFrame, label: DataFrame, marks: DataFrame, n_rows: int, least: int) -> DataFrame:
    """(label, mine, theirs): ids of regions between which there are pairs of different components with `least` equal values.

    All classes that a region's largest component doesn't hold meet all classes of the region, BLOCK by BLOCK. A pair counts
    in the first order only in which it shares a region. No pairs are listed, but the ids that are in any, under the label of
    their region's largest component; a task gives them once.
    """
    kind = marks.schema["id"].dataType.simpleString()
    rows = regions.join(label.select(F.col("node").alias("id"), "label"), "id", "left").select("region", "tree", "id", F.coalesce("label", "id").alias("label"))
    sizes = rows.groupBy("region", "label").agg(F.count("*").alias("n"))
    facts = sizes.groupBy("region").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.max("n").alias("most"), F.sum("n").alias("__n")).where("most < __n")
    rows = join_facts(rows, facts, "region", "__n", ["id"], n_rows * TREES).where("main IS NOT NULL").withColumn("stray", F.col("label") != F.col("main"))
    place = lambda n: F.pmod(F.xxhash64("id"), F.ceil(n / BLOCK)).cast("int")
    rows = rows.withColumns({"n_m": F.ceil(F.col("__n") / BLOCK).cast("int"), "m": place(F.col("__n")), "s": place(F.col("__n") - F.col("most"))})
    rows = cut(narrow(rows.join(marks, "id").select("region", "tree", "id", "label", "main", "stray", "n_m", "m", "s", "signature"), n_rows))
    held = F.collect_list(F.struct("id", "label", "stray", "signature"))
    many = rows.groupBy("region", "m").agg(held.alias("theirs"))
    few = rows.where("stray").groupBy("region", "tree", "main", "n_m", "s").agg(held.alias("mine"))
    few = few.withColumn("m", F.explode(F.sequence(F.lit(0), F.col("n_m") - 1)))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            for main, tree, mine, theirs in zip(*batch.columns, strict=True):
                a, b = mine.as_py(), theirs.as_py()
                x, y = (np.frombuffer(b"".join(r["signature"] for r in some), np.uint32).reshape(-1, VALUES) for some in (a, b))
                equal = x[:, None] == y
                wanted = equal.sum(axis=2) >= least
                wanted &= equal.reshape(len(a), len(b), TREES, DEPTHS[0]).all(axis=3).argmax(axis=2) == tree.as_py()
                wanted &= np.array([r["label"] for r in a])[:, None] != np.array([r["label"] for r in b])
                # two strays meet twice
                wanted &= (np.array([r["id"] for r in a])[:, None] < np.array([r["id"] for r in b])) | ~np.array([r["stray"] for r in b])
                if wanted.any():
                    some = found.setdefault(main.as_py(), (set(), set()))
                    some[0].update(a[i]["id"] for i in np.flatnonzero(wanted.any(axis=1)))
                    some[1].update(b[j]["id"] for j in np.flatnonzero(wanted.any(axis=0)))
        for main, (left, right) in found.items():
            yield pa.RecordBatch.from_pylist([{"label": main, "mine": sorted(left), "theirs": sorted(right)}])

    pairs = few.join(many, ["region", "m"]).select("main", "tree", "mine", "theirs")
    return cut(pairs.mapInArrow(released(likely), f"label {kind}, mine array<{kind}>, theirs array<{kind}>"))


def _linked_apart(apart: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between `mine` and `theirs` of a label, found by comparing whole sets block by block.

    Of m and n ids, (m / BLOCK) * (n / BLOCK) pairs of blocks are made, not m * n pairs; a pair of blocks gives as many links
    as join what they hold.
    """
    kind = apart.schema["label"].dataType.simpleString()
    few, many = (cut(apart.select("label", F.explode(side).alias("id")).distinct()) for side in ("mine", "theirs"))
    sets = _sets(few.select("id").unionByName(many.select("id")).distinct(), docs, width)

    def sized(rows: DataFrame) -> tuple[DataFrame, int]:
        return cut(rows.groupBy("label").agg(F.count("*").alias("__n"))), rows.count()

    def blocks(rows: DataFrame, sizes: DataFrame, n: int, block: str, held: str) -> DataFrame:
        placed = join_facts(rows, sizes, "label", "__n", ["id"], n).withColumn(block, F.pmod(F.xxhash64("id"), F.ceil(F.col("__n") / BLOCK)).cast("int"))
        return placed.join(sets, "id").groupBy("label", block).agg(F.collect_list(F.struct("id", "set")).alias(held))

    n_many, n_few = sized(many), sized(few)
    many = blocks(many, *n_many, "m", "theirs")
    few = join_facts(blocks(few, *n_few, "s", "mine"), n_many[0], "label", "__n", ["s"], n_many[1])
    few = few.withColumn("m", F.explode(F.sequence(F.lit(0), F.ceil(F.col("__n") / BLOCK).cast("int") - 1)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mine, theirs in zip(batch.column(0), batch.column(1), strict=True):
                a, b = mine.as_py(), theirs.as_py()
                both = common_matrix([x["set"] for x in a], [x["set"] for x in b])
                sizes = np.array([len(x["set"]) // 8 for x in a])[:, None] + np.array([len(x["set"]) // 8 for x in b])
                above: dict = {}
                links = []
                for i, j in np.argwhere(100 * both >= percent * (sizes - both)).tolist():
                    low, high = x, y = sorted((a[i]["id"], b[j]["id"]))
                    while x in above:
                        x = above[x]
                    while y in above:
                        y = above[y]
                    if x != y:
                        above[y] = x
                        links.append({"a": low, "b": high})
                if links:
                    yield pa.RecordBatch.from_pylist(links)

    return cut(few.join(many, ["label", "m"]).select("mine", "theirs").mapInArrow(released(compare), f"a {kind}, b {kind}"))


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: the id, n_shingles, component_id and kept (the row with its component's smallest id).

    Words are as in `words`, after lower-casing A-Z. A row's set is its distinct `width`-word shingles; with fewer words,
    its whole sequence; without words, empty, and then it is linked with nothing. Rows are linked when 100 * intersection
    >= percent * union. Links are confirmed on whole sets; a pair of similarity s has a chance of 1 - (1 - s**3)**20 to be
    a candidate, however large its region is, and one of `percent` is ruled out by its signature with a chance of MISS at most
    (both together lose less than one in a million at 0.8). Rows that share an id are taken as one document in
    links, and each is kept if the id is. A row without an id is linked like its class but never makes a component of
    its own (component_id null, kept). An empty table gives none.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = slim.schema["id"].dataType.simpleString()
    base = cut(slim.mapInArrow(released(_sketches(width)), f"id {id_type}, n_shingles long, set_key string, signature binary"))
    n_rows = base.count()
    base = narrow(base, n_rows)
    classes = base.where("id IS NOT NULL AND set_key IS NOT NULL").groupBy("set_key").agg(F.min("id").alias("id"), F.count("*").alias("__n"), F.min("signature").alias("signature"))
    classes = cut(narrow(classes, n_rows))

    members, wide = _regions(classes, n_rows)
    members = cut(members)
    order = Window.partitionBy("region").orderBy("rest", "id")
    small = members.where(F.col("__n") <= REGION)
    near = small.select("id", F.array(*[F.lag("id", k).over(order) for k in range(1, NEAR + 1)]).alias("others"))
    near = near.select("id", F.explode("others").alias("other"))
    heads = members.where(F.col("id") != F.col("head")).select("id", F.col("head").alias("other"))
    pairs = near.unionByName(heads).where("other IS NOT NULL AND other <> id").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    marks = classes.select("id", "signature")
    least = least_agreeing(percent)

    def likely(some: DataFrame) -> DataFrame:
        met = some.join(marks.select(F.col("id").alias("a"), F.col("signature").alias("__left")), "a").join(marks.select(F.col("id").alias("b"), F.col("signature").alias("__right")), "b")
        met = met.withColumn("likely", arrow(agreement, "bigint")("__left", "__right")).select("a", "b", "likely")
        return cut(narrow(met.where(F.col("likely") >= least), n_rows))

    pairs = likely(pairs)
    best = pairs.groupBy("b").agg(F.min_by("a", F.struct(-F.col("likely"), F.col("a"))).alias("a")).select("a", "b")
    best = cut(narrow(best, n_rows))
    links = _confirmed(best, slim, width, percent)
    label = components(links)
    other = pairs.join(label.select(F.col("node").alias("a"), F.col("label").alias("__a")), "a", "left").join(label.select(F.col("node").alias("b"), F.col("label").alias("__b")), "b", "left")
    rest = other.where(F.coalesce("__a", "a") != F.coalesce("__b", "b")).select("a", "b").join(best, ["a", "b"], "left_anti")
    rest = cut(narrow(rest, n_rows))
    if not rest.isEmpty():
        links = links.unionByName(_confirmed(rest, slim, width, percent))
        label = components(links)
    apart = _apart(wide, label, marks, n_rows, least)
    if not apart.isEmpty():
        label = components(links.unionByName(_linked_apart(apart, slim, width, percent)))

    found = classes.join(label.select(F.col("node").alias("id"), F.col("label").alias("__label")), "id", "left").where("__n > 1 OR __label IS NOT NULL")
    facts = found.select("set_key", F.coalesce("__label", "id").alias("component_id"), "__n")
    out = join_facts(base.select("id", "n_shingles", "set_key"), facts, "set_key", "__n", ["id"], n_rows)
    out = out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col(id_col)))


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that near_groups keeps, with the columns of docs.

    Only rows whose id is possibly among those that go are exchanged; all others pass straight through.
    """
    gone = cut(near_groups(docs, width, percent, id_col, text_col).where("NOT kept").select(F.col(id_col).alias("__gone")).where("__gone IS NOT NULL").distinct())
    rows = docs.withColumn("__maybe", possibly(gone.withColumnRenamed("__gone", id_col), F.xxhash64(id_col)))
    maybe = rows.where("__maybe").join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
    return rows.where("NOT __maybe").unionByName(maybe).drop("__maybe")
