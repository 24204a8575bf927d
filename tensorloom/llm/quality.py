"""A quality classifier: a byte-level convolutional network in numpy.

Bytes have learned vectors. Learned filters of two blocks of BLOCK bytes slide over the text by one block. A chunk is two
halves of HALF blocks and overlaps the next by one half; each filter's largest answer in a chunk is kept. A layer of hidden
units reads these, and their mean over all chunks of the whole text goes through one logistic unit. Chunks are short, so that
one word said over and over, which stirs few filters, shows.

Fitting uses whole texts of a sample that is bounded in rows and bytes. Scoring adds up table entries, one for each byte of a
filter's field, takes maxima and sums whole numbers, so that a text's score depends on no other text, batch or piece.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import arrow, byte_view, released, small_batches, text_of, without

OUT = ("score", "predicted")
BLOCK, HALF = 4, 16  # bytes of a block; blocks of half a chunk
PAD = 256  # the number of the padding byte
NONE = PAD + 1  # stands for the bytes of a block that isn't there
STEP_BLOCKS = 1 << 18  # blocks that are held at once
CACHED = 1 << 12  # blocks that are added up at once
FIXED = 1 << 24  # hidden units are summed as whole multiples of its inverse


@dataclass
class Network:
    vectors: np.ndarray  # 257 x e, the padding's being 0
    left: np.ndarray  # BLOCK * e x filters
    right: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray  # filters x units
    inner: np.ndarray
    out: np.ndarray
    base: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.vectors, self.left, self.right, self.bias, self.hidden, self.inner, self.out, self.base]


def fresh(seed: int, width: int = 8, filters: int = 24, units: int = 12) -> Network:
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.5, (PAD + 1, width)).astype(np.float32)
    vectors[PAD] = 0
    shape = (BLOCK * width, filters)
    return Network(vectors, rng.normal(0, 0.25, shape).astype(np.float32), rng.normal(0, 0.25, shape).astype(np.float32), np.zeros(filters, np.float32), rng.normal(0, (2 / filters) ** 0.5, (filters, units)).astype(np.float32), np.zeros(units, np.float32), rng.normal(0, 0.3, units).astype(np.float32), np.zeros(1, np.float32))


def blocks_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows' bytes padded to whole blocks, one at least (blocks x BLOCK), and the offsets of rows in blocks."""
    sizes = np.diff(at)
    counts = np.maximum(1, -(-sizes // BLOCK))
    begin = np.concatenate([[0], np.cumsum(counts)])
    out = np.full(begin[-1] * BLOCK, PAD, np.int16)
    shift = np.repeat(begin[:-1] * BLOCK - at[:-1], sizes)
    out[np.arange(len(raw)) + shift] = raw
    return out.reshape(-1, BLOCK), begin


def halves_of(begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first block of every half chunk, and the offsets of rows in halves."""
    counts = -(-np.diff(begin) // HALF)
    at = np.concatenate([[0], np.cumsum(counts)])
    inner = np.arange(at[-1]) - np.repeat(at[:-1], counts)
    return np.repeat(begin[:-1], counts) + inner * HALF, at


def answers(net: Network, blocks: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Each filter's answer at each block; `last` are the last blocks of rows, which no block follows."""
    x = net.vectors[blocks].reshape(len(blocks), -1)
    y = x @ net.left
    after = x @ net.right
    after[last[last + 1 < len(blocks)] + 1] = 0  # what begins a row follows nothing
    y[:-1] += after[1:]
    return y


@dataclass
class Scorer:
    """What scoring reads of a network: for each byte of a filter's field what every byte value adds to the answers."""

    tables: np.ndarray  # 2 * BLOCK x 258 x filters
    bias: np.ndarray
    hidden: np.ndarray
    inner: np.ndarray
    out: np.ndarray
    base: float

    @cached_property
    def pairs(self) -> np.ndarray:
        """BLOCK x 258**2 x filters: what two bytes in a row add; 25 MB that each worker makes for itself."""
        t = self.tables
        return np.stack([(t[j, :, None] + t[j + 1, None]).reshape(-1, t.shape[2]) for j in range(0, len(t), 2)])


def scorer(net: Network) -> Scorer:
    e = net.vectors.shape[1]
    vectors = np.concatenate([net.vectors, np.zeros((1, e), np.float32)])
    tables = np.stack([vectors @ side[j * e : (j + 1) * e] for side in (net.left, net.right) for j in range(BLOCK)])
    return Scorer(tables.astype(np.float32), net.bias, net.hidden, net.inner, net.out.astype(np.float64), float(net.base[0]))


def largest(net: Scorer, blocks: np.ndarray, after: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The largest answer of each filter from each of `starts` to the next; block i is followed by after[i]."""
    field = np.concatenate([blocks, after], axis=1).astype(np.int32)
    field = field[:, ::2] * (NONE + 1) + field[:, 1::2]
    best = np.empty((len(starts), net.pairs.shape[2]), np.float32)
    ends = np.append(starts[1:], len(blocks))
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + CACHED, "right")))
        some = field[starts[lo] : ends[hi - 1]]
        y = net.pairs[0].take(some[:, 0], axis=0)
        for j in range(1, len(net.pairs)):
            y += net.pairs[j].take(some[:, j], axis=0)
        best[lo:hi] = np.maximum.reduceat(y, starts[lo:hi] - starts[lo], axis=0)
        lo = hi
    return best


def _logits(net: Scorer, best: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows' logits: chunks are pairs of neighbouring halves of a row, or its only half."""
    counts, ends = np.diff(at), at[1:] - 1
    pair = np.maximum(best, np.concatenate([best[1:], best[-1:]]))
    pair[ends] = best[ends]
    weight = np.ones(len(best), bool)
    weight[ends] = counts == 1  # the last half begins no chunk of its own
    active = np.maximum(pair + net.bias, np.float32(0))
    unit = np.tile(net.inner, (len(best), 1))
    for f in range(active.shape[1]):  # one filter after another: a product of matrices would depend on their shape
        unit += active[:, f : f + 1] * net.hidden[f]
    whole = np.rint(np.maximum(unit, np.float32(0)).astype(np.float64) * FIXED).astype(np.int64) * weight[:, None]
    feature = np.add.reduceat(whole, at[:-1], axis=0) / FIXED / np.maximum(1, counts - 1)[:, None]
    out = np.full(len(counts), net.base)
    for u in range(feature.shape[1]):
        out += feature[:, u] * net.out[u]
    return out


def scores(net: Scorer, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The probability of label 1 of every row, rows of any length: long rows go through the filters piece by piece."""
    out = np.zeros(len(at) - 1)
    upto = np.cumsum(np.maximum(1, -(-np.diff(at) // BLOCK)))
    lo = 0
    while lo < len(out):
        before = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, before + STEP_BLOCKS, "right")))
        if hi == lo + 1 and upto[lo] - before > STEP_BLOCKS:
            best = _pieces(net, raw[at[lo] : at[hi]])
            halves = np.array([0, len(best)])
        else:
            blocks, begin = blocks_of(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            starts, halves = halves_of(begin)
            after = np.concatenate([blocks[1:], blocks[:1]])
            after[begin[1:] - 1] = NONE
            best = largest(net, blocks, after, starts)
        out[lo:hi] = _logits(net, best, halves)
        lo = hi
    return np.round(1 / (1 + np.exp(-np.clip(out, -60, 60))), 6)


def _pieces(net: Scorer, raw: np.ndarray) -> np.ndarray:
    """The halves of one long row: each piece is read one block further, so that no answer differs."""
    size, best = (STEP_BLOCKS // HALF) * HALF * BLOCK, []
    for a in range(0, len(raw), size):
        part = raw[a : a + size + BLOCK]
        blocks, _ = blocks_of(part, np.array([0, len(part)]))
        n = min(len(blocks), size // BLOCK)
        after = np.concatenate([blocks[1:], np.full((1, BLOCK), NONE, np.int16)])[:n]
        best.append(largest(net, blocks[:n], after, np.arange(0, n, HALF)))
    return np.concatenate(best)


def _stretches(starts: np.ndarray, n_blocks: int) -> Iterator[tuple[int, int, int, int]]:
    """Runs [a, b) of halves of about STEP_BLOCKS blocks, and the blocks [lo, hi) that they have."""
    ends, a = np.append(starts[1:], n_blocks), 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + STEP_BLOCKS, "right")))
        yield a, b, int(starts[a]), int(ends[b - 1])
        a = b


def _peaks(net: Network, blocks: np.ndarray, begin: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest answer of each filter in each half, and the block that gives it."""
    length = np.diff(np.append(starts, len(blocks)))
    best, peak, last = [], [], begin[1:] - 1
    for a, b, lo, hi in _stretches(starts, len(blocks)):
        y = answers(net, blocks[lo : hi + 1], last[(last >= lo) & (last < hi)] - lo)[: hi - lo]
        inside = starts[a:b, None] - lo + np.minimum(np.arange(HALF), length[a:b, None] - 1)  # repeats of the last block come after it
        at = np.argmax(y[inside], axis=1)
        best.append(np.take_along_axis(y[inside], at[:, None], axis=1)[:, 0])
        peak.append(starts[a:b, None] + at)
    return np.concatenate(best), np.concatenate(peak)


def _gradients(net: Network, blocks: np.ndarray, begin: np.ndarray, labels: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Of the mean log loss, and the rows' logits. Only the places where a filter is largest in its half get any."""
    starts, at = halves_of(begin)
    best, peak = _peaks(net, blocks, begin, starts)
    counts = np.diff(at)
    nxt = np.minimum(np.arange(len(best)) + 1, len(best) - 1)
    ends = at[1:] - 1
    nxt[ends] = ends
    take_next = best[nxt] > best
    pair = np.where(take_next, best[nxt], best)
    weight = np.ones(len(best), best.dtype)
    weight[ends] = counts == 1
    share = weight / np.repeat(np.maximum(1, counts - 1), counts).astype(best.dtype)
    row = np.repeat(np.arange(len(counts)), counts)
    active = np.maximum(pair + net.bias, 0)
    unit = np.maximum(active @ net.hidden + net.inner, 0)
    feature = np.add.reduceat(unit * share[:, None], at[:-1], axis=0)
    logit = feature @ net.out + net.base[0]
    error = ((1 / (1 + np.exp(-np.clip(logit, -60, 60)))) - labels).astype(best.dtype) / len(labels)
    d_unit = (error[row] * share)[:, None] * net.out * (unit > 0)
    d_pair = d_unit @ net.hidden.T * (active > 0)
    place = np.where(take_next, peak[nxt], peak)
    filters, e = best.shape[1], net.vectors.shape[1]
    d_left, d_right, d_vectors = np.zeros_like(net.left), np.zeros_like(net.right), np.zeros_like(net.vectors)
    for a, b, lo, hi in _stretches(starts, len(blocks)):
        near = slice(max(0, a - 1), b)  # the half before may have its largest answer here
        here = (place[near] >= lo) & (place[near] < hi)
        spot = ((place[near] - lo) * filters + np.arange(filters))[here]
        d_y = np.bincount(spot, d_pair[near][here], (hi - lo) * filters).reshape(-1, filters).astype(best.dtype)
        some = blocks[lo : hi + 1]
        x = net.vectors[some].reshape(len(some), -1)
        d_after = np.zeros((len(some), filters), best.dtype)
        d_after[1:] = d_y[: len(some) - 1]
        begins = begin[:-1][(begin[:-1] >= lo) & (begin[:-1] < lo + len(some))] - lo
        d_after[begins] = 0
        d_left += x[: hi - lo].T @ d_y
        d_right += x.T @ d_after
        d_x = d_after @ net.right.T
        d_x[: hi - lo] += d_y @ net.left.T
        d_x = d_x.reshape(-1, e)
        d_vectors += np.stack([np.bincount(some.ravel(), d_x[:, i], PAD + 1) for i in range(e)], axis=1).astype(best.dtype)
    d_vectors[PAD] = 0
    return [d_vectors, d_left, d_right, d_pair.sum(axis=0), active.T @ d_unit, d_unit.sum(axis=0), feature.T @ error, np.array([error.sum()], best.dtype)], logit


def fit_network(raw: np.ndarray, at: np.ndarray, labels: np.ndarray, seed: int = 7, visits: int = 20_000, batch: int = 64, rate: float = 8e-3) -> Network:
    """A network fitted by Adam to rows of bytes with labels 0 and 1; the same rows give the same network.

    All rows are gone through as often as makes `visits` rows, 6 times at least and 20 times at most.
    """
    net, rng = fresh(seed), np.random.default_rng(seed)
    if not len(labels):
        return net

    share = float(np.clip(labels.mean(), 0.01, 0.99))
    net.base[0] = np.log(share / (1 - share))
    first, second, step = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()], 0
    epochs = min(20, max(6, -(-visits // len(labels))))
    total = epochs * (-(-len(labels) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            sizes = (at[rows + 1] - at[rows]).astype(np.int64)
            some = np.concatenate([raw[at[r] : at[r + 1]] for r in rows])
            blocks, begin = blocks_of(some, np.concatenate([[0], np.cumsum(sizes)]))
            step += 1
            pace = rate * 0.5 * (1 + np.cos(np.pi * step / total)) + 1e-5
            for p, g, m, v in zip(net.parameters(), _gradients(net, blocks, begin, labels[rows].astype(np.float32))[0], first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(p.dtype)
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, most_rows: int, most_bytes: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: Column | None = None) -> DataFrame:
    """(order, id, label, bytes): whole texts of most_rows labels and most_bytes bytes at most, the least by a hash of the id.

    A text that no longer fits in most_bytes is passed over; later ones that fit are taken.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).where("__label in (0, 1)")
    known = known.groupBy("__id").agg(F.max("__label").alias("__label"))
    if held_out is not None:
        known = known.where(~held_out)
    chosen = known.withColumn("__order", F.xxhash64("__id")).orderBy("__order", "__id").limit(most_rows)
    rows = docs.select(F.col(id_col).alias("__doc"), text_of(text_col).alias("__text"))
    named = F.col("__doc") == F.col("__id")
    sizes = rows.select("__doc", F.octet_length("__text").alias("n")).join(F.broadcast(chosen), named).groupBy("__order", "__id", "__label").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    taken, bytes_left, rows_left = [], most_bytes, most_rows
    for order, key, label, n, n_rows in sizes.orderBy("__order", "__id").collect():  # most_rows at most
        if n <= bytes_left and n_rows <= rows_left:
            taken.append((order, key, label))
            bytes_left, rows_left = bytes_left - n, rows_left - n_rows
    taken = spark.createDataFrame(taken, chosen.select("__order", "__id", "__label").schema)
    return rows.join(F.broadcast(taken), named).select("__order", "__id", "__label", F.col("__text").cast("binary").alias("__bytes"))


def fit_sample(sample: DataFrame, seed: int) -> Network:
    """The network fitted to a sample, which one task holds; if its executor is lost, another fits the same."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        at = np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])]).astype(np.int64)
        net = fit_network(np.frombuffer(b"".join(r[3] for r in rows), np.uint8), at, np.array([r[2] for r in rows], np.int64), seed=seed)
        yield pa.record_batch({"net": pa.array([pickle.dumps(net)], pa.binary())})

    row = sample.repartition(1).mapInArrow(released(fit), "net binary").first()
    return pickle.loads(row["net"]) if row else fresh(seed)


def held_out_of(id_col: str) -> Column:
    """Rows that are never learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 4000, most_bytes: int = 12 << 20, threshold: float = 0.3, seed: int = 7) -> DataFrame:
    """docs with held_out, score (the probability of label 1) and predicted (1 if score >= threshold, else 0).

    The network is fitted to whole texts of labelled rows that are not held out, most_rows rows and most_bytes bytes at
    most; it then reads every byte of every text and nothing else. A null or empty text has a score too, that of one padded block.
    Labels other than 0 and 1 are left out; of several labels of one id the largest counts. Without any label the score is
    that of an unfitted network. Equal texts have equal scores, however rows are batched. Input columns named like an output
    column are replaced. An empty table gives none.
    """
    small_batches(docs.sparkSession)
    net = fit_sample(labelled_sample(docs, labels, most_rows, most_bytes, id_col, text_col, label_col, held_out_of("__id")), seed)
    held = docs.sparkSession.sparkContext.broadcast(scorer(net))

    def score(texts: pa.Array) -> pa.Array:
        return pa.array(scores(held.value, *byte_view(texts)), pa.float64())

    rows = without(docs, "held_out", *OUT).withColumns({"held_out": held_out_of(id_col), "score": arrow(score, "double")(F.col(text_col))})
    return rows.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))
