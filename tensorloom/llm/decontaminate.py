"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are normalised: lower-cased, each run of ASCII characters that are no letters or digits being one space. Benchmark
items are cut into overlapping windows of at most WINDOW bytes. A place of a text that holds a window with k edits or
fewer shares at least length - Q + 1 - Q * k of the window's Q-grams with it, on diagonals (place in text less place in
window) that differ by k at most. So shared Q-grams are counted in overlapping bands of diagonals; bands that reach that
count are verified by an alignment within the band. Items under LEAST bytes are one window without edits, and count only
between the borders of words; those under Q bytes have no Q-gram and match nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import arrow, byte_view, cut, released, small_batches
from tensorloom.llm.words import pieces_of

Q = 8  # bytes of a q-gram: one 64-bit word, so that q-grams are compared as they are
WINDOW, STRIDE, LEAST = 96, 48, 32  # bytes of a window and between windows; shorter items have to match whole
RATE = 0.08  # edits for each byte of a window
BAND = 8  # diagonals from one band to the next; a band is twice as wide, so any BAND in a row are in one
PIECE = 1 << 19  # bytes of text that are looked through at once
BLOCK_BYTES = 1 << 20  # bytes of benchmark items that are one block of windows
HELD = 16  # blocks that are broadcast at once: each pass over the documents looks for so many
_MAP_BITS = 22
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the normalised texts; null counts as empty."""
    raw, at = byte_view(pc.utf8_lower(texts))
    if not len(raw):
        return raw, at
    plain = _PLAIN[raw]
    keep = plain.copy()
    keep[1:] |= plain[:-1]
    begins = at[:-1][np.diff(at) > 0]
    keep[begins] = plain[begins]
    total = np.concatenate([[0], np.cumsum(keep)])
    return np.where(plain, raw, np.uint8(0x20))[keep], total[at]


@dataclass
class Windows:
    """The windows of a block of items, and where each of their q-grams is."""

    item: np.ndarray  # of each window: the number of its item
    data: np.ndarray  # windows x WINDOW bytes, zero beyond the length
    length: np.ndarray
    edits: np.ndarray  # the most that a match may have
    least: np.ndarray  # shared q-grams that any match has
    grams: np.ndarray  # sorted and distinct
    first: np.ndarray  # of each q-gram: where its places begin in the two following
    window: np.ndarray
    place: np.ndarray
    seen: np.ndarray  # a bit map of hashed q-grams
    windows_of: np.ndarray  # of each item: its windows


def windows_of(items: pa.Array) -> Windows:
    raw, at = normalised(items)
    item, parts = [], []
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if b - a < LEAST:
            whole = raw[a : b - 1] if b > a and raw[b - 1] == 0x20 else raw[a:b]
            if len(whole) >= Q:
                parts.append(whole)
                item.append(i)
        else:
            starts = sorted({*range(a, max(a, b - WINDOW) + 1, STRIDE), max(a, b - WINDOW)})
            parts += [raw[s : min(b, s + WINDOW)] for s in starts]
            item += [i] * len(starts)
    length = np.array([len(p) for p in parts], np.int64)
    data = np.zeros((len(parts), WINDOW), np.uint8)
    for row, part in zip(data, parts, strict=True):
        row[: len(part)] = part
    edits = np.where(length < LEAST, 0, np.floor(length * RATE)).astype(np.int64)
    gram = [np.lib.stride_tricks.sliding_window_view(p, Q).copy().view("<u8").ravel() for p in parts]
    every = np.concatenate(gram) if gram else np.zeros(0, np.uint64)
    window = np.repeat(np.arange(len(parts)), [len(g) for g in gram])
    place = np.concatenate([np.arange(len(g)) for g in gram]) if gram else np.zeros(0, np.int64)
    order = np.argsort(every, kind="stable")
    grams, first = np.unique(every[order], return_index=True)
    seen = np.zeros(1 << _MAP_BITS, bool)
    seen[(grams * _MULTIPLIER) >> np.uint64(64 - _MAP_BITS)] = True
    return Windows(np.array(item, np.int64), data, length, edits, length - Q + 1 - Q * edits, grams, np.append(first, len(every)), window[order], place[order], seen, np.bincount(item, minlength=len(at) - 1))


def _bands(w: Windows, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, window, first diagonal of the band) wherever a band shares enough q-grams; rows are text[at[i]:at[i + 1]]."""
    none = np.zeros(0, np.int64)
    if len(text) < Q or not len(w.grams):
        return none, none, none
    gram = np.ndarray((len(text) - Q + 1,), "<u8", np.ascontiguousarray(text), 0, (1,))
    hit = w.seen[(gram * _MULTIPLIER) >> np.uint64(64 - _MAP_BITS)]
    for end in at[1:-1].tolist():  # no q-gram goes over the end of a row
        hit[max(0, end - Q + 1) : end] = False
    # a match's q-grams are within one window and its edits: where so long a stretch has too few, there is none
    span, need = WINDOW + int(w.edits.max()), int(w.least.min())
    total = np.concatenate([[0], np.cumsum(hit, dtype=np.int32)])
    dense = total[np.minimum(np.arange(len(hit)) + span, len(hit))] - total[:-1] >= need
    starts = np.flatnonzero(dense)
    if not len(starts):
        return none, none, none
    edge = np.zeros(len(hit) + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + span, len(hit)), -1)
    place = np.flatnonzero(hit & (np.cumsum(edge[:-1]) > 0))
    which = np.searchsorted(w.grams, gram[place])
    which = np.minimum(which, len(w.grams) - 1)
    real = w.grams[which] == gram[place]
    place, which = place[real], which[real]
    times = w.first[which + 1] - w.first[which]
    source = np.repeat(w.first[which] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum()) if len(times) else none
    place = np.repeat(place, times)
    window, diagonal = w.window[source], place - w.place[source]
    row = np.searchsorted(at, place, "right") - 1
    band = diagonal // BAND + 2 * WINDOW  # never negative
    n_bands = len(text) // BAND + 4 * WINDOW
    key = (row * len(w.item) + window) * n_bands + band
    key, count = np.unique(np.concatenate([key, key - 1]), return_counts=True)
    window = key // n_bands % len(w.item)
    enough = count >= w.least[window]
    key, window = key[enough], window[enough]
    return key // n_bands // len(w.item), window, (key % n_bands - 2 * WINDOW) * BAND


def align(w: Windows, text: np.ndarray, lo: np.ndarray, hi: np.ndarray, window: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each window against its text[lo:hi] within the band, and where that ends in the text.

    Column c of the band in line i of the window is the text's byte diagonal + i + c. All bands advance together.
    """
    width = 2 * BAND + 1
    column = np.arange(width)
    far = 4 * WINDOW
    cost = np.where((diagonal[:, None] + column >= lo[:, None]) & (diagonal[:, None] + column <= hi[:, None]), 0, far)
    best, end = np.full(len(window), far), np.zeros(len(window), np.int64)
    for i in range(WINDOW):
        spot = diagonal[:, None] + i + column
        inside = (spot >= lo[:, None]) & (spot < hi[:, None])
        same = inside & (text[np.clip(spot, 0, len(text) - 1)] == w.data[window, i][:, None])
        step = np.where(inside, cost + ~same, far)  # the byte at `spot` is read
        # line i + 1 stands in the text after the byte that was read: the same column
        skip = np.concatenate([cost[:, 1:], np.full((len(cost), 1), far)], axis=1) + 1  # the window's byte has none
        cost = np.minimum(step, skip)
        cost = np.minimum.accumulate(cost - column, axis=1) + column  # bytes of the text that the window lacks
        done = w.length[window] == i + 1
        if done.any():
            at = np.argmin(cost[done], axis=1)
            best[done], end[done] = cost[done, at], diagonal[done] + i + 1 + at
    return best, np.clip(end, lo, hi)


Hit = tuple[int, int, int, int, int, int]


def leaks(held: list[Windows], texts: pa.Array) -> Iterator[tuple[int, list[Hit]]]:
    """(block, hits): of each block (row, item, windows found, edits of the best, begin, end) for each row and item that share a window.

    begin and end are bytes of the row's normalised text. Rows are looked through about PIECE bytes at a time, by all blocks.
    """
    if not len(texts):
        return
    for a, b in pieces_of(byte_view(texts)[1], PIECE):
        raw, at = normalised(texts.slice(a, b - a))
        for k, w in enumerate(held):
            if hits := [(a + hit[0], *hit[1:]) for hit in _leaks(w, raw, at)]:
                yield k, hits


def _leaks(w: Windows, raw: np.ndarray, at: np.ndarray) -> list[Hit]:
    """The hits of one block in normalised rows, all at once; long rows in pieces that overlap."""
    if not len(w.item):
        return []
    overlap = 4 * WINDOW
    pieces = []  # (row, begin, end) in raw
    for row in np.flatnonzero(np.diff(at) >= (w.length - w.edits).min()).tolist():
        a, b = int(at[row]), int(at[row + 1])
        while b - a > PIECE:
            pieces.append((row, a, a + PIECE))
            a += PIECE - overlap
        pieces.append((row, a, b))
    found: dict[tuple[int, int], list] = {}
    i = 0
    while i < len(pieces):
        j, size = i, 0
        while j < len(pieces) and (j == i or size + pieces[j][2] - pieces[j][1] <= PIECE):
            size += pieces[j][2] - pieces[j][1]
            j += 1
        text = np.concatenate([raw[a:b] for _, a, b in pieces[i:j]])
        begin = np.concatenate([[0], np.cumsum([b - a for _, a, b in pieces[i:j]])])
        piece, window, diagonal = _bands(w, text, begin)
        for s in range(0, len(piece), 4096):
            p, v, d = piece[s : s + 4096], window[s : s + 4096], diagonal[s : s + 4096]
            edits, end = align(w, text, begin[p], begin[p + 1], v, d)
            for k in np.flatnonzero(edits <= w.edits[v]).tolist():
                row, a, _ = pieces[i + p[k]]
                stop, length = int(end[k] - begin[p[k]] + a - at[row]), int(w.length[v[k]])
                if length < LEAST and not _between_borders(raw[at[row] : at[row + 1]], stop - length, stop):
                    continue
                entry = found.setdefault((row, int(w.item[v[k]])), [set(), WINDOW, stop, stop])
                entry[0].add(int(v[k]))
                entry[1] = min(entry[1], int(edits[k]))
                entry[2] = min(entry[2], max(0, stop - length))
                entry[3] = max(entry[3], stop)
        i = j
    return [(row, item, len(e[0]), e[1], e[2], e[3]) for (row, item), e in sorted(found.items())]


def _between_borders(text: np.ndarray, begin: int, end: int) -> bool:
    return (begin == 0 or text[begin - 1] == 0x20) and (end == len(text) or text[end] == 0x20)


def blocks_of_items(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, Windows]]:
    """The items in blocks of about BLOCK_BYTES, or of one longer item."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(id_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1].encode())
        if size >= BLOCK_BYTES:
            yield ids, windows_of(pa.array(texts, pa.string()))
            ids, texts, size = [], [], 0
    if ids:
        yield ids, windows_of(pa.array(texts, pa.string()))


def _passes(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, look: Callable[[DataFrame, Broadcast], DataFrame]) -> Iterator[DataFrame]:
    """What `look` gives of each HELD blocks of items, which alone are broadcast, and on the driver, at a time.

    A benchmark of one such pass (about 16 MB) leaves the result lazy; with more, each pass is written to the shared folder
    before its blocks are given up.
    """
    blocks = blocks_of_items(benchmark, id_col, text_col)
    some = list(islice(blocks, HELD))
    while some:
        after = list(islice(blocks, HELD))
        held = docs.sparkSession.sparkContext.broadcast(some)
        if not after:
            yield look(docs, held)
            return
        yield cut(look(docs, held))
        held.destroy()
        some = after


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and benchmark item that share a window of the item, up to RATE edits a byte.

    Gives the document's id, the item's id, n_windows (of the item), n_found, edits (of the best window), begin and end (bytes
    of the document's normalised text). Documents without a shared window have no row. Items under LEAST bytes when
    normalised match as they are, between borders of words; null items and those under Q bytes match nothing, null texts hold
    nothing; repeated rows and items are reported each on their own. Other columns of the inputs are not carried. No rows are
    exchanged: the items go to the documents, HELD blocks a pass.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type, item_type = rows.schema["id"].dataType.simpleString(), benchmark.schema[item_id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, `{item_id_col}` {item_type}, n_windows int, n_found int, edits int, begin long, `end` long"

    def look(some: DataFrame, held: Broadcast) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, windows = zip(*held.value, strict=True)
            for batch in batches:
                for block, hits in leaks(list(windows), batch.column(1)):
                    row, item, n_found, edits, begin, end = zip(*hits, strict=True)
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(row, pa.int64())),
                        pa.array([names[block][i] for i in item], pa.int64() if item_type == "bigint" else None),
                        pa.array(windows[block].windows_of[list(item)].astype(np.int32)),
                        pa.array(n_found, pa.int32()),
                        pa.array(edits, pa.int32()),
                        pa.array(begin, pa.int64()),
                        pa.array(end, pa.int64()),
                    ], [id_col, item_id_col, "n_windows", "n_found", "edits", "begin", "end"])

        return some.mapInArrow(released(search), schema)

    out = spark.createDataFrame([], schema)
    for found in _passes(rows, benchmark, item_id_col, item_text_col, look):
        out = out.unionByName(found)
    return out


def _leaked(held: Broadcast) -> Callable[[pa.Array], pa.Array]:
    def leaked(texts: pa.Array) -> pa.Array:
        flags = np.zeros(len(texts), bool)
        for _, hits in leaks([w for _, w in held.value], texts):
            flags[[hit[0] for hit in hits]] = True
        return pa.array(flags)

    return leaked


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that share no window with any benchmark item (see find_leaks), with the columns of docs.

    With a benchmark of more than one pass, what each pass leaves is written to the shared folder and read by the next.
    """
    small_batches(docs.sparkSession)
    left = [docs]

    def look(_: DataFrame, held: Broadcast) -> DataFrame:
        return left[0].where(~arrow(_leaked(held), "boolean")(F.col(text_col)))

    for kept in _passes(docs, benchmark, item_id_col, item_text_col, look):
        left[0] = kept
    return left[0]
