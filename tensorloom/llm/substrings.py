"""Removal of byte strings that an earlier document has too, by merging the Burrows-Wheeler transforms of shards.

Every window (a string of LENGTH bytes) belongs to the anchor within it whose hash is least, so equal windows share an
anchor, and the windows of one anchor in a row are one segment of at most LENGTH + REACH bytes. Anchors that only one document
has are left out after one pass that exchanges four bytes an anchor. Each task makes shards of the segments of the others: it
sorts the suffixes of their texts once, and sends, dealt by anchor, the transform of the segments, that is the byte before
each of their suffixes in the order of these. Equal segments of a shard are one. A place that has a segment which an earlier
document of the same shard has too goes whole, and is settled there; only the places of the earliest document are sent.

Where shards meet, their transforms are merged without sorting any suffix again. The interleave of what follows the windows
starts as the shards one after another, each in its own order, and is refined LENGTH times: a stable counting pass moves
each place by the byte before it, and the last-to-first mapping of its own shard leads on to that byte's suffix. After step k
the interleave is in order of k bytes, and neighbours that the step tells apart have a common prefix below k. Intervals whose
common prefix is LENGTH at the end are the repeated ones, and the least document of each decides which of its places go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.bloom import filter_bits, holds, possibly, shared_positions, words_of_hash
from tensorloom.llm.common import arrow, byte_view, cut, narrow, released, small_batches, text_of, without
from tensorloom.llm.words import _powers, mixed

OUT = ("n_bytes", "n_removed", "n_spans", "spans", "kept_sha256")
LENGTH = 50  # bytes of the strings that count as repeated
GRAM = 24  # bytes that an anchor's hash reads
REACH = LENGTH - GRAM + 1  # places where a window's anchor can be
PIECE = 1 << 19  # bytes that are looked through at once
FLUSH = 1 << 20  # anchors that a task holds before it sends them
SEGMENTS = 1 << 15  # of a shard
PART_BYTES = 4 << 20  # text for each part that anchors are dealt into
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
LAST_ID = (1 << 63) - 1  # a row without an id comes after all others


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    n = 1
    while 2 * n <= width:
        x, n = np.minimum(x[: len(x) - n], x[n:]), 2 * n
    rest = width - n
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def segments(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last-but-one window of each segment and its anchor's hash; windows never go over the end of a row."""
    none = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return none, none, none.view(np.uint64)

    word = np.ndarray((len(raw) - 7,), "<u8", np.ascontiguousarray(raw), 0, (1,))
    n = len(raw) - GRAM + 1
    h = word[:n] * _A + (word[8 : 8 + n] ^ (word[8 : 8 + n] >> np.uint64(29))) * _B + (word[16 : 16 + n] ^ (word[16 : 16 + n] >> np.uint64(31))) * _C
    h = (h ^ (h >> np.uint64(32))) * _B
    h ^= h >> np.uint64(29)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)  # of equal ones the first
    anchor = (_least(key, REACH) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    whole = np.ones(len(anchor), bool)
    for end in at[1:-1].tolist():
        whole[max(0, end - LENGTH + 1) : end] = False
    change = np.ones(len(anchor), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])
    begin = np.flatnonzero(change)
    end = np.append(begin[1:], len(anchor))
    keep = whole[begin]
    begin, end = begin[keep], end[keep]
    return begin, end, mixed(h[anchor[begin]])  # the least of many hashes are small: mixed, they fill all parts alike


def _pieces(at: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (row, begin, end) of about PIECE bytes; long rows are cut so that each window is in one piece alone."""
    held, size = [], 0
    for row, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        while b - a >= LENGTH:
            stop = min(b, a + PIECE + LENGTH - 1)
            held.append((row, a, stop))
            size += stop - a
            if size >= PIECE:
                yield held
                held, size = [], 0
            if stop == b:
                break
            a += PIECE
    if held:
        yield held


def _joined(raw: np.ndarray, pieces: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([raw[a:b] for _, a, b in pieces]), np.concatenate([[0], np.cumsum([b - a for _, a, b in pieces])])


def _noted(hashes: list[np.ndarray], docs: list[np.ndarray], shift: int) -> pa.RecordBatch:
    """The anchors that a task met in one document, and in more, as 32-bit words in the part of their leading bits."""
    h, d = np.concatenate(hashes), np.concatenate(docs)
    h = h >> np.uint64(shift - 32)
    order = np.argsort(h, kind="stable")
    h, d = h[order], d[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    several = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
    h = h[first]
    part = (h >> np.uint64(32)).astype(np.int64)
    low = h.astype(np.uint32)
    parts, starts = np.unique(part, return_index=True)
    spans = list(zip(starts, np.append(starts[1:], len(part)), strict=True))
    return pa.record_batch({
        "part": pa.array(parts.astype(np.int32)),
        "met": pa.array([low[a:b].tobytes() for a, b in spans], pa.binary()),
        "again": pa.array([low[a:b][several[a:b]].tobytes() for a, b in spans], pa.binary()),
    })


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def shared_anchors(docs: DataFrame, bits: int) -> DataFrame:
    """(anchor) the leading 32 + bits bits of the anchors that two documents (id, hash, text) or more have."""
    shift = 64 - bits

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, owners, held, base = [], [], 0, 0
        for batch in batches:
            raw, at = byte_view(batch.column(2))
            for pieces in _pieces(at):
                text, offsets = _joined(raw, pieces)
                begin, _, anchor = segments(text, offsets)
                row = np.array([p[0] for p in pieces])[np.searchsorted(offsets, begin, "right") - 1]
                hashes.append(anchor)
                owners.append(row + base)
                held += len(anchor)
                if held >= FLUSH:
                    yield _noted(hashes, owners, shift)
                    hashes, owners, held = [], [], 0
            base += len(at) - 1
        if held:
            yield _noted(hashes, owners, shift)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in groupby(_rows_of(batches), lambda r: r[0]):
            met, again = [], []
            for _, one, more in rows:
                met.append(np.frombuffer(one, np.uint32))
                again.append(np.frombuffer(more, np.uint32))
            met = np.sort(np.concatenate(met))
            found = np.unique(np.concatenate([met[1:][met[1:] == met[:-1]], *again])).astype(np.int64)
            yield pa.record_batch({"anchor": pa.array((np.int64(part) << np.int64(32)) | found)})

    notes = docs.mapInArrow(released(note), "part int, met binary, again binary")
    return notes.repartition(1 << bits, "part").sortWithinPartitions("part").mapInArrow(released(merge), "anchor long")


def _content_hash(raw: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    up, down = _powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    return mixed((total[stop] - total[begin]) * down[begin] + (stop - begin).astype(np.uint64))


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... count[0] of them, then those of begin[1], and so on."""
    return np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())


def _radix(key: np.ndarray) -> np.ndarray:
    """A stable order of natural numbers below 2**32, by counting passes."""
    order = np.argsort(key.astype(np.uint16), kind="stable")
    high = (key >> 16).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


def runs_of(text: np.ndarray, begin: np.ndarray, stop: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text that ordered segments [begin, stop) cover, in runs, each with one more place for its end.

    Gives the text, those places, and where the segments begin in it. Runs never go over the end of a row.
    """
    new = np.append(True, (begin[1:] >= stop[:-1]) | (row[1:] != row[:-1]))
    first = begin[new]
    size = stop[np.append(new[1:], True)] - first
    at = np.cumsum(size + 1) - size - 1
    ends = at + size
    out = np.append(text, np.uint8(0))[_spread(first, size + 1)]
    out[ends] = 0
    return out, ends, begin + (at - first)[np.cumsum(new) - 1]


_FRONT = np.array([0] + [((1 << 8 * c) - 1) << 8 * (8 - c) for c in range(1, 8)], np.uint64)


def suffix_order(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places of a text of runs in order of their suffixes, which go to the end of their run.

    Ends are less than all bytes, and an earlier end is less than a later one. Places are sorted by seven bytes first; those
    that are still alike are told apart by the ranks of what follows, which doubles the length every time.
    """
    n = len(text)
    end_of = np.repeat(ends, np.diff(np.append(-1, ends)))
    left = np.minimum(end_of - np.arange(n), 7)
    word = np.ndarray((n,), ">u8", np.append(text, np.zeros(8, np.uint8)), 0, (1,)).astype(np.uint64)
    key = (word & _FRONT[left]) | left.astype(np.uint64)
    order = np.argsort(key)
    order[: len(ends)] = ends
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])
    new[: len(ends)] = True
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    slot, length = np.arange(n), 7
    while True:
        tied = ~(new & np.append(new[1:], True))
        slot = slot[tied]
        if not len(slot):
            return order
        some = order[slot]
        pair = (rank[some] << 32) | rank[np.minimum(some + length, end_of[some])]
        moved = np.argsort(pair)
        some, pair = some[moved], pair[moved]
        new = np.append(True, pair[1:] != pair[:-1])
        order[slot] = some
        rank[some] = np.maximum.accumulate(np.where(new, slot, 0))
        length *= 2


def transform(text: np.ndarray, ends: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, place, symbol) of all places of all segments, the end included, in order of their suffixes in the text.

    The symbol is the byte before the place; the first place of a segment has none (0).
    """
    n = len(text)
    opened = np.cumsum(np.bincount(begin, minlength=n))
    closed = np.cumsum(np.bincount(stop + 1, minlength=n + 1))[:n]  # segments end in the order in which they begin
    order = suffix_order(text, ends)
    count = (opened - closed)[order]
    segment, place = _spread(closed[order], count), np.repeat(order, count)
    return segment, place, np.where(place > begin[segment], text[place - 1], np.uint8(0))


class _Shard:
    """The segments of one task and their places, until they are sent."""

    def __init__(self) -> None:
        self.part, self.group, self.key, self.begin, self.size, self.id, self.hash, self.place, self.times, self.row = ([] for _ in range(10))
        self.text: list[np.ndarray] = []
        self.held = self.at = self.rows = 0

    def add(self, text: np.ndarray, begin: np.ndarray, stop: np.ndarray, row: np.ndarray, **columns: np.ndarray) -> None:
        some, _, at = runs_of(text, begin, stop, row)
        self.text.append(some)
        self.begin.append(at + self.at)
        self.size.append(stop - begin)
        self.row.append(row + self.rows)
        for name, values in columns.items():
            getattr(self, name).append(values)
        self.at += len(some)
        self.rows += int(row[-1]) + 1
        self.held += len(begin)

    def batches(self, bits: int) -> Iterator[pa.RecordBatch]:
        part, group, key, begin, size, ids, hashes, place, times, row = (np.concatenate(x) for x in (self.part, self.group, self.key, self.begin, self.size, self.id, self.hash, self.place, self.times, self.row))
        order = np.lexsort((ids, key, part))
        new = np.append(True, (key[order][1:] != key[order][:-1]) | (part[order][1:] != part[order][:-1]))
        string = np.cumsum(new) - 1
        first = order[new]
        # an earlier document of this shard has the segment too: its places go whole
        later = ids[order] > ids[first][string]
        gone = order[later]
        if len(gone):
            yield from settled(ids[gone], hashes[gone], place[gone], place[gone] + (times[gone] - 1) * (size[gone] - LENGTH + 1) + size[gone], bits)
        order, string = order[~later], string[~later]
        chosen = np.sort(first)
        number = np.empty(len(part), np.int64)
        number[first] = np.arange(len(first))
        text, ends, at = runs_of(np.concatenate(self.text), begin[chosen], begin[chosen] + size[chosen], row[chosen])
        segment, spot, symbol = transform(text, ends, at, at + size[chosen])
        dealt = _radix(part[chosen][segment])
        segment, spot, symbol = segment[dealt], spot[dealt], symbol[dealt]
        opens, closes = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
        here = np.flatnonzero(spot == at[segment])
        opens[number[chosen[segment[here]]]] = here
        here = np.flatnonzero(spot == (at + size[chosen])[segment])
        closes[number[chosen[segment[here]]]] = here
        s_part = part[first]
        parts, s_begin = np.unique(s_part, return_index=True)
        s_end = np.append(s_begin[1:], len(s_part))
        cuts = np.searchsorted(string, np.append(s_begin, len(s_part)))
        e_cuts = np.searchsorted(part[chosen][segment], np.append(parts, s_part[-1] + 1))
        out = {n: [] for n in COLUMNS}
        for a, b, lo, hi, e_lo, e_hi in zip(s_begin, s_end, cuts[:-1], cuts[1:], e_cuts[:-1], e_cuts[1:], strict=True):
            rows, of = order[lo:hi], first[a:b]
            values = (size[of].astype(np.uint8), key[of], group[of].astype(np.uint32), (opens[a:b] - e_lo).astype(np.int32), (closes[a:b] - e_lo).astype(np.int32), symbol[e_lo:e_hi], (string[lo:hi] - a).astype(np.int32), ids[rows], hashes[rows], place[rows], times[rows].astype(np.int32))
            for n, x in zip(COLUMNS, values, strict=True):
                out[n].append(x.tobytes())
        yield pa.record_batch({"part": pa.array(parts.astype(np.int32))} | {n: pa.array(x, pa.binary()) for n, x in out.items()})


#: Of each string: its size, content hash, anchor, first and last place in the transform; the transform; then the places of strings.
COLUMNS = ("size", "key", "anchor", "opens", "closes", "symbol", "string", "id", "hash", "place", "times")


def _bucketed(ids: np.ndarray, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, bits: int) -> dict[int, tuple]:
    """Spans by the bucket of their document."""
    bucket = (mixed(ids.view(np.uint64) ^ mixed(hashes.view(np.uint64))) >> np.uint64(64 - bits)).astype(np.int64)
    order = np.lexsort((begin, hashes, ids, bucket))
    buckets, first = np.unique(bucket[order], return_index=True)
    cuts = zip(first, np.append(first[1:], len(order)), strict=True)
    return {int(k): tuple(x[order[a:b]].tobytes() for x in (ids, hashes, begin, end)) for k, (a, b) in zip(buckets, cuts, strict=True)}


def settled(ids: np.ndarray, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Spans that go, in the form of a shard without strings: spans that touch are one."""
    order = np.lexsort((begin, hashes, ids))
    ids, hashes, begin, end = ids[order], hashes[order], begin[order], end[order]
    row = np.cumsum(np.append(True, (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1]))) - 1
    shift = row * (int(end.max()) + 1)  # rows one behind another, so that one pass joins the spans of all
    upto = np.maximum.accumulate(end + shift)
    new = np.append(True, (row[1:] != row[:-1]) | (begin[1:] + shift[1:] > upto[:-1]))
    last = np.append(new[1:], True)
    found = _bucketed(ids[new], hashes[new], begin[new], (upto - shift)[last], bits)
    empty = [b""] * len(found)
    columns = dict.fromkeys(COLUMNS, empty) | {n: [x[i] for x in found.values()] for i, n in enumerate(("id", "hash", "place", "times"))}
    yield pa.record_batch({"part": pa.array(list(found), pa.int32())} | {n: pa.array(columns[n], pa.binary()) for n in COLUMNS})


SHARDS = "part int, " + ", ".join(f"{c} binary" for c in COLUMNS)


def shards_of(docs: DataFrame, anchors: DataFrame, bits: int) -> DataFrame:
    """Each task's shards of the segments whose anchor is possibly shared, packed by part; settled spans by bucket."""
    shift = np.uint64(64 - bits - 32)
    spark = docs.sparkSession
    size = filter_bits(anchors.count())
    held = spark.sparkContext.broadcast(shared_positions(anchors, size, words_of_hash, times=1))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            ids, hashes = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False)).astype(np.int64) for i in (0, 1))
            raw, at = byte_view(batch.column(2))
            for pieces in _pieces(at):
                text, offsets = _joined(raw, pieces)
                begin, end, anchor = segments(text, offsets)
                key = (anchor >> shift).view(np.int64)
                use = holds(held.value, words_of_hash(pa.array(key)), size)
                if not use.any():
                    continue
                begin, end, key = begin[use], end[use], key[use]
                stop = end + LENGTH - 1
                which = np.searchsorted(offsets, begin, "right") - 1
                row = np.array([p[0] for p in pieces])[which]
                shift_back = np.array([a for _, a, _ in pieces])[which] - offsets[which] - at[row]
                content, place = _content_hash(text, begin, stop), begin + shift_back
                # a text that says one thing over and over has one string again and again: one place, and how often
                new = np.append(True, (content[1:] != content[:-1]) | (row[1:] != row[:-1]) | (begin[1:] != end[:-1]))
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(new)))
                r, k = row[first], key[first]
                shard.add(text, begin[first], stop[first], which[first], part=k >> np.int64(32), group=k & np.int64(0xFFFFFFFF), key=content[first], id=ids[r], hash=hashes[r], place=place[first], times=times)
                if shard.held >= SEGMENTS:
                    yield from shard.batches(bits)
                    shard = _Shard()
        if shard.held:
            yield from shard.batches(bits)

    return docs.mapInArrow(released(pack), SHARDS)


def last_to_first(symbol: np.ndarray, shard: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
    """For every place of the transforms of shards, one after another, where the place before it in its segment is.

    The places that have one before them, by symbol, are in the order in which those are that have one after them.
    """
    has_before, has_after = np.ones(len(symbol), bool), np.ones(len(symbol), bool)
    has_before[opens], has_after[closes] = False, False
    later = np.flatnonzero(has_before)
    later = later[np.argsort(symbol[later], kind="stable")]
    later = later[_radix(shard[later])]
    out = np.full(len(symbol), -1, np.int32)
    out[later] = np.flatnonzero(has_after)
    return out


def interleave(symbol: np.ndarray, before: np.ndarray, order: np.ndarray, spot: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The least owner among all windows equal to each window.

    spot[i] is where the transforms have what follows window i, and order the windows in order of it.
    """
    least = owner.copy()
    spot = spot[order]
    block = np.zeros(len(order), np.int64)
    for step in range(1, LENGTH + 1):
        if not len(order):
            break
        byte = symbol[spot]
        moved = np.argsort(byte, kind="stable")
        order, byte, block, spot = order[moved], byte[moved], block[moved], before[spot[moved]]
        new = np.append(True, (byte[1:] != byte[:-1]) | (block[1:] != block[:-1]))  # a common prefix below `step`
        if step % 4 == 0:
            alone = new & np.append(new[1:], True)
            if alone.any():
                order, new, spot = order[~alone], new[~alone], spot[~alone]
        block = np.cumsum(new)
    if len(order):
        first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        low = np.minimum.reduceat(owner[order], first)
        least[order] = np.repeat(low, np.diff(np.append(first, len(order))))
    return least


STRINGS = 1 << 14  # strings whose windows are interleaved at once


def merged_shards(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id, hash, begin, end) of bytes that an earlier document has too, from all shards of one part."""
    column = lambda name, kind: [np.frombuffer(r[1 + COLUMNS.index(name)], kind) for r in rows]
    symbols, sizes = column("symbol", np.uint8), column("size", np.uint8)
    counts, lengths = [len(x) for x in sizes], [len(x) for x in symbols]
    size, key, group = np.concatenate(sizes).astype(np.int64), np.concatenate(column("key", np.uint64)), np.concatenate(column("anchor", np.uint32))
    after = np.repeat(np.cumsum(lengths) - lengths, counts)  # places of the shards before each string's
    opens, closes = np.concatenate(column("opens", np.int32)) + after, np.concatenate(column("closes", np.int32)) + after
    symbol = np.concatenate(symbols)
    before = last_to_first(symbol, np.repeat(np.arange(len(rows), dtype=np.uint32), lengths), opens, closes)
    base = np.cumsum([0, *counts[:-1]])
    string = np.concatenate([x.astype(np.int64) + b for x, b in zip(column("string", np.int32), base, strict=True)])
    ids, hashes, place = (np.concatenate(column(n, np.int64)) for n in ("id", "hash", "place"))
    times = np.concatenate(column("times", np.int32)).astype(np.int64)
    # equal strings of several shards are one
    _, first, same = np.unique(key, return_index=True, return_inverse=True)
    size, string, group, closes = size[first], same[string], group[first], closes[first]
    owner = np.full(len(first), LAST_ID, np.int64)
    np.minimum.at(owner, string, ids)
    n_windows = size - LENGTH + 1
    begin = np.concatenate([[0], np.cumsum(n_windows)])
    # what follows the last window is the segment's end; the places before it follow the windows before
    spot = np.empty(begin[-1], np.int64)
    for step in range(REACH):
        some = n_windows > step
        spot[(begin[1:] - 1 - step)[some]] = closes[some]
        closes = before[closes]
    least, owner = np.empty(begin[-1], np.int64), np.repeat(owner, n_windows)
    # equal windows are in strings with the same anchor; the strings of one anchor are interleaved together
    by_anchor = np.argsort(group, kind="stable")
    ends = np.append(np.flatnonzero(group[by_anchor][1:] != group[by_anchor][:-1]) + 1, len(group))
    marked, a = np.full(len(symbol), -1, np.int64), 0
    while a < len(by_anchor):
        b = ends[np.searchsorted(ends, min(a + STRINGS, len(by_anchor)))]
        strings = by_anchor[a:b]
        window = _spread(begin[strings], n_windows[strings])
        marked[spot[window]] = np.arange(len(window))
        order = marked[np.flatnonzero(marked >= 0)]  # one shard after another, each in its own order
        marked[spot[window]] = -1
        least[window] = interleave(symbol, before, order, spot[window], owner[window])
        a = b
    # of the places of most strings either no window has an earlier document or all have
    low, high = np.minimum.reduceat(least, begin[:-1])[string], np.maximum.reduceat(least, begin[:-1])[string]
    whole = np.flatnonzero(high < ids)
    out = [(ids[whole], hashes[whole], place[whole], place[whole] + times[whole] * n_windows[string[whole]] + LENGTH - 1)]
    some = np.flatnonzero((low < ids) & (high >= ids))
    upto = np.cumsum(times[some] * n_windows[string[some]])
    a = 0
    while a < len(some):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + (1 << 18), "right")))
        out.append(_spans_of(np.repeat(some[a:b], times[some[a:b]]), _spread(np.zeros(b - a, np.int64), times[some[a:b]]), string, ids, hashes, place, begin, n_windows, least))
        a = b
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _spans_of(rows: np.ndarray, again: np.ndarray, string: np.ndarray, ids: np.ndarray, hashes: np.ndarray, place: np.ndarray, begin: np.ndarray, n_windows: np.ndarray, least: np.ndarray) -> tuple:
    """(id, hash, begin, end) of the runs of windows that go, at the again-th repeat of each of the places `rows`."""
    count = n_windows[string[rows]]
    window, which = _spread(begin[string[rows]], count), np.repeat(np.arange(len(rows)), count)
    goes = least[window] < ids[rows[which]]
    edge = np.append(True, which[1:] != which[:-1])
    opens = goes & (edge | ~np.append(False, goes[:-1]))
    closes = goes & (np.append(edge[1:], True) | ~np.append(goes[1:], False))
    a, b = np.flatnonzero(opens), np.flatnonzero(closes)
    row, repeat = rows[which[a]], again[which[a]]
    lo = place[row] + repeat * n_windows[string[row]] + window[a] - begin[string[row]]
    return ids[row], hashes[row], lo, lo + (b - a) + LENGTH


def _union(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted spans without overlaps; spans that touch are one."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.append(True, begin[1:] > end[:-1])
    return begin[new], end[np.append(new[1:], True)]


SPANS = "id long, hash long, spans binary"


def repeated_spans(docs: DataFrame, total_bytes: int) -> DataFrame:
    """(id, hash, spans): of each document (id, hash, text) that has bytes to remove, their spans as 64-bit pairs."""
    bits = max(3, (max(1, total_bytes // PART_BYTES) - 1).bit_length())
    shards = shards_of(docs, cut(shared_anchors(docs, bits)), bits)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spans(found: dict[int, tuple]) -> pa.RecordBatch:
            columns = {n: pa.array([x[i] for x in found.values()], pa.binary()) for i, n in enumerate(("id", "hash", "begin", "end"))}
            return pa.record_batch({"bucket": pa.array(list(found), pa.int32())} | columns)

        for part, rows in groupby(_rows_of(batches), lambda r: r[0]):
            held = []
            for row in rows:
                if row[1]:
                    held.append(row)
                else:  # settled already
                    yield spans({part: row[1 + COLUMNS.index("id") :]})
            if held:
                ids, hashes, begin, end = merged_shards(held)
                if len(ids):
                    yield spans(_bucketed(ids, hashes, begin, end, bits))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(_rows_of(batches), lambda r: r[0]):
            ids, hashes, begin, end = (np.concatenate(x) for x in zip(*([np.frombuffer(c, np.int64) for c in r[1:]] for r in rows), strict=True))
            order = np.lexsort((hashes, ids))
            ids, hashes, begin, end = ids[order], hashes[order], begin[order], end[order]
            first = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])))
            spans = [np.stack(_union(begin[a:b], end[a:b]), axis=1).tobytes() for a, b in zip(first, np.append(first[1:], len(ids)), strict=True)]
            yield pa.record_batch({"id": pa.array(ids[first]), "hash": pa.array(hashes[first]), "spans": pa.array(spans, pa.binary())})

    found = shards.repartition(1 << bits, "part").sortWithinPartitions("part").mapInArrow(released(merge), "bucket int, id binary, hash binary, begin binary, `end` binary")
    return found.repartition(1 << bits, "bucket").sortWithinPartitions("bucket").mapInArrow(released(collect), SPANS)


def _removal(texts: pa.Array, spans: pa.Array) -> pa.Array:
    raw, at = byte_view(texts)
    cuts, cut_at = byte_view(spans)
    removed, pieces, digests = [], [], []
    for i in range(len(texts)):
        text, pairs = raw[at[i] : at[i + 1]], cuts[cut_at[i] : cut_at[i + 1]].view(np.int64).reshape(-1, 2)
        digest, done = hashlib.sha256(), 0
        for a, b in pairs.tolist():
            digest.update(text[done:a].tobytes())
            done = b
        digest.update(text[done:].tobytes())
        removed.append(int((pairs[:, 1] - pairs[:, 0]).sum()))
        pieces.append(len(pairs))
        digests.append(digest.hexdigest())
    return pa.StructArray.from_arrays([pa.array(np.diff(at), pa.int64()), pa.array(removed, pa.int64()), pa.array(pieces, pa.int64()), pa.array(digests, pa.string())], ["n_bytes", "n_removed", "n_spans", "kept_sha256"])


def kept_text(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """The bytes that stay, as text; a character of which only a part stays is replaced (U+FFFD)."""
    raw, at = byte_view(texts)
    cuts, cut_at = byte_view(spans)
    out = []
    for i in range(len(texts)):
        text, done, kept = raw[at[i] : at[i + 1]], 0, []
        for a, b in cuts[cut_at[i] : cut_at[i + 1]].view(np.int64).reshape(-1, 2).tolist():
            kept.append(text[done:a].tobytes())
            done = b
        out.append((b"".join(kept) + text[done:].tobytes()).decode("utf-8", "replace"))
    return pa.array(out, pa.string())


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, spans (binary: 64-bit begin, end pairs) and kept_sha256 of the bytes that stay.

    Texts are UTF-8 bytes, null being empty. A byte goes when a LENGTH-byte string that covers it also starts in a row with a
    smaller id; strings are judged on the input, and matches never cross rows. Rows repeated with one id remove nothing from
    each other. A row without an id comes after all others. Texts shorter than LENGTH keep everything. Input columns named like
    an output column are replaced. An empty table gives none.

    Rows with equal texts are one string to begin with: those after the least id go whole. `kept_text` gives the text.
    """
    small_batches(docs.sparkSession)
    rows = without(docs, *OUT)
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))
    keyed = rows.withColumns({"__id": order, "__hash": F.xxhash64(order, text_of(text_col))})
    slim = cut(keyed.select("__id", "__hash", F.sha2(text_of(text_col).cast("binary"), 256).alias("sha"), F.octet_length(text_of(text_col)).cast("long").alias("n")))
    n_rows, total = slim.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    slim = narrow(slim, n_rows)
    least = slim.where(F.col("n") >= LENGTH).groupBy("sha").agg(F.min("__id").alias("least"), F.count("*").alias("rows")).where("rows > 1")
    copies = slim.join(cut(narrow(least, n_rows)), "sha").where(F.col("__id") > F.col("least"))
    size = F.concat(*[F.lpad(F.hex(F.shiftright("n", 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(8)])
    whole = F.unhex(F.concat(F.lit("0" * 16), size))  # 0 and n, as 64-bit words
    copies = cut(narrow(copies.select("__id", "__hash", whole.alias("spans")), n_rows)).dropDuplicates(["__id", "__hash"])
    both = F.xxhash64("__id", "__hash")

    texts = keyed.select("__id", "__hash", F.col(text_col).alias("text"))
    marked = texts.withColumn("__maybe", possibly(copies.select("__id", "__hash"), both))
    first = marked.where("NOT __maybe").drop("__maybe").unionByName(marked.where("__maybe").drop("__maybe").join(copies.select("__id", "__hash"), ["__id", "__hash"], "left_anti"))
    spans = repeated_spans(first, total).toDF("__id", "__hash", "spans").unionByName(copies)
    spans = cut(narrow(spans, n_rows))

    marked = keyed.withColumn("__maybe", possibly(spans.select("__id", "__hash"), both))
    met = marked.where("__maybe").join(spans, ["__id", "__hash"], "left")
    out = marked.where("NOT __maybe").withColumn("spans", F.lit(None).cast("binary")).unionByName(met)
    out = out.withColumn("spans", F.coalesce("spans", F.lit(b"")))
    out = out.withColumn("__r", arrow(_removal, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")(F.col(text_col), F.col("spans")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in OUT], "__r.n_bytes", "__r.n_removed", "__r.n_spans", "spans", "__r.kept_sha256")
