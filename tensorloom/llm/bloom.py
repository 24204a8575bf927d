"""Bloom filters over whole tables, made in slices by the executors and bounded in size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from tensorloom.llm.common import arrow, byte_view, released
from tensorloom.llm.words import mixed

SLICE_BITS = 20  # positions of one slice of the filter
MOST_BITS = 1 << 30  # of a filter: 128 MB, the most that is broadcast
FLUSH_ROWS = 1 << 20  # a task hands its notes on after so many rows

Words = Callable[[pa.Array], np.ndarray]


def filter_bits(n_rows: int, bits_per_row: int = 16, most_bits: int = MOST_BITS) -> int:
    """A power of two: bits_per_row for each row, but one slice at least and most_bits at most."""
    return min(most_bits, max(1 << SLICE_BITS, 1 << (max(1, n_rows * bits_per_row) - 1).bit_length()))


def words_of_hex(digests: pa.Array) -> np.ndarray:
    """Two 64-bit words of each hexadecimal digest of 256 bits."""
    raw, at = byte_view(digests)
    if len(at) < 2:
        return np.zeros((0, 2), np.uint64)

    return np.frombuffer(bytes.fromhex(raw.tobytes().decode()), ">u8").reshape(-1, 4)[:, :2].astype(np.uint64)


def words_of_hash(hashes: pa.Array) -> np.ndarray:
    """Two 64-bit words of each 64-bit hash."""
    first = np.asarray(hashes.to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint64)
    return np.stack([mixed(first), mixed(first ^ np.uint64(0x5851F42D4C957F2D))], axis=1)


def positions(words: np.ndarray, bits: int) -> np.ndarray:
    """Two different filter positions of each row."""
    at = words & np.uint64(bits - 1)
    at[at[:, 0] == at[:, 1], 1] ^= np.uint64(1)
    return at


def holds(shared: np.ndarray, words: np.ndarray, bits: int) -> np.ndarray:
    at = positions(words, bits)
    flags = (shared[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & np.uint8(1)
    return flags.all(axis=1)


def _noted(held: list[np.ndarray]) -> pa.RecordBatch:
    at, times = np.unique(np.concatenate(held), return_counts=True)
    part, low = (at >> np.uint64(SLICE_BITS)).astype(np.int64), (at & np.uint64((1 << SLICE_BITS) - 1)).astype(np.uint32)
    slices = np.unique(part)
    cuts = np.searchsorted(part, np.append(slices, np.iinfo(np.int64).max))
    spans = list(zip(cuts[:-1], cuts[1:], strict=True))
    return pa.record_batch({
        "slice": pa.array(slices.astype(np.int32)),
        "met": pa.array([low[a:b].tobytes() for a, b in spans], pa.binary()),
        "again": pa.array([low[a:b][times[a:b] > 1].tobytes() for a, b in spans], pa.binary()),
    })


def shared_positions(keys: DataFrame, bits: int, words: Words, times: int = 2) -> np.ndarray:
    """The filter of a one-column table, as packed bits: set where `times` (1 or 2) rows or more fall."""

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            at = positions(words(batch.column(0)), bits)
            held.append(at.ravel())
            rows += len(at)
            if rows >= FLUSH_ROWS:
                yield _noted(held)
                held, rows = [], 0
        if rows:
            yield _noted(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = {}, {}
        for batch in batches:
            for part, met, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part not in once:
                    once[part], twice[part] = np.zeros(1 << SLICE_BITS, bool), np.zeros(1 << SLICE_BITS, bool)
                at = np.frombuffer(met, np.uint32)
                twice[part][at[once[part][at]]] = True
                twice[part][np.frombuffer(again, np.uint32)] = True
                once[part][at] = True
        for part, flags in (twice if times > 1 else once).items():
            yield pa.record_batch({"slice": pa.array([part], pa.int32()), "bits": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    slices = max(1, bits >> SLICE_BITS)
    notes = keys.mapInArrow(released(note), "slice int, met binary, again binary").repartition(min(slices, 64), "slice").coalesce(min(slices, 64))
    found = np.zeros(max(1, (slices << SLICE_BITS) // 8), np.uint8)
    for row in notes.mapInArrow(released(merge), "slice int, bits binary").toLocalIterator():  # bits / 8 bytes in all: the filter
        found[row["slice"] << (SLICE_BITS - 3) :][: 1 << (SLICE_BITS - 3)] = np.frombuffer(row["bits"], np.uint8)
    return found


def key_filter(keys: DataFrame, n_keys: int) -> Callable[[pa.Array], np.ndarray]:
    """A test for use on executors: false for 64-bit hashes that are not in the one-column table.

    The filter has 16 bits a key and MOST_BITS at most; beyond, it only lets more through.
    """
    bits = filter_bits(n_keys)
    held = keys.sparkSession.sparkContext.broadcast(shared_positions(keys, bits, words_of_hash, times=1))
    return lambda hashes: holds(held.value, words_of_hash(hashes), bits)


def possibly(keys: DataFrame, hashed: Column) -> Column:
    """False where the 64-bit hash `hashed` of a row is not that of a row of `keys`, which has the columns it reads."""
    test = key_filter(keys.select(hashed), keys.count())

    def found(hashes: pa.Array) -> pa.Array:
        return pa.array(test(hashes))

    return arrow(found, "boolean")(hashed)
