"""Words of byte texts, over whole Arrow batches at a time.

A word is a maximal run of bytes that are not a space or one of the control characters 9 to 13, that is
``[^\\x20\\x09-\\x0D]+``; bytes of multi-byte characters are never among these.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from tensorloom.llm.common import byte_view

_BREAK = np.zeros(256, bool)
_BREAK[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each row (offsets `at`) the number of its first word, with the total last."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    inside = ~_BREAK[raw]
    begins, ends = inside.copy(), inside.copy()
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    begins[inner] = inside[inner]  # a word never goes on into the next row
    ends[inner - 1] = inside[inner - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, at)


def count_words(texts: pa.Array) -> pa.Array:
    """Words of each text; null counts as empty."""
    raw, at = byte_view(texts)
    counts = [np.diff(word_bounds(raw[at[a] : at[b]], at[a : b + 1] - at[a])[2]) for a, b in pieces_of(at)]
    return pa.array(np.concatenate([np.zeros(0, np.int64), *counts]), pa.int64())


_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
PIECE = 1 << 20  # bytes of rows that are hashed at once; a longer row is hashed alone
LONG = 64  # bytes of a word


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, base in (("up", _STEP), ("down", _BACK)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: differences of one running polynomial over all bytes, each shifted back to its word.

    Words of over LONG bytes are hashed by BLAKE2b, as long ones can be made so that their polynomials are equal.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    out = mixed((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    for i in np.flatnonzero(stops - starts > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : stops[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def pieces_of(at: np.ndarray, most: int = PIECE) -> list[tuple[int, int]]:
    """Runs of rows [a, b) of at most `most` bytes together, or of one longer row."""
    out, a = [], 0
    while a < len(at) - 1:
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1)
        out.append((a, b))
        a = b
    return out


_PLACES = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(raw: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """Each row's distinct `width`-word shingles as sorted hashes; rows of fewer words have their sequence as the only one."""
    out: list[np.ndarray] = []
    none = np.zeros(0, np.uint64)
    for a, b in pieces_of(at):
        some, offsets = raw[at[a] : at[b]], at[a : b + 1] - at[a]
        starts, stops, first = word_bounds(some, offsets)
        word = word_hashes(some, starts, stops)
        n = len(word) - width + 1
        whole = none
        if n > 0:
            whole = np.zeros(n, np.uint64)
            for k in range(width):
                whole += word[k : k + n] * _PLACES[k]
            whole = mixed(whole)
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if hi - lo >= width:
                out.append(np.unique(whole[lo : hi - width + 1]))
            elif hi > lo:
                n_words = hi - lo  # hashed too, so that no short sequence is taken for a shingle
                short = (word[lo:hi] * _PLACES[:n_words]).sum(keepdims=True, dtype=np.uint64) + _PLACES[63 - n_words : 64 - n_words]
                out.append(mixed(short))
            else:
                out.append(none)
    return out
