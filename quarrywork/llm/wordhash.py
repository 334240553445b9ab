"""Words and word shingles of whole texts as 64-bit hashes, computed on Arrow's buffers.

A word's hash is a polynomial over random values of its bytes, taken from prefix sums, so all words
of a batch are hashed by a few array operations and no Python string is made.  White space is the
six ASCII characters; A-Z are lower-cased; all other bytes count as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
#: A random odd value for each byte, the same for both cases of a letter.
_VALUE = (_RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[_LOWER]
#: Bytes of text whose arrays are held at once (a longer text is one slice of its own).
SLICE = 1 << 19
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        if size <= 4 * SLICE:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) with about ``SLICE`` bytes each.

    Null rows must be empty strings before.
    """
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    a = 0
    while a < len(column):
        b = int(np.searchsorted(offsets, offsets[a] + SLICE, side="right")) - 1
        b = min(max(b, a + 1), len(column))
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first bytes and ends of all words, and the number of words before each text."""
    if not len(raw):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)  # a text begins here
    edge[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    with np.errstate(over="ignore"):
        sums = np.empty(len(raw) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_VALUE[raw] * _powers(_BASE, len(raw)), out=sums[1:])
        hashes = mix((sums[last] - sums[first]) * _powers(_INVERSE, len(raw))[first])
    return hashes, first, last, np.searchsorted(first, offsets)


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles.

    A text of fewer words has its whole sequence as its one shingle; without words, none.
    """
    rng = np.random.default_rng(77)
    keys = rng.integers(0, 1 << 63, 2 * size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for a, b, raw, offsets in slices(column):
        hashes, _, _, before = words(raw, offsets)
        with np.errstate(over="ignore"):
            n = max(0, len(hashes) - size + 1)
            grams = np.zeros(n, np.uint64)
            for j in range(size):
                grams += mix(hashes[j : j + n] + keys[j]) * keys[j]
            grams = mix(grams)
            for i in range(b - a):
                lo, hi = int(before[i]), int(before[i + 1])
                if hi - lo >= size:
                    yield np.unique(grams[lo : hi - size + 1])
                elif hi > lo:
                    part = hashes[lo:hi]
                    whole = (mix(part + keys[: hi - lo]) * keys[: hi - lo]).sum(dtype=np.uint64) + keys[size + hi - lo - 1]
                    yield mix(np.array([whole], np.uint64))
                else:
                    yield np.empty(0, np.uint64)
