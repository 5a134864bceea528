"""Words and word windows of whole batches of texts as numpy arrays.

A word is a maximal run of bytes other than 0x20 and 0x09 to 0x0D of the UTF-8 text, which is the same as
`[^\\x20\\x09-\\x0D]+` over code points. Words and windows are told apart by 64-bit hashes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII letters in lower case, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BYTE_CODE = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64)
RATE = 0x9E3779B97F4A7C15
INVERSE = pow(RATE, -1, 1 << 64)
#: One odd factor for each place in a window.
PLACE = np.random.default_rng(7).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(2)
def powers(base: int, size: int) -> np.ndarray:
    return np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, base, np.uint64), dtype=np.uint64)))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and the n + 1 places where texts begin and end; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a batch: `start`, `end` (byte places) and `first`, where text d has words first[d]:first[d + 1]."""

    def __init__(self, column: pa.Array, lower: bool):
        raw, self.offsets = text_bytes(column)
        self.data = LOWER[raw] if lower else raw
        space = IS_SPACE[self.data]
        n = len(space)
        before, after = np.ones(n, bool), np.ones(n, bool)
        if n:
            before[1:], after[:-1] = space[:-1], space[1:]
            edges = np.unique(self.offsets)
            before[edges[edges < n]] = True
            after[edges[edges > 0] - 1] = True
        self.space = space
        self.start = np.flatnonzero(~space & before)
        self.end = np.flatnonzero(~space & after) + 1
        self.first = np.searchsorted(self.start, self.offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        n = len(self.data)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = max(1 << 21, 1 << int(n).bit_length())
        sums = np.concatenate(([np.uint64(0)], np.cumsum(BYTE_CODE[self.data] * powers(RATE, size)[:n], dtype=np.uint64)))
        return mix((sums[self.end] - sums[self.start]) * powers(INVERSE, size)[self.start])

    def totals(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text are set in the mask."""
        sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the windows of k words that begin at each word; the last k - 1 windows run over the end."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += hashes[j : j + n] * PLACE[j]
    return mix(total)


def shingle_sets(column: pa.Array, k: int):
    """For each text the sorted distinct hashes of its k-word shingles, in lower case (A-Z).

    With 1 to k - 1 words, the whole sequence is the one shingle; without words or text, the set is empty.
    """
    words = Words(column, lower=True)
    hashes = words.hashes()
    wide = windows(hashes, k)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= k:
            yield np.unique(wide[a : b - k + 1])
        elif b > a:
            yield windows(hashes[a:b], b - a) + np.uint64(b - a)
        else:
            yield np.zeros(0, np.uint64)
