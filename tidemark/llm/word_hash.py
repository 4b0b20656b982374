"""Hashes of words and shingles for whole columns of texts, in numpy.

Words are told apart by their 64-bit hashes. The hash of a word is a polynomial
in its bytes, read off running sums over a stretch of text, so no Python object
is made per word. Two different words or shingles share a hash with a chance of
about 1 in 10^18 a pair.
"""

from __future__ import annotations

import numpy as np

BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
STRETCH = 1 << 20  # bytes of text looked at together; a longer text is a stretch of its own
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Splits texts at blanks after lower-casing A-Z."""

    def __init__(self):
        self.lower = np.arange(256, dtype=np.uint64)
        self.lower[65:91] += np.uint64(32)
        self.lower += np.uint64(1)
        self.solid = np.ones(256, dtype=bool)
        self.solid[list(BLANKS)] = False
        self.power = self.back = np.ones(0, dtype=np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.power) < n:
            self.power, self.back = np.full((2, n + 1), 1, dtype=np.uint64)
            self.power[1:], self.back[1:] = BASE, INVERSE
            self.power, self.back = np.cumprod(self.power), np.cumprod(self.back)
        return self.power, self.back

    def stretch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of texts lying end to end in ``data`` and where each text's words begin."""
        n = len(data)
        if not n:
            return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
        solid = self.solid[data]
        before = np.empty(n, dtype=bool)
        before[0], before[1:] = False, solid[:-1]
        before[offsets[:-1][offsets[:-1] < n]] = False
        starts = np.flatnonzero(solid & ~before)
        after = np.empty(n, dtype=bool)
        after[-1], after[:-1] = False, solid[1:]
        inner = offsets[1:-1]
        after[inner[inner > 0] - 1] = False
        ends = np.flatnonzero(solid & ~after) + 1
        power, back = self.powers(n)
        sums = np.empty(n + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(self.lower[data] * power[:n], out=sums[1:])
        hashes = mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
        return hashes, np.searchsorted(starts, offsets)

    def stretches(self, texts):
        """Over an Arrow string column: (first row, word hashes, begins of rows' words), a stretch at a time."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        _, raw, data = texts.buffers()
        offsets = np.frombuffer(raw, np.int64, len(texts) + 1, texts.offset * 8)
        data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        row = 0
        while row < len(texts):
            end = int(np.searchsorted(offsets, offsets[row] + STRETCH, "right")) - 1
            end = min(max(end, row + 1), len(texts))
            own = offsets[row : end + 1]
            hashes, begins = self.stretch(data[own[0] : own[-1]], own - own[0])
            yield row, hashes, begins
            row = end


def shingles(hashes: np.ndarray, begins: np.ndarray, size: int):
    """Yield each text's distinct shingle hashes, sorted; a shorter text is one shingle."""
    rolled = np.zeros(max(0, len(hashes) - size + 1), dtype=np.uint64)
    for k in range(size):
        rolled = mixed(rolled ^ hashes[k : k + len(rolled)], k)
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
        if b - a >= size:
            yield np.unique(rolled[a : b - size + 1])
        elif b > a:
            whole = np.zeros(1, dtype=np.uint64)
            for k in range(a, b):
                whole = mixed(whole ^ hashes[k : k + 1], k - a)
            yield mixed(whole, 1000 + b - a)
        else:
            yield np.zeros(0, dtype=np.uint64)
