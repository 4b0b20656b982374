"""Elias-Fano coding of monotone sequences, with select and successor search.

A sequence of n numbers up to u takes about 2 + log2(u / n) bits each: the low
bits stand in a packed array, the high bits in a unary-coded bit vector whose
i-th set bit gives the i-th number. Everything is read straight from one buffer,
so a memory-mapped file serves as well as bytes. Opening a sequence counts the set
bits of every block of 512 and keeps two counts a block (an eighth of the high part);
select counts on from there in the packed bits, and no table of positions is made.
"""

from __future__ import annotations

import struct

import numpy as np

HEAD = "<QQB7x"  # numbers, bytes of the high part, low bits
HEAD_SIZE = struct.calcsize(HEAD)
BLOCK_WORDS = 8  # 64-bit words whose set bits are counted together
BLOCK_BITS = 64 * BLOCK_WORDS
RUN = 1 << 14  # queries answered side by side

# where the k-th set bit of a byte stands
BIT_PLACES = np.zeros((256, 8), dtype=np.int64)
for _byte in range(256):
    _places = [b for b in range(8) if _byte >> b & 1]
    BIT_PLACES[_byte, : len(_places)] = _places


def encode(values: np.ndarray) -> bytes:
    """Code a non-decreasing array of non-negative integers."""
    values = np.asarray(values, dtype=np.uint64)
    n = len(values)
    if n and bool((values[1:] < values[:-1]).any()):
        raise ValueError("Elias-Fano needs a non-decreasing sequence")
    top = int(values[-1]) if n else 0
    width = max(0, (top // n).bit_length() - 1) if n else 0
    low = (values & np.uint64((1 << width) - 1)).astype(np.uint64)
    bits = ((low[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    packed = np.packbits(bits.ravel(), bitorder="little").tobytes()
    places = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
    high = np.zeros((int(places[-1]) + 1) if n else 0, dtype=np.uint8)
    high[places] = 1
    packed_high = np.packbits(high, bitorder="little").tobytes()
    return struct.pack(HEAD, n, len(packed_high), width) + packed_high + packed + bytes(8)


class EliasFano:
    """A coded sequence over a buffer; ``size`` is the bytes it takes there."""

    def __init__(self, buffer, offset: int = 0):
        self.n, high_bytes, self.width = struct.unpack_from(HEAD, buffer, offset)
        start = offset + HEAD_SIZE
        low_bytes = (self.n * self.width + 7) // 8
        self.size = HEAD_SIZE + high_bytes + low_bytes + 8
        # whole words: the last may reach into what follows, always behind the n-th set bit
        self.words = np.frombuffer(buffer, "<u8", (high_bytes + 7) // 8, start)
        self.low = np.frombuffer(buffer, np.uint8, low_bytes + 8, start + high_bytes)
        self.ones, self.zeros = self._samples()
        self.top = int(self._place(np.array([self.n - 1]), True)[0]) - (self.n - 1) if self.n else -1

    def _samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Set and unset bits before each block."""
        starts = np.arange(0, len(self.words), BLOCK_WORDS)
        kind = np.uint32 if 64 * len(self.words) < 1 << 32 else np.uint64
        ones = np.zeros(len(starts), dtype=kind)
        held = 0
        step = RUN * BLOCK_WORDS
        for at in range(0, len(self.words), step):
            counts = np.bitwise_count(self.words[at : at + step])
            sums = np.add.reduceat(counts, np.arange(0, len(counts), BLOCK_WORDS), dtype=np.int64)
            begin = at // BLOCK_WORDS
            upto = np.cumsum(sums)
            ones[begin : begin + len(sums)] = held + upto - sums
            held += int(upto[-1])
        return ones, (starts * 64 - ones.astype(np.int64)).astype(kind)

    def _place(self, index: np.ndarray, ones: bool) -> np.ndarray:
        """Where the set (or unset) bits of the given numbers stand."""
        before = self.ones if ones else self.zeros
        out = np.empty(len(index), dtype=np.int64)
        for at in range(0, len(index), RUN):
            wanted = index[at : at + RUN]
            row = np.arange(len(wanted))
            block = np.searchsorted(before, wanted.astype(before.dtype), side="right") - 1
            left = wanted - before[block].astype(np.int64)
            places = np.minimum(block[:, None] * BLOCK_WORDS + np.arange(BLOCK_WORDS), len(self.words) - 1)
            words = self.words[places] if ones else ~self.words[places]
            word, left = _reached(words, left)
            parts = np.ascontiguousarray(words[row, word]).view(np.uint8).reshape(-1, 8)
            byte, left = _reached(parts, left)
            out[at : at + RUN] = block * BLOCK_BITS + word * 64 + byte * 8 + BIT_PLACES[parts[row, byte], left]
        return out

    def select(self, index: np.ndarray) -> np.ndarray:
        """The numbers at the given places."""
        index = np.asarray(index, dtype=np.int64)
        high = (self._place(index, True) - index).astype(np.uint64)
        return (high << np.uint64(self.width)) | self._low(index)

    def _low(self, index: np.ndarray) -> np.ndarray:
        """The low bits of the numbers at the given places."""
        if not self.width:
            return np.zeros(len(index), dtype=np.uint64)
        bit = index * self.width
        byte, shift = bit >> 3, (bit & 7).astype(np.uint64)
        word = np.zeros(len(index), dtype=np.uint64)
        for k in range(8):
            word |= self.low[byte + k].astype(np.uint64) << np.uint64(8 * k)
        word >>= shift
        if self.width > 56:  # the number may reach into a ninth byte
            more = self.low[np.minimum(byte + 8, len(self.low) - 1)].astype(np.uint64)
            word |= np.where(shift > 0, more << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return word & np.uint64((1 << self.width) - 1)

    def runs(self, size: int = RUN):
        """All numbers in order, so many at a time."""
        for at in range(0, self.n, size):
            yield self.select(np.arange(at, min(at + size, self.n)))

    def all(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, dtype=np.uint64), *self.runs()])

    def successor(self, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Per query the first place in [lo, hi) whose number is not below ``wanted``.

        The unset bits bound the numbers that share the wanted high part; among
        them low parts alone are compared.
        """
        lo, hi = lo.astype(np.int64), hi.astype(np.int64)
        if not self.n:
            return lo.copy()
        wanted = wanted.astype(np.uint64)
        high = np.minimum(wanted >> np.uint64(self.width), np.uint64(self.top + 1)).astype(np.int64)
        low = wanted & np.uint64((1 << self.width) - 1)
        first = np.clip(self._up_to(high - 1), lo, hi)
        last = np.clip(self._up_to(high), lo, hi)
        while True:
            open_ = np.flatnonzero(first < last)
            if not len(open_):
                return first
            middle = (first[open_] + last[open_]) >> 1
            below = self._low(middle) < low[open_]
            first[open_[below]] = middle[below] + 1
            last[open_[~below]] = middle[~below]

    def _up_to(self, high: np.ndarray) -> np.ndarray:
        """How many numbers have at most this high part."""
        out = np.where(high < 0, 0, self.n)
        inner = np.flatnonzero((high >= 0) & (high < self.top))
        out[inner] = self._place(high[inner], False) - high[inner]
        return out


def _reached(parts: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the part in which set bit number ``left`` stands, and its number there."""
    upto = np.cumsum(np.bitwise_count(parts), axis=1, dtype=np.int64)
    part = (upto <= left[:, None]).sum(axis=1)
    row = np.arange(len(parts))
    return part, left - np.where(part > 0, upto[row, np.maximum(part - 1, 0)], 0)
