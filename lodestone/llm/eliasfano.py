"""Elias-Fano sequences over flat arrays, queried for whole arrays of arguments at once.

A monotone sequence of n values below u keeps each value's low ``l`` bits packed
and its high part in unary in a bit vector of about 2n bits; counts of ones
before each 64-bit word serve selection of the i-th one or zero.
"""

from __future__ import annotations

import numpy as np

from .packed import pack


def _pack_wide(values: np.ndarray, width: int) -> np.ndarray:
    """Little-end packed bytes of uint64 values, padded for 8-byte reads."""
    if not width or not len(values):
        return np.zeros(8, np.uint8)
    if width <= 32:
        raw = pack(values.astype(np.uint32), width)
    else:
        bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, count=width, bitorder="little")
        raw = np.packbits(bits.reshape(-1), bitorder="little").tobytes()
    return np.frombuffer(raw + bytes(8 + -len(raw) % 8), np.uint8)


def encode(values: np.ndarray, universe: int) -> list[np.ndarray]:
    """[header (n, l), low bytes, high words, ones before each word] for ascending uint64 values below ``universe``."""
    n = len(values)
    # Low parts are read as 64-bit words from any byte, which leaves 57 bits.
    width = min(57, max(0, (max(1, universe) // max(1, n)).bit_length() - 1))
    values = values.astype(np.uint64)
    low = _pack_wide(values & np.uint64((1 << width) - 1), width)
    high = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
    size = (int(universe) >> width) + n + 1
    bits = np.zeros(-(-size // 64) * 64, np.uint8)
    bits[high] = 1
    words = np.packbits(bits, bitorder="little").view("<u8")
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
    return [np.array([n, width], np.int64), low, words, before]


_SELECT = [(np.uint64(s), np.uint64((1 << s) - 1)) for s in (32, 16, 8, 4, 2, 1)]


def _select_in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Position of the rank-th (from 0) one of each word."""
    word, rank, at = word.copy(), rank.astype(np.int64), np.zeros(len(word), np.int64)
    for shift, mask in _SELECT:
        ones = np.bitwise_count(word & mask).astype(np.int64)
        go = rank >= ones
        rank -= ones * go
        word >>= shift * go.astype(np.uint64)
        at += int(shift) * go
    return at


class EliasFano:
    def __init__(self, header: np.ndarray, low: np.ndarray, words: np.ndarray, before: np.ndarray) -> None:
        self.n, self.width = int(header[0]), int(header[1])
        self.words, self.before = words, before
        self.zeros = np.arange(len(before), dtype=np.int64) * 64 - before
        self.lanes = np.lib.stride_tricks.as_strided(low[:8].view("<u8"), (len(low) - 7,), (1,))
        self.mask = np.uint64((1 << self.width) - 1)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        bit = i * self.width
        return (self.lanes[bit >> 3] >> (bit & 7).astype(np.uint64)) & self.mask

    def _select1(self, i: np.ndarray) -> np.ndarray:
        w = np.searchsorted(self.before, i, "right") - 1
        return w * 64 + _select_in_word(self.words[w], i - self.before[w])

    def _select0(self, i: np.ndarray) -> np.ndarray:
        w = np.searchsorted(self.zeros, i, "right") - 1
        return w * 64 + _select_in_word(~self.words[w], i - self.zeros[w])

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at positions ``i``."""
        if not len(i):
            return np.zeros(0, np.uint64)
        high = (self._select1(i) - i).astype(np.uint64)
        return high << np.uint64(self.width) | self._low(i)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position of the first value that isn't below x, whether it equals x); x within the universe."""
        if not self.n or not len(x):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        high = (x >> np.uint64(self.width)).astype(np.int64)
        want = x & self.mask
        first = np.zeros(len(x), np.int64)
        later = np.flatnonzero(high > 0)
        first[later] = self._select0(high[later] - 1) + 1 - high[later]
        end = self._select0(high) - high
        lo, hi = first, end.copy()
        active = np.flatnonzero(lo < hi)
        while len(active):
            mid = (lo[active] + hi[active]) >> 1
            less = self._low(mid) < want[active]
            lo[active] = np.where(less, mid + 1, lo[active])
            hi[active] = np.where(less, hi[active], mid)
            active = active[lo[active] < hi[active]]
        hit = lo < end
        at = np.flatnonzero(hit)
        hit[at] = self._low(lo[at]) == want[at]
        return lo, hit
