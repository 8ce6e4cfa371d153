"""Vectorised reading of Arrow string columns: bytes, words and word hashes in numpy.

A column is read as one UTF-8 buffer with row offsets. Words are the runs of
bytes that a 256-entry table marks; a word's hash is a polynomial over its
bytes modulo 2**64 (from one running sum over the buffer), then mixed, or XXH64
if it is longer than ``LONG``. Rows are
taken in blocks of a bounded number of bytes; a text longer than that is a
block by itself, always whole.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

BLOCK_BYTES = 1 << 20
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
_BASE = 0x9E3779B97F4A7C15
#: Polynomials modulo a power of two collide by design on some long words, so words of more bytes have an XXH64.
LONG = 64


def _powers(n: int) -> np.ndarray:
    out, done = np.ones(n, np.uint64), 1
    while done < n:
        m = min(done, n - done)
        out[done : done + m] = out[:m] * np.uint64(pow(_BASE, done, 2**64))
        done += m
    return out


class _Tables:
    """Powers of the hash's base, grown on demand."""

    known = np.zeros(0, np.uint64)

    @classmethod
    def get(cls, n: int) -> np.ndarray:
        if len(cls.known) < n:
            cls.known = _powers(n + 65536)
        return cls.known


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The bytes of words `[^\x20\x09-\x0D]+`.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Letters, as far as bytes tell: A-Z, a-z and all of the characters beyond ASCII.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
LETTER[128:] = True


def release() -> None:
    """Give memory that is no longer used back to the system: several workers share an executor's."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


class Block(NamedTuple):
    lo: int  # first row
    data: np.ndarray  # uint8, all rows' bytes end to end
    offsets: np.ndarray  # int64, rows + 1, into data

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def binary_column(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.cast(pa.large_string()).cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col


def blocks(col: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of whole rows; a null is an empty text."""
    col = binary_column(col)
    if col.null_count:
        col = col.fill_null(b"")
    n = len(col)
    if not n:
        return
    off = np.frombuffer(col.buffers()[1], np.int64, n + 1 + col.offset)[col.offset :]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + block_bytes, "right")) - 1)
        yield Block(lo, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi
    release()


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray  # of the block
    per_row: np.ndarray  # words of each row


def words(block: Block, table: np.ndarray = NON_SPACE) -> Words:
    inside = table[block.data]
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z, z, z, np.zeros(block.rows, np.int64))
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    edges = block.offsets[1:-1]
    edges = edges[edges < n]
    before[edges] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[edges[edges > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    per_row = np.diff(np.searchsorted(start, block.offsets, "left"))
    return Words(start, end, np.repeat(np.arange(block.rows), per_row), per_row)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; equal bytes have equal hashes."""
    n = len(data)
    power = _Tables.get(n + 1)
    total = np.zeros(n + 1, np.uint64)
    # Byte j has weight P**(n - j); the word's first byte then gets weight one by P**start and P**-n.
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[n:0:-1], out=total[1:])
    out = mix((total[end] - total[start]) * power[start] * np.uint64(pow(_BASE, -n, 2**64)))
    long = np.flatnonzero(end - start > LONG)
    if len(long):
        ends = zip(start[long].tolist(), end[long].tolist())
        out[long] = np.fromiter((xxhash.xxh64_intdigest(data[a:b].tobytes()) for a, b in ends), np.uint64, len(long))
    return out


def hash_of(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(hashes(LOWER[data], np.array([0]), np.array([len(data)]))[0])
