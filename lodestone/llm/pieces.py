"""Encoding by distinct pieces: each piece of text between white space is encoded once by a worker.

For vocabularies that drop white space, the ids of a text are those of its
pieces end to end. Known pieces are found by a 64-bit hash and then compared byte
by byte; their ids lie in one array, and a block of texts is put together by one
gather. A block in which two pieces share a hash is encoded by their texts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

from .words import Block, Words, hashes, words

#: Pieces that a worker keeps, at most, and their bytes.
MAX_PIECES = 500_000
MAX_BYTES = 32 << 20
#: Pieces are compared eight bytes at a time, all at once; what is left of long ones after so many steps, one by one.
LANES = 8


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number."""
    return np.lib.stride_tricks.as_strided(data[:8].view("<u8"), (len(data) - 7,), (1,))


def _equal(left: np.ndarray, left_start: np.ndarray, right: np.ndarray, right_start: np.ndarray, size: np.ndarray) -> bool:
    """Whether the pieces of ``size`` bytes at both starts are equal, all of them; both arrays have eight bytes to spare."""
    x, y = _lanes(left), _lanes(right)
    a, b, n = left_start, right_start, size
    for _ in range(LANES):
        differ = (x[a] ^ y[b]) << (64 - 8 * np.minimum(n, 8)).astype(np.uint64)
        if differ.any():
            return False
        more = np.flatnonzero(n > 8)
        if not len(more):
            return True
        a, b, n = a[more] + 8, b[more] + 8, n[more] - 8
    return all(np.array_equal(left[i : i + k], right[j : j + k]) for i, j, k in zip(a.tolist(), b.tolist(), n.tolist()))


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return data[np.repeat(start, size) + within]


def _room(array: np.ndarray, used: int, more: int) -> np.ndarray:
    """The array, longer if ``more`` values don't fit behind those in use."""
    while used + more + 8 > len(array):
        array = np.concatenate([array, np.zeros(len(array), array.dtype)])
    return array


class PieceMemo:
    """``learn`` gives the ids, as little-endian uint32 bytes, of each of a list of distinct pieces."""

    def __init__(self, learn: Callable[[list[str]], list[bytes]], max_pieces: int = MAX_PIECES) -> None:
        self.learn, self.max_pieces = learn, max_pieces
        self.clear()

    def clear(self) -> None:
        # Each level: ascending keys, first byte, bytes, first id, ids. New pieces go to the
        # small level, which is merged into the large one now and then.
        self.levels = [self._empty(), self._empty()]
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.raw, self.raw_used = np.zeros(1 << 16, np.uint8), 0

    @staticmethod
    def _empty() -> tuple[np.ndarray, ...]:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def __len__(self) -> int:
        return sum(len(level[0]) for level in self.levels)

    @staticmethod
    def _merge(level: tuple[np.ndarray, ...], more: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        at = np.searchsorted(level[0], more[0])
        return tuple(np.insert(a, at, b) for a, b in zip(level, more))

    def _find(self, keys: np.ndarray, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(known, first id, ids) of the pieces of ``data`` with ascending keys; None if a known key has other bytes."""
        known, start, size = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for level in self.levels:
            if len(level[0]):
                at = np.minimum(np.searchsorted(level[0], keys), len(level[0]) - 1)
                hit = np.flatnonzero((level[0][at] == keys) & ~known)
                of = at[hit]
                if (level[2][of] != length[hit]).any() or not _equal(self.raw, level[1][of], data, begin[hit], length[hit]):
                    return None
                known[hit], start[hit], size[hit] = True, level[3][of], level[4][of]
        return known, start, size

    def _add(self, keys: np.ndarray, raw: np.ndarray, length: np.ndarray, encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Keep new pieces, whose bytes lie end to end; (first id, ids) of each."""
        new = np.frombuffer(b"".join(encoded), "<u4")
        self.ids, self.raw = _room(self.ids, self.used, len(new)), _room(self.raw, self.raw_used, len(raw))
        self.ids[self.used : self.used + len(new)] = new
        self.raw[self.raw_used : self.raw_used + len(raw)] = raw
        size = np.fromiter(map(len, encoded), np.int32, len(encoded)) // 4
        start = self.used + np.cumsum(size, dtype=np.int64) - size
        begin = self.raw_used + np.cumsum(length, dtype=np.int64) - length
        self.used += len(new)
        self.raw_used += len(raw)
        self.levels[1] = self._merge(self.levels[1], (keys, begin, length.astype(np.int32), start, size))
        if len(self.levels[1][0]) > max(1 << 16, len(self.levels[0][0]) // 8):
            self.levels = [self._merge(*self.levels), self._empty()]
        return start, size

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows end to end, ids of each row)."""
        w = words(block)
        if not len(w.start):
            return np.zeros(0, np.uint32), np.zeros(block.rows, np.int64)
        if len(self) > self.max_pieces or self.raw_used > MAX_BYTES:
            self.clear()
        codes, distinct = pd.factorize(hashes(block.data, w.start, w.end))
        by = np.argsort(distinct)
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        codes, distinct = rank[codes], distinct[by]
        one = np.empty(len(distinct), np.int64)  # a word of each distinct key
        one[codes] = np.arange(len(codes))
        length = w.end - w.start
        like = one[codes]
        data = np.concatenate([block.data, np.zeros(8, np.uint8)])
        if (length[like] != length).any() or not _equal(data, w.start, data, w.start[like], length):
            return self._plain(block, w)
        found = self._find(distinct, data, w.start[one], length[one])
        if found is None:
            return self._plain(block, w)
        known, start, size = found
        new = np.flatnonzero(~known)
        if len(new):
            flat, sizes = _gather(block.data, w.start[one[new]], length[one[new]]), length[one[new]]
            raw, ends = flat.tobytes(), np.cumsum(sizes).tolist()
            learned = self.learn([raw[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends], ends)])
            start[new], size[new] = self._add(distinct[new], flat, sizes, learned)
        size = size[codes]
        total = np.cumsum(size)
        place = np.repeat(start[codes] - (total - size), size)
        place += np.arange(len(place))
        per_row = np.diff(np.concatenate([[0], total])[np.concatenate([[0], np.cumsum(w.per_row)])])
        return self.ids[place], per_row

    def _plain(self, block: Block, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Two pieces share a hash: encode the block's pieces by their text."""
        raw = block.data.tobytes()
        pieces = [raw[a:b].decode("utf-8", "replace") for a, b in zip(w.start.tolist(), w.end.tolist())]
        distinct = list(dict.fromkeys(pieces))
        ids = dict(zip(distinct, self.learn(distinct)))
        encoded = [ids[p] for p in pieces]
        size = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        return np.frombuffer(b"".join(encoded), "<u4"), np.bincount(w.row, weights=size, minlength=block.rows).astype(np.int64)
