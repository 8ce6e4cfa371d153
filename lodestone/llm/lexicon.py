"""A minimal acyclic transducer from words to lists of token ids, in one memory-mapped file.

Words are added in byte order; whenever a branch is finished, its states are
replaced by equal ones that exist already, so common suffixes are shared. Each
transition carries the number of words that sort before those behind it, so
the sum along a word's path is the word's rank, and the rank finds its ids in a
flat output array. Look-ups walk all words of a batch in step, one byte at a
time, by binary search over the sorted transitions.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np

MAGIC = b"LDSTMAT1"


def compile_words(entries: dict[bytes, Sequence[int]]) -> bytes:
    """The file's bytes for distinct non-empty words and their ids."""
    words = sorted(entries)
    children: list[dict[int, int]] = [{}]
    final: list[bool] = [False]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []  # parent, label, child; not yet shared
    free: list[int] = []

    def close(keep: int) -> None:
        while len(path) > keep:
            parent, label, child = path.pop()
            key = (final[child], tuple(children[child].items()))
            known = register.get(key)
            if known is None:
                register[key] = child
            else:
                children[parent][label] = known
                free.append(child)

    before = b""
    for word in words:
        if not word:
            raise ValueError("a word must have a byte")
        common = 0
        for a, b in zip(before, word):
            if a != b:
                break
            common += 1
        close(common)
        state = path[-1][2] if path else 0
        for label in word[common:]:
            if free:
                child = free.pop()
                children[child], final[child] = {}, False
            else:
                child = len(children)
                children.append({})
                final.append(False)
            children[state][label] = child
            path.append((state, label, child))
            state = child
        final[state] = True
        before = word
    close(0)

    # Number the states that are reached, children after parents, and count words below each.
    order, seen, stack = [], {0}, [(0, iter(list(children[0].values())))]
    while stack:
        state, rest = stack[-1]
        for child in rest:
            if child not in seen:
                seen.add(child)
                stack.append((child, iter(list(children[child].values()))))
                break
        else:
            order.append(state)
            stack.pop()
    below = {}
    for state in order:
        below[state] = int(final[state]) + sum(below[c] for c in children[state].values())
    number = {state: i for i, state in enumerate(reversed(order))}
    keys, targets, ranks = [], [], []
    ends = np.zeros(len(order), np.uint8)
    for state, i in number.items():
        ends[i] = final[state]
        rank = int(final[state])
        for label, child in children[state].items():
            keys.append(i << 8 | label)
            targets.append(number[child])
            ranks.append(rank)
            rank += below[child]
    by = np.argsort(np.array(keys, np.int64), kind="stable") if keys else np.zeros(0, np.int64)
    offsets = np.cumsum([0, *(len(entries[w]) for w in words)], dtype=np.int64)
    ids = np.array([i for w in words for i in entries[w]], np.uint32)
    parts = [
        np.array(keys, np.int64)[by],
        np.array(targets, np.int32)[by],
        np.array(ranks, np.int32)[by],
        ends,
        offsets,
        ids,
    ]
    head, body = MAGIC + struct.pack("<4q", len(keys), len(order), len(words), len(ids)), b""
    for part in parts:
        raw = part.tobytes()
        body += raw + bytes(-len(raw) % 8)
    return head + body


class Lexicon:
    """Read side; ``path`` is memory-mapped."""

    def __init__(self, path: str) -> None:
        raw = np.memmap(path, np.uint8, "r")
        if bytes(raw[:8]) != MAGIC:
            raise ValueError(f"{path} is no lexicon")
        n, states, words, ids = struct.unpack("<4q", bytes(raw[8:40]))
        at = 40

        def take(kind: type, count: int) -> np.ndarray:
            nonlocal at
            size = count * np.dtype(kind).itemsize
            out = raw[at : at + size].view(kind)
            at += size + -size % 8
            return out

        self.keys, self.targets, self.ranks = take(np.int64, n), take(np.int32, n), take(np.int32, n)
        self.ends, self.offsets, self.ids = take(np.uint8, states), take(np.int64, words + 1), take(np.uint32, ids)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def states(self) -> int:
        return len(self.ends)

    def rank(self, words: list[bytes]) -> np.ndarray:
        """Each word's rank in the lexicon, or -1."""
        n = len(words)
        rank = np.zeros(n, np.int64)
        if not n or not len(self.keys):
            return np.full(n, -1, np.int64)
        size = np.fromiter(map(len, words), np.int64, n)
        start = np.cumsum(size) - size
        data = np.frombuffer(b"".join(words), np.uint8)
        state = np.zeros(n, np.int64)
        alive = np.flatnonzero(size > 0)
        rank[size == 0] = -1
        step = 0
        while len(alive):
            key = state[alive] << 8 | data[start[alive] + step]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == key
            rank[alive[~hit]] = -1
            alive, at = alive[hit], at[hit]
            rank[alive] += self.ranks[at]
            state[alive] = self.targets[at]
            step += 1
            done = size[alive] == step
            over = alive[done]
            rank[over[self.ends[state[over]] == 0]] = -1
            alive = alive[~done]
        return rank

    def output(self, rank: int) -> np.ndarray:
        return self.ids[self.offsets[rank] : self.offsets[rank + 1]]
