"""Structured RNA search: models from one structured sequence, substitution scores for single bases and pairs, scans and alignments.

A model is a tree over the query: pairs, single bases on the left or right, and
forks. The score of a node for the ``d`` symbols that end at place ``j`` is the
best over matching, deleting (``gap`` for each base) and inserting (``insert``
for each symbol on either side). A scan fills one table for each node, all ends
at once for each length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import align as A

BASES = "ACGU"
LOW = -1e9


class Scores:
    """``single[a, b]`` and ``pair[a, a', b, b']`` for query bases a (paired with a') and target bases b (and b')."""

    def __init__(self, single: np.ndarray, pair: np.ndarray, gap: float = -3.0, insert: float = -2.0) -> None:
        self.single, self.pair, self.gap, self.insert = single, pair, gap, insert


def simple_scores(match: float = 2.0, mismatch: float = -1.0, paired: float = 3.0, unpaired: float = -3.0, gap: float = -3.0, insert: float = -2.0) -> Scores:
    """Equal single bases match; a target pair is good if its bases can pair (with a bonus where it is the query's own pair)."""
    single = np.full((4, 4), mismatch)
    np.fill_diagonal(single, match)
    can = np.zeros((4, 4), bool)
    for x, y in ("AU", "CG", "GU"):
        can[BASES.index(x), BASES.index(y)] = can[BASES.index(y), BASES.index(x)] = True
    pair = np.where(can[None, None], paired, unpaired) + np.zeros((4, 4, 4, 4))
    for a in range(4):
        for b in range(4):
            pair[a, b, a, b] += 1.0 if can[a, b] else 0.0
    return Scores(single, pair, gap, insert)


def codes(seq: str) -> np.ndarray:
    """Places in ``BASES``; T is U, other symbols are 4."""
    table = np.full(256, 4)
    for k, c in enumerate(BASES):
        table[ord(c)] = table[ord(c.lower())] = k
    table[ord("T")] = table[ord("t")] = 3
    return table[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]


def pair_table(structure: str) -> list[int]:
    """The partner of each place, -1 for single ones."""
    out, stack = [-1] * len(structure), []
    for k, c in enumerate(structure):
        if c in "<([{":
            stack.append(k)
        elif c in ">)]}":
            if not stack:
                raise ValueError("unbalanced structure")
            i = stack.pop()
            out[i], out[k] = k, i
    if stack:
        raise ValueError("unbalanced structure")
    return out


class Model:
    """Nodes with children before parents: (kind, left place, right place, children)."""

    def __init__(self, seq: str, structure: str, scores: Scores) -> None:
        if len(seq) != len(structure):
            raise ValueError("sequence and structure differ in length")
        self.query, self.scores, partner = codes(seq), scores, pair_table(structure)
        self.nodes: list[tuple[str, int, int, tuple[int, ...]]] = []

        def build(i: int, j: int) -> int:
            if i > j:
                node = ("end", -1, -1, ())
            elif partner[i] == j:
                node = ("pair", i, j, (build(i + 1, j - 1),))
            elif partner[i] < 0:
                node = ("left", i, -1, (build(i + 1, j),))
            elif partner[j] < 0:
                node = ("right", -1, j, (build(i, j - 1),))
            else:
                node = ("fork", -1, -1, (build(i, partner[i]), build(partner[i] + 1, j)))
            self.nodes.append(node)
            return len(self.nodes) - 1

        build(0, len(seq) - 1)

    def _known(self, table: np.ndarray, place: int, x: np.ndarray) -> np.ndarray:
        row = np.append(table[self.query[place]] if self.query[place] < 4 else np.zeros(4), 0.0)
        return row[x]

    def fill(self, x: np.ndarray, longest: int) -> list[np.ndarray]:
        """For each node, the scores [end, length] of the parts of ``x`` that end before ``end``."""
        n, s = len(x), self.scores
        x = x.astype(np.intp)
        out: list[np.ndarray] = []
        full = np.zeros((5, 5, 5, 5))
        full[:4, :4, :4, :4] = s.pair
        # Tables are kept [length, end], so that every step reads and writes whole rows; row d begins at end d.
        sides = [5 * x[: n + 1 - d] + x[d - 1 :] if 2 <= d <= n else None for d in range(longest + 1)]
        for kind, i, j, children in self.nodes:
            t = np.full((longest + 1, n + 1), LOW)
            child = [out[c] for c in children]
            left = self._known(s.single, i, x) if kind in ("left", "pair") else None
            right = self._known(s.single, j, x) if kind in ("right", "pair") else None
            both = full[self.query[i], self.query[j]].ravel() if kind == "pair" else None
            for d in range(min(longest, n) + 1):
                if kind == "end":
                    best = np.full(n + 1 - d, 0.0 if d == 0 else LOW)
                elif kind == "fork":
                    best = np.full(n + 1 - d, LOW)
                    for k in range(d + 1):
                        np.maximum(best, child[0][d - k, d - k : n + 1 - k] + child[1][k, d:], out=best)
                else:
                    c = child[0]
                    best = c[d, d:] + s.gap * (2 if kind == "pair" else 1)
                    if d >= 1 and left is not None:
                        found = c[d - 1, d:] + left[: n + 1 - d]
                        np.maximum(best, found + s.gap if kind == "pair" else found, out=best)
                    if d >= 1 and right is not None:  # the child ends one symbol earlier
                        found = c[d - 1, d - 1 : n] + right[d - 1 :]
                        np.maximum(best, found + s.gap if kind == "pair" else found, out=best)
                    if d >= 2 and both is not None:
                        np.maximum(best, c[d - 2, d - 1 : n] + both[sides[d]], out=best)
                if d >= 1:
                    np.maximum(best, np.maximum(t[d - 1, d:], t[d - 1, d - 1 : n]) + s.insert, out=best)
                np.maximum(best, LOW, out=t[d, d:])
            out.append(t)
        return [t.T for t in out]

    def parts(self, x: np.ndarray, starts: np.ndarray, longest: int, size: int = 8192) -> Iterator[tuple[int, np.ndarray]]:
        """(first end, scores [end, length]) of sequences that begin at ``starts`` of ``x``, ``size`` ends at a time.

        A part's score depends on its own symbols alone, so the tables run over many sequences; parts that begin before their sequence are left out.
        """
        room = np.arange(1, len(x) + 1) - np.repeat(starts, np.diff(np.append(starts, len(x))))
        for a in range(0, len(x), size):
            low = max(0, a - longest)
            t = self.fill(x[low : a + size], longest)[-1][a - low + 1 :]
            yield a + 1, np.where(np.arange(longest + 1) <= room[a : a + size, None], t, LOW)

    def hits(self, x: np.ndarray, starts: np.ndarray, longest: int, cutoff: float, size: int = 8192) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``scan``, over sequences that begin at ``starts`` of ``x``: arrays of starts, ends and scores."""
        out = [np.zeros((3, 0))]
        for first, t in self.parts(x, starts, longest, size):
            t = t[:, 1:]
            above = t >= cutoff
            above[:, 1:] &= t[:, 1:] > np.maximum.accumulate(t, axis=1)[:, :-1]
            end, d = np.nonzero(above)
            out.append(np.array([end + first - d - 1, end + first, t[end, d]]))
        begin, end, score = np.concatenate(out, axis=1)
        return begin.astype(int), end.astype(int), score

    def scan(self, seq: str, longest: int, cutoff: float) -> list[tuple[int, int, float]]:
        """(start, end, score), ends exclusive: for each end the shortest part above the cutoff and every longer one that beats all shorter."""
        x = codes(seq)
        return list(zip(*(v.tolist() for v in self.hits(x, np.zeros(min(1, len(x)), int), min(longest, len(x)), cutoff))))

    def align(self, seq: str) -> tuple[float, str, str]:
        """(score, aligned target, structure over it) of the whole sequence; small letters are insertions, ``-`` deletions."""
        x = codes(seq)
        tables = self.fill(x, len(x))
        s = self.scores

        def walk(v: int, j: int, d: int) -> tuple[str, str]:
            kind, a, b, children = self.nodes[v]
            value, i = tables[v][j, d], j - d
            if kind == "end" and d == 0:
                return "", ""
            if kind == "fork":
                for k in range(d + 1):
                    if tables[children[0]][j - k, d - k] + tables[children[1]][j, k] == value:
                        p, q = walk(children[0], j - k, d - k), walk(children[1], j, k)
                        return p[0] + q[0], p[1] + q[1]
            elif kind != "end":
                c = tables[children[0]]
                one = lambda place, k: float(self._known(s.single, place, x[[k]])[0])
                if kind == "pair" and d >= 2 and self.query[a] < 4 and self.query[b] < 4 and x[i] < 4 and x[j - 1] < 4 and c[j - 1, d - 2] + s.pair[self.query[a], self.query[b], x[i], x[j - 1]] == value:
                    p = walk(children[0], j - 1, d - 2)
                    return seq[i] + p[0] + seq[j - 1], "<" + p[1] + ">"
                lost = s.gap if kind == "pair" else 0
                if kind in ("left", "pair") and d >= 1 and c[j, d - 1] + one(a, i) + lost == value:
                    p = walk(children[0], j, d - 1)
                    return seq[i] + p[0] + ("-" if lost else ""), "." + p[1] + ("." if lost else "")
                if kind in ("right", "pair") and d >= 1 and c[j - 1, d - 1] + one(b, j - 1) + lost == value:
                    p = walk(children[0], j - 1, d - 1)
                    return ("-" if lost else "") + p[0] + seq[j - 1], ("." if lost else "") + p[1] + "."
                if c[j, d] + s.gap * (2 if kind == "pair" else 1) == value:
                    p = walk(children[0], j, d)
                    return ("-" if kind != "right" else "") + p[0] + ("-" if kind != "left" else ""), ("." if kind != "right" else "") + p[1] + ("." if kind != "left" else "")
            if d and tables[v][j, d - 1] + s.insert == value:
                p = walk(v, j, d - 1)
                return seq[i].lower() + p[0], "." + p[1]
            p = walk(v, j - 1, d - 1)
            return p[0] + seq[j - 1].lower(), p[1] + "."

        aligned, structure = walk(len(self.nodes) - 1, len(x), len(x))
        return float(tables[-1][len(x), len(x)]), aligned, structure


def _joined(seqs, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places of the rows, joined codes, starts) of sequences with a symbol, about ``most`` symbols at a time."""
    rows, held, n = [], [], 0
    for k, s in enumerate(seqs):
        if s:
            rows.append(k)
            held.append(codes(s).astype(np.uint8))
            n += len(s)
        if n >= most:
            sizes = [len(h) for h in held]
            yield np.array(rows), np.concatenate(held), np.cumsum(sizes) - sizes
            rows, held, n = [], [], 0
    if held:
        sizes = [len(h) for h in held]
        yield np.array(rows), np.concatenate(held), np.cumsum(sizes) - sizes


def search(seqs: DataFrame, model: Model, cutoff: float, longest: int) -> DataFrame:
    """``(seq_id, start, end, score)``: the hits of ``seqs(id, seq)`` that don't overlap a better one.

    Sequences are scanned many at a time, and long ones in pieces that overlap by the longest hit, so no hit is lost.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["id"].to_numpy()
            for rows, x, starts in _joined(batch["seq"]):
                begin, end, score = model.hits(x, starts, longest, cutoff)
                which = np.searchsorted(starts, begin, "right") - 1
                yield pd.DataFrame({"seq_id": ids[rows[which]], "start": begin - starts[which], "end": end - starts[which] - 1, "score": score})

    return A.remove_overlaps(seqs.select("id", "seq").mapInPandas(run, "seq_id long, start long, end long, score double"))


def best_scores(seqs: DataFrame, model: Model, longest: int) -> DataFrame:
    """``(id, score)``: the best score of any part of each sequence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            best = np.full(len(batch), LOW)
            for rows, x, starts in _joined(batch["seq"]):
                top = np.concatenate([t[:, 1:].max(axis=1, initial=LOW) for _, t in model.parts(x, starts, longest)])
                best[rows] = np.maximum.reduceat(top, starts)
            yield pd.DataFrame({"id": batch["id"], "score": best})

    return seqs.select("id", "seq").mapInPandas(run, "id long, score double")


def calibrate(spark, model: Model, longest: int, shares=(0.3, 0.5, 0.7), samples: int = 100, length: int = 200, seed: int = 0) -> DataFrame:
    """``(gc, mu, lam)``: an extreme value distribution of the best scores of random sequences for each GC share (in percent)."""
    rows = [(i, float(g)) for i, g in enumerate(s for s in shares for _ in range(samples))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, g in zip(batch["id"], batch["gc"]):
                rng = np.random.default_rng([seed, int(i)])
                x = rng.choice(4, length, p=[(1 - g) / 2, g / 2, g / 2, (1 - g) / 2])
                out.append((round(100 * g), float(model.fill(x, longest)[-1][:, 1:].max())))
            yield pd.DataFrame(out, columns=["gc", "score"])

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        mu, lam = A.fit_extreme_values(part["score"])
        return pd.DataFrame({"gc": [part["gc"].iloc[0]], "mu": [mu], "lam": [lam]})

    drawn = spark.createDataFrame(rows, "id long, gc double").repartition(8).mapInPandas(run, "gc long, score double")
    return drawn.groupBy("gc").applyInPandas(fit, "gc long, mu double, lam double")


def substitution_counts(aligned: DataFrame, structure: str, cutoff: float, weights: DataFrame | None = None) -> DataFrame:
    """``(kind, x, y, n)``: weighted substitutions between sequences of ``aligned(id, seq)`` whose identity is ``cutoff`` or more.

    Paired columns count as symbols of two bases, single ones as one; columns with a gap in either sequence are left out. A
    pair of sequences weighs the mean of their weights, and counts in both directions.
    """
    spark = aligned.sparkSession
    partner = pair_table(structure)
    places = spark.createDataFrame([(k, p) for k, p in enumerate(partner) if p < 0 or p > k], "pos int, partner int")
    c = A.columns(aligned)
    left = c.join(F.broadcast(places), "pos")
    right = c.select("id", F.col("pos").alias("partner"), F.col("sym").alias("_r"))
    symbols = left.join(right, ["id", "partner"], "left").select("id", "pos", F.when(F.col("partner") < 0, "single").otherwise("pair").alias("kind"), F.concat("sym", F.coalesce("_r", F.lit(""))).alias("s"))
    symbols = symbols.where(~F.col("s").contains("-"))
    w = aligned.select("id", F.lit(1.0).alias("weight")) if weights is None else weights.select("id", "weight")
    near = A.identity_pairs(aligned).where(F.col("identity") >= cutoff).select("a", "b")
    near = near.join(w.select(F.col("id").alias("a"), F.col("weight").alias("_a")), "a").join(w.select(F.col("id").alias("b"), F.col("weight").alias("_b")), "b")
    near = near.select("a", "b", ((F.col("_a") + F.col("_b")) / 2).alias("w"))
    x = symbols.select(F.col("id").alias("a"), "pos", "kind", F.col("s").alias("x"))
    y = symbols.select(F.col("id").alias("b"), "pos", F.col("s").alias("y"))
    both = near.join(x, "a").join(y, ["b", "pos"]).select("kind", "x", "y", "w")
    both = both.union(both.select("kind", F.col("y").alias("x"), F.col("x").alias("y"), "w"))
    return both.groupBy("kind", "x", "y").agg(F.sum("w").alias("n"))


def log_odds(counts: DataFrame, pseudo: float = 1.0) -> Scores:
    """Scores in bits from ``substitution_counts``, with pseudo-counts for each substitution."""
    single, pair = np.full((4, 4), pseudo), np.full((4, 4, 4, 4), pseudo / 16)
    for r in counts.collect():  # at most 16 + 256 rows of bases, and those of rarer symbols
        x, y = ([BASES.find(c.replace("T", "U")) for c in s] for s in (r.x, r.y))
        if min(x + y) >= 0:
            if r.kind == "single":
                single[x[0], y[0]] += r.n
            else:
                pair[x[0], x[1], y[0], y[1]] += r.n
    p = single / single.sum()
    base = p.sum(axis=1)
    q = pair / pair.sum()
    return Scores(np.log2(p / np.outer(base, base)), np.log2(q / np.multiply.outer(np.outer(base, base), np.outer(base, base))))
