"""Likelihood on trees for distinct columns at once: branch lengths, co-occurrence, constrained joining, and search.

An alignment's distinct columns and their numbers come from one aggregate; they
are bounded by the columns, and trees are walked for all of them together.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.special import golden_minimum
from lodestone.operators.align import columns
from lodestone.operators.phylogeny import Node, jukes_cantor, neighbour_interchanges, neighbour_joining, satisfies, splits, transition, write_newick

ALPHABET = "ACGT"


class Patterns:
    """Distinct columns: ``names`` of the rows, ``states`` (patterns x rows, -1 for what fits every state) and their ``counts``."""

    def __init__(self, names: Sequence[str], states: np.ndarray, counts: np.ndarray) -> None:
        self.names, self.states, self.counts = list(names), states, counts

    def leaf(self, name: str, k: int) -> np.ndarray:
        """Patterns x k: 1 for the states that the symbol may be."""
        s = self.states[:, self.names.index(name)]
        return np.where(s[:, None] < 0, 1.0, (s[:, None] == np.arange(k)).astype(float))


def patterns(aligned: DataFrame, alphabet: str = ALPHABET) -> Patterns:
    """The distinct columns of ``aligned(id, seq)``, one row for each."""
    code = F.instr(F.lit(alphabet), F.col("sym")) - 1
    rows = columns(aligned).groupBy("pos").agg(F.array_sort(F.collect_list(F.struct(F.col("id").cast("string").alias("id"), code.alias("s")))).alias("column"))
    found = rows.groupBy("column").agg(F.count("*").alias("n")).collect()
    names = [c["id"] for c in found[0]["column"]]
    order = sorted(found, key=lambda r: [c["s"] for c in r["column"]])
    return Patterns(names, np.array([[c["s"] for c in r["column"]] for r in order]), np.array([r["n"] for r in order], float))


def _up(node: Node, data: Patterns, k: int, rate: float, seen: dict[int, np.ndarray]) -> np.ndarray:
    """Patterns x k: the likelihood of what lies below a node, for each of its states."""
    if node.children:
        out = np.ones((len(data.counts), k))
        for c in node.children:
            out = out * (_up(c, data, k, rate, seen) @ transition(c.length * rate, k).T)
    else:
        out = data.leaf(node.name, k)
    seen[id(node)] = out
    return out


def log_likelihood(tree: Node, data: Patterns, rates: Sequence[float] = (1.0,), k: int = 4) -> float:
    """Of all columns, averaged over equally likely rates."""
    total = sum(_up(tree, data, k, r, {}).mean(axis=1) for r in rates) / len(rates)
    return float((data.counts * np.log(np.maximum(total, 1e-300))).sum())


def optimise_lengths(tree: Node, data: Patterns, rounds: int = 4, longest: float = 3.0) -> float:
    """Branch lengths that maximise the likelihood, one after the other; changes the tree and returns the log-likelihood."""
    best = log_likelihood(tree, data)
    for _ in range(rounds):
        before = best
        for node in [n for n in tree.walk() if n is not tree]:

            def cost(t: float, node: Node = node) -> float:
                node.length = t
                return -log_likelihood(tree, data)

            old = node.length
            node.length = golden_minimum(cost, 1e-6, longest, 40)
            now = log_likelihood(tree, data)
            if now < best:
                node.length = old
            else:
                best = now
        if best - before < 1e-3:
            break
    return best


def distance_tree(data: Patterns, constraint: Node | None = None) -> Node:
    """Neighbour joining on equal-rates distances; with a constraint, only pairs that keep its splits possible are joined."""
    n = len(data.names)
    d = np.zeros((n, n))
    for i in range(n):
        for j in range(i + 1, n):
            ok = (data.states[:, i] >= 0) & (data.states[:, j] >= 0)
            total = data.counts[ok].sum()
            p = data.counts[ok & (data.states[:, i] != data.states[:, j])].sum() / total if total else 0.0
            d[i, j] = d[j, i] = jukes_cantor(float(p))
    return neighbour_joining(data.names, d) if constraint is None else constrained_joining(data.names, d, constraint)


def constrained_joining(names: Sequence[str], distances: np.ndarray, constraint: Node) -> Node:
    """Neighbour joining that keeps every split of a constraint tree over the same or fewer names."""
    sides = [set(s) for s in splits(constraint)]
    everything = set(constraint.leaves())
    groups: list[tuple[Node, set[str]]] = [(Node(x), {x}) for x in names]
    d = np.array(distances, float)

    def allowed(a: set[str], b: set[str]) -> bool:
        joined = (a | b) & everything
        return all(not (joined & s) or joined <= s or s <= joined or joined | s >= everything for s in sides)

    while len(groups) > 3:
        n = len(groups)
        r = d.sum(axis=1) / (n - 2)
        pairs = sorted((d[i, j] - r[i] - r[j], i, j) for i in range(n) for j in range(i + 1, n))
        _, i, j = next((p for p in pairs if allowed(groups[p[1]][1], groups[p[2]][1])), pairs[0])
        a = (d[i, j] + r[i] - r[j]) / 2
        groups[i][0].length, groups[j][0].length = max(a, 0.0), max(d[i, j] - a, 0.0)
        new = (d[i] + d[j] - d[i, j]) / 2
        keep = [k for k in range(n) if k not in (i, j)]
        merged = (Node("", 0.0, [groups[i][0], groups[j][0]]), groups[i][1] | groups[j][1])
        d = np.block([[d[np.ix_(keep, keep)], new[keep][:, None]], [new[keep][None, :], np.zeros((1, 1))]])
        groups = [groups[k] for k in keep] + [merged]
    for k in range(len(groups)):
        others = [x for x in range(len(groups)) if x != k]
        far = d[k, others].sum() - (d[others[0], others[1]] if len(others) == 2 else 0.0)
        groups[k][0].length = max(far / 2, 0.0)
    return Node("", 0.0, [g[0] for g in groups])


def search(data: Patterns, start: Node | None = None, constraint: Node | None = None, rounds: int = 20) -> tuple[Node, float]:
    """The likeliest tree that exchanges of neighbours reach from a start, lengths optimised; a constraint's splits are kept."""
    tree = copy.deepcopy(start) if start else distance_tree(data, constraint)
    best = optimise_lengths(tree, data)
    for _ in range(rounds):
        near = [t for t in neighbour_interchanges(tree) if constraint is None or satisfies(t, constraint)]
        found = [(optimise_lengths(t, data, 1), k) for k, t in enumerate(near)]
        top, k = max(found, default=(-math.inf, 0))
        if top <= best + 1e-3:
            break
        tree, best = near[k], optimise_lengths(near[k], data)
    return tree, best


def restarts(aligned: DataFrame, trees: DataFrame) -> DataFrame:
    """``(newick, log_likelihood)``: a search from each of ``trees(newick)``, one start in a task."""
    import pandas as pd

    from lodestone.operators.phylogeny import parse_newick

    data = patterns(aligned)

    def run(batches):
        for batch in batches:
            found = [search(data, parse_newick(t)) for t in batch["newick"]]
            yield pd.DataFrame({"newick": [write_newick(t) for t, _ in found], "log_likelihood": [v for _, v in found]})

    return trees.select("newick").mapInPandas(run, "newick string, log_likelihood double")


def co_occurrence(tree: Node, name: str, data: Patterns, rates: Sequence[float] = (1.0,), k: int = 4) -> np.ndarray:
    """Rates x k x k: expected numbers of (parent state, child state) along the branch above the node called ``name``."""
    target = next(n for n in tree.walk() if n.name == name)
    out = []
    for r in rates:
        up: dict[int, np.ndarray] = {}
        _up(tree, data, k, r, up)

        def down(node: Node, above: np.ndarray) -> np.ndarray | None:
            """What is known above the target's branch, for each state of its parent."""
            sides = [up[id(c)] @ transition(c.length * r, k).T for c in node.children]  # noqa: B023
            for i, c in enumerate(node.children):
                here = above * np.prod([s for j, s in enumerate(sides) if j != i] or [np.ones_like(above)], axis=0)
                if c is target:
                    return here
                found = down(c, here @ transition(c.length * r, k)) if c.children else None  # noqa: B023
                if found is not None:
                    return found
            return None

        above = down(tree, np.full((len(data.counts), k), 1 / k))
        out.append(above[:, :, None] * transition(target.length * r, k)[None] * up[id(target)][:, None, :])
    joint = np.array(out)  # rates, patterns, parent, child
    joint = joint / joint.sum(axis=(0, 2, 3), keepdims=True)
    return (joint * data.counts[None, :, None, None]).sum(axis=1)
