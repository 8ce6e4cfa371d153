"""Phylogenetic trees: Newick, neighbour joining, likelihood, splits, bootstrap and consensus."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Node:
    def __init__(self, name: str = "", length: float = 0.0, children: list[Node] | None = None) -> None:
        self.name, self.length, self.children = name, length, children or []

    def leaves(self) -> list[str]:
        return [self.name] if not self.children else [x for c in self.children for x in c.leaves()]

    def walk(self):
        """Children before parents."""
        for c in self.children:
            yield from c.walk()
        yield self


def parse_newick(text: str) -> Node:
    """A tree with names, branch lengths, quoted names and comments in brackets."""
    at = 0

    def blank() -> None:
        nonlocal at
        while at < len(text) and (text[at].isspace() or text[at] == "["):
            at = text.index("]", at) + 1 if text[at] == "[" else at + 1

    def word(stop: str) -> str:
        nonlocal at
        blank()
        if at < len(text) and text[at] == "'":
            end = text.index("'", at + 1)
            out, at = text[at + 1 : end], end + 1
            return out
        start = at
        while at < len(text) and text[at] not in stop and not text[at].isspace():
            at += 1
        return text[start:at]

    def node() -> Node:
        nonlocal at
        blank()
        children = []
        if at < len(text) and text[at] == "(":
            while text[at] in "(,":
                at += 1
                children.append(node())
                blank()
            if text[at] != ")":
                raise ValueError(f"')' expected at {at}")
            at += 1
        out = Node(word("(),:;["), 0.0, children)
        blank()
        if at < len(text) and text[at] == ":":
            at += 1
            out.length = float(word("(),;["))
        return out

    return node()


def write_newick(tree: Node, lengths: bool = True) -> str:
    def one(n: Node, top: bool) -> str:
        inner = f"({','.join(one(c, False) for c in n.children)})" if n.children else ""
        return inner + n.name + (f":{n.length:.6g}" if lengths and not top else "")

    return one(tree, True) + ";"


def tree_rows(tree: Node) -> list[tuple[int, int | None, str, float]]:
    """(node, parent, name, length), nodes numbered from the root."""
    out: list[tuple] = []

    def add(n: Node, parent: int | None) -> None:
        me = len(out)
        out.append((me, parent, n.name, n.length))
        for c in n.children:
            add(c, me)

    add(tree, None)
    return out


def neighbour_joining(names: Sequence[str], distances: np.ndarray) -> Node:
    """The tree of a distance matrix; ties to the first pair, negative lengths become 0."""
    nodes = [Node(n) for n in names]
    d = np.array(distances, float)
    while len(nodes) > 3:
        n = len(nodes)
        r = d.sum(axis=1) / (n - 2)
        m = d - r[:, None] - r[None, :]
        m[np.tril_indices(n)] = np.inf
        i, j = np.unravel_index(int(np.argmin(m)), m.shape)
        a = (d[i, j] + r[i] - r[j]) / 2
        nodes[i].length, nodes[j].length = max(a, 0.0), max(d[i, j] - a, 0.0)
        new = (d[i] + d[j] - d[i, j]) / 2
        keep = [k for k in range(n) if k not in (i, j)]
        d = np.block([[d[np.ix_(keep, keep)], new[keep][:, None]], [new[keep][None, :], np.zeros((1, 1))]])
        nodes = [nodes[k] for k in keep] + [Node("", 0.0, [nodes[i], nodes[j]])]
    if len(nodes) == 3:
        for k, (x, y) in enumerate(((1, 2), (0, 2), (0, 1))):
            nodes[k].length = max((d[k, x] + d[k, y] - d[x, y]) / 2, 0.0)
    elif len(nodes) == 2:
        nodes[0].length = nodes[1].length = max(d[0, 1] / 2, 0.0)
    return Node("", 0.0, nodes)


def jukes_cantor(p: float, states: int = 4) -> float:
    """The distance for a share of differing sites; saturated shares give 5."""
    b = (states - 1) / states
    return 5.0 if p >= b * 0.999 else -b * math.log(1 - p / b)


def transition(t: float, states: int = 4) -> np.ndarray:
    """P(t) of the equal-rates model, t in substitutions per site."""
    e = math.exp(-states * t / (states - 1))
    out = np.full((states, states), (1 - e) / states)
    np.fill_diagonal(out, 1 / states + (1 - 1 / states) * e)
    return out


def hky_rate_matrix(freqs: Sequence[float], kappa: float) -> np.ndarray:
    """Rates in the order ACGT, scaled to one substitution per unit."""
    pi = np.asarray(freqs, float)
    q = np.tile(pi, (4, 1))
    for a, b in ((0, 2), (2, 0), (1, 3), (3, 1)):
        q[a, b] *= kappa
    np.fill_diagonal(q, 0)
    np.fill_diagonal(q, -q.sum(axis=1))
    return q / -(pi * np.diag(q)).sum()


def exponential(q: np.ndarray, t: float) -> np.ndarray:
    w, v = np.linalg.eig(q)
    return np.real(v @ np.diag(np.exp(w * t)) @ np.linalg.inv(v))


def site_likelihoods(tree: Node, column: dict[str, str], alphabet: str = "ACGT", rates: Sequence[float] = (1.0,)) -> float:
    """The likelihood of one alignment column by Felsenstein's pruning, averaged over rates; unknown symbols fit every state."""
    k, total = len(alphabet), 0.0
    for rate in rates:
        up: dict[int, np.ndarray] = {}
        for n in tree.walk():
            if n.children:
                v = np.ones(k)
                for c in n.children:
                    v = v * (transition(c.length * rate, k) @ up[id(c)])
            else:
                s = column.get(n.name, "-").upper()
                v = np.eye(k)[alphabet.index(s)] if s in alphabet else np.ones(k)
            up[id(n)] = v
        total += up[id(tree)].mean() / len(rates)
    return total


def log_likelihoods(aligned: DataFrame, newick: str, alphabet: str = "ACGT") -> DataFrame:
    """``(pos, log_likelihood)`` of ``aligned(id, seq)`` with names as ids; distinct columns are computed once."""
    from .align import columns

    rows = columns(aligned).groupBy("pos").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("id").cast("string"), "sym")))).alias("m"))
    pattern = F.to_json("m")
    patterns = rows.select(pattern.alias("pattern")).distinct()

    def run(batches):
        import json

        tree = parse_newick(newick)
        for batch in batches:
            yield pd.DataFrame({"pattern": batch["pattern"], "log_likelihood": [math.log(site_likelihoods(tree, json.loads(p), alphabet)) for p in batch["pattern"]]})

    values = patterns.mapInPandas(run, "pattern string, log_likelihood double")
    return rows.select("pos", pattern.alias("pattern")).join(values, "pattern").select("pos", "log_likelihood")


def splits(tree: Node) -> set[tuple[str, ...]]:
    """Non-trivial splits: the sorted side without the first leaf by name."""
    everything = sorted(tree.leaves())
    out = set()
    for n in tree.walk():
        side = set(n.leaves())
        if everything and everything[0] in side:
            side = set(everything) - side
        if 1 < len(side) < len(everything) - 1:
            out.add(tuple(sorted(side)))
    return out


def split_counts(trees: DataFrame) -> DataFrame:
    """``(split, n)`` over ``trees(newick)``: how many trees have each split."""

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"split": [",".join(s) for t in batch["newick"] for s in sorted(splits(parse_newick(t)))]}, dtype="object")

    return trees.select("newick").mapInPandas(run, "split string").groupBy("split").agg(F.count("*").alias("n"))


def compatible(a: Sequence[str], b: Sequence[str]) -> bool:
    """Whether two splits (sides without the first leaf) fit one tree."""
    x, y = set(a), set(b)
    return x <= y or y <= x or not x & y


def consensus(trees: DataFrame, threshold: float = 0.5) -> Node:
    """Greedy consensus: splits by descending count, at least ``threshold`` of the trees, that fit those taken before."""
    n = trees.count()
    names = sorted(parse_newick(trees.first()["newick"]).leaves())
    counts = sorted(((r.n, r.split) for r in split_counts(trees).where(F.col("n") >= threshold * n).collect()), key=lambda r: (-r[0], r[1]))
    taken: list[tuple[str, ...]] = []
    support: dict[tuple[str, ...], int] = {}
    for c, s in counts:
        side = tuple(s.split(","))
        if all(compatible(side, t) for t in taken):
            taken.append(side)
            support[side] = c
    nodes = {frozenset([x]): Node(x) for x in names}
    current = [frozenset([x]) for x in names]
    for side in sorted(taken, key=len):
        inside = [g for g in current if g <= set(side)]
        merged = frozenset(side)
        nodes[merged] = Node(str(support[side]), 0.0, [nodes[g] for g in inside])
        current = [g for g in current if g not in inside] + [merged]
    return Node("", 0.0, [nodes[g] for g in current])


def bootstrap_trees(aligned: DataFrame, replicates: int, seed: int) -> DataFrame:
    """``(rep, newick)``: neighbour joining on Jukes-Cantor distances of resampled columns, one replicate for each group."""
    from .align import bootstrap_columns

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        names, x = [str(i) for i in part["id"]], np.array([list(s) for s in part["seq"]])
        d = np.array([[jukes_cantor(float((a != b).mean())) if len(a) else 0.0 for b in x] for a in x])
        return pd.DataFrame({"rep": [part["rep"].iloc[0]], "newick": [write_newick(neighbour_joining(names, d))]})

    return bootstrap_columns(aligned, replicates, seed).groupBy("rep").applyInPandas(run, "rep long, newick string")


def path_distances(tree: Node) -> dict[tuple[str, str], float]:
    """Branch-length distances of all pairs of leaves."""
    out: dict[tuple[str, str], float] = {}

    def below(n: Node) -> dict[str, float]:
        if not n.children:
            return {n.name: 0.0}
        seen: dict[str, float] = {}
        for c in n.children:
            part = {k: v + c.length for k, v in below(c).items()}
            for a, x in seen.items():
                for b, y in part.items():
                    out[min(a, b), max(a, b)] = x + y
            seen.update(part)
        return seen

    below(tree)
    return out


def hierarchy(names: Sequence[str], distances: np.ndarray, mode: str = "mean") -> Node:
    """Agglomerative tree of a distance matrix by ``mean`` (UPGMA), ``min`` or ``max`` linkage; ties to the first pair."""
    d = np.array(distances, float)
    np.fill_diagonal(d, np.inf)
    nodes, sizes, heights = [Node(n) for n in names], np.ones(len(names)), np.zeros(len(names))
    while len(nodes) > 1:
        upper = np.where(np.triu(np.ones_like(d), 1) > 0, d, np.inf)
        i, j = np.unravel_index(int(np.argmin(upper)), d.shape)
        height = d[i, j] / 2
        nodes[i].length, nodes[j].length = max(height - heights[i], 0.0), max(height - heights[j], 0.0)
        joined = {"mean": (sizes[i] * d[i] + sizes[j] * d[j]) / (sizes[i] + sizes[j]), "min": np.minimum(d[i], d[j]), "max": np.maximum(d[i], d[j])}[mode]
        keep = [k for k in range(len(nodes)) if k not in (i, j)]
        nodes = [nodes[k] for k in keep] + [Node("", 0.0, [nodes[i], nodes[j]])]
        sizes, heights = np.append(sizes[keep], sizes[i] + sizes[j]), np.append(heights[keep], height)
        d = np.block([[d[np.ix_(keep, keep)], joined[keep][:, None]], [joined[keep][None, :], np.full((1, 1), np.inf)]])
    return nodes[0]


def gamma_distance(p: float, alpha: float, states: int = 4) -> float:
    """The equal-rates distance with gamma-distributed rates over sites."""
    b = (states - 1) / states
    return 5.0 if p >= b * 0.999 else b * alpha * ((1 - p / b) ** (-1 / alpha) - 1)


def likelihood_distance(counts: np.ndarray, rates: Sequence[float] = (1.0,), longest: float = 5.0) -> float:
    """The branch length that maximises the likelihood of a pair's symbol counts."""
    from lodestone.functions.special import golden_minimum

    def cost(t: float) -> float:
        p = sum(transition(t * r, len(counts)) for r in rates) / len(rates)
        return -float((counts * np.log(np.maximum(p, 1e-300))).sum())

    return golden_minimum(cost, 1e-9, longest)


def same_topology(a: Node, b: Node) -> bool:
    return sorted(a.leaves()) == sorted(b.leaves()) and splits(a) == splits(b)


def satisfies(tree: Node, constraint: Node) -> bool:
    """Whether the tree has every split of the constraint, on the constraint's leaves."""
    names = set(constraint.leaves())

    def prune(n: Node) -> Node | None:
        if not n.children:
            return n if n.name in names else None
        left = [c for c in map(prune, n.children) if c]
        return None if not left else left[0] if len(left) == 1 else Node(n.name, n.length, left)

    rest = prune(tree)
    return rest is not None and splits(constraint) <= splits(rest)


def neighbour_interchanges(tree: Node) -> list[Node]:
    """The trees that differ by one exchange of subtrees across an inner branch."""
    import copy

    out = []

    def places(n: Node, path: tuple[int, ...]):
        for k, c in enumerate(n.children):
            if c.children:
                yield (*path, k)
            yield from places(c, (*path, k))

    for path in places(tree, ()):
        for inner in range(2):
            new = copy.deepcopy(tree)
            parent = new
            for k in path[:-1]:
                parent = parent.children[k]
            child = parent.children[path[-1]]
            other = next(k for k in range(len(parent.children)) if k != path[-1])
            parent.children[other], child.children[inner] = child.children[inner], parent.children[other]
            out.append(new)
    return out


def simulate(spark, newick: str, sites: int, seed: int, alphabet: str = "ACGT") -> DataFrame:
    """``(id, seq)`` of the leaves: every site evolves on its own from a uniform root; seeded by blocks of sites."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        tree = parse_newick(newick)
        rng = np.random.default_rng([seed, int(part["block"].iloc[0])])
        n, out = len(part), []

        def down(node: Node, state: np.ndarray) -> None:
            if not node.children:
                out.append((node.name, state))
            for c in node.children:
                total = np.cumsum(transition(c.length, len(alphabet))[state], axis=1)
                down(c, np.minimum((rng.random(n)[:, None] > total).sum(axis=1), len(alphabet) - 1))

        down(tree, rng.integers(len(alphabet), size=n))
        sites_here = sorted(part["id"])
        return pd.DataFrame([(name, s, alphabet[v]) for name, x in out for s, v in zip(sites_here, x)], columns=["id", "site", "sym"])

    rows = spark.range(sites).withColumn("block", F.floor(F.col("id") / 1000)).groupBy("block").applyInPandas(run, "id string, site long, sym string")
    return rows.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("site", "sym"))), lambda s: s["sym"]), "").alias("seq"))


def site_rates(aligned: DataFrame, newick: str, grid: Sequence[float] = (0.05, 0.1, 0.2, 0.4, 0.7, 1.0, 1.5, 2.5, 4.0, 8.0), prior: Sequence[float] | None = None, alphabet: str = "ACGT") -> DataFrame:
    """``(pos, ml_rate, eb_rate)``: the likeliest rate of the grid and the posterior mean under the prior; columns are independent."""
    from .align import columns

    rows = columns(aligned).groupBy("pos").agg(F.collect_list(F.struct(F.col("id").cast("string").alias("id"), "sym")).alias("column"))

    def run(batches):
        tree, weights = parse_newick(newick), np.ones(len(grid)) if prior is None else np.asarray(prior, float)
        for batch in batches:
            out = []
            for pos, column in zip(batch["pos"], batch["column"]):
                values = {c["id"]: c["sym"] for c in column}
                like = np.array([site_likelihoods(tree, values, alphabet, (r,)) for r in grid])
                post = like * weights / (like * weights).sum()
                out.append((pos, float(grid[int(np.argmax(like >= like.max() * (1 - 1e-12)))]), float((post * np.asarray(grid)).sum())))
            yield pd.DataFrame(out, columns=["pos", "ml_rate", "eb_rate"])

    return rows.mapInPandas(run, "pos int, ml_rate double, eb_rate double")
