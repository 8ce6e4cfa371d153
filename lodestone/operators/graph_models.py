"""Graphical models beyond Bayesian networks' elimination: junction trees, factor graphs, Markov nets, decisions, series.

A factor is ``(variables, table)`` with an axis for each variable. Models have few
nodes and live on the driver or in the task that has a series; what they learn
from data comes from aggregates.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import graph as G
from lodestone.plans.levels import level

Factor = tuple[list[str], np.ndarray]


def _spread(factor: Factor, variables: Sequence[str], sizes: dict[str, int]) -> np.ndarray:
    """A factor's table over more variables."""
    names, table = factor
    order = [v for v in variables if v in names]
    table = np.transpose(table, [names.index(v) for v in order])
    return table.reshape([sizes[v] if v in names else 1 for v in variables])


def _product(factors: Sequence[Factor], variables: Sequence[str], sizes: dict[str, int]) -> np.ndarray:
    out = np.ones([sizes[v] for v in variables])
    for f in factors:
        out = out * _spread(f, variables, sizes)
    return out


def with_evidence(factors: Sequence[Factor], places: dict[str, int]) -> list[Factor]:
    """Factors with what isn't observed set to 0; the variables stay."""
    out = []
    for names, table in factors:
        table = table.copy()
        for axis, v in enumerate(names):
            if v in places:
                keep = np.arange(table.shape[axis]) == places[v]
                table = table * keep.reshape([-1 if k == axis else 1 for k in range(table.ndim)])
        out.append((list(names), table))
    return out


# --- junction trees --------------------------------------------------------------------------------


def moral_graph(scopes: Sequence[Sequence[str]]) -> dict[str, set[str]]:
    """The neighbours of each variable: those it shares a factor with."""
    near: dict[str, set[str]] = {v: set() for s in scopes for v in s}
    for s in scopes:
        for a, b in itertools.permutations(s, 2):
            near[a].add(b)
    return near


def triangulate(near: dict[str, set[str]]) -> tuple[list[str], list[tuple[str, ...]]]:
    """(elimination order, maximal cliques): the variable that adds the fewest edges goes first, ties by name."""
    near = {v: set(n) for v, n in near.items()}
    order, cliques = [], []
    while near:
        fill = lambda v: sum(b not in near[a] for a, b in itertools.combinations(sorted(near[v]), 2))
        v = min(sorted(near), key=fill)
        clique = {v, *near[v]}
        if not any(clique <= set(c) for c in cliques):
            cliques.append(tuple(sorted(clique)))
        for a, b in itertools.permutations(near[v], 2):
            near[a].add(b)
        for a in near.pop(v):
            near[a].discard(v)
        order.append(v)
    return order, cliques


class JunctionTree:
    """Cliques of the triangulated graph of the factors, joined by a spanning tree of the largest separators."""

    def __init__(self, factors: Sequence[Factor], sizes: dict[str, int]) -> None:
        self.factors, self.sizes = list(factors), sizes
        scopes = [names for names, _ in factors] + [[v] for v in sizes]
        self.order, self.cliques = triangulate(moral_graph(scopes))
        weights = {(i, j): len(set(a) & set(b)) for (i, a), (j, b) in itertools.combinations(enumerate(self.cliques), 2)}
        self.edges = [(i, j) for i, j in G.spanning_tree(weights)] if weights else []
        self.home = [next(i for i, c in enumerate(self.cliques) if set(names) <= set(c)) for names, _ in factors]
        self.beliefs: list[np.ndarray] = []

    def calibrate(self, evidence: dict[str, int] | None = None, maximise: bool = False) -> JunctionTree:
        """Collect to the first clique, then distribute; beliefs are then proportional to the cliques' (max-)marginals."""
        gather = (lambda t, axes: t.max(axis=axes)) if maximise else (lambda t, axes: t.sum(axis=axes))
        factors = with_evidence(self.factors, evidence or {})
        self.beliefs = [_product([f for f, h in zip(factors, self.home) if h == i], c, self.sizes) for i, c in enumerate(self.cliques)]
        near: dict[int, list[int]] = {i: [] for i in range(len(self.cliques))}
        for i, j in self.edges:
            near[i].append(j)
            near[j].append(i)
        walk, seen = [], {0}
        stack = [0]
        while stack:
            i = stack.pop()
            for j in near[i]:
                if j not in seen:
                    seen.add(j)
                    walk.append((i, j))
                    stack.append(j)
        sent: dict[tuple[int, int], np.ndarray] = {}

        def pass_on(i: int, j: int) -> None:
            shared = [v for v in self.cliques[i] if v in self.cliques[j]]
            axes = tuple(k for k, v in enumerate(self.cliques[i]) if v not in shared)
            message = gather(self.beliefs[i], axes)
            old = sent.get((j, i))
            ratio = message if old is None else np.divide(message, old, out=np.zeros_like(message), where=old != 0)
            self.beliefs[j] = self.beliefs[j] * _spread((shared, ratio), self.cliques[j], self.sizes)
            sent[i, j] = message

        for i, j in reversed(walk):
            pass_on(j, i)
        for i, j in walk:
            pass_on(i, j)
        return self

    def marginal(self, variable: str) -> np.ndarray:
        i = next(k for k, c in enumerate(self.cliques) if variable in c)
        axes = tuple(k for k, v in enumerate(self.cliques[i]) if v != variable)
        out = self.beliefs[i].sum(axis=axes)
        return out / out.sum()

    def log_likelihood(self) -> float:
        """ln of the total of all factors with the evidence, from any clique's belief."""
        return float(np.log(self.beliefs[0].sum()))

    def most_probable(self, evidence: dict[str, int] | None = None) -> dict[str, int]:
        """The places of the most probable values of all variables, from max-marginals fixed one clique after the other."""
        fixed = dict(evidence or {})
        for c in self.cliques:
            for v in c:
                if v not in fixed:
                    self.calibrate(fixed, maximise=True)
                    i = next(k for k, x in enumerate(self.cliques) if v in x)
                    axes = tuple(k for k, x in enumerate(self.cliques[i]) if x != v)
                    fixed[v] = int(np.argmax(self.beliefs[i].max(axis=axes)))
        return fixed


def junction_tree(net: G.BayesNet) -> JunctionTree:
    return JunctionTree(net._factors({}), {v: len(x) for v, x in net.values.items()})


# --- factor graphs and Markov nets -----------------------------------------------------------------


class FactorGraph:
    """Sum-product or max-product messages between variables and factors; exact on trees."""

    def __init__(self, factors: Sequence[Factor], sizes: dict[str, int]) -> None:
        self.factors, self.sizes = list(factors), sizes

    def run(self, evidence: dict[str, int] | None = None, maximise: bool = False, rounds: int = 50) -> dict[str, np.ndarray]:
        """The normalised (max-)marginal of each variable."""
        factors = with_evidence(self.factors, evidence or {})
        edges = [(i, v) for i, (names, _) in enumerate(factors) for v in names]
        out = {e: np.ones(self.sizes[e[1]]) for e in edges}
        scale = lambda m: m / (m.max() or 1.0)
        for _ in range(rounds):
            into = {}
            for i, v in edges:
                into[i, v] = scale(np.prod([out[j, u] for j, u in edges if u == v and j != i] or [np.ones(self.sizes[v])], axis=0))
            new = {}
            for i, v in edges:
                names, table = factors[i]
                t = _product([(names, table), *[([u], into[i, u]) for u in names if u != v]], names, self.sizes)
                axes = tuple(k for k, u in enumerate(names) if u != v)
                new[i, v] = scale(t.max(axis=axes) if maximise else t.sum(axis=axes))
            done = all(np.allclose(new[e], out[e], rtol=0, atol=1e-15) for e in edges)
            out = new
            if done:
                break
        found = {v: np.prod([out[e] for e in edges if e[1] == v] or [np.ones(n)], axis=0) for v, n in self.sizes.items()}
        return {v: b / b.sum() for v, b in found.items()}


def by_components(factors: Sequence[Factor], sizes: dict[str, int], evidence: dict[str, int] | None = None) -> dict[str, np.ndarray]:
    """Marginals by brute force within each connected component of the factors' graph."""
    near, left, out = moral_graph([n for n, _ in factors] + [[v] for v in sizes]), set(sizes), {}
    shown = with_evidence(factors, evidence or {})
    while left:
        group, stack = set(), [min(left)]
        while stack:
            v = stack.pop()
            if v not in group:
                group.add(v)
                stack += near[v]
        names = sorted(group)
        table = _product([f for f in shown if set(f[0]) <= group], names, sizes)
        for k, v in enumerate(names):
            m = table.sum(axis=tuple(i for i in range(len(names)) if i != k))
            out[v] = m / m.sum()
        left -= group
    return out


class MarkovNet:
    """Undirected models: cliques with potentials, learned as counts or set, and inference by a junction tree."""

    def __init__(self) -> None:
        self.values: dict[str, list] = {}
        self.factors: list[Factor] = []

    def add_node(self, name: str, values: Sequence) -> None:
        self.values[name] = list(values)

    def add_clique(self, names: Sequence[str], table=None) -> None:
        shape = [len(self.values[v]) for v in names]
        self.factors.append((list(names), np.ones(shape) if table is None else np.asarray(table, float).reshape(shape)))

    def fit(self, cases: DataFrame) -> MarkovNet:
        """Each potential the shares of its clique's configurations, one aggregate for each clique."""
        for k, (names, table) in enumerate(self.factors):
            new = np.zeros_like(table)
            for r in cases.groupBy(*names).agg(F.count("*").alias("_n")).collect():
                new[tuple(self.values[v].index(r[v]) for v in names)] = r["_n"]
            self.factors[k] = (names, new / max(new.sum(), 1.0))
        return self

    def query(self, variable: str, evidence: dict) -> np.ndarray:
        sizes = {v: len(x) for v, x in self.values.items()}
        tree = JunctionTree(self.factors, sizes).calibrate({v: self.values[v].index(x) for v, x in evidence.items()})
        return tree.marginal(variable)


# --- decisions -------------------------------------------------------------------------------------


class DecisionNet:
    """Chance factors, decisions with what is known when they are made, and utilities; policies are improved one at a time."""

    def __init__(self, factors: Sequence[Factor], sizes: dict[str, int], decisions: dict[str, Sequence[str]], utilities: Sequence[Factor]) -> None:
        self.factors, self.sizes, self.utilities = list(factors), sizes, list(utilities)
        self.known = {d: list(k) for d, k in decisions.items()}
        self.policy = {d: np.full([sizes[v] for v in (*k, d)], 1 / sizes[d]) for d, k in self.known.items()}

    def _table(self, names: list[str], without: str | None) -> np.ndarray:
        policies = [([*self.known[d], d], p) for d, p in self.policy.items() if d != without]
        return _product([*self.factors, *policies], names, self.sizes)

    def expected_utility(self) -> float:
        names = list(self.sizes)
        joint = self._table(names, None)
        return float((joint * sum(_spread(u, names, self.sizes) for u in self.utilities)).sum())

    def improve(self, rounds: int = 20) -> DecisionNet:
        """The best choice of each decision for each known configuration, given the other policies, until nothing changes."""
        names = list(self.sizes)
        worth = sum(_spread(u, names, self.sizes) for u in self.utilities)
        for _ in range(rounds):
            changed = False
            for d, known in self.known.items():
                total = self._table(names, d) * worth
                scope = [*known, d]
                by = total.sum(axis=tuple(k for k, v in enumerate(names) if v not in scope))
                by = np.transpose(by, [[v for v in names if v in scope].index(v) for v in scope])
                best = (np.arange(self.sizes[d]) == by.argmax(axis=-1)[..., None]).astype(float)
                changed = changed or not np.array_equal(best, self.policy[d])
                self.policy[d] = best
            if not changed:
                break
        return self


# --- series ----------------------------------------------------------------------------------------


class SeriesModel:
    """A hidden chain with an observation in each slice: ``initial``, ``transition`` and ``emission`` tables."""

    def __init__(self, initial, transition, emission) -> None:
        self.initial, self.transition, self.emission = (np.asarray(m, float) for m in (initial, transition, emission))

    def smooth(self, observations) -> tuple[np.ndarray, np.ndarray, float]:
        """(P(state | all) by slice, expected transitions, log-likelihood)."""
        return self._smooth(np.array(observations, float), np.array([0]))

    def _smooth(self, observed: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """As ``smooth``, of the series that begin at ``starts``: a step takes one slice of all of them; transitions and likelihoods are sums."""
        b, n = G.emitted(self.emission, observed), len(observed)
        steps = G.slices(starts, n)
        forward, scale = np.zeros_like(b), np.zeros(n)
        for t, at in enumerate(steps):
            now = (self.initial if t == 0 else forward[at - 1] @ self.transition) * b[at]
            scale[at] = now.sum(axis=1)
            forward[at] = now / scale[at, None]
        back, moves = np.ones_like(b), np.zeros_like(self.transition)
        for at in steps[:0:-1]:
            ahead = b[at] * back[at] / scale[at, None]
            moves += forward[at - 1].T @ ahead
            back[at - 1] = ahead @ self.transition.T
        return forward * back, moves * self.transition, float(np.log(scale).sum())

    def decode(self, observations) -> list[int]:
        """The most probable states; ties to the lower one."""
        return self._decode(np.array(observations, float), np.array([0])).tolist()

    def _decode(self, observed: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """As ``decode``, of the series that begin at ``starts``."""
        with np.errstate(divide="ignore"):
            best, a, first = np.log(G.emitted(self.emission, observed)), np.log(self.transition), np.log(self.initial)
        steps, came = G.slices(starts, len(observed)), np.zeros(best.shape, np.int32)
        for t, at in enumerate(steps):
            if t == 0:
                best[at] += first
            else:
                through = best[at - 1][:, :, None] + a
                came[at] = through.argmax(axis=1)
                best[at] += through.max(axis=1)
        states = best.argmax(axis=1)
        for at in steps[:0:-1]:
            states[at - 1] = came[at, states[at]]
        return states

    def smooth_series(self, observations: DataFrame) -> DataFrame:
        """``(series, t, state, p)`` of ``observations(series, t, obs)``."""

        def work(series, times, observed, starts) -> pd.DataFrame:
            p, _, _ = self._smooth(observed, starts)
            k = p.shape[1]
            return pd.DataFrame({"series": np.repeat(series, k), "t": np.repeat(times, k), "state": np.tile(np.arange(k), len(times)), "p": p.reshape(-1)})

        return G.by_series(G.arranged(observations), work, "series long, t long, state int, p double")

    def decode_series(self, observations: DataFrame) -> DataFrame:
        """``(series, t, obs, state)``."""

        def work(series, times, observed, starts) -> pd.DataFrame:
            return pd.DataFrame({"series": series, "t": times, "obs": observed, "state": self._decode(observed, starts)})

        return G.by_series(G.arranged(observations), work, "series long, t long, obs long, state int")

    def learn(self, observations: DataFrame, rounds: int = 10) -> tuple[SeriesModel, list[float]]:
        """Tables by expectation maximisation, and the log-likelihood before each round.

        The series are arranged once and kept; a round is one job over them whose partial sums are small, one for each batch.
        """
        model, seen = self, []
        k, m = self.emission.shape
        kept = level(G.arranged(observations))
        for _ in range(rounds):
            now = model

            def work(series, times, observed, starts) -> pd.DataFrame:
                p, moves, ll = now._smooth(observed, starts)  # noqa: B023
                known = ~np.isnan(observed)
                emitted = np.array([np.bincount(observed[known].astype(int), q[known], m) for q in p.T])
                return pd.DataFrame({"sums": [np.concatenate([p[starts].sum(axis=0), moves.ravel(), emitted.ravel(), [ll]]).tolist()]})

            sums = G.by_series(kept, work, "sums array<double>")
            width = k + k * k + k * m + 1
            total = np.array(list(sums.agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]).first()))
            seen.append(float(total[-1]))
            norm = lambda t: t / np.where(t.sum(axis=-1, keepdims=True) > 0, t.sum(axis=-1, keepdims=True), 1)
            model = SeriesModel(norm(total[:k]), norm(total[k : k + k * k].reshape(k, k)), norm(total[k + k * k : -1].reshape(k, m)))
        return model, seen


# --- learning --------------------------------------------------------------------------------------


def dirichlet_table(cases: DataFrame, child: str, parents: Sequence[str], prior: float = 1.0) -> DataFrame:
    """``(parents, child, n, p)``: the posterior mean of a table whose rows have ``prior`` pseudo-counts for each value."""
    counted = G.cpt(cases, child, parents)
    from pyspark.sql import Window

    over = Window.partitionBy(*parents)
    return counted.withColumn("p", (F.col("n") + prior) / (F.sum("n").over(over) + prior * F.count("*").over(over)))


def best_structure(cases: DataFrame, columns: Sequence[str], score: str = "BIC") -> tuple[list[tuple], float]:
    """The acyclic graph of the best score among all; for a handful of variables. All families are scored in one job."""
    r = cases.agg(F.count("*").alias("_n"), *[F.countDistinct(c).alias(c) for c in columns]).first()
    families = [(c, tuple(sorted(s))) for c in columns for k in range(len(columns)) for s in itertools.combinations([x for x in columns if x != c], k)]
    known = G.family_scores(cases, families, r["_n"], {c: r[c] for c in columns}, score)
    best: tuple[float, list[tuple]] = (-math.inf, [])
    # Every acyclic graph fits an order, and in an order each node takes its best parents among those before it.
    for order in itertools.permutations(columns):
        total, edges = 0.0, []
        for k, c in enumerate(order):
            s = max((tuple(sorted(s)) for n in range(k + 1) for s in itertools.combinations(order[:k], n)), key=lambda s: (known[c, s], -len(s)))  # noqa: B023
            total += known[c, s]
            edges += [(p, c) for p in s]
        if total > best[0] + 1e-9:
            best = total, sorted(edges)
    return best[1], best[0]


def linear_gaussian(cases: DataFrame, child: str, parents: Sequence[str]) -> tuple[np.ndarray, float]:
    """(coefficients, the constant first, residual variance) of a normal node with normal parents, one aggregate and a small solve."""
    from lodestone.functions.matrix import regression

    b = regression(cases, list(parents), child)
    fitted = sum((F.col(p) * float(v) for p, v in zip(parents, b[1:])), F.lit(float(b[0])))
    return b, float(cases.agg(F.avg((F.col(child) - fitted) * (F.col(child) - fitted))).first()[0])
