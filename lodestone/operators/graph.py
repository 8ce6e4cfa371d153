"""Graphs and probabilistic graphical models.

Graphs are edge tables ``(src, dst)``; factors and conditional probability
tables are long tables with one column for each variable and a value ``p``.
Structures with some dozens of nodes are searched on the driver; counts over
cases are DataFrame aggregates.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.levels import forget, level, stored

# --- edge tables ---------------------------------------------------------------------------------


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(node, component)``: the least node of each undirected component, by label propagation with shortcuts."""
    both = stored(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    every = both.select(F.col("src").alias("node"))
    if nodes is not None:
        every = every.union(nodes.select(F.col(nodes.columns[0]).alias("node")))
    labels = stored(every.distinct().withColumn("component", F.col("node")))
    while True:
        least = both.join(labels, both.dst == labels.node).groupBy("src").agg(F.min("component").alias("_m"))
        hooked = labels.join(least, labels.node == least.src, "left").select("node", F.least("component", F.coalesce("_m", "component")).alias("component"))
        hooked = stored(hooked)
        up = hooked.select(F.col("node").alias("component"), F.col("component").alias("_top"))
        new = stored(hooked.join(up, "component", "left").select("node", F.coalesce("_top", "component").alias("component")))
        done = new.join(labels.withColumnRenamed("component", "_old"), "node").where("component <> _old").isEmpty()
        forget(hooked)
        forget(labels)
        labels = new
        if done:
            forget(both)
            return labels


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``(node)``: what can be reached from the start nodes along the edges, the start nodes included."""
    seen = level(start.select(F.col(start.columns[0]).alias("node")).distinct())
    frontier = seen
    while not frontier.isEmpty():
        frontier = level(frontier.join(edges, frontier.node == edges.src).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        seen = level(seen.union(frontier))
    return seen


def ancestors(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``(node)``: proper ancestors of the start nodes."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return closure(back, start).join(start.select(F.col(start.columns[0]).alias("node")), "node", "left_anti")


def ancestral_closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    return closure(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start)


def markov_blanket(edges: DataFrame) -> DataFrame:
    """``(node, member)``: parents, children and the children's other parents of every node."""
    parents = edges.select(F.col("dst").alias("node"), F.col("src").alias("member"))
    children = edges.select(F.col("src").alias("node"), F.col("dst").alias("member"))
    a, b = edges.alias("a"), edges.alias("b")
    partners = a.join(b, (F.col("a.dst") == F.col("b.dst")) & (F.col("a.src") != F.col("b.src"))).select(F.col("a.src").alias("node"), F.col("b.src").alias("member"))
    return parents.union(children).union(partners).where("node <> member").distinct()


def moralise(edges: DataFrame) -> DataFrame:
    """Undirected ``(a, b)`` with a < b: the edges without direction, and all pairs of parents of a node."""
    plain = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    x, y = edges.alias("x"), edges.alias("y")
    married = x.join(y, (F.col("x.dst") == F.col("y.dst")) & (F.col("x.src") < F.col("y.src"))).select(F.col("x.src").alias("a"), F.col("y.src").alias("b"))
    return plain.union(married).distinct()


def topological_levels(edges: DataFrame) -> DataFrame:
    """``(node, level)``: the longest path that leads to each node; nodes on or behind a cycle have none."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    left, rest, out, depth = level(nodes), level(edges.select("src", "dst").distinct()), None, 0
    while True:
        ready = level(left.join(rest.select(F.col("dst").alias("node")).distinct(), "node", "left_anti"))
        if ready.isEmpty():
            tail = left.select("node", F.lit(None).cast("int").alias("level"))
            return tail if out is None else out.union(tail)
        now = ready.select("node", F.lit(depth).alias("level"))
        out = now if out is None else out.union(now)
        left = level(left.join(ready, "node", "left_anti"))
        rest = level(rest.join(ready.withColumnRenamed("node", "src"), "src", "left_anti").select("src", "dst"))
        depth += 1


def d_connected(edges: list[tuple], start: str, evidence: set) -> set:
    """Nodes that an active path joins to ``start`` given the evidence (a small graph, on the driver)."""
    parents, children = {}, {}
    for a, b in edges:
        parents.setdefault(b, set()).add(a)
        children.setdefault(a, set()).add(b)
    above, stack = set(), list(evidence)
    while stack:
        n = stack.pop()
        if n not in above:
            above.add(n)
            stack += parents.get(n, ())
    seen, found, queue = set(), set(), [(start, "up")]
    while queue:
        n, way = queue.pop()
        if (n, way) in seen:
            continue
        seen.add((n, way))
        if n not in evidence:
            found.add(n)
        if way == "up" and n not in evidence:
            queue += [(p, "up") for p in parents.get(n, ())] + [(c, "down") for c in children.get(n, ())]
        elif way == "down":
            if n not in evidence:
                queue += [(c, "down") for c in children.get(n, ())]
            if n in above:
                queue += [(p, "up") for p in parents.get(n, ())]
    return found - {start}


def spanning_tree(weights: dict[tuple, float]) -> list[tuple]:
    """Edges of a maximum spanning tree; ties to the first pair by name."""
    top = {n: n for pair in weights for n in pair}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    out = []
    for a, b in sorted(weights, key=lambda e: (-weights[e], e)):
        x, y = find(a), find(b)
        if x != y:
            top[y] = x
            out.append((a, b))
    return out


def mutual_information(cases: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(a, b, mi)`` of each pair of columns, from one aggregate for all pairs."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")) for a, b in pairs]
    joint = cases.select(F.inline(F.array(*cells))).groupBy("a", "b", "x", "y").agg(F.count("*").alias("n"))
    w = Window.partitionBy("a", "b")  # over value pairs of two columns
    p = F.col("n") / F.sum("n").over(w)
    px = F.sum("n").over(Window.partitionBy("a", "b", "x")) / F.sum("n").over(w)
    py = F.sum("n").over(Window.partitionBy("a", "b", "y")) / F.sum("n").over(w)
    return joint.select("a", "b", (p * F.log(p / (px * py))).alias("t")).groupBy("a", "b").agg(F.sum("t").alias("mi"))


# --- factors -------------------------------------------------------------------------------------


def multiply(left: DataFrame, right: DataFrame, divide: bool = False) -> DataFrame:
    """The product (or quotient, 0/0 = 0) of two factors on their shared variables."""
    shared = [c for c in left.columns if c != "p" and c in right.columns]
    a, b = left.withColumnRenamed("p", "_a"), right.withColumnRenamed("p", "_b")
    joined = a.join(b, shared) if shared else a.crossJoin(b)
    value = F.when(F.col("_b") != 0, F.col("_a") / F.col("_b")).otherwise(0.0) if divide else F.col("_a") * F.col("_b")
    return joined.withColumn("p", value).drop("_a", "_b")


def marginal(factor: DataFrame, variables: Sequence[str], maximise: bool = False) -> DataFrame:
    return factor.groupBy(*variables).agg((F.max if maximise else F.sum)("p").alias("p"))


def normalise(factor: DataFrame, given: Sequence[str] = ()) -> DataFrame:
    """Values divided by their sum, for each configuration of ``given``."""
    total = F.sum("p").over(Window.partitionBy(*given))
    return factor.withColumn("p", F.col("p") / F.nullif(total, F.lit(0.0)))


def observe(factor: DataFrame, evidence: dict) -> DataFrame:
    for variable, value in evidence.items():
        if variable in factor.columns:
            factor = factor.where(F.col(variable) == value)
    return factor


def infer(factors: Sequence[DataFrame], variables: Sequence[str], evidence: dict) -> DataFrame:
    """The posterior of ``variables``: product of all factors, summed and normalised (the oracle for small models)."""
    product = observe(factors[0], evidence)
    for f in factors[1:]:
        product = multiply(product, observe(f, evidence))
    return normalise(marginal(product, variables))


def cpt(cases: DataFrame, child: str, parents: Sequence[str], weight: str | None = None) -> DataFrame:
    """Maximum-likelihood ``(parents, child, n, p)``; unseen child values of a seen configuration have p 0, unseen configurations are uniform.

    All combinations of occurring values are listed.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    counts = cases.groupBy(*parents, child).agg(F.sum(w).alias("n"))
    full = cases.select(child).distinct()
    for c in parents:
        full = full.crossJoin(cases.select(c).distinct())  # values of a few variables
    table = full.join(counts, [*parents, child], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    total = F.sum("n").over(Window.partitionBy(*parents))
    size = F.count("*").over(Window.partitionBy(*parents))
    return table.withColumn("p", F.when(total > 0, F.col("n") / total).otherwise(1 / size))


def family_scores(cases: DataFrame, families: Sequence[tuple[str, tuple[str, ...]]], n: int, arity: dict[str, int], score: str = "BIC") -> dict:
    """The score of each family ``(child, parents)``: log-likelihood less the penalty, all families in one job."""
    cells = []
    for i, (child, parents) in enumerate(families):
        key = F.concat_ws("\x01", *[F.col(p).cast("string") for p in parents]) if parents else F.lit("")
        cells.append(F.struct(F.lit(i).alias("f"), key.alias("pa"), F.col(child).cast("string").alias("x")))
    counts = cases.select(F.inline(F.array(*cells))).groupBy("f", "pa", "x").agg(F.count("*").alias("n"))
    parents_n = counts.groupBy("f", "pa").agg(F.sum("n").alias("m"))
    ll = counts.join(parents_n, ["f", "pa"]).groupBy("f").agg(F.sum(F.col("n") * F.log(F.col("n") / F.col("m"))).alias("ll"))
    found = {r.f: r.ll for r in ll.collect()}
    out = {}
    for i, (child, parents) in enumerate(families):
        free = (arity[child] - 1) * math.prod(arity[p] for p in parents)
        penalty = {"BIC": 0.5 * math.log(n) * free, "AIC": float(free), "none": 0.0}[score]
        out[child, parents] = found.get(i, 0.0) - penalty
    return out


def learn_structure(cases: DataFrame, columns: Sequence[str], score: str = "BIC", max_parents: int = 5, min_progress: float = 1e-5) -> tuple[list[tuple], float]:
    """Hill climbing over directed acyclic graphs: add, delete and reverse; all new families of a step are scored in one job.

    Starts from the empty graph; stops when the best step gains at most
    ``min_progress`` of the absolute score. Returns the edges and the score.
    """
    cases = level(cases.select(*columns))
    r = cases.agg(F.count("*").alias("_n"), *[F.countDistinct(c).alias(c) for c in columns]).first()
    n, arity = r["_n"], {c: r[c] for c in columns}
    parents: dict[str, tuple] = {c: () for c in columns}
    known: dict = {}

    def value(wanted):
        new = sorted({w for w in wanted if w not in known})
        if new:
            known.update(family_scores(cases, new, n, arity, score))

    def leads(a, b, without=None):
        seen, stack = set(), [b]
        while stack:
            x = stack.pop()
            if x == a:
                return True
            for p in parents[x]:
                if (p, x) != without and p not in seen:
                    seen.add(p)
                    stack.append(p)
        return False

    value([(c, ()) for c in columns])
    while True:
        moves = []
        for a, b in itertools.permutations(columns, 2):
            if a in parents[b]:
                less = tuple(x for x in parents[b] if x != a)
                moves.append(("delete", a, b, [(b, less)]))
                if len(parents[a]) < max_parents and not leads(a, b, without=(a, b)):
                    moves.append(("reverse", a, b, [(b, less), (a, tuple(sorted((*parents[a], b))))]))
            elif b not in parents[a] and len(parents[b]) < max_parents and not leads(b, a):
                moves.append(("add", a, b, [(b, tuple(sorted((*parents[b], a))))]))
        value([f for m in moves for f in m[3]])
        gain = lambda m: sum(known[f] - known[f[0], parents[f[0]]] for f in m[3])
        best = max(moves, key=gain, default=None)
        total = sum(known[c, parents[c]] for c in columns)
        if best is None or gain(best) <= min_progress * abs(total):
            return sorted((p, c) for c in columns for p in parents[c]), total
        for child, new in best[3]:
            parents[child] = new


# --- small models on the driver ------------------------------------------------------------------


class BayesNet:
    """Discrete Bayesian networks: exact, propagation and sampling inference over numpy tables."""

    def __init__(self) -> None:
        self.values: dict[str, list] = {}
        self.parents: dict[str, list[str]] = {}
        self.tables: dict[str, np.ndarray] = {}

    def add_node(self, name: str, values: Sequence) -> None:
        self.values[name], self.parents[name] = list(values), []

    def add_arc(self, parent: str, child: str) -> None:
        self.parents[child].append(parent)

    def set_table(self, name: str, table) -> None:
        """Axes: the parents in order, then the node."""
        shape = [len(self.values[v]) for v in (*self.parents[name], name)]
        self.tables[name] = np.asarray(table, float).reshape(shape)

    def fit(self, cases: DataFrame) -> BayesNet:
        """Maximum-likelihood tables from complete cases, one aggregate for each node."""
        for name, parents in self.parents.items():
            table = np.zeros([len(self.values[v]) for v in (*parents, name)])
            for r in cases.groupBy(*parents, name).agg(F.count("*").alias("_n")).collect():
                table[tuple(self.values[v].index(r[v]) for v in (*parents, name))] = r["_n"]
            total = table.sum(axis=-1, keepdims=True)
            self.tables[name] = np.where(total > 0, table / np.where(total > 0, total, 1), 1 / table.shape[-1])
        return self

    def save(self) -> str:
        """The model as JSON."""
        return json.dumps({"values": self.values, "parents": self.parents, "tables": {k: t.tolist() for k, t in self.tables.items()}})

    @classmethod
    def load(cls, text: str) -> BayesNet:
        net, data = cls(), json.loads(text)
        net.values, net.parents = data["values"], data["parents"]
        for name, t in data["tables"].items():
            net.set_table(name, t)
        return net

    def order(self) -> list[str]:
        out: list[str] = []
        while len(out) < len(self.parents):
            ready = [n for n, ps in self.parents.items() if n not in out and all(p in out for p in ps)]
            if not ready:
                raise ValueError("the graph has a cycle")
            out += ready
        return out

    def _factors(self, evidence: dict) -> list[tuple[list[str], np.ndarray]]:
        out = []
        for name, parents in self.parents.items():
            variables, table = [*parents, name], self.tables[name]
            for v in list(variables):
                if v in evidence:
                    table = np.take(table, self.values[v].index(evidence[v]), axis=variables.index(v))
                    variables.remove(v)
            out.append((variables, table))
        return out

    @staticmethod
    def _product(factors):
        variables = list(dict.fromkeys(v for vs, _ in factors for v in vs))
        letter = {v: i for i, v in enumerate(variables)}
        operands = [x for vs, t in factors for x in (t, [letter[v] for v in vs])]
        return variables, lambda keep: np.einsum(*operands, [letter[v] for v in keep])

    def query(self, variables: Sequence[str], evidence: dict) -> np.ndarray:
        """The joint posterior by elimination in order of least new factor."""
        factors = self._factors(evidence)
        hidden = [v for v in self.values if v not in variables and v not in evidence]
        while hidden:
            cost = lambda v: len({x for vs, _ in factors if v in vs for x in vs})  # noqa: E731, B023
            v = min(hidden, key=cost)
            hidden.remove(v)
            mine = [f for f in factors if v in f[0]]
            names, total = self._product(mine)
            keep = [x for x in names if x != v]
            factors = [f for f in factors if v not in f[0]] + [(keep, total(keep))]
        _, total = self._product([*factors, *[([v], np.ones(len(self.values[v]))) for v in variables]])
        out = total(list(variables))
        return out / out.sum()

    def log_likelihood(self, evidence: dict) -> float:
        factors = self._factors(evidence)
        _, total = self._product(factors)
        return float(np.log(total([])))

    def most_probable(self, evidence: dict) -> dict:
        """The most probable values of all unobserved nodes, by max elimination over the full joint of a small model."""
        hidden = [v for v in self.values if v not in evidence]
        _, total = self._product(self._factors(evidence))
        joint = total(hidden)
        return {v: self.values[v][i] for v, i in zip(hidden, np.unravel_index(np.argmax(joint), joint.shape))}

    def propagate(self, variable: str, evidence: dict, rounds: int = 30) -> np.ndarray:
        """Sum-product messages between nodes and factors; exact on trees."""
        factors = self._factors(evidence)
        edges = [(i, v) for i, (vs, _) in enumerate(factors) for v in vs]
        to_variable = {e: np.ones(len(self.values[e[1]])) for e in edges}
        for _ in range(rounds):
            to_factor = {}
            for i, v in edges:
                m = np.ones(len(self.values[v]))
                for j, u in edges:
                    if u == v and j != i:
                        m = m * to_variable[j, u]
                to_factor[i, v] = m / max(m.sum(), 1e-300)
            for i, v in edges:
                vs, t = factors[i]
                for u in vs:
                    if u != v:
                        t = t * to_factor[i, u].reshape([-1 if x == u else 1 for x in vs])
                m = t.sum(axis=tuple(k for k, x in enumerate(vs) if x != v))
                to_variable[i, v] = m / max(m.sum(), 1e-300)
        out = np.ones(len(self.values[variable]))
        for i, v in edges:
            if v == variable:
                out = out * to_variable[i, v]
        return out / out.sum()

    def gibbs(self, spark, variable: str, evidence: dict, chains: int = 8, steps: int = 2000, burn_in: int = 200, seed: int = 0) -> np.ndarray:
        """Posterior by Gibbs sampling, one chain for each group of a Spark job."""
        net = self

        def run(part: pd.DataFrame) -> pd.DataFrame:
            rng = np.random.default_rng([seed, int(part["chain"].iloc[0])])
            hidden = [v for v in net.values if v not in evidence]
            state = {v: net.values[v].index(evidence[v]) if v in evidence else int(rng.integers(len(net.values[v]))) for v in net.values}
            touched = {v: [n for n, ps in net.parents.items() if v == n or v in ps] for v in hidden}
            counts = np.zeros(len(net.values[variable]))
            for t in range(steps + burn_in):
                for v in hidden:
                    p = np.ones(len(net.values[v]))
                    for n in touched[v]:
                        axes = (*net.parents[n], n)
                        p = p * net.tables[n][tuple(slice(None) if x == v else state[x] for x in axes)]
                    state[v] = int(rng.choice(len(p), p=p / p.sum())) if p.sum() > 0 else state[v]
                if t >= burn_in:
                    counts[state[variable]] += 1
            return pd.DataFrame({"value": range(len(counts)), "n": counts})

        rows = spark.range(chains).withColumnRenamed("id", "chain").groupBy("chain").applyInPandas(run, "value long, n double")
        found = {r.value: r.n for r in rows.groupBy("value").agg(F.sum("n").alias("n")).collect()}
        out = np.array([found.get(i, 0.0) for i in range(len(self.values[variable]))])
        return out / out.sum()

    def sample(self, spark, n: int, seed: int = 0) -> DataFrame:
        """``n`` cases in topological order; seeded by row number."""
        df = spark.range(n).withColumnRenamed("id", "rid")
        for name in self.order():
            unit = (F.pmod(F.xxhash64("rid", F.lit(seed), F.lit(name)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
            parents, e = self.parents[name], F.lit(None).cast("string")
            for config in itertools.product(*[range(len(self.values[p])) for p in parents]):
                cumulative = np.cumsum(self.tables[name][config])
                draw = F.lit(self.values[name][-1])
                for i in range(len(cumulative) - 2, -1, -1):
                    draw = F.when(unit < float(cumulative[i]), F.lit(self.values[name][i])).otherwise(draw)
                match = F.lit(True)
                for p, i in zip(parents, config):
                    match = match & (F.col(p) == self.values[p][i])
                e = F.when(match, draw).otherwise(e)
            df = df.withColumn(name, e)
        return df

    def likelihood_weighting(self, spark, variable: str, evidence: dict, n: int = 20000, seed: int = 0) -> DataFrame:
        """``(variable, p)`` from samples that keep the evidence, weighted by its probability; DataFrame operations only."""
        clamped = BayesNet()
        clamped.values, clamped.parents = self.values, self.parents
        clamped.tables = dict(self.tables)
        for v, value in evidence.items():
            one = np.zeros_like(self.tables[v])
            one[..., self.values[v].index(value)] = 1
            clamped.tables[v] = one
        df = clamped.sample(spark, n, seed).withColumn("_w", F.lit(1.0))
        for v, value in evidence.items():
            w = F.lit(0.0)
            for config in itertools.product(*[range(len(self.values[p])) for p in self.parents[v]]):
                match = F.lit(True)
                for p, i in zip(self.parents[v], config):
                    match = match & (F.col(p) == self.values[p][i])
                w = F.when(match, F.lit(float(self.tables[v][(*config, self.values[v].index(value))]))).otherwise(w)
            df = df.withColumn("_w", F.col("_w") * w)
        sums = df.groupBy(variable).agg(F.sum("_w").alias("p"))
        return normalise(sums)

    def expectation_maximisation(self, cases: DataFrame, rounds: int = 20) -> BayesNet:
        """Tables from cases with unknown values: distinct cases are counted once, each round fills them by their posteriors."""
        names = list(self.values)
        distinct = [(r.asDict(), r["_n"]) for r in cases.groupBy(*names).agg(F.count("*").alias("_n")).collect()]
        for _ in range(rounds):
            expected = {n: np.zeros_like(self.tables[n]) for n in names}
            for row, weight in distinct:
                evidence = {v: row[v] for v in names if row[v] is not None}
                for n in names:
                    family = [*self.parents[n], n]
                    free = [v for v in family if v not in evidence]
                    p = self.query(free, evidence) if free else np.array(1.0)
                    index = tuple(slice(None) if v in free else self.values[v].index(evidence[v]) for v in family)
                    expected[n][index] += weight * p
            for n in names:
                total = expected[n].sum(axis=-1, keepdims=True)
                self.tables[n] = np.where(total > 0, expected[n] / np.where(total > 0, total, 1), 1 / expected[n].shape[-1])
        return self


def arranged(rows: DataFrame) -> DataFrame:
    """``rows(series, t, obs)`` with each series in one partition, in order of ``t``."""
    return rows.select("series", "t", "obs").repartition("series").sortWithinPartitions("series", "t")


def by_series(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work(series, times, observations, starts)`` on whole series of ``arranged`` rows, many at a time; it gives a frame.

    Observations are numbers, NaN where unknown; ``starts`` has the place of each series' first row. A task holds one
    batch and the series that it cuts, and no series costs a call of its own.
    """

    def whole(parts: list[pd.DataFrame]) -> pd.DataFrame:
        frame = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        series = frame["series"].to_numpy()
        starts = np.append(0, np.flatnonzero(series[1:] != series[:-1]) + 1)
        return work(series, frame["t"].to_numpy(), frame["obs"].to_numpy(float, na_value=np.nan), starts)

    def run(batches):
        waiting: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            series = batch["series"].to_numpy()
            other = np.flatnonzero(series != series[-1])
            last = int(other[-1]) + 1 if len(other) else 0
            if last == 0 and waiting and waiting[-1]["series"].iloc[-1] != series[0]:
                yield whole(waiting)
                waiting = []
            if last:
                yield whole([*waiting, batch.iloc[:last]])
                waiting = []
            waiting.append(batch.iloc[last:])
        if waiting:
            yield whole(waiting)

    return rows.mapInPandas(run, schema)


def slices(starts: np.ndarray, n: int) -> list[np.ndarray]:
    """The first row of each of the series that begin at ``starts`` of ``n`` rows, then the second of those that have one, and so on."""
    sizes = np.diff(np.append(starts, n))
    order = np.argsort(-sizes, kind="stable")
    starts, sizes, out = starts[order], -sizes[order], []
    for t in range(-int(sizes.min(initial=0))):
        starts = starts[: np.searchsorted(sizes, -t)]
        out.append(starts + t)
    return out


def emitted(emission: np.ndarray, observed: np.ndarray) -> np.ndarray:
    """The probability of each observation in each state, 1 for unknown ones."""
    out, known = np.ones((len(observed), len(emission))), ~np.isnan(observed)
    out[known] = emission.T[observed[known].astype(int)]
    return out


def filter_series(observations: DataFrame, initial, transition, emission) -> DataFrame:
    """Forward filtering of a two-slice model over each ``series`` in order of ``t``: ``(series, t, state, p)``."""
    pi, a, b = (np.asarray(m, float) for m in (initial, transition, emission))

    def work(series, times, observed, starts) -> pd.DataFrame:
        k, p = len(pi), emitted(b, observed)
        for t, at in enumerate(slices(starts, len(series))):
            now = (pi if t == 0 else p[at - 1] @ a) * p[at]
            p[at] = now / now.sum(axis=1, keepdims=True)
        return pd.DataFrame({"series": np.repeat(series, k), "t": np.repeat(times, k), "state": np.tile(np.arange(k), len(times)), "p": p.reshape(-1)})

    return by_series(arranged(observations), work, "series long, t long, state int, p double")
