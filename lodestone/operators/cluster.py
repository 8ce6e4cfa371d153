"""Clustering: k-means, fuzzy c-means, clustering features (summary tree), density and hopping.

Points are ``(id, x)`` with ``x`` an array of doubles. Centres are small lists
(k times dimensions), kept on the driver; everything that grows with the points
stays in DataFrames.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.operators import graph
from lodestone.operators.table import all_of, numbered
from lodestone.plans.levels import forget, level, stored

SMOOTH = 1e-5
#: Coordinates of points that k-means holds on the driver, at most (8 bytes each).
MAX_HELD = 1_000_000
#: Points of a box of the neighbour search, about, and boxes at most; beyond that boxes grow.
LEAF, LEAVES = 2_000, 4_096


def _distances(x: Column, centres: Sequence[Sequence[float]]) -> Column:
    return F.array(*[V.square_distance(x, V.literal(c)) for c in centres])


def _ranked(points: DataFrame, centres: Sequence[Sequence[float]]) -> DataFrame:
    out = points.withColumn("_d", _distances(F.col("x"), centres)).withColumn("d2", F.array_min("_d"))
    return out.withColumn("cluster", (F.array_position("_d", F.col("d2")) - 1).cast("int"))


def assign(points: DataFrame, centres: Sequence[Sequence[float]]) -> DataFrame:
    """``points`` with ``cluster`` (from 0, the first of equally near ones) and squared distance ``d2``."""
    return _ranked(points, centres).drop("_d")


def means(assigned: DataFrame, dims: int, k: int) -> dict[int, tuple[int, list[float]]]:
    """Count and mean of each cluster: k rows."""
    sums = assigned.groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(F.col("x")[i]).alias(f"x{i}") for i in range(dims)])
    return {r.cluster: (r.n, [r[f"x{i}"] for i in range(dims)]) for r in sums.limit(k).collect()}


def first_centres(points: DataFrame, k: int, seed: int = 7) -> list[list[float]]:
    """k points picked by a seeded hash of their ids."""
    return [list(r.x) for r in points.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(k).select("x").collect()]


def _square(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances along the last axis, added in the order of ``vectors.square_distance``, so both give the same bits."""
    total = 0.0
    for i in range(x.shape[-1]):
        total = total + (x[..., i] - y[..., i]) * (x[..., i] - y[..., i])
    return total


def _cluster_of(x: np.ndarray, centres: Sequence[Sequence[float]]) -> np.ndarray:
    """As ``assign``: the first of the nearest centres; a distance that isn't a number is the greatest."""
    d = np.stack([_square(x, np.asarray(c)) for c in centres])
    return (d == np.fmin.reduce(d)).argmax(axis=0)


def _shift(a: Sequence[Sequence[float]], b: Sequence[Sequence[float]]) -> float:
    return float(np.max([math.dist(x, y) for x, y in zip(a, b)]))


def _with_gap(points: DataFrame, centres: Sequence[Sequence[float]]) -> DataFrame:
    """Assigned points with ``gap``: by how much the second centre is farther than the first, rounded down; no limit with one centre."""
    two = F.array_sort("_d")
    gap = F.sqrt(F.get(two, F.lit(1))) * (1 - 1e-12) - F.sqrt("d2")
    return _ranked(points, centres).withColumn("gap", F.coalesce(gap, F.lit(math.inf))).drop("_d")


def _hold(points: DataFrame, centres: Sequence[Sequence[float]], reach: float, n: int, most: int) -> tuple | None:
    """``(counts, sums, x)``: of the points that keep their cluster while no centre moves by more than ``reach``, and the other points.

    None where the others are more than ``most``.
    """
    k, dims = len(centres), len(centres[0])
    counts, sums = np.zeros(k, np.int64), np.zeros((k, dims))
    if math.isfinite(reach):
        now = _with_gap(points, centres)
        firm = (F.col("gap") > 2 * reach) & ~F.isnan("gap")
        for r in now.where(firm).groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("x")[i]).alias(f"x{i}") for i in range(dims)]).collect():
            counts[r.cluster], sums[r.cluster] = r.n, [r[f"x{i}"] for i in range(dims)]
        if n - counts.sum() > most:
            return None
        points = now.where(~firm)
    got = points.select(*[F.col("x")[i].alias(f"x{i}") for i in range(dims)]).toArrow()
    return counts, sums, np.stack([got.column(i).to_numpy() for i in range(dims)], axis=1)


def kmeans(points: DataFrame, centres: Sequence[Sequence[float]], threshold: float = 0.001, max_loops: int = 500) -> tuple[list[list[float]], DataFrame]:
    """Lloyd's iterations until the share of points that change cluster is at most ``threshold``.

    An empty cluster keeps its centre, and a point without all coordinates has no cluster. Returns the centres and the points
    with the clusters of the last assignment.

    All rounds assign all points, in one of two ways. A round over the table is one aggregate. It also tells how far points are
    from a change: the gap between the distances of their two nearest centres. While no centre is farther than half the gap from
    where it was, a point keeps its cluster. So the sums of most points stand for many rounds, in which only the others, of
    which at most ``MAX_HELD`` coordinates are held on the driver, are assigned anew. Where that bound leaves no such
    rounds, all of them go over the table.
    """
    centres = [list(map(float, c)) for c in centres]
    k, dims = len(centres), len(centres[0])
    most = max(MAX_HELD // dims, 1)
    rows = points.where((F.size("x") == dims) & F.forall("x", lambda v: v.isNotNull())).select("x")
    n = rows.count()
    before, anchor, reach = None, centres, math.inf
    if n <= most:
        held = _hold(rows, centres, reach, n, most)
    else:
        rows, held = level(rows), None
    was = None
    for _ in range(max_loops + 1):
        if held is not None:
            counts, sums, x = held
            now = _cluster_of(x, centres)
            moved = n if before is None else int((now != was).sum())
            was = now
            counts = counts + np.bincount(now, minlength=k)
            sums = sums + np.stack([np.bincount(now, x[:, i], k) for i in range(dims)], axis=1)
            found = {c: (sums[c] / counts[c]).tolist() for c in range(k) if counts[c]}
        else:
            # One job: both assignments are expressions over the points, so nothing is joined.
            table = rows if before is None else assign(rows, before).select("x", F.col("cluster").alias("_old"))
            change = F.lit(1) if before is None else (F.col("cluster") != F.col("_old")).cast("int")
            aggs = [F.count("*").alias("n"), F.sum(change).alias("moved"), F.percentile_approx("gap", 0.9 * most / n).alias("gap")]
            got = _with_gap(table, centres).groupBy("cluster").agg(*aggs, *[F.avg(F.col("x")[i]).alias(f"x{i}") for i in range(dims)]).collect()
            moved, found = sum(r.moved for r in got), {r.cluster: [r[f"x{i}"] for i in range(dims)] for r in got}
            anchor, reach = centres, float(np.min([r.gap for r in got])) / 2
        before, centres = centres, [found.get(c, old) for c, old in enumerate(centres)]
        if moved <= threshold * n:
            break
        inside = _shift(anchor, centres) <= reach * (1 - 1e-9)
        if held is None and inside:
            held = _hold(rows, anchor, reach, n, most)
            was = None if held is None else _cluster_of(held[2], before)
        elif not inside:
            held = None
    return centres, assign(points, before)


def zscore(points: DataFrame, dims: int) -> DataFrame:
    """Each dimension with mean 0 and population standard deviation 1."""
    parts = [f(F.col("x")[i]).alias(f"{n}{i}") for i in range(dims) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    r = points.agg(*parts).first()
    spread = [r[f"s{i}"] or 1.0 for i in range(dims)]
    return points.withColumn("x", V.affine(F.col("x"), [1 / s for s in spread], [-r[f"m{i}"] / s for i, s in enumerate(spread)]))


def memberships(points: DataFrame, centres: Sequence[Sequence[float]], q: float) -> DataFrame:
    """``points`` with ``u``, the array of fuzzy memberships with fuzzifier q."""
    near = F.transform(_distances(F.col("x"), centres), lambda d: F.pow(1 / (d + SMOOTH), F.lit(1 / (q - 1))))
    out = points.withColumn("_w", near).withColumn("_sum", V.total(F.col("_w")) + SMOOTH)
    return out.withColumn("u", F.transform("_w", lambda w: w / F.col("_sum"))).drop("_w", "_sum")


def fuzzy_cmeans(points: DataFrame, centres: Sequence[Sequence[float]], q: float = 2.0, threshold: float = 0.001, max_loops: int = 100):
    """Fuzzy c-means until no centre moves by more than ``threshold``; returns the centres."""
    centres = [list(map(float, c)) for c in centres]
    dims = len(centres[0])
    for _ in range(max_loops):
        weighted = memberships(points, centres, q).select("x", F.transform("u", lambda u: F.pow(u, F.lit(q))).alias("w"))
        sums = []
        for c in range(len(centres)):
            w = F.col("w")[c]
            sums += [F.sum(w).alias(f"w{c}"), *[F.sum(w * F.col("x")[i]).alias(f"s{c}_{i}") for i in range(dims)]]
        r = weighted.agg(*sums).first()
        moved = [[r[f"s{c}_{i}"] / r[f"w{c}"] for i in range(dims)] for c in range(len(centres))]
        shift = max(math.dist(a, b) for a, b in zip(centres, moved))
        centres = moved
        if shift <= threshold:
            break
    return centres


def fuzzy_validity(points: DataFrame, centres: Sequence[Sequence[float]], q: float) -> DataFrame:
    """Compactness over separation, times a penalty for small clusters; one row.

    The separation is the squared mean, over centres, of the least distance to a
    later centre.
    """
    d = _distances(F.col("x"), centres)
    spread = memberships(points, centres, q).withColumn("_v", V.total(F.zip_with(d, "u", lambda a, u: a * F.pow(u, F.lit(q)))))
    spread = spread.agg(F.sum("_v").alias("compactness"), F.count("*").alias("n"))
    sizes = assign(points, centres).groupBy("cluster").agg(F.count("*").alias("m"))
    full = sizes.agg(F.sum(1 / (1 + F.col("m"))).alias("p"), F.count("*").alias("k"))
    penalty = (F.col("p") + (len(centres) - F.col("k"))) / len(centres)
    gaps = [min(math.dist(centres[i], centres[j]) for j in range(i + 1, len(centres))) for i in range(len(centres) - 1)]
    separation = (sum(gaps) / (len(centres) - 1)) ** 2
    out = spread.crossJoin(full).select("compactness", F.lit(separation).alias("separation"), penalty.alias("penalty"), "n")
    return out.select("*", (F.col("compactness") / (F.col("n") * F.col("separation"))).alias("xie_beni_variant"))


# --- clustering features -------------------------------------------------------------------------


def features(points: DataFrame, group: str, dims: int) -> DataFrame:
    """``(group, n, sx, sxx)``: additive summaries, partially aggregated before the shuffle."""
    sums = [F.sum(F.col("x")[i]).alias(f"_s{i}") for i in range(dims)]
    out = points.groupBy(group).agg(F.count("*").alias("n"), F.sum(V.dot(F.col("x"), F.col("x"))).alias("sxx"), *sums)
    return out.select(group, "n", F.array(*[f"_s{i}" for i in range(dims)]).alias("sx"), "sxx")


def merge_features(cfs: DataFrame, group: str, dims: int) -> DataFrame:
    sums = [F.sum(F.col("sx")[i]).alias(f"_s{i}") for i in range(dims)]
    out = cfs.groupBy(group).agg(F.sum("n").alias("n"), F.sum("sxx").alias("sxx"), *sums)
    return out.select(group, "n", F.array(*[f"_s{i}" for i in range(dims)]).alias("sx"), "sxx")


def quality(cfs: DataFrame) -> DataFrame:
    """Overall average diameter and radius, from the features alone."""
    n, sx, sxx = F.col("n"), F.col("sx"), F.col("sxx")
    within = F.sum(2 * (n * sxx - V.dot(sx, sx)))
    spread = F.sum(sxx - V.dot(sx, sx) / n)
    return cfs.agg(F.sqrt(within / F.sum(n * (n - 1))).alias("average_diameter"), F.sqrt(spread / F.sum(n)).alias("average_radius"))


class _Leaf:
    """A bounded set of clustering features; the threshold grows until they fit."""

    def __init__(self, limit: int, threshold: float) -> None:
        self.limit, self.threshold = limit, threshold
        self.n, self.sx, self.sxx = np.zeros(0), None, np.zeros(0)

    def _diameter2(self, n, sx, sxx):
        return np.where(n > 1, np.maximum(2 * (n * sxx - (sx * sx).sum(-1)) / np.maximum(n * (n - 1), 1), 0), 0)

    def insert(self, n: float, sx: np.ndarray, sxx: float) -> None:
        if len(self.n):
            d = ((self.sx / self.n[:, None] - sx / n) ** 2).sum(axis=1)
            i = int(np.argmin(d))
            if self._diameter2(self.n[i] + n, self.sx[i] + sx, self.sxx[i] + sxx) <= self.threshold**2:
                self.n[i] += n
                self.sx[i] += sx
                self.sxx[i] += sxx
                return
        self.n = np.append(self.n, n)
        self.sx = sx[None, :].copy() if self.sx is None else np.vstack([self.sx, sx])
        self.sxx = np.append(self.sxx, sxx)
        if len(self.n) > self.limit:
            self.rebuild()

    def rebuild(self) -> None:
        """Raise the threshold to the typical diameter of the nearest pairs and insert all features again."""
        centre = self.sx / self.n[:, None]
        d = ((centre[:, None, :] - centre[None, :, :]) ** 2).sum(axis=2)
        np.fill_diagonal(d, np.inf)
        j = d.argmin(axis=1)
        pair = self._diameter2(self.n + self.n[j], self.sx + self.sx[j], self.sxx + self.sxx[j])
        self.threshold = max(float(np.sqrt(np.median(pair))), self.threshold * 1.5, 1e-12)
        n, sx, sxx = self.n, self.sx, self.sxx
        self.n, self.sx, self.sxx = np.zeros(0), None, np.zeros(0)
        for a in zip(n, sx, sxx):
            self.insert(*a)


def summarise(points: DataFrame, dims: int, limit: int = 500, threshold: float = 0.0) -> DataFrame:
    """Phase one: in one pass, each partition becomes at most ``limit`` features ``(n, sx, sxx)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaf = _Leaf(limit, threshold)
        for batch in batches:
            for x in batch["x"]:
                x = np.asarray(x, float)
                leaf.insert(1.0, x, float(x @ x))
        if len(leaf.n):
            yield pd.DataFrame({"n": leaf.n.astype(np.int64), "sx": list(leaf.sx), "sxx": leaf.sxx})

    return points.select("x").mapInPandas(run, "n long, sx array<double>, sxx double")


def condense(cfs: DataFrame, dims: int, limit: int = 1000, noise: float = 0.25) -> pd.DataFrame:
    """Phase two: merge features until at most ``limit`` are left, in halving rounds of partitions; then drop those far smaller than average."""
    parts = max(1, cfs.rdd.getNumPartitions())
    while parts > 1:
        parts = max(1, parts // 8)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            leaf = _Leaf(limit, 0.0)
            for b in batches:
                for n, sx, sxx in zip(b["n"], b["sx"], b["sxx"]):
                    leaf.insert(float(n), np.asarray(sx, float), float(sxx))
            if len(leaf.n):
                yield pd.DataFrame({"n": leaf.n.astype(np.int64), "sx": list(leaf.sx), "sxx": leaf.sxx})

        cfs = level(cfs.repartition(parts).mapInPandas(run, "n long, sx array<double>, sxx double"))
    out = cfs.toPandas()  # at most `limit` rows
    return out[out["n"] >= noise * out["n"].mean()].reset_index(drop=True) if noise and len(out) else out


def agglomerate(cfs: pd.DataFrame, k: int, kind: str = "D2") -> list[list[float]]:
    """Phase three: merge the two nearest features until k are left; returns centres. For some thousand features on the driver."""
    n, sx, sxx = cfs["n"].to_numpy(float), np.array(cfs["sx"].tolist(), float), cfs["sxx"].to_numpy(float)

    def between(i: int) -> np.ndarray:
        if kind == "D0":
            return ((sx / n[:, None] - sx[i] / n[i]) ** 2).sum(axis=1)
        if kind == "D2":
            return np.maximum((n[i] * sxx + n * sxx[i] - 2 * sx @ sx[i]) / (n * n[i]), 0)
        if kind == "D4":
            both = sx + sx[i]
            return np.maximum((sx**2).sum(1) / n + (sx[i] ** 2).sum() / n[i] - (both**2).sum(1) / (n + n[i]), 0)
        raise ValueError(kind)

    alive = np.ones(len(n), bool)
    d = np.array([between(i) for i in range(len(n))])
    np.fill_diagonal(d, np.inf)
    while alive.sum() > k:
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        n[i], sx[i], sxx[i], alive[j] = n[i] + n[j], sx[i] + sx[j], sxx[i] + sxx[j], False
        row = between(i)
        row[~alive], row[i] = np.inf, np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
    return (sx[alive] / n[alive][:, None]).tolist()


def birch(points: DataFrame, dims: int, k: int, limit: int = 500, refine: int = 1) -> tuple[list[list[float]], DataFrame]:
    """All phases: summarise, condense, agglomerate, and ``refine`` passes of reassignment; returns centres and assigned points."""
    centres = agglomerate(condense(summarise(points, dims, limit), dims, limit), k)
    for _ in range(refine):
        for c, (_, mean) in means(assign(points, centres), dims, len(centres)).items():
            centres[c] = mean
    return centres, assign(points, centres)


def noise_labels(points: DataFrame, centres: Sequence[Sequence[float]], dims: int, radii: float = 4.0) -> DataFrame:
    """Assigned points; the cluster is null where the distance is beyond ``radii`` root mean square radii of the cluster."""
    assigned = assign(points, centres)
    spread = assigned.groupBy("cluster").agg(F.avg("d2").alias("_r2"))
    return assigned.join(spread, "cluster").withColumn("cluster", F.when(F.col("d2") <= radii * radii * F.col("_r2"), F.col("cluster"))).drop("_r2")


def kernel_density(cfs: DataFrame, grid: DataFrame, width: float, dims: int) -> DataFrame:
    """``grid(id, x)`` with the normal-kernel density of the features, each of variance radius^2 / dims + width^2 per dimension."""
    n, sx, sxx = F.col("n"), F.col("sx"), F.col("sxx")
    var = V.cf_radius2(n, sx, sxx) / dims + width * width
    cf = cfs.select("n", V.scale(sx, 1 / n).alias("_c"), var.alias("_v"))
    total = cfs.agg(F.sum("n").alias("_all"))
    term = n * F.exp(-V.square_distance(F.col("x"), F.col("_c")) / (2 * F.col("_v"))) / F.pow(2 * F.pi() * F.col("_v"), F.lit(dims / 2))
    pairs = grid.crossJoin(F.broadcast(cf)).crossJoin(F.broadcast(total))  # both are bounded: a grid and condensed features
    return pairs.groupBy("id").agg((F.sum(term) / F.max("_all")).alias("density"))


# --- neighbours and hopping ----------------------------------------------------------------------


def _cells(x: Column, dims: int, size: float) -> list[Column]:
    return [F.floor(x[i] / size).cast("long") for i in range(dims)]


def within(points: DataFrame, others: DataFrame, dims: int, radius: float) -> DataFrame:
    """``(id, other, d2)`` for all pairs within the radius: an equi-join on grid cells, then the exact test."""
    a = points.select("id", "x", F.array(*_cells(F.col("x"), dims, radius)).alias("_cell"))
    steps = F.array(*[F.lit(v).cast("long") for v in (-1, 0, 1)])
    for i in range(dims):
        moved = F.array(*[F.col("_cell")[j] + F.col("_step") if j == i else F.col("_cell")[j] for j in range(dims)])
        a = a.withColumn("_step", F.explode(steps)).withColumn("_cell", moved)
    b = others.select(F.col("id").alias("other"), F.col("x").alias("_y"), F.array(*_cells(F.col("x"), dims, radius)).alias("_cell"))
    d2 = V.square_distance(F.col("x"), F.col("_y"))
    return a.join(b, "_cell").select("id", "other", d2.alias("d2")).where(F.col("d2") <= radius * radius)


class _Tree:
    """Boxes that halve space at medians of sampled points: where points lie, and which boxes a ball meets."""

    def __init__(self, sample: np.ndarray, leaves: int) -> None:
        self.dim, self.cut, self.below, self.above = [], [], [], []  # by node; a leaf has dimension -1 and its number in ``below``
        self.leaves = 0
        self._split(sample, leaves)
        self.dim, self.cut, self.below, self.above = (np.array(v) for v in (self.dim, self.cut, self.below, self.above))

    def _split(self, x: np.ndarray, leaves: int) -> int:
        node = len(self.dim)
        for column in (self.dim, self.cut, self.below, self.above):
            column.append(-1)
        spread = x.max(axis=0) - x.min(axis=0) if len(x) else np.zeros(1)
        d = int(spread.argmax())
        if leaves < 2 or not spread[d] > 0:
            self.below[node], self.leaves = self.leaves, self.leaves + 1
            return node
        values = np.sort(x[:, d])
        cut = values[(len(values) - 1) * (leaves // 2) // leaves]
        cut = cut if cut < values[-1] else values[values < values[-1]][-1]
        self.dim[node], self.cut[node] = d, float(cut)
        self.below[node] = self._split(x[x[:, d] <= cut], leaves // 2)
        self.above[node] = self._split(x[x[:, d] > cut], leaves - leaves // 2)
        return node

    def place(self, x: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows := rows[self.dim[node[rows]] >= 0]):
            at = node[rows]
            node[rows] = np.where(x[rows, self.dim[at]] <= self.cut[at], self.below[at], self.above[at])
        return self.below[node]

    def met(self, x: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of x, leaves) where the box of the leaf isn't farther than the row's squared distance."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        todo = [(0, np.arange(len(x)), np.zeros(x.shape))]  # with the distance from the box in each dimension
        while todo:
            node, rows, away = todo.pop()
            d = self.dim[node]
            if d < 0:
                out.append((rows, np.full(len(rows), self.below[node])))
                continue
            gap = x[rows, d] - self.cut[node]
            for child, far in ((self.below[node], gap > 0), (self.above[node], gap <= 0)):
                side = away.copy()
                side[far, d] = np.maximum(np.abs(gap[far]), side[far, d])
                near = _square(side, np.zeros_like(side)) <= d2[rows]
                if near.any():
                    todo.append((child, rows[near], side[near]))
        return np.concatenate([r for r, _ in out]), np.concatenate([leaf for _, leaf in out])


def _least(d: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k least values of each row, in order; ties to the first column."""
    if d.shape[1] > k:
        found = np.sort(np.argpartition(d, k - 1, axis=1)[:, :k], axis=1)
        most = np.take_along_axis(d, found, axis=1).max(axis=1)
        tied = (d <= most[:, None]).sum(axis=1) > k
        found[tied] = np.sort(np.argsort(d[tied], axis=1, kind="stable")[:, :k], axis=1)
    else:
        found = np.broadcast_to(np.arange(d.shape[1]), d.shape)
    order = np.argsort(np.take_along_axis(d, found, axis=1), axis=1, kind="stable")
    return np.take_along_axis(found, order, axis=1)


def _search(p: np.ndarray, q: np.ndarray, k: int, reach: np.ndarray, size: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances and rows of the k points of ``p`` nearest to each of ``q``, within ``reach``; ties to the first row.

    Places that stay empty have the row ``len(p)``. Points lie in boxes of about ``size``: the box of the query comes first, then those that the ball meets.
    """
    d2, row = np.full((len(q), k), np.inf), np.full((len(q), k), len(p))
    tree = _Tree(p, -(-len(p) // size))
    home, where = tree.place(q), tree.place(p)
    by_leaf = np.argsort(where, kind="stable")
    starts = np.searchsorted(where[by_leaf], np.arange(tree.leaves + 1))

    def ask(queries: np.ndarray, leaves: np.ndarray) -> None:
        order = np.argsort(leaves, kind="stable")
        queries, leaves = queries[order], leaves[order]
        ends = np.searchsorted(leaves, np.arange(tree.leaves + 1))
        for leaf in np.unique(leaves):
            at = by_leaf[starts[leaf] : starts[leaf + 1]]
            for i in range(ends[leaf], ends[leaf + 1], 2048) if len(at) else ():
                rows = queries[i : min(i + 2048, ends[leaf + 1])]
                d = _square(q[rows][:, None], p[at][None])
                best = _least(d, k)
                both = np.concatenate([d2[rows], np.take_along_axis(d, best, axis=1)], axis=1), np.concatenate([row[rows], at[best]], axis=1)
                first = np.lexsort((both[1], both[0]), axis=1)[:, :k]
                d2[rows], row[rows] = (np.take_along_axis(v, first, axis=1) for v in both)

    ask(np.arange(len(q)), home)
    rows, leaves = tree.met(q, np.minimum(d2[:, -1], reach))
    other = leaves != home[rows]
    ask(rows[other], leaves[other])
    row[d2 > reach[:, None]] = len(p)
    return d2, row


def _coordinates(table: pa.Table, dims: int) -> np.ndarray:
    return table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _lists(ids: pa.Array, d2: np.ndarray, row: np.ndarray) -> pa.Array:
    """Arrow lists of ``(d2, other)`` of the rows found."""
    found = row < len(ids)
    ends = np.concatenate([[0], found.sum(axis=1).cumsum()])
    pairs = pa.StructArray.from_arrays([pa.array(d2[found]), ids.take(pa.array(row[found]))], ["d2", "other"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)


def _by_id(table: pa.Table) -> pa.Table:
    return table.take(pc.sort_indices(table["id"]))


def nearest_neighbours(points: DataFrame, k: int, dims: int) -> DataFrame:
    """``(id, other, d2, rank)``: the k nearest points of each (itself included) by the first ``dims`` coordinates, ties by id; exact.

    Space is cut into boxes of some thousand points, each searched in one task. A point whose ball of k neighbours meets
    other boxes asks those too, once. Of points in one place the k with the least ids are searched, as the others can't be
    neighbours, but have the same ones. The sample that boxes are cut by decides their sizes only. Points without all coordinates, or with
    infinite ones, neither are nor have neighbours.
    """
    spark, kind = points.sparkSession, points.schema["id"].dataType.simpleString()
    coordinates = [F.get("x", F.lit(i)) for i in range(dims)]
    whole = points.where(all_of([F.abs(c) < math.inf for c in coordinates])).select("id", F.array(*[c.cast("double") + 0.0 for c in coordinates]).alias("x"))
    few = level(whole.withColumn("_nth", F.row_number().over(Window.partitionBy("x").orderBy("id"))).where(F.col("_nth") <= k))
    n = few.count()
    near = f"array<struct<d2:double,other:{kind}>>"
    if not n:
        return spark.createDataFrame([], f"id {kind}, other {kind}, d2 double, rank int")
    places, k = k, min(k, n)
    leaves = max(1, min(LEAVES, n // LEAF))
    sample = few.where(F.pmod(F.xxhash64("id", "x"), F.lit(max(1, n // (32 * leaves)))) == 0).select("x").toArrow() if leaves > 1 else None
    tree = _Tree(np.zeros((0, dims)) if sample is None else _coordinates(sample, dims), leaves)
    parts = min(tree.leaves, 4 * spark.sparkContext.defaultParallelism)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = tree.place(_coordinates(pa.Table.from_batches([b]), dims))
            yield pa.RecordBatch.from_arrays([b["id"], b["x"], pa.array(leaf, pa.int32())], ["id", "x", "leaf"])

    def inside(table: pa.Table) -> pa.Table:
        table = _by_id(table)
        ids, x, leaf = table["id"].combine_chunks(), _coordinates(table, dims), table["leaf"][0].as_py()
        d2, row = _search(x, x, k, np.full(len(x), np.inf))
        rows, met = tree.met(x, d2[:, -1])
        rows, met = rows[met != leaf], met[met != leaf]
        order, ends = np.argsort(rows, kind="stable"), np.concatenate([[0], np.bincount(rows, minlength=len(x)).cumsum()])
        others = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(met[order], pa.int32()))
        return pa.table({"id": ids, "x": table["x"], "near": _lists(ids, d2, row), "reach": d2[:, -1], "others": others})

    def outside(asked: pa.Table, held: pa.Table) -> pa.Table:
        held = _by_id(held)
        d2, row = _search(_coordinates(held, dims), _coordinates(asked, dims), k, asked["reach"].to_numpy())
        return pa.table({"id": asked["id"], "near": _lists(held["id"].combine_chunks(), d2, row)})

    placed = few.select("id", "x").mapInArrow(place, f"id {kind}, x array<double>, leaf int").repartition(parts, "leaf")
    own = level(placed.groupBy("leaf").applyInArrow(inside, f"id {kind}, x array<double>, near {near}, reach double, others array<int>"))
    asked = own.select("id", "x", "reach", F.explode("others").alias("leaf")).repartition(parts, "leaf")
    more = asked.groupBy("leaf").cogroup(placed.groupBy("leaf")).applyInArrow(outside, f"id {kind}, near {near}")
    open_ = own.where(F.size("others") > 0).select("id", "near").union(more)
    merged = open_.groupBy("id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    found = own.where(F.size("others") == 0).select("id", "near").union(merged).select("id", F.posexplode("near").alias("_at", "_n"))
    out = found.select("id", "_n.other", "_n.d2", (F.col("_at") + 1).alias("rank"))
    if not few.where(F.col("_nth") == places).isEmpty():
        # Further points in a place: they have the k least ids of it as neighbours. A place with many points is dealt to several tasks.
        full = few.groupBy("x").agg(F.sort_array(F.collect_list("id")).alias("_ids")).where(F.size("_ids") == places)
        full = full.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(15))))
        rest = whole.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(16)).cast("int")).join(full, ["x", "_part"]).where(F.col("id") > F.element_at("_ids", -1))
        rest = rest.select("id", F.posexplode("_ids").alias("_at", "other"))
        out = out.union(rest.select("id", "other", F.lit(0.0).alias("d2"), (F.col("_at") + 1).alias("rank")))
    return level(out)


def spline_density(neighbours: DataFrame, mass: float = 1.0, symmetric: bool = True) -> DataFrame:
    """``(id, density)`` by cubic-spline smoothing over the k nearest; the reach is the distance of the last one."""
    reach = neighbours.groupBy("id").agg(F.max("d2").alias("h2"))
    rows = neighbours.join(reach, "id").where("h2 > 0")
    h3 = F.pow(4 / F.col("h2"), F.lit(1.5)) / F.pi()
    value = V.spline(F.col("d2"), F.col("h2")) * h3 * mass
    if not symmetric:
        return rows.groupBy("id").agg(F.sum(value).alias("density"))
    half = rows.select("id", "other", (value / 2).alias("v"))
    both = half.select("id", "v").union(half.select(F.col("other").alias("id"), "v"))
    return both.groupBy("id").agg(F.sum("v").alias("density"))


def hop(neighbours: DataFrame, densities: DataFrame, hops: int, threshold: float = 0.0) -> DataFrame:
    """``(id, next)``: the densest of the first ``hops`` neighbours, ties to the least id; only points at or above the threshold."""
    dense = densities.where(F.col("density") >= threshold)
    rows = neighbours.where(F.col("rank") <= hops).join(dense.select("id"), "id", "left_semi")
    rows = rows.join(dense.select(F.col("id").alias("other"), "density"), "other")
    return rows.groupBy("id").agg(F.max_by("other", F.struct("density", -F.col("other"))).alias("next"))


def follow(pointers: DataFrame) -> DataFrame:
    """``(id, root)``: the end of each point's path, by pointer doubling (a logarithmic number of joins)."""
    now = stored(pointers.select("id", F.col("next").alias("root")))
    while True:
        up = now.select(F.col("id").alias("root"), F.col("root").alias("_top"))
        new = stored(now.join(up, "root", "left").select("id", F.coalesce("_top", "root").alias("root")))
        done = new.join(now.withColumnRenamed("root", "_old"), "id").where("root <> _old").isEmpty()
        forget(now)
        if done:
            return new
        now = new


def group_sizes(groups: DataFrame, densities: DataFrame) -> DataFrame:
    """``(root, size, peak, rank)``: groups by size, largest first."""
    sizes = groups.join(densities, "id").groupBy("root").agg(F.count("*").alias("size"), F.max("density").alias("peak"))
    return numbered(sizes, [F.desc("size"), F.col("root")], "rank").withColumn("rank", (F.col("rank") + 1).cast("int"))


def boundaries(neighbours: DataFrame, groups: DataFrame, densities: DataFrame, depth: int) -> DataFrame:
    """``(a, b, saddle)``: for neighbouring groups, the greatest mean density of a pair of neighbours across the border."""
    member = groups.join(densities, "id")
    rows = neighbours.where((F.col("rank") <= depth) & (F.col("id") != F.col("other"))).select("id", "other")
    rows = rows.join(member.select("id", F.col("root").alias("g1"), F.col("density").alias("d1")), "id")
    rows = rows.join(member.select(F.col("id").alias("other"), F.col("root").alias("g2"), F.col("density").alias("d2")), "other").where("g1 <> g2")
    return rows.groupBy(F.least("g1", "g2").alias("a"), F.greatest("g1", "g2").alias("b")).agg(F.max((F.col("d1") + F.col("d2")) / 2).alias("saddle"))


def regroup(sizes: DataFrame, borders: DataFrame, peak: float, saddle: float, min_size: int = 1) -> DataFrame:
    """``(root, merged)``: groups with a peak of at least ``peak`` merge over borders of at least ``saddle``.

    Lower groups join the neighbour with the highest border, if there is one.
    Groups smaller than ``min_size`` have no merged group. The group graph has a
    row for each group and border; merged groups are its components, named by their least root.
    """
    sizes, borders = stored(sizes), stored(borders)
    high = sizes.where(F.col("peak") >= peak).select("root")
    strong = borders.where(F.col("saddle") >= saddle).join(high.withColumnRenamed("root", "a"), "a", "left_semi").join(high.withColumnRenamed("root", "b"), "b", "left_semi")
    labels = graph.components(strong.select(F.col("a").alias("src"), F.col("b").alias("dst")), high).select(F.col("node").alias("root"), F.col("component").alias("merged"))
    low = sizes.join(high, "root", "left_anti").select("root")
    sides = borders.select(F.col("a").alias("root"), F.col("b").alias("to"), "saddle").union(borders.select(F.col("b").alias("root"), F.col("a").alias("to"), "saddle"))
    joined = low.join(sides, "root").join(labels.select(F.col("root").alias("to"), "merged"), "to").groupBy("root").agg(F.max_by("merged", F.struct("saddle", -F.col("to"))).alias("merged"))
    out = labels.union(joined).join(sizes.select("root", "size"), "root")
    total = out.groupBy("merged").agg(F.sum("size").alias("_n")).where(F.col("_n") >= min_size)
    return sizes.select("root").join(out.join(total, "merged").select("root", "merged"), "root", "left")


def box_counts(points: DataFrame, dims: int, sizes: Sequence[float]) -> DataFrame:
    """``(size, boxes)``: occupied boxes for each box size, in one pass over the points."""
    boxes = [F.struct(F.lit(float(s)).alias("size"), F.array(*_cells(F.col("x"), dims, s)).alias("box")) for s in sizes]
    return points.select(F.inline(F.array(*boxes))).distinct().groupBy("size").agg(F.count("*").alias("boxes"))


def density_cut(groups: DataFrame, densities: DataFrame, threshold: float) -> DataFrame:
    """``(id, root)`` with null for points whose density is below the threshold."""
    return groups.join(densities, "id").select("id", F.when(F.col("density") >= threshold, F.col("root")).alias("root"))


def overlapping(cfs: DataFrame, dims: int) -> DataFrame:
    """``(id, other)``: the pairs of ``cfs(id, n, sx, sxx)`` whose balls (centre and radius) overlap.

    Pairs are found on grid cells as wide as two of the largest radii; cells need few dimensions.
    """
    r = F.sqrt(V.cf_radius2(F.col("n"), F.col("sx"), F.col("sxx")))
    balls = cfs.select("id", V.scale(F.col("sx"), 1 / F.col("n")).alias("x"), r.alias("r"))
    widest = balls.agg(F.max("r")).first()[0] or 0.0
    near = within(balls.select("id", "x"), balls.select("id", "x"), dims, max(2 * widest, 1e-9)).where("id < other")
    near = near.join(balls.select("id", F.col("r").alias("r1")), "id").join(balls.select(F.col("id").alias("other"), F.col("r").alias("r2")), "other")
    return near.where(F.sqrt("d2") <= F.col("r1") + F.col("r2")).select("id", "other")


def kd_leaves(points: DataFrame, depth: int, dims: int) -> DataFrame:
    """``(id, leaf)``: the leaf, from 1 at the root by doubling, of a tree that halves each node at the median of one dimension.

    The dimensions take turns; a point goes left if it isn't above the node's lower median. A level is one aggregate and a join
    with the medians of its nodes, of which there are at most two to the power of the level.
    """
    now = points.select("id", "x", F.lit(1).cast("long").alias("leaf"))
    for k in range(depth):
        v = F.col("x")[k % dims]
        cuts = now.groupBy("leaf").agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY x[{k % dims}])").alias("_cut"))
        now = now.join(cuts, "leaf").select("id", "x", (F.col("leaf") * 2 + (v > F.col("_cut")).cast("long")).alias("leaf"))
    return now.select("id", "leaf")


def point_density(points: DataFrame, grid: DataFrame, width: float, dims: int) -> DataFrame:
    """``grid(id, x)`` with the mean normal-kernel density of the points; the grid is a bounded list of places."""
    term = F.exp(-V.square_distance(F.col("x"), F.col("_p")) / (2 * width * width)) / (2 * math.pi * width * width) ** (dims / 2)
    return points.select(F.col("x").alias("_p")).crossJoin(F.broadcast(grid)).groupBy("id").agg(F.avg(term).alias("density"))


def cluster_summary(assigned: DataFrame, dims: int) -> DataFrame:
    """``(cluster, n, center, radius)`` of assigned points."""
    cf = features(assigned, "cluster", dims)
    n = F.col("n").cast("double")
    return cf.select("cluster", "n", V.scale(F.col("sx"), 1 / n).alias("center"), F.sqrt(V.cf_radius2(n, F.col("sx"), F.col("sxx"))).alias("radius"))


def next_threshold(history: Sequence[tuple[int, float]], points: int) -> float:
    """The squared threshold at which ``points`` points should fit, from (points, squared threshold) seen so far.

    A line is fitted to the logarithms by least squares; with fewer than two, or no growth, the last threshold is doubled.
    """
    known = [(math.log(n), math.log(t)) for n, t in history if n > 0 and t > 0]
    last = history[-1][1] if history else 0.0
    if len(known) < 2:
        return 2 * last if last else 1e-12
    mx, my = (sum(v) / len(known) for v in zip(*known))
    spread = sum((x - mx) ** 2 for x, _ in known)
    slope = sum((x - mx) * (y - my) for x, y in known) / spread if spread else 0.0
    guess = math.exp(my + slope * (math.log(max(points, 1)) - mx)) if slope > 0 else 0.0
    return max(guess, 2 * last if guess <= last else guess)
