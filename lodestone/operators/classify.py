"""Classification and feature ranking: decision trees, naive and full Bayes, support vector machines.

Rows are ``(rid, class, attributes...)``. Models are small tables or arrays;
what grows with the rows stays in DataFrames.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.plans.levels import level

# --- decision trees ------------------------------------------------------------------------------


def unpivot(df: DataFrame, keys: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """Long form: keys, ``attr``, ``val``."""
    cells = [F.struct(F.lit(a).alias("attr"), F.col(a).cast("double").alias("val")) for a in attributes]
    return df.select(*keys, F.inline(F.array(*cells)))


def running_sums(df: DataFrame, group: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Inclusive running sums within each group, without gathering a group: a range sort, sums inside partitions, and offsets."""
    ordered = df.repartitionByRange(*group, order).withColumn("_part", F.spark_partition_id())
    ordered = level(ordered)
    here = Window.partitionBy("_part", *group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = ordered.withColumns({f"_{c}": F.sum(c).over(here) for c in columns})
    parts = ordered.groupBy("_part", *group).agg(*[F.sum(c).alias(c) for c in columns])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", *group, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_o_{c}") for c in columns])
    joined = local.join(offsets, ["_part", *group])
    return joined.withColumns({f"{c}_below": F.col(f"_{c}") + F.col(f"_o_{c}") for c in columns}).drop("_part", *[f"_{c}" for c in columns], *[f"_o_{c}" for c in columns])


def best_splits(rows: DataFrame, attributes: Sequence[str], classes: Sequence) -> DataFrame:
    """``(node, attr, cut, gini)`` of ``rows(node, class, attributes)``: the best split ``value <= cut`` of each node.

    Values are counted by class first; cuts lie between distinct values. Ties go
    to the first attribute by name, then to the least cut.
    """
    counts = [F.count_if(F.col("class") == c).alias(f"c{i}") for i, c in enumerate(classes)]
    values = unpivot(rows, ["node", "class"], attributes).groupBy("node", "attr", "val").agg(*counts)
    names = [f"c{i}" for i in range(len(classes))]
    totals = rows.groupBy("node").agg(*[F.count_if(F.col("class") == c).alias(f"t{i}") for i, c in enumerate(classes)])
    run = running_sums(values, ["node", "attr"], "val", names).join(totals, "node")
    below = [F.col(f"{n}_below") for n in names]
    above = [F.col(f"t{i}") - b for i, b in enumerate(below)]
    scored = run.withColumn("gini", V.split_gini(above, below)).where(sum(above[1:], above[0]) > 0)
    best = scored.groupBy("node").agg(F.min(F.struct(F.round("gini", 12).alias("gini"), "attr", F.col("val").alias("cut"))).alias("best"))
    return best.select("node", "best.attr", "best.cut", "best.gini")


def grow_tree(rows: DataFrame, attributes: Sequence[str], max_depth: int | None = None) -> tuple[list[dict], DataFrame]:
    """Breadth first until all nodes are pure, or equal in all attributes, or at ``max_depth``: the nodes, and the rows with their leaf ``node``.

    The tree itself (one entry for each node) is kept on the driver.
    """
    classes = sorted(r[0] for r in rows.select("class").distinct().collect())
    now = level(rows.withColumn("node", F.lit(1).cast("long")))
    nodes: list[dict] = []
    open_nodes = [1]
    for depth in itertools.count():
        summary = now.where(F.col("node").isin(open_nodes)).groupBy("node").agg(*[F.count_if(F.col("class") == c).alias(f"c{i}") for i, c in enumerate(classes)]).collect()
        mixed = [r.node for r in summary if sum(r[f"c{i}"] > 0 for i in range(len(classes))) > 1]
        active = now.where(F.col("node").isin(mixed)) if mixed and (max_depth is None or depth < max_depth) else None
        splits = {r.node: r for r in best_splits(active, attributes, classes).collect()} if active is not None else {}
        for r in sorted(summary):
            counts = {c: r[f"c{i}"] for i, c in enumerate(classes)}
            s = splits.get(r.node)
            nodes.append({"node": r.node, "depth": depth, "counts": counts, "attr": s and s.attr, "cut": s and s.cut, "gini": s and s.gini})
        if not splits:
            break
        table = now.sparkSession.createDataFrame([(n, s.attr, s.cut) for n, s in splits.items()], "node long, _attr string, _cut double")
        value = F.coalesce(*[F.when(F.col("_attr") == a, F.col(a).cast("double")) for a in attributes])
        child = F.when(F.col("_cut").isNull(), F.col("node")).when(value <= F.col("_cut"), 2 * F.col("node")).otherwise(2 * F.col("node") + 1)
        now = level(now.join(F.broadcast(table), "node", "left").withColumn("node", child).drop("_attr", "_cut"))  # a row for each node
        open_nodes = [c for n in splits for c in (2 * n, 2 * n + 1)]
    return nodes, now


# --- Bayes classifiers ---------------------------------------------------------------------------


def class_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("class").agg(F.count("*").alias("n"))


def symbol_counts(rows: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """``(attr, val, class, n)`` of symbolic attributes, unknown values left out."""
    cells = [F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("val")) for a in attributes]
    return rows.select("class", F.inline(F.array(*cells))).where("val is not null").groupBy("attr", "val", "class").agg(F.count("*").alias("n"))


def gaussians(rows: DataFrame, attributes: Sequence[str], maximum_likelihood: bool = False) -> DataFrame:
    """``(attr, class, n, mean, variance)`` of numeric attributes; the variance divides by n - 1, or by n."""
    v = F.var_pop if maximum_likelihood else F.var_samp
    return unpivot(rows, ["class"], attributes).where("val is not null").groupBy("attr", "class").agg(F.count("val").alias("n"), F.avg("val").alias("mean"), v("val").alias("variance"))


def naive_bayes(rows: DataFrame, symbolic: Sequence[str], numeric: Sequence[str], laplace: float = 0.0, maximum_likelihood: bool = False) -> dict:
    """The model as plain values: classes times attribute values."""
    n = {r["class"]: r.n for r in class_counts(rows).collect()}
    table: dict = {}
    for r in symbol_counts(rows, symbolic).collect() if symbolic else []:
        table.setdefault(r.attr, {}).setdefault(r["class"], {})[r.val] = r.n
    normal: dict = {}
    for r in gaussians(rows, numeric, maximum_likelihood).collect() if numeric else []:
        normal.setdefault(r.attr, {})[r["class"]] = (r.mean, r.variance)
    return {"n": n, "symbols": table, "normals": normal, "laplace": laplace}


def log_posteriors(model: dict) -> dict:
    """An expression of the unnormalised log posterior for each class; unknown values say nothing."""
    total, k, out = sum(model["n"].values()), len(model["n"]), {}
    for c, n in model["n"].items():
        e = F.lit(math.log((n + model["laplace"]) / (total + k * model["laplace"])))
        for a, by_class in model["symbols"].items():
            values = {v for t in by_class.values() for v in t}
            own = by_class.get(c, {})
            size = sum(own.values()) + model["laplace"] * len(values)
            term = F.lit(0.0)
            for v in sorted(values):
                p = (own.get(v, 0) + model["laplace"]) / size if size else 0.0
                term = F.when(F.col(a).cast("string") == v, F.lit(math.log(max(p, 1e-300)))).otherwise(term)
            e = e + term
        for a, by_class in model["normals"].items():
            if c in by_class:
                mean, var = by_class[c]
                var = max(var or 0.0, 1e-12)
                x = F.col(a).cast("double")
                e = e + F.coalesce(-0.5 * (F.log(F.lit(2 * math.pi * var)) + (x - mean) * (x - mean) / var), F.lit(0.0))
        out[c] = e
    return out


def classify(rows: DataFrame, model: dict) -> DataFrame:
    """``rows`` with ``predicted`` (ties to the first class) and ``confidence``."""
    scores = log_posteriors(model)
    order = sorted(scores)
    out = rows.withColumn("_s", F.array(*[scores[c] for c in order])).withColumn("_top", F.array_max("_s"))
    at = F.array_position("_s", F.col("_top")).cast("int")
    confidence = 1 / V.total(F.transform("_s", lambda s: F.exp(s - F.col("_top"))))
    return out.withColumn("predicted", F.element_at(F.array(*[F.lit(c) for c in order]), at)).withColumn("confidence", confidence).drop("_s", "_top")


def error_rate(classified: DataFrame) -> DataFrame:
    wrong = F.count_if(~F.col("predicted").eqNullSafe(F.col("class")))
    return classified.agg(wrong.alias("errors"), (100 * wrong / F.count("*")).alias("percent"))


def full_bayes(rows: DataFrame, attributes: Sequence[str]) -> dict:
    """Mean vector and covariance matrix (n - 1) of each class."""
    sums = [F.avg(a).alias(f"m_{a}") for a in attributes]
    sums += [F.covar_samp(a, b).alias(f"c_{a}_{b}") for i, a in enumerate(attributes) for b in attributes[i:]]
    out = {}
    for r in rows.groupBy("class").agg(F.count("*").alias("n"), *sums).collect():
        cov = np.zeros((len(attributes),) * 2)
        for i, a in enumerate(attributes):
            for j in range(i, len(attributes)):
                cov[i, j] = cov[j, i] = r[f"c_{a}_{attributes[j]}"]
        out[r["class"]] = (r.n, np.array([r[f"m_{a}"] for a in attributes]), cov)
    return out


def classify_full(rows: DataFrame, model: dict, attributes: Sequence[str]) -> DataFrame:
    """``rows`` with ``predicted`` by the largest multivariate normal density times class share."""
    total = sum(n for n, _, _ in model.values())
    order, scores = sorted(model), []
    for c in order:
        n, mean, cov = model[c]
        inverse = np.linalg.inv(np.linalg.cholesky(cov + 1e-9 * np.trace(cov) / len(cov) * np.eye(len(cov))))
        centred = [F.col(a).cast("double") - float(m) for a, m in zip(attributes, mean)]
        quadratic = F.lit(0.0)
        for row in inverse:
            z: Column = F.lit(0.0)
            for w, x in zip(row, centred):
                if w:
                    z = z + float(w) * x
            quadratic = quadratic + z * z
        scores.append(float(math.log(n / total) + np.log(np.diag(inverse)).sum()) - 0.5 * quadratic)
    out = rows.withColumn("_s", F.array(*scores))
    at = F.array_position("_s", F.array_max("_s")).cast("int")
    return out.withColumn("predicted", F.element_at(F.array(*[F.lit(c) for c in order]), at)).drop("_s")


def generate(spark, model: dict, n: int, seed: int) -> DataFrame:
    """``n`` rows drawn from a naive Bayes model; seeded by row number, so the same on any cluster."""
    unit = lambda tag: (F.pmod(F.xxhash64("rid", F.lit(seed), F.lit(tag)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    df = spark.range(n).withColumnRenamed("id", "rid")

    def draw(weights: dict, u: Column) -> Column:
        total, acc, e = sum(weights.values()), 0.0, None
        for v in sorted(weights, reverse=True):
            acc += weights[v] / total
            e = F.lit(v) if e is None else F.when(u < 1 - acc + weights[v] / total, F.lit(v)).otherwise(e)
        return e

    df = df.withColumn("class", draw(model["n"], unit("class")))
    for a, by_class in model["symbols"].items():
        e = F.lit(None).cast("string")
        for c, t in by_class.items():
            e = F.when(F.col("class") == c, draw(t, unit(a))).otherwise(e)
        df = df.withColumn(a, e)
    for a, by_class in model["normals"].items():
        z = F.sqrt(-2 * F.log(unit(a + "/r"))) * F.cos(2 * F.pi() * unit(a + "/t"))
        e = F.lit(None).cast("double")
        for c, (mean, var) in by_class.items():
            e = F.when(F.col("class") == c, mean + math.sqrt(max(var or 0.0, 0.0)) * z).otherwise(e)
        df = df.withColumn(a, e)
    return df


def cross_validate(rows: DataFrame, folds: int, symbolic: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """``(fold, errors, n)``: naive Bayes trained on the other folds of ``rows(fold, ...)``."""
    rows, out = level(rows), None
    for f in range(folds):
        model = naive_bayes(rows.where(F.col("fold") != f), symbolic, numeric)
        judged = classify(rows.where(F.col("fold") == f), model)
        part = judged.agg(F.lit(f).alias("fold"), F.count_if(F.col("predicted") != F.col("class")).alias("errors"), F.count("*").alias("n"))
        out = part if out is None else out.union(part)
    return out


# --- support vector machines ---------------------------------------------------------------------


def feature_scores(long: DataFrame) -> DataFrame:
    """``(feature, score)`` of ``long(rid, feature, x, y)``: centred sum of products over the product of centred squares."""
    sums = long.groupBy("feature").agg(
        F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("y")).alias("sxy"),
        F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"),
    )
    n = F.col("n")
    xy = F.col("sxy") - F.col("sx") * F.col("sy") / n
    xx, yy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    return sums.select("feature", (xy / F.nullif(xx * yy, F.lit(0.0))).alias("score"))


def kernel(kind: str, a: np.ndarray, b: np.ndarray, gamma: float = 1.0, coef: float = 0.0, degree: int = 3) -> np.ndarray:
    if kind == "linear":
        return a @ b.T
    if kind == "poly":
        return (gamma * (a @ b.T) + coef) ** degree
    if kind == "rbf":
        return np.exp(-gamma * ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T))
    if kind == "sigmoid":
        return np.tanh(gamma * (a @ b.T) + coef)
    raise ValueError(kind)


def train_svc(gram: np.ndarray, y: np.ndarray, c: float = 1.0, eps: float = 1e-3, max_steps: int = 100_000) -> tuple[np.ndarray, float]:
    """Dual coefficients (times the label) and bias of a two-class machine with cost c, by maximal violating pairs."""
    n = len(y)
    alpha, gradient = np.zeros(n), -np.ones(n)
    q = gram * np.outer(y, y)
    for _ in range(max_steps):
        up = ((alpha < c) & (y > 0)) | ((alpha > 0) & (y < 0))
        low = ((alpha < c) & (y < 0)) | ((alpha > 0) & (y > 0))
        v = -y * gradient
        i = int(np.argmax(np.where(up, v, -np.inf)))
        j = int(np.argmin(np.where(low, v, np.inf)))
        if not up.any() or not low.any() or v[i] - v[j] < eps:
            break
        curvature = max(gram[i, i] + gram[j, j] - 2 * gram[i, j], 1e-12)
        step = (v[i] - v[j]) / curvature
        step = min(step, c - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else c - alpha[j])
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        gradient += q[:, i] * (y[i] * step) - q[:, j] * (y[j] * step)
    v = -y * gradient
    free = (alpha > 0) & (alpha < c)
    bias = v[free].mean() if free.any() else (v.max() + v.min()) / 2
    return alpha * y, float(bias)


def train_linear(x: np.ndarray, y: np.ndarray, c: float = 1.0, eps: float = 1e-3, max_steps: int = 100_000) -> np.ndarray:
    """The dual coefficients of ``train_svc`` on ``x @ x.T``, by the same steps from the cases alone: memory grows with them, not with their square."""
    alpha, v = np.zeros(len(y)), y.astype(float)
    # 0 where a coefficient may rise (or fall) along v, infinite where not.
    up, low = np.where(y > 0, 0.0, -np.inf), np.where(y < 0, 0.0, np.inf)
    for _ in range(max_steps):
        i, j = int(np.argmax(v + up)), int(np.argmin(v + low))
        if up[i] or low[j] or v[i] - v[j] < eps:
            break
        apart = x[i] - x[j]
        step = (v[i] - v[j]) / max(apart @ apart, 1e-12)
        step = min(step, c - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else c - alpha[j])
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        v -= x @ (apart * step)
        for k in (i, j):
            rises, falls = alpha[k] < c, alpha[k] > 0
            up[k] = 0.0 if (rises if y[k] > 0 else falls) else -np.inf
            low[k] = 0.0 if (rises if y[k] < 0 else falls) else np.inf
    return alpha * y


def predict_svc(coef: np.ndarray, bias: float, gram: np.ndarray) -> np.ndarray:
    """Decision values for rows of ``gram`` (cases times training cases)."""
    return gram @ coef + bias


def normalise_cases(x: np.ndarray) -> np.ndarray:
    """Each row, then each column, to mean 0 and deviation 1 (n - 1); then the arc tangent."""
    for axis in (1, 0):
        spread = x.std(axis=axis, ddof=1, keepdims=True)
        x = (x - x.mean(axis=axis, keepdims=True)) / np.where(spread > 0, spread, 1)
    return np.arctan(x)


def eliminate_features(x: np.ndarray, y: np.ndarray, step: int = 1, keep: int = 0, c: float = 1.0) -> list[int]:
    """Features in order of elimination: retrain, drop the ``step`` with the least absolute weight (ties to the lowest index).

    The kernel is linear, so no Gram matrix is kept: memory grows with the cases.
    """
    left, out = list(range(x.shape[1])), []
    while len(left) > keep:
        part = np.ascontiguousarray(x[:, left])
        weight = np.abs(part.T @ train_linear(part, y, c))
        drop = [left[i] for i in np.argsort(weight, kind="stable")[: min(step, len(left) - keep)]]
        out += drop
        left = [f for f in left if f not in set(drop)]
    return out + left


def rank_features(cases: DataFrame, step: int = 1) -> DataFrame:
    """``(feature, rank)`` by recursive elimination over ``cases(group, y, x)``: each group's cases are one training problem."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        order = eliminate_features(normalise_cases(np.array(part["x"].tolist(), float)), np.where(part["y"] > 0, 1.0, -1.0), step)
        return pd.DataFrame({"group": part["group"].iloc[0], "feature": order, "rank": range(len(order), 0, -1)})

    # A group is much work in few bytes: partitions of a stated number aren't merged by size.
    dealt = cases.repartition(int(cases.sparkSession.conf.get("spark.sql.shuffle.partitions")), "group")
    return dealt.groupBy("group").applyInPandas(run, "group long, feature int, rank int")


def normalise_long(long: DataFrame) -> DataFrame:
    """``long(rid, feature, x)`` with each row, then each feature, to mean 0 and deviation 1 (n - 1), then the arc tangent; two windows, no gathering of rows by hand."""

    def z(by: str):
        w = Window.partitionBy(by)
        spread = F.stddev_samp("x").over(w)
        return (F.col("x") - F.avg("x").over(w)) / F.when(spread > 0, spread).otherwise(1.0)

    out = long.select("rid", "feature", z("rid").alias("x"))
    return out.select("rid", "feature", z("feature").alias("x")).withColumn("x", F.atan("x"))


def regression_splits(rows: DataFrame, attributes: Sequence[str], target: str) -> DataFrame:
    """``(node, attr, cut, error)`` of ``rows(node, attributes, target)``: the split ``value <= cut`` that leaves the least squares of each node.

    Ties go to the first attribute by name, then to the least cut.
    """
    y = F.col(target).cast("double")
    values = unpivot(rows.withColumn("_y", y), ["node", "_y"], attributes).groupBy("node", "attr", "val")
    values = values.agg(F.count("*").cast("double").alias("n"), F.sum("_y").alias("s"), F.sum(F.col("_y") * F.col("_y")).alias("q"))
    totals = rows.groupBy("node").agg(F.count("*").cast("double").alias("tn"), F.sum(y).alias("ts"), F.sum(y * y).alias("tq"))
    run = running_sums(values, ["node", "attr"], "val", ["n", "s", "q"]).join(totals, "node").where("tn > n_below")
    squares = lambda n, s, q: q - s * s / n
    error = squares(F.col("n_below"), F.col("s_below"), F.col("q_below")) + squares(F.col("tn") - F.col("n_below"), F.col("ts") - F.col("s_below"), F.col("tq") - F.col("q_below"))
    best = run.withColumn("error", error).groupBy("node").agg(F.min(F.struct(F.round(F.col("error") / F.col("tn"), 6).alias("error"), "attr", F.col("val").alias("cut"))).alias("best"))
    return best.select("node", "best.attr", "best.cut", "best.error")
