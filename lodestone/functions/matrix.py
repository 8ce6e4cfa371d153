"""Matrices as long tables ``(i, j, v)``, and dense kernels for small ones on the driver.

Products and sums of long tables are joins and aggregates; absent entries are 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def scale(m: DataFrame, factor: float) -> DataFrame:
    return m.withColumn("v", F.col("v") * factor)


def add(a: DataFrame, b: DataFrame, factor: float = 1.0) -> DataFrame:
    """a + factor b."""
    return a.select("i", "j", "v").union(scale(b, factor).select("i", "j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def times_vector(a: DataFrame, vector: DataFrame) -> DataFrame:
    """``(i, v)`` for ``vector(j, x)``."""
    return a.join(vector, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def diagonal(m: DataFrame) -> DataFrame:
    return m.where("i = j").select("i", "v")


def swap_rows(m: DataFrame, a: int, b: int) -> DataFrame:
    return m.withColumn("i", F.when(F.col("i") == a, b).when(F.col("i") == b, a).otherwise(F.col("i")))


def to_dense(m: DataFrame, rows: int, columns: int) -> np.ndarray:
    """A small matrix on the driver."""
    out = np.zeros((rows, columns))
    for r in m.limit(rows * columns).collect():
        out[r.i, r.j] = r.v
    return out


def from_dense(spark, m: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(m)], "i long, j long, v double")


def determinant(m: np.ndarray) -> float:
    return float(np.linalg.det(m))


def invert(m: np.ndarray) -> np.ndarray:
    return np.linalg.inv(m)


def solve(m: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.solve(m, b)


def lu(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row order, unit lower, upper) with partial pivoting."""
    u, n = np.array(m, float), len(m)
    order, low = np.arange(n), np.eye(n)
    for k in range(n):
        p = k + int(np.argmax(np.abs(u[k:, k])))
        u[[k, p]], order[[k, p]] = u[[p, k]], order[[p, k]]
        low[[k, p], :k] = low[[p, k], :k]
        if u[k, k]:
            low[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
            u[k + 1 :] -= np.outer(low[k + 1 :, k], u[k])
    return order, low, u


def cholesky(m: np.ndarray) -> np.ndarray:
    return np.linalg.cholesky(m)


def symmetric_eigen(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.linalg.eigh(m)


def regression(rows: DataFrame, inputs: list[str], target: str) -> np.ndarray:
    """Least-squares coefficients, the constant first: sums of products in one aggregate, then a small solve."""
    names = [F.lit(1.0), *[F.col(c).cast("double") for c in inputs]]
    sums = [F.sum(a * b).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate([*names, F.col(target).cast("double")]) if j >= i]
    r, n = rows.agg(*sums).first(), len(names)
    gram = np.array([[r[f"{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
    return np.linalg.solve(gram, np.array([r[f"{i}_{n}"] for i in range(n)]))
