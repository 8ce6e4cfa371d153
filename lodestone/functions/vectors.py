"""Column builders for vectors (arrays of doubles), clustering features and distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def square_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def scale(a: Column, factor: Column | float) -> Column:
    return F.transform(a, lambda x: x * factor)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def affine(a: Column, weights: Sequence[float], offsets: Sequence[float]) -> Column:
    """w * x + m in each dimension."""
    w, m = (F.array(*[F.lit(float(v)) for v in vs]) for vs in (weights, offsets))
    return add(F.zip_with(a, w, lambda x, y: x * y), m)


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in vector])


def cross(a: Column, b: Column) -> Column:
    """The cross product of three-dimensional vectors."""
    x, y = [F.element_at(a, i) for i in (1, 2, 3)], [F.element_at(b, i) for i in (1, 2, 3)]
    return F.array(x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0])


def log_sum_exp(a: Column) -> Column:
    top = F.array_max(a)
    return top + F.log(total(F.transform(a, lambda v: F.exp(v - top))))


# A clustering feature is n, the vector sum sx and the sum of squared lengths sxx.


def cf_radius2(n: Column, sx: Column, sxx: Column) -> Column:
    mean = scale(sx, 1 / n)
    return F.when(n <= 1, 0.0).otherwise(F.greatest(sxx / n - dot(mean, mean), F.lit(0.0)))


def cf_diameter2(n: Column, sx: Column, sxx: Column) -> Column:
    return F.when(n <= 1, 0.0).otherwise(F.greatest(2 * (n * sxx - dot(sx, sx)) / (n * (n - 1)), F.lit(0.0)))


def cf_distance(kind: str, a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """D0 squared centroid distance, D1 Manhattan, D2 mean squared between, D3 mean squared within the union, D4 variance increase."""
    (n, sx, sxx), (m, sy, syy) = a, b
    if kind == "D0":
        return square_distance(scale(sx, 1 / n), scale(sy, 1 / m))
    if kind == "D1":
        return manhattan(scale(sx, 1 / n), scale(sy, 1 / m))
    if kind == "D2":
        value = (m * sxx + n * syy - 2 * dot(sx, sy)) / (n * m)
    elif kind == "D3":
        both = add(sx, sy)
        value = 2 * ((n + m) * (sxx + syy) - dot(both, both)) / ((n + m) * (n + m - 1))
    elif kind == "D4":
        both = add(sx, sy)
        value = dot(sx, sx) / n + dot(sy, sy) / m - dot(both, both) / (n + m)
    else:
        raise ValueError(kind)
    return F.greatest(value, F.lit(0.0))


def spline(r2: Column, h2: Column) -> Column:
    """The cubic-spline kernel's shape for a squared distance; ``h2`` is the squared reach, which has value 0."""
    q2 = 4 * r2 / h2
    q = F.sqrt(q2)
    near = 1 - 0.75 * (2 - q) * q2
    return F.when(q2 < 1, near).otherwise(0.25 * F.pow(F.greatest(2 - q, F.lit(0.0)), 3))


def gini(counts: Sequence[Column]) -> Column:
    n = sum(counts[1:], counts[0])
    return F.when(n > 0, 1 - sum((c * c for c in counts[1:]), counts[0] * counts[0]) / (n * n)).otherwise(0.0)


def split_gini(above: Sequence[Column], below: Sequence[Column]) -> Column:
    """The weighted impurity of a binary split from class counts on both sides."""
    squares = lambda cs: sum((c * c for c in cs[1:]), cs[0] * cs[0])
    a, b = sum(above[1:], above[0]), sum(below[1:], below[0])
    part = lambda s, n: F.when(n > 0, s / n).otherwise(0.0)
    return 1 - (part(squares(above), a) + part(squares(below), b)) / (a + b)


def evd_density(x: Column, mu: float, lam: float) -> Column:
    z = lam * (x - mu)
    return lam * F.exp(-z - F.exp(-z))


def evd_cdf(x: Column, mu: float, lam: float) -> Column:
    return F.exp(-F.exp(-lam * (x - mu)))


def evd_p(x: Column, mu: float, lam: float) -> Column:
    """P(score >= x) under the extreme value distribution."""
    return -F.expm1(-F.exp(-lam * (x - mu)))


def normal_density(x: Column, mu: Column | float, var: Column | float) -> Column:
    mu, var = (v if isinstance(v, Column) else F.lit(float(v)) for v in (mu, var))
    return F.exp(-(x - mu) * (x - mu) / (2 * var)) / F.sqrt(2 * F.pi() * var)
