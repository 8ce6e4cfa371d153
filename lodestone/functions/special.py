"""Special functions as vectorised kernels (numpy and math only)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def regularised_gamma(a: float, x: float) -> float:
    """The lower incomplete gamma function over gamma(a): a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * scale
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - h * scale


def bisect(f, low: float, high: float, rounds: int = 200) -> float:
    """The zero of an increasing function."""
    for _ in range(rounds):
        mid = (low + high) / 2
        if f(mid) < 0:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def normal_quantile(p: float) -> float:
    return bisect(lambda x: 0.5 * math.erfc(-x / math.sqrt(2)) - p, -40, 40)


def chi_square_quantile(p: float, df: float) -> float:
    return bisect(lambda x: regularised_gamma(df / 2, x / 2) - p, 0, 40 + 10 * df)


def zeta(x: float, terms: int = 20) -> float:
    """Riemann's zeta function for x > 1, with an Euler-Maclaurin tail."""
    n = terms
    tail = n ** (1 - x) / (x - 1) + 0.5 * n**-x + x * n ** (-x - 1) / 12 - x * (x + 1) * (x + 2) * n ** (-x - 3) / 720
    return sum(k**-x for k in range(1, n)) + tail


def choose(n: int, k: int) -> int:
    return math.comb(n, k) if 0 <= k <= n else 0


def gamma_rates(alpha: float, categories: int) -> np.ndarray:
    """Mean rates of equally likely classes of a gamma distribution with mean 1."""
    cuts = [0.0, *(chi_square_quantile(i / categories, 2 * alpha) / (2 * alpha) for i in range(1, categories))]
    mass = [regularised_gamma(alpha + 1, c * alpha) for c in cuts] + [1.0]
    return np.diff(mass) * categories


def _column(f):
    # Annotations are objects here so that Spark finds the types.
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore").astype(float)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")


erf, log_gamma, gamma = (lambda c: _column(math.erf)(c)), (lambda c: _column(math.lgamma)(c)), (lambda c: _column(math.gamma)(c))


def golden_minimum(f, low: float, high: float, rounds: int = 100) -> float:
    """The minimum of a one-dimensional function in a bracket, by golden sections."""
    ratio = (math.sqrt(5) - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = f(a), f(b)
    for _ in range(rounds):
        if fa < fb:
            high, b, fb = b, a, fa
            a = high - ratio * (high - low)
            fa = f(a)
        else:
            low, a, fa = a, b, fb
            b = low + ratio * (high - low)
            fb = f(b)
    return (low + high) / 2


def subsets(items, k: int):
    """All subsets of ``k`` elements of an array column, in the order of their places."""
    if k == 0:
        return F.array(F.array().cast("array<string>"))
    if k == 1:
        return F.transform(items, lambda x: F.array(x))
    # Each place begins the subsets of what follows it.
    rest = lambda i: subsets(F.slice(items, i + 2, F.greatest(F.size(items) - i - 1, F.lit(0))), k - 1)
    return F.flatten(F.transform(items, lambda x, i: F.transform(rest(i), lambda s: F.concat(F.array(x), s))))


def next_subset(places: list[int], n: int) -> list[int] | None:
    """The next subset of the places 0 to n - 1 in lexicographic order; None after the last."""
    k, out = len(places), list(places)
    for i in range(k - 1, -1, -1):
        if out[i] < n - k + i:
            out[i] += 1
            for j in range(i + 1, k):
                out[j] = out[j - 1] + 1
            return out
    return None


def beta(a: float, b: float) -> float:
    return math.exp(math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))


def laguerre(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) of the quadrature of f(x) exp(-x) from 0 on that is exact for polynomials below degree 2 n."""
    return np.polynomial.laguerre.laggauss(n)


def chebyshev(f, low: float, high: float, n: int) -> np.ndarray:
    """Coefficients of a Chebyshev series of a function on a range, from its values at ``n`` nodes."""
    x = np.cos(np.pi * (np.arange(n) + 0.5) / n)
    y = np.array([f((low + high) / 2 + (high - low) / 2 * v) for v in x])
    return np.array([(2 - (k == 0)) / n * (y * np.cos(k * np.pi * (np.arange(n) + 0.5) / n)).sum() for k in range(n)])


def chebyshev_value(coefficients: np.ndarray, low: float, high: float, x: float) -> float:
    return float(np.polynomial.chebyshev.chebval((2 * x - low - high) / (high - low), coefficients))


def brent_root(f, low: float, high: float, tolerance: float = 1e-12, rounds: int = 200) -> float:
    """A zero in a bracket with a change of sign: inverse interpolation where it helps, halving where it doesn't."""
    a, b, fa, fb = low, high, f(low), f(high)
    if fa * fb > 0:
        raise ValueError("the function has the same sign at both ends")
    for _ in range(rounds):
        if abs(fa) < abs(fb):
            a, b, fa, fb = b, a, fb, fa
        if fb == 0 or abs(b - a) < tolerance:
            break
        middle = (a + b) / 2
        secant = b - fb * (b - a) / (fb - fa) if fa != fb else middle
        x = secant if min(middle, b) < secant < max(middle, b) else middle
        fx = f(x)
        # The bracket must shrink by half within two steps.
        if abs(x - b) < tolerance:
            x = middle
            fx = f(x)
        if fa * fx < 0:
            b, fb = x, fx
        else:
            a, fa = x, fx
    return b if abs(fb) < abs(fa) else a


def line_fit(rows, x: str, y: str, weight: str | None = None):
    """``(slope, intercept, correlation)`` of a weighted least-squares line, one aggregate."""
    w = F.col(weight) if weight else F.lit(1.0)
    u, v = F.col(x).cast("double"), F.col(y).cast("double")
    sums = rows.agg(F.sum(w).alias("n"), F.sum(w * u).alias("u"), F.sum(w * v).alias("v"), F.sum(w * u * u).alias("uu"), F.sum(w * v * v).alias("vv"), F.sum(w * u * v).alias("uv"))
    c = lambda a, b, ab: F.col(ab) - F.col(a) * F.col(b) / F.col("n")
    slope = c("u", "v", "uv") / c("u", "u", "uu")
    return sums.select(slope.alias("slope"), ((F.col("v") - slope * F.col("u")) / F.col("n")).alias("intercept"), (c("u", "v", "uv") / F.sqrt(c("u", "u", "uu") * c("v", "v", "vv"))).alias("correlation"))
