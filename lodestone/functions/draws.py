"""Random draws as expressions of a row's key and a seed: the same on any cluster and in any order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column, seed: int, stream: str = "u") -> Column:
    """In (0, 1)."""
    return (F.pmod(F.xxhash64(key, F.lit(seed), F.lit(stream)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def exponential(key: Column, seed: int, mean: float = 1.0, stream: str = "e") -> Column:
    return -mean * F.log(uniform(key, seed, stream))


def normal(key: Column, seed: int, mean: float = 0.0, deviation: float = 1.0, stream: str = "n") -> Column:
    radius = F.sqrt(-2 * F.log(uniform(key, seed, f"{stream}/r")))
    return mean + deviation * radius * F.cos(2 * F.pi() * uniform(key, seed, f"{stream}/t"))


def lognormal(key: Column, seed: int, mean: float = 0.0, deviation: float = 1.0, stream: str = "l") -> Column:
    """The exponential of a normal draw."""
    return F.exp(normal(key, seed, mean, deviation, stream))


def gamma(key: Column, seed: int, shape: int, scale: float = 1.0, stream: str = "g") -> Column:
    """For a whole-numbered shape: a sum of exponential draws."""
    return sum((exponential(key, seed, scale, f"{stream}/{i}") for i in range(1, shape)), exponential(key, seed, scale, f"{stream}/0"))


def beta(key: Column, seed: int, a: int, b: int, stream: str = "b") -> Column:
    x, y = gamma(key, seed, a, 1.0, f"{stream}/a"), gamma(key, seed, b, 1.0, f"{stream}/b")
    return x / (x + y)


def hyperexponential(key: Column, seed: int, share: float, first: float, second: float, stream: str = "h") -> Column:
    """Exponential with mean ``first`` with probability ``share``, else with mean ``second``."""
    return F.when(uniform(key, seed, f"{stream}/c") < share, exponential(key, seed, first, stream)).otherwise(exponential(key, seed, second, stream))


def choose(key: Column, seed: int, weights: Sequence[float], stream: str = "c") -> Column:
    """A place in ``weights``, with chances in proportion."""
    total, below, u = sum(weights), 0.0, uniform(key, seed, stream)
    out = F.lit(len(weights) - 1)
    for i in range(len(weights) - 2, -1, -1):
        below = sum(weights[: i + 1]) / total
        out = F.when(u < below, F.lit(i)).otherwise(out)
    return out
