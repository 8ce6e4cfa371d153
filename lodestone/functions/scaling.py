"""Column-wise scaling learned in one aggregate: registered data, ranges, and linear maps that can be undone."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Scaling:
    """Least and greatest value, offset and factor of each column."""

    def __init__(self, columns: Sequence[str]) -> None:
        self.columns = list(columns)
        self.low, self.high = {c: math.inf for c in columns}, {c: -math.inf for c in columns}
        self.offset, self.factor = {c: 0.0 for c in columns}, {c: 1.0 for c in columns}

    def register(self, df: DataFrame, weight: str | None = None) -> Scaling:
        """Ranges, and offsets and factors that give mean 0 and (population) deviation 1."""
        w = F.col(weight) if weight else F.lit(1.0)
        parts = []
        for c in self.columns:
            x = F.col(c).cast("double")
            parts += [F.min(x).alias(f"{c}|a"), F.max(x).alias(f"{c}|b"), F.sum(w * x).alias(f"{c}|s"), F.sum(w * x * x).alias(f"{c}|q"), F.sum(F.when(x.isNotNull(), w)).alias(f"{c}|n")]
        r = df.agg(*parts).first()
        for c in self.columns:
            if r[f"{c}|n"]:
                self.low[c], self.high[c] = min(self.low[c], r[f"{c}|a"]), max(self.high[c], r[f"{c}|b"])
                mean = r[f"{c}|s"] / r[f"{c}|n"]
                spread = r[f"{c}|q"] - mean * r[f"{c}|s"]
                self.offset[c], self.factor[c] = mean, math.sqrt(r[f"{c}|n"] / spread) if spread > 0 else 1.0
        return self

    def expand(self, factor: float) -> Scaling:
        """Ranges wider by a factor around their middles."""
        for c in self.columns:
            more = (self.high[c] - self.low[c]) * (factor - 1) / 2
            self.low[c], self.high[c] = self.low[c] - more, self.high[c] + more
        return self

    def to_range(self, low: float, high: float) -> Scaling:
        """Offsets and factors that map the ranges to this one."""
        for c in self.columns:
            size = self.high[c] - self.low[c]
            self.factor[c] = (high - low) / size if size > 0 else 1.0
            self.offset[c] = self.low[c] - low / self.factor[c]
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - self.offset[c]) * self.factor[c] for c in self.columns})

    def undo(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) / self.factor[c] + self.offset[c] for c in self.columns})

    def centre(self) -> dict[str, float]:
        return {c: (self.low[c] + self.high[c]) / 2 for c in self.columns}

    def spans(self) -> dict[str, float]:
        return {c: self.high[c] - self.low[c] for c in self.columns}
