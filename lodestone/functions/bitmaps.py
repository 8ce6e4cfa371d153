"""Bitmaps of row numbers as long tables ``(item, word, bits)``: 64 numbers in each word, absent words are empty.

Counts of one or two bitmaps are aggregates over words, so no bitmap is ever in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bitmaps(rows: DataFrame, number: str = "tid", item: str = "item") -> DataFrame:
    """``(item, word, bits)`` of ``rows(item, number)``; repeated rows set the same bit."""
    bit = F.expr(f"shiftleft(1L, cast({number} % 64 as int))")
    return rows.groupBy(F.col(item).alias("item"), F.floor(F.col(number) / 64).cast("long").alias("word")).agg(F.bit_or(bit).alias("bits"))


def both(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(a, b, word, bits)``: the intersections of all bitmaps of the two sides that share a word."""
    a, b = left.select(F.col("item").alias("a"), "word", F.col("bits").alias("x")), right.select(F.col("item").alias("b"), "word", F.col("bits").alias("y"))
    found = a.join(b, "word").select("a", "b", "word", F.col("x").bitwiseAND(F.col("y")).alias("bits"))
    return found.where("bits <> 0")


def either(maps: DataFrame, group: str) -> DataFrame:
    """``(group, word, bits)``: the unions of bitmaps by a column."""
    return maps.groupBy(group, "word").agg(F.bit_or("bits").alias("bits"))


def counts(maps: DataFrame, *keys: str) -> DataFrame:
    """``(keys, n)``: set bits."""
    return maps.groupBy(*keys).agg(F.sum(F.bit_count("bits")).cast("long").alias("n"))


def counts_after(maps: DataFrame, place: int, *keys: str) -> DataFrame:
    """``(keys, n)``: set bits of numbers beyond ``place``."""
    word, bit = place // 64, place % 64
    mask = ~((1 << (bit + 1)) - 1) & ((1 << 64) - 1)
    mask = mask - (1 << 64) if mask >> 63 else mask
    rest = F.when(F.col("word") > word, F.col("bits")).when(F.col("word") == word, F.col("bits").bitwiseAND(F.lit(mask))).otherwise(F.lit(0))
    return maps.groupBy(*keys).agg(F.sum(F.bit_count(rest)).cast("long").alias("n"))


def likeness(maps: DataFrame, rows: int) -> DataFrame:
    """``(a, b, n, contained, cosine, correlation)`` of the pairs a < b that share a number, among ``rows`` numbers in all."""
    single = counts(maps, "item")
    pairs = counts(both(maps, maps).where("a < b"), "a", "b")
    pairs = pairs.join(single.select(F.col("item").alias("a"), F.col("n").alias("na")), "a").join(single.select(F.col("item").alias("b"), F.col("n").alias("nb")), "b")
    n, na, nb = F.col("n"), F.col("na"), F.col("nb")
    spread = F.sqrt(na.cast("double") * (rows - na) * nb * (rows - nb))
    phi = F.when(spread > 0, (rows * n - na * nb) / spread).otherwise(0.0)
    return pairs.select("a", "b", "n", (n == F.least(na, nb)).alias("contained"), (n / F.sqrt(na.cast("double") * nb)).alias("cosine"), phi.alias("correlation"))
