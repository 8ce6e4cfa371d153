"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    far = both.where("v > u").join(least, "u")
    return far.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = down.join(_least(down), "u")
    return (
        near.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(near.select("u", F.col("m").alias("v")))
        .where("u <> v")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of longs to ``(node, component)`` for every node of an edge.

    The component is its least node. Self-links are ignored; an empty table
    gives an empty result. Each round writes the edges to the shared folder, so
    a lost executor costs one round, and no round gathers a component in one
    place: hubs meet in joins and partial aggregates only.
    """
    now = scratch.materialise(edges.where("u <> v").select("u", "v").distinct(), "edges")
    seen = None
    while True:
        step = scratch.materialise(_small_star(_large_star(now)), "edges")
        mark = step.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.discard(now)
        now = step
        if mark == seen:
            break
        seen = mark
    member = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return member.union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
