"""Incremental summaries over streams: an extension, built on additive state.

Item supports and clustering features add up, so each micro-batch is aggregated
and merged into a table of running sums by the batch's number: a batch that is
run again replaces its own part and isn't counted twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import cluster, patterns


def batch_parts(path: str, summarise: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: writes each batch's summary to its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        summarise(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def running_supports(spark, path: str) -> DataFrame:
    """``(item, support)`` of all batches so far."""
    return spark.read.parquet(path).groupBy("item").agg(F.sum("support").alias("support"))


def running_features(spark, path: str, group: str, dims: int) -> DataFrame:
    """``(group, n, sx, sxx)`` of all batches so far."""
    return cluster.merge_features(spark.read.parquet(path), group, dims)


def supports(stream: DataFrame, path: str, checkpoint: str):
    """Start counting item supports of a stream of ``(tid, item)`` rows."""
    return stream.writeStream.foreachBatch(batch_parts(path, patterns.item_counts)).option("checkpointLocation", checkpoint).start()


def features(stream: DataFrame, path: str, checkpoint: str, group: str, dims: int):
    """Start summarising a stream of ``(group, x)`` rows."""
    return stream.writeStream.foreachBatch(batch_parts(path, lambda b: cluster.features(b, group, dims))).option("checkpointLocation", checkpoint).start()


def windowed_sequences(events: DataFrame, delay: str, width: str) -> DataFrame:
    """Counts by item and time window of a stream of ``(item, ts)`` with late events up to ``delay``."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "item").agg(F.count("*").alias("n"))
