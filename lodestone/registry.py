"""All registered queries and their SQL oracles."""

from __future__ import annotations

from lodestone.plans import classify_queries, cluster_queries, function_queries, graph_queries, pattern_queries, sequence_queries, source_queries, table_queries

MODULES = [table_queries, pattern_queries, cluster_queries, classify_queries, graph_queries, sequence_queries, source_queries, function_queries]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
