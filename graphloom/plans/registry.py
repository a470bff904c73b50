"""Named queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.sources.projection import SQL, Graph, graph_projection

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers f(graph, spark, sf_dir) under a name; sql follows the projection's common table expressions."""
    def register(f: Callable[[Graph, SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(graph_projection(spark, sf_dir), spark, sf_dir)
        if sql:
            ORACLES[name] = SQL + sql.lstrip()
        return f

    return register
