"""The query catalogue: one entry per operator of the library, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrazone.plans import data_queries, graph_queries, panel_queries, source_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return panel_queries.QUERIES | graph_queries.QUERIES | data_queries.QUERIES | source_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return panel_queries.SQL | graph_queries.SQL | data_queries.SQL | source_queries.SQL
