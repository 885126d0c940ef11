"""A session with the settings that the library's plans expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "terrazone", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins, Arrow. Pass spark settings with underscores for dots."""
    builder = SparkSession.builder.appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
