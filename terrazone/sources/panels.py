"""Panels: a value for each node and epoch, gaps as null, with the period of each epoch.

Columns: node, e (epoch index from 0), years (since the first epoch), n (epochs in all), period and value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrazone.operators.timeaxis import with_periods


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epochs(observed: DataFrame) -> DataFrame:
    """t, e, years, n, period: one row for each distinct time. Their number is that of the epochs, not of the rows."""
    t = F.unix_micros(F.col("t").cast("timestamp"))
    times = observed.select("t").distinct()
    first = times.agg(F.min(t).alias("first"), F.count("*").alias("n"))
    ordered = times.withColumn("e", F.row_number().over(Window.orderBy("t")) - 1).crossJoin(F.broadcast(first))
    return with_periods(ordered.select("t", "e", ((t - F.col("first")) / F.lit(86400e6) / F.lit(365.25)).alias("years"), "n"))


def grid(observed: DataFrame) -> DataFrame:
    """Every node at every epoch; observed has node, t and value. The epochs, few by nature, are broadcast."""
    nodes = observed.select("node").distinct()
    full = nodes.crossJoin(F.broadcast(epochs(observed)))
    return full.join(observed, ["node", "t"], "left").select("node", "e", "years", "n", "period", "value")


def averaged(rows: DataFrame, node: Column, t: Column, value: Column) -> DataFrame:
    return rows.groupBy(node.alias("node"), t.alias("t")).agg(F.avg(value).alias("value"))


def ship_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quantity that each supplier ships in a month."""
    return grid(averaged(table(spark, sf_dir, "lineitem"), F.col("l_suppkey"), F.date_trunc("month", "l_shipdate"), F.col("l_quantity")))


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value of each user's events in a day. Cents are summed as integers, so the mean does not depend on order."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("node"), F.date_trunc("day", "ts").alias("t"))
    return grid(rows.agg((F.sum(F.round(F.col("value") * 100).cast("long")) / F.count("value") / 100).alias("value")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, z (doubles) and its class."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("z"), F.col("label").cast("long").alias("label"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, x, y and terrain of each supplier's place on a lattice; suppliers stand in for measuring points."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("node"), (k % 10).cast("double").alias("x"), F.floor(k / 10).cast("double").alias("y"),
        F.col("s_acctbal").alias("elevation"), (F.col("s_nationkey") * 1.5).alias("slope"), ((k * 37) % 360).cast("double").alias("aspect"),
        (F.col("s_acctbal") / 1000 - F.col("s_nationkey") / 10).alias("curvature"), (k % 7 + 0.5).alias("tri"),
    )
