"""Sinks: site tables with a digest of their ids, labels, metrics and result tables, all written by Spark."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazone.operators import audits


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir, which all executors share; in local mode one of our own if unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="terrazone-core-"))
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_LOCAL: dict[str, str] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows from a table in the shared folder: it cuts the plan and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ids_digest(points: DataFrame, column: str = "point_id", order: str = "node") -> DataFrame:
    """One row: the SHA-256 of the ids, one a line, in order. The text is as long as all ids of one site."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, column))), lambda x: x[column]), "\n")
    return points.agg(F.sha2(joined.cast("binary"), 256).alias("point_ids_sha256"), F.count("*").alias("n_points"))


def write_site(points: DataFrame, obs: DataFrame, epochs: DataFrame, path: str, records: dict | None = None) -> DataFrame:
    """Writes the three tables, observations partitioned by period, and returns the site's summary row. The records of
    a site, where given, must be complete and are written beside the tables."""
    if records is not None:
        audits.site_records(records)
        points.sparkSession.createDataFrame([(json.dumps(records, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/records")
    points.write.mode("overwrite").parquet(f"{path}/points")
    epochs.write.mode("overwrite").parquet(f"{path}/epochs")
    obs.write.mode("overwrite").partitionBy("period").parquet(f"{path}/obs")
    sizes = epochs.groupBy().pivot("period", ["train", "val", "test"]).count()
    summary = ids_digest(points).crossJoin(sizes.select(F.col("train").alias("n_train"), F.col("val").alias("n_validation"), F.col("test").alias("n_test")))
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    return summary


def write_table(rows: DataFrame, path: str, order: list[str]) -> None:
    """One CSV file with a header, for result tables of a few rows."""
    rows.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_metrics(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").json(path)
