"""Tables written to the folder that driver and executors share, in place of cached or locally checkpointed data."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch: some megabytes of ordinary documents.
BATCH_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; in local mode, where it may be unset, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="terrazone-"))
    return found.rstrip("/")


_LOCAL: dict[str, str] = {}


def tune(spark: SparkSession) -> None:
    """Small Arrow batches bound the memory of the Python workers."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


class Scratch:
    """A folder of one run's tables. They survive lost executors; drop() removes one that is no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(df: DataFrame, text: str = "text", name: str = "_bytes") -> DataFrame:
    """Adds the UTF-8 bytes of a text column; null counts as empty."""
    return df.withColumn(name, F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of rounds whose tables are written: it does so once their frames are collected."""
    gc.collect()
    spark._jvm.System.gc()
