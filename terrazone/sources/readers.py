"""Readers: wide tables with a column for each date, raster series, provenance, results; all through Spark's sources."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from terrazone.functions.columns import point_id
from terrazone.operators.timeaxis import FRACTIONS


@dataclass(frozen=True)
class WideFormat:
    """How a site's table names its columns: the id, static columns to keep, and the dates in its header."""

    separator: str
    id_column: str
    static: tuple[str, ...]
    date_columns: str
    date_format: str
    first_day: str | None = None
    last_day: str | None = None


#: Layouts of published point tables (fixed values).
OFFIDA = WideFormat(",", "pid", ("latitude", "longitude", "rmse", "temporal_coherence", "amplitude_dispersion", "mean_velocity_std"), r"^(\d{8})$", "yyyyMMdd")
MENDATICA = WideFormat(";", "pid", ("easting", "northing", "coherence", "vel_std"), r"^D(\d{8})$", "ddMMyyyy", "2015-07-04", "2019-12-25")
ZHOUQU = WideFormat(",", "pid", ("x", "y", "Coherence"), r"^D_(\d{8})$", "yyyyMMdd", "2015-07-04", "2020-02-16")


def header_dates(names: list[str], layout: WideFormat, value_scope: str = "all") -> dict[str, pd.Timestamp]:
    """Date columns inside the layout's window by time; with train_only those of the training period."""
    if value_scope not in ("all", "train_only"):
        raise ValueError("value_scope is all or train_only")
    python = layout.date_format.replace("yyyy", "%Y").replace("MM", "%m").replace("dd", "%d")
    dates = {n: pd.to_datetime(m[1], format=python) for n in names if (m := re.match(layout.date_columns, n))}
    low, high = (pd.Timestamp(x) if x else None for x in (layout.first_day, layout.last_day))
    dates = {n: d for n, d in dates.items() if (low is None or d >= low) and (high is None or d <= high)}
    kept = sorted(dates, key=dates.get)
    return {n: dates[n] for n in (kept[: int(np.floor(FRACTIONS[0] * len(kept)))] if value_scope == "train_only" else kept)}


def read_wide(spark: SparkSession, path: str, layout: WideFormat, value_scope: str = "all") -> tuple[DataFrame, DataFrame]:
    """points (point_id and static columns) and observed (point_id, t, value), from a CSV with a column for each date.

    Only the header is read to plan; columns outside the window, or beyond the training period where value_scope is
    train_only, are pruned from the scan.
    """
    head = spark.read.text(path).limit(1).first()
    if head is None:
        raise ValueError("the table has no header")
    names = next(iter(pd.read_csv(io.StringIO(head[0]), sep=layout.separator).columns.to_frame().T.values.tolist()))
    dates = header_dates(names, layout, value_scope)
    kept = list(dates)
    schema = StructType([StructField(n, StringType()) for n in names])
    rows = spark.read.schema(schema).option("header", True).option("sep", layout.separator).csv(path)
    rows = rows.withColumn("point_id", point_id(F.col(layout.id_column)))
    static = [c for c in layout.static if c in names]
    points = rows.select("point_id", *[F.col(f"`{c}`").cast("double").alias(c) for c in static])
    long = rows.select("point_id", F.explode(F.array(*[F.struct(F.lit(dates[n].to_pydatetime()).alias("t"), F.col(f"`{n}`").cast("double").alias("value")) for n in kept])).alias("c"))
    value = F.when(~F.isnan("c.value"), F.col("c.value"))
    return points, long.select("point_id", F.col("c.t").alias("t"), value.alias("value"))


def read_zipped(spark: SparkSession, path: str, member: str = r"\.csv$") -> DataFrame:
    """line: the text lines of the matching members of zip files, inner archives included. A member streams through one
    task; write the result once and read that instead."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def walk(raw: bytes) -> Iterator[str]:
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                for name in sorted(z.namelist()):
                    if name.endswith(".zip"):
                        yield from walk(z.read(name))
                    elif re.search(member, name):
                        with z.open(name) as f:
                            yield from (x.rstrip("\r\n") for x in io.TextIOWrapper(f, "utf-8"))

        for pdf in batches:
            for raw in pdf["content"]:
                held = []
                for x in walk(bytes(raw)):
                    held.append(x)
                    if len(held) == 50_000:
                        yield pd.DataFrame({"line": held})
                        held = []
                yield pd.DataFrame({"line": held})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(lines, "line string")


def unzip(spark: SparkSession, path: str, folder: str, member: str = r"\.csv$") -> str:
    """Writes the matching member of a zip file as one text table below a shared folder, header first; its path."""
    read_zipped(spark, path, member).coalesce(1).write.mode("overwrite").text(folder)
    return folder


def read_config(spark: SparkSession, path: str, required: list[str] | None = None) -> dict:
    """A JSON object, such as a run's settings; an absent required key is an error that names it."""
    record = json.loads("\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect()))
    if missing := sorted(set(required or ()) - set(record)):
        raise ValueError(f"the settings lack {missing}")
    return record


def read_manifest(spark: SparkSession, path: str, start: str = "start", end: str = "end") -> DataFrame:
    """start and end dates of a manifest's rows, in order; a row that ends before it starts is an error when read."""
    rows = spark.read.option("header", True).csv(path).select(F.to_date(start).alias("start"), F.to_date(end).alias("end"))
    wrong = F.raise_error(F.lit("an interval of the manifest is not one")).cast("date")
    return rows.withColumn("end", F.when(F.col("start") <= F.col("end"), F.col("end")).otherwise(wrong)).orderBy("start", "end")


def dated(paths: DataFrame, column: str = "path") -> DataFrame:
    """Adds day: the first eight digits of each file's name; files without are left out."""
    digits = F.regexp_extract(F.regexp_extract(column, r"([^/]*)$", 1), r"(\d{8})", 1)
    return paths.withColumn("day", F.try_to_timestamp(digits, F.lit("yyyyMMdd")).cast("date")).where("day is not null")


def read_raster_series(spark: SparkSession, path: str, decode=None) -> DataFrame:
    """day, row, col, value of a folder of dated rasters. decode: bytes to a 2-D array (NPY without one)."""
    decode = decode or (lambda raw: np.load(io.BytesIO(raw)))

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for day, raw in zip(pdf["day"], pdf["content"], strict=True):
                z = np.asarray(decode(bytes(raw)), dtype=float)
                r, c = np.divmod(np.arange(z.size), z.shape[1])
                v = z.ravel()
                yield pd.DataFrame({"day": day, "row": r, "col": c, "value": np.where(np.isfinite(v), v, None)})

    files = dated(spark.read.format("binaryFile").load(path)).select("day", "content")
    return files.mapInPandas(cells, "day date, row long, col long, value double")


#: Keys that a provenance record must have (fixed values).
PROVENANCE_KEYS = ["site", "job_id", "backend", "collection", "aoi_path", "aoi_sha256", "temporal_extent", "train_cutoff", "bands", "scl_mask", "monthly_reducer", "process_graph", "output_path"]


def read_provenance(spark: SparkSession, path: str) -> dict:
    """A provenance record whose extent ends at its cutoff."""
    record = json.loads("\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect()))
    missing = sorted(set(PROVENANCE_KEYS) - set(record))
    if missing:
        raise ValueError(f"the provenance record lacks {missing}")
    if record["temporal_extent"][1] != record["train_cutoff"]:
        raise ValueError("the extent does not end at the training cutoff")
    return record


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def month_intervals(lower: str | Column, upper: str | Column) -> Column:
    """An array of (start, stop): the months from lower to upper, clipped to both."""
    lo, hi = (F.to_date(F.lit(x)) if isinstance(x, str) else x for x in (lower, upper))
    months = F.sequence(F.trunc(lo, "month"), F.trunc(hi, "month"), F.expr("interval 1 month"))
    return F.transform(months, lambda m: F.struct(F.greatest(m, lo).alias("start"), F.least(F.last_day(m), hi).alias("stop")))
