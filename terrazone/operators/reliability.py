"""Node reliability: metadata, valid share and local residuals into weights of mean one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrazone.functions.columns import EPSILON, clip


def quality_inputs(quality: DataFrame, audit: DataFrame) -> DataFrame:
    """Fields of the data that the audit accepts and gives a direction; names must agree exactly."""
    accepted = audit.where((F.col("status") == "ACCEPTED") & F.col("direction").isNotNull()).select("field", "direction")
    return quality.join(F.broadcast(accepted), "field")


def dropped_fields(quality: DataFrame, audit: DataFrame) -> DataFrame:
    """Accepted fields that no value has but for the case of their name: a warning, not an error."""
    fields = quality.select(F.col("field").alias("found")).distinct()
    accepted = audit.where((F.col("status") == "ACCEPTED") & F.col("direction").isNotNull()).select("field")
    return accepted.join(fields, F.lower("field") == F.lower("found")).where("field <> found")


def range_share(x: Column, low: Column, high: Column, up: Column, epsilon: float = EPSILON) -> Column:
    """Place of x between the 2 % and 98 % quantiles, 0 to 1, reversed where lower is better."""
    return F.when(up, clip((x - low) / (high - low + epsilon), 0, 1)).otherwise(clip((high - x) / (high - low + epsilon), 0, 1))


def metadata_reliability(quality: DataFrame) -> DataFrame:
    """node, q_meta: geometric mean over fields. quality: node, field, value, direction."""
    parts = quality.groupBy("field").agg(F.percentile("value", F.array(F.lit(0.02), F.lit(0.98))).alias("_q"))
    q = range_share(F.col("value"), F.col("_q")[0], F.col("_q")[1], F.col("direction") == "higher_is_better")
    rows = quality.join(F.broadcast(parts), "field").select("node", q.alias("q"))
    return rows.groupBy("node").agg(F.when(F.min("q") <= 0, 0.0).otherwise(F.exp(F.avg(F.log("q")))).alias("q_meta"))


def local_residuals(panel: DataFrame, least: int = 3) -> DataFrame:
    """Valid values' distances from the median of their two valid neighbours on either side; none in nodes with fewer
    than `least` valid values."""
    w = Window.partitionBy("node")
    valid = panel.where("value is not null").withColumn("_n", F.count("*").over(w)).where(F.col("_n") >= least)
    middle = F.percentile("value", F.lit(0.5)).over(w.orderBy("e").rowsBetween(-2, 2))
    return valid.withColumn("residual", F.abs(F.col("value") - middle)).drop("_n")


def residual_scale(panel: DataFrame) -> DataFrame:
    """node, scale: the median residual of every node, null where there is none."""
    scale = local_residuals(panel).groupBy("node").agg(F.percentile("residual", F.lit(0.5)).alias("scale"))
    return panel.select("node").distinct().join(scale, "node", "left")


def residual_reliability(scales: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Adds q_res: 1 where the scale is null, and for all where it does not vary or fewer than two are known."""
    known = scales.agg(F.count("scale").alias("_n"), F.percentile("scale", F.array(F.lit(0.02), F.lit(0.98))).alias("_q"))
    flat = (F.col("_n") < 2) | (F.col("_q")[1] - F.col("_q")[0] <= epsilon)
    q = range_share(F.col("scale"), F.col("_q")[0], F.col("_q")[1], F.lit(False), epsilon)
    both = scales.crossJoin(F.broadcast(known))
    return both.withColumn("q_res", F.when(F.coalesce(flat, F.lit(True)) | F.col("scale").isNull(), 1.0).otherwise(q)).select(*scales.columns, "q_res")


def node_reliability(panel: DataFrame, quality: DataFrame | None = None, epsilon: float = EPSILON) -> DataFrame:
    """node, q_valid, q_meta, q_res, q_d and rho, whose mean is one."""
    rows = panel.groupBy("node").agg(F.avg(F.col("value").isNotNull().cast("double")).alias("q_valid"))
    rows = rows.join(residual_reliability(residual_scale(panel), epsilon).select("node", "q_res"), "node")
    rows = rows.join(metadata_reliability(quality), "node", "left") if quality is not None else rows.withColumn("q_meta", F.lit(1.0))
    rows = rows.withColumn("q_d", F.cbrt(clip(F.coalesce("q_meta", F.lit(1.0)) * F.col("q_valid") * F.col("q_res"), 0, 1)))
    mean = rows.agg(F.avg(F.col("q_d") + epsilon).alias("_m"))
    return rows.crossJoin(F.broadcast(mean)).withColumn("rho", (F.col("q_d") + epsilon) / F.col("_m")).drop("_m")
