"""The time axis: causal split, admission of epochs, gap interpolation, rates, segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FRACTIONS = (0.6, 0.2, 0.2)
SEGMENTS = 12


def with_periods(epochs: DataFrame, fractions: Sequence[float] = FRACTIONS) -> DataFrame:
    """Adds period: train, val or test, by floor of the fractions of n in order of e. Fewer than three epochs, or a
    period without one, are an error when the rows are read."""
    if abs(sum(fractions) - 1) > 1e-12 or min(fractions) <= 0:
        raise ValueError("fractions must be positive and sum to one")
    train, val = (F.floor(F.lit(f) * F.col("n")) for f in fractions[:2])
    named = F.when(F.col("e") < train, "train").when(F.col("e") < train + val, "val").otherwise("test")
    bad = (F.col("n") < 3) | (train < 1) | (val < 1) | (train + val >= F.col("n"))
    return epochs.withColumn("period", F.when(bad, F.raise_error(F.lit("a period of the split has no epoch"))).otherwise(named))


def admitted(panel: DataFrame, stage: str) -> DataFrame:
    """Rows that a model built at a stage may see: train, or train_val. Applied before any aggregate."""
    if stage not in ("train", "train_val"):
        raise ValueError("stage is train or train_val")
    return panel.where(F.col("period").isin(["train", "val"] if stage == "train_val" else ["train"]))


def train_prefix(panel: DataFrame) -> DataFrame:
    """All epochs, with values only in the training period; later ones are unread placeholders."""
    early = F.col("period") == "train"
    return panel.withColumn("value", F.when(early, F.col("value"))).withColumn("valid", early & F.col("value").isNotNull())


def value_scope(panel: DataFrame, scope: str) -> DataFrame:
    """One row that says which values of the axis were read."""
    early = scope == "train_only"
    n = F.max("n")
    last = F.floor(F.lit(FRACTIONS[0]) * n) if early else n
    return panel.agg(n.alias("full_epoch_count"), (last - 1).alias("last_index"), F.lit(not early).alias("validation_read"), F.lit(not early).alias("test_read")).withColumn("value_scope", F.lit(scope))


def late_rows(rows: DataFrame, t: Column, cutoff: Column) -> DataFrame:
    """How many rows were checked, and how many lie beyond an inclusive cutoff."""
    return rows.agg(F.count("*").alias("checked"), F.count_if(t > cutoff).alias("late"))


def interpolate(panel: DataFrame, by: Sequence[str] = ("node",)) -> DataFrame:
    """Fills gaps linearly in time, flat beyond the ends; a node without a value is an error when it is read.

    One window for each direction over a node's epochs; no self-join.
    """
    seen = F.when(F.col("value").isNotNull(), F.struct(F.col("years").alias("y"), F.col("value").alias("v")))
    w = Window.partitionBy(*by).orderBy("e")
    left = F.last(seen, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first(seen, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = panel.withColumns({"_l": left, "_r": right})
    share = (F.col("years") - F.col("_l.y")) / (F.col("_r.y") - F.col("_l.y"))
    line = F.col("_l.v") + share * (F.col("_r.v") - F.col("_l.v"))
    filled = F.coalesce("value", line, "_l.v", "_r.v", F.raise_error(F.lit("a node has no value")).cast("double"))
    return both.withColumn("filled", filled).drop("_l", "_r")


def rates(panel: DataFrame, value: str = "filled", by: Sequence[str] = ("node",)) -> DataFrame:
    """Adds rate: the change from the epoch before, per year; null at the first."""
    w = Window.partitionBy(*by).orderBy("e")
    return panel.withColumn("rate", (F.col(value) - F.lag(value).over(w)) / (F.col("years") - F.lag("years").over(w)))


def segments(panel: DataFrame, value: str, length: int, first: int = 0, by: Sequence[str] = ("node",), count: int = SEGMENTS) -> DataFrame:
    """Piecewise aggregate: means over `count` segments of equal width, epochs on a border shared by their parts.

    length: epochs of the axis; an epoch's place is e - first. Each epoch meets at most two or, where segments are
    short, a few segments, found by arithmetic and not by a join.
    """
    if length < count:
        raise ValueError("an axis has at least as many epochs as segments")
    width = length / count
    place = F.col("e") - first
    part = F.explode(F.sequence(F.floor(place / width).cast("int"), F.least(F.ceil((place + 1) / width).cast("int"), F.lit(count)) - 1))
    cut = panel.select(*by, place.alias("i"), F.col(value).alias("x"), part.alias("segment"))
    weight = F.greatest(F.lit(0.0), F.least(F.col("i") + 1, (F.col("segment") + 1) * width) - F.greatest(F.col("i").cast("double"), F.col("segment") * width))
    return cut.groupBy(*by, "segment").agg((F.sum(weight * F.col("x")) / width).alias("value"))


def rebased(panel: DataFrame, value: str = "value", by: Sequence[str] = ("node",)) -> Column:
    """The value less the node's first."""
    w = Window.partitionBy(*by).orderBy("e").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.col(value) - F.first(value).over(w)
