"""Epochs as they arrive: admission up to a cutoff, windowed panels with late data, each node's last rate."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def admit(stream: DataFrame, t: str, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """Rows up to an inclusive cutoff, and those beyond it, which are refused and not dropped silently."""
    late = F.col(t).cast("timestamp") > F.to_timestamp(F.lit(cutoff))
    return stream.where(~late), stream.where(late)


def windowed_panel(stream: DataFrame, node: str, t: str, value: str, width: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """node, t, value, n: means by window; a window closes when the watermark passes it."""
    rows = stream.select(F.col(node).alias("node"), F.col(t).cast("timestamp").alias("t"), F.col(value).alias("value")).withWatermark("t", lateness)
    found = rows.groupBy(F.window("t", width).alias("w"), "node").agg(F.avg("value").alias("value"), F.count("value").alias("n"))
    return found.select("node", F.col("w.start").alias("t"), "value", "n")


def last_rates(stream: DataFrame, node: str, t: str, value: str) -> DataFrame:
    """node, t, value, rate: for each micro-batch and node the newest value and its rate from the one before, per year.
    State holds one value for each node; rows older than it are ignored."""
    rows = stream.select(F.col(node).cast("long").alias("node"), F.col(t).cast("timestamp").alias("t"), F.col(value).cast("double").alias("value"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else None
        out = []
        for pdf in batches:
            for x, v in pdf.dropna().sort_values(["t", "value"])[["t", "value"]].itertuples(index=False):
                at = x.timestamp()
                if old is None or at > old[0]:
                    rate = None if old is None else (v - old[1]) / ((at - old[0]) / 86400 / 365.25)
                    old = (at, float(v))
                    out = [(key[0], x, float(v), rate)]
        if old is not None:
            state.update(old)
        yield pd.DataFrame(out, columns=["node", "t", "value", "rate"])

    return rows.groupBy("node").applyInPandasWithState(step, "node long, t timestamp, value double, rate double", "at double, value double", "update", GroupStateTimeout.NoTimeout)
