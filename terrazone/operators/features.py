"""Node features: robust scaling, long-term statistics, blocks, the latent space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrazone.functions.columns import EPSILON, quantile, quantiles
from terrazone.operators import timeaxis
from terrazone.sources.sinks import written

LONG_TERM = ["mean", "std", "median", "mad", "q05", "q25", "q75", "q95", "trend", "mean_abs_rate", "max_abs_rate", "end_minus_start", "late_minus_early", "annual_amplitude"]


def robust_scale(rows: DataFrame, columns: list[str], epsilon: float = EPSILON) -> DataFrame:
    """(x - median) / (interquartile range + epsilon) of each column. Quantiles are exact; one row is broadcast."""
    parts = quantiles(rows, {f"_{c}": F.col(c) for c in columns}, [0.25, 0.5, 0.75])
    both = rows.crossJoin(F.broadcast(parts))
    return both.withColumns({c: (F.col(c) - F.col(f"_{c}")[1]) / (F.col(f"_{c}")[2] - F.col(f"_{c}")[0] + epsilon) for c in columns}).select(*rows.columns)


def node_normalised(panel: DataFrame, value: str = "filled", epsilon: float = EPSILON) -> DataFrame:
    """Adds normalised: (x - median) / (median absolute deviation + epsilon) within each node."""
    w = Window.partitionBy("node")
    centred = panel.withColumn("_d", F.col(value) - F.percentile(value, F.lit(0.5)).over(w))
    return centred.withColumn("normalised", F.col("_d") / (F.percentile(F.abs("_d"), F.lit(0.5)).over(w) + epsilon)).drop("_d")


def annual_weights(years: list[float]) -> list[tuple[float, float]]:
    """For each epoch, the weights that give the sine and cosine coefficient of a fit on 1, t, sin 2 pi t, cos 2 pi t.

    The design is common to all nodes, so a fit is a weighted sum; a singular one gets the least-norm solution.
    """
    t = np.array(years)
    inverse = np.linalg.pinv(np.column_stack([np.ones_like(t), t, np.sin(2 * np.pi * t), np.cos(2 * np.pi * t)]))
    return [(float(a), float(b)) for a, b in zip(inverse[2], inverse[3], strict=True)]


def with_annual_weights(panel: DataFrame) -> DataFrame:
    """Adds w_sin and w_cos. The epochs of the axis are gathered: as many rows as the axis has epochs."""
    axis = sorted((r.e, r.years) for r in panel.select("e", "years").distinct().collect())
    rows = [(e, a, b) for (e, _), (a, b) in zip(axis, annual_weights([y for _, y in axis]), strict=True)]
    return panel.join(F.broadcast(panel.sparkSession.createDataFrame(rows, "e int, w_sin double, w_cos double")), "e")


def amplitude(value: str) -> Column:
    return F.hypot(F.sum(F.col("w_sin") * F.col(value)), F.sum(F.col("w_cos") * F.col(value)))


def long_term(panel: DataFrame, value: str = "filled") -> DataFrame:
    """The 14 ordered long-term statistics of each node's working series (LONG_TERM)."""
    w = Window.partitionBy("node")
    v = F.col(value)
    rows = with_annual_weights(timeaxis.rates(panel, value))
    rows = rows.withColumns({"_mid": F.percentile(v, F.lit(0.5)).over(w), "_t": F.floor(F.count("*").over(w) / 2), "_i": F.row_number().over(w.orderBy("e")) - 1})
    early = F.col("_i") < F.col("_t")
    return rows.groupBy("node").agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), quantile(v, 0.5).alias("median"), quantile(F.abs(v - F.col("_mid")), 0.5).alias("mad"),
        *[quantile(v, q).alias(f"q{round(100 * q):02d}") for q in (0.05, 0.25, 0.75, 0.95)],
        F.regr_slope(v, F.col("years")).alias("trend"), F.avg(F.abs("rate")).alias("mean_abs_rate"), F.max(F.abs("rate")).alias("max_abs_rate"),
        (F.max_by(v, "e") - F.min_by(v, "e")).alias("end_minus_start"), (F.avg(F.when(~early, v)) - F.avg(F.when(early, v))).alias("late_minus_early"),
        amplitude(value).alias("annual_amplitude"),
    )


def block_energy(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the root mean square length of a block's rows."""
    total = sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0))
    return rows.agg(F.sqrt(F.sum(total) / F.count("*")).alias("energy"), F.count("*").alias("n"))


def blocks(panel: DataFrame) -> tuple[DataFrame, list[list[str]]]:
    """Each node's three blocks side by side: 12 segment means of the normalised series, 12 of its rates, 14 statistics."""
    filled = timeaxis.interpolate(panel).persist()  # read by each of the three blocks
    lengths = filled.agg(F.countDistinct("e").alias("n"), F.min("e").alias("first")).first()
    if lengths.n < 13:
        raise ValueError("a construction period has at least 13 epochs")
    shape = timeaxis.segments(node_normalised(filled), "normalised", lengths.n, lengths.first)
    moved = timeaxis.rates(filled).where("rate is not null")
    rate = timeaxis.segments(node_normalised(moved, "rate"), "normalised", lengths.n - 1, lengths.first + 1)
    names = [[f"{p}{k}" for k in range(timeaxis.SEGMENTS)] for p in ("s", "r")]

    def wide(rows: DataFrame, cols: list[str]) -> DataFrame:
        return rows.groupBy("node").agg(*[F.max(F.when(F.col("segment") == k, F.col("value"))).alias(c) for k, c in enumerate(cols)])

    joined = wide(shape, names[0]).join(wide(rate, names[1]), "node").join(long_term(filled), "node")
    return joined, [*names, LONG_TERM]


def products(rows: DataFrame, column: str, dim: int) -> tuple[int, np.ndarray]:
    """How many rows, and the sum of their outer products: one matrix for each task, added up on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dim, dim)), 0
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            total, n = total + x.T @ x, n + len(x)
        at = np.append(np.arange(dim * dim), -1)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(total.ravel(), float(n)))], names=["at", "v"])

    found = dict(map(tuple, rows.select(column).mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()))
    return int(found.pop(-1, 0)), np.array([found.get(k, 0.0) for k in range(dim * dim)]).reshape(dim, dim)


def latent(panel: DataFrame, threshold: float = 0.95, epsilon: float = EPSILON) -> tuple[DataFrame, dict]:
    """node, z: scaled blocks of equal energy, centred and projected on the first principal axes that hold `threshold`
    of the variance, signs fixed by each axis's largest weight, then scaled robustly.

    Sums of products are aggregated on the executors; the driver solves a 38 by 38 eigenproblem.
    """
    rows, parts = blocks(panel)
    names = [c for p in parts for c in p]
    rows = written(robust_scale(written(rows, "blocks"), names, epsilon), "scaled")
    energy = rows.agg(*[F.sqrt(F.sum(sum((F.col(c) * F.col(c) for c in p), F.lit(0.0))) / F.count("*")) for p in parts]).first()
    scaled = rows.select("node", F.array(*[F.col(c) / (max(e, epsilon) * 3**0.5) for p, e in zip(parts, energy, strict=True) for c in p]).alias("x"))
    # a one before each row: its products are the sums and the count, so one pass gives means and covariances
    n, gram = products(scaled.select(F.concat(F.array(F.lit(1.0)), "x").alias("x")), "x", len(names) + 1)
    if n < 2:
        raise ValueError("a latent space takes at least two nodes")
    mean = gram[0, 1:] / n
    gram = gram[1:, 1:] - n * np.outer(mean, mean)  # values are robustly scaled, so little cancels
    centred = scaled.withColumn("x", F.zip_with("x", F.array(*[F.lit(float(m)) for m in mean]), lambda a, b: a - b))
    value, axes = np.linalg.eigh(gram / (n - 1))
    value, axes = np.maximum(value[::-1], 0), axes[:, ::-1]
    share = np.cumsum(value) / max(value.sum(), 1e-300)
    p = 1 if value.sum() <= epsilon else int(np.argmax(share >= threshold)) + 1
    for k in range(p):
        axes[:, k] *= np.sign(axes[np.abs(axes[:, k]).argmax(), k]) or 1
    out = centred.select("node", *[sum((F.col("x")[i] * float(axes[i, k]) for i in range(len(names))), F.lit(0.0)).alias(f"z{k}") for k in range(p)])
    z = robust_scale(out, [f"z{k}" for k in range(p)], epsilon)
    return z.select("node", F.array(*[f"z{k}" for k in range(p)]).alias("z")), {"components": p, "shares": share.tolist(), "variances": value.tolist(), "features": names}
