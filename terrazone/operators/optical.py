"""Monthly imagery: features of each node and their reliability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazone.functions.columns import EPSILON, quantile
from terrazone.operators.features import robust_scale

STATISTICS = ["median", "std", "q25", "q75", "last_minus_first"]


def features(rows: DataFrame, indices: list[str]) -> DataFrame:
    """node, q_o and five statistics of each index over usable months (valid proportion above 0 and a value).

    rows: node, month, valid_proportion and the indices. q_o is the mean valid proportion over all months.
    """
    aggs = [F.avg("valid_proportion").alias("q_o")]
    for name in indices:
        v = F.when(F.col("valid_proportion") > 0, F.when(~F.isnan(name), F.col(name)))
        when = F.when(v.isNotNull(), F.col("month"))
        made = [quantile(v, 0.5), F.stddev_pop(v), quantile(v, 0.25), quantile(v, 0.75), F.max_by(v, when) - F.min_by(v, when)]
        aggs += [x.alias(f"{name}_{s}") for x, s in zip(made, STATISTICS, strict=True)]
    return rows.groupBy("node").agg(*aggs)


def representation(rows: DataFrame, indices: list[str], epsilon: float = EPSILON) -> DataFrame:
    """node, q_o, z_o: features with gaps filled by the column's median (0 where all are missing), scaled robustly."""
    made = features(rows, indices)
    names = [f"{i}_{s}" for i in indices for s in STATISTICS]
    middle = made.agg(*[F.coalesce(quantile(F.col(c), 0.5), F.lit(0.0)).alias(f"_{c}") for c in names])
    filled = made.crossJoin(F.broadcast(middle)).select("node", "q_o", *[F.coalesce(c, F.col(f"_{c}")).alias(c) for c in names])
    return robust_scale(filled, names, epsilon).select("node", "q_o", F.array(*names).alias("z_o"))
