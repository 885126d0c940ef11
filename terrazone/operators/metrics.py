"""Evaluation: dispersion of future motion, fragmentation, agreement, boundaries, error, experiment summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrazone.functions.columns import choose2, dot, minus
from terrazone.operators.graph import components, gather
from terrazone.operators.timeaxis import rebased


#: Ranges of the order of scores that average precision sums up first.
SCORE_CELLS = 4096


def dispersion(panel: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the mean absolute distance of test values, less their node's first, from their zone's median curve.

    All test cells must have a value. labels: node, label.
    """
    cells = panel.where("period = 'test'").withColumn("x", rebased(panel)).join(labels, "node")
    cells = cells.withColumn("x", F.coalesce("x", F.raise_error(F.lit("a test cell has no value")).cast("double")))
    middle = cells.groupBy("label", "e").agg(F.percentile("x", F.lit(0.5)).alias("m"))
    return cells.join(middle, ["label", "e"]).agg((F.sum(F.abs(F.col("x") - F.col("m"))) / F.count("*")).alias("fdd"), F.count("*").alias("cells"))


def fragments(links: DataFrame, labels: DataFrame) -> DataFrame:
    """label, pieces: connected components of each zone over edges inside it."""
    inside = gather(links.select("src", "dst"), labels, "label").where("label_s = label_t").select("src", "dst")
    return components(inside, labels.select("node")).join(labels, "node").groupBy("label").agg(F.countDistinct("root").alias("pieces"))


def fragmentation(links: DataFrame, labels: DataFrame) -> DataFrame:
    return fragments(links, labels).agg(F.avg("pieces").alias("fi"), F.count("*").alias("zones"))


def recovery_error(nodes: DataFrame, estimate: str, truth: str) -> DataFrame:
    """One row: root of the summed squared error over that of the truth, at least 1e-12."""
    d = minus(F.col(estimate), F.col(truth))
    return nodes.agg((F.sqrt(F.sum(dot(d, d))) / F.greatest(F.sqrt(F.sum(dot(F.col(truth), F.col(truth)))), F.lit(1e-12))).alias("nrmse"))


def rand_index(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the adjusted Rand index of two labelings, by one pass of grouping sets."""
    rows = rows.select(F.col(a).alias("_a"), F.col(b).alias("_b"))
    counted = rows.groupingSets([[F.col("_a"), F.col("_b")], [F.col("_a")], [F.col("_b")], []], F.col("_a"), F.col("_b")).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    pairs = {name: F.sum(F.when(F.col("g") == g, choose2(F.col("n"))).otherwise(0.0)) for name, g in (("both", 0), ("left", 1), ("right", 2), ("all", 3))}
    s = counted.agg(*[x.alias(n) for n, x in pairs.items()])
    expected, most = F.try_divide(F.col("left") * F.col("right"), F.col("all")), (F.col("left") + F.col("right")) / 2
    flat = F.when(F.col("both") == most, 1.0).otherwise(0.0)
    return s.select(F.when((F.col("all") == 0) | (most == expected), flat).otherwise((F.col("both") - expected) / (most - expected)).alias("ari"))


def average_precision(rows: DataFrame, positive: str, score: str) -> DataFrame:
    """One row: area under precision and recall, one point for each distinct score; 0 without a positive."""
    # scores are summed up inside ranges of their order first, so that no task sees all of them
    by = rows.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.col(positive).cast("long")).alias("tp"), F.count("*").alias("n"))
    ends = by.agg(F.min("s").alias("_a"), F.max("s").alias("_b"))
    cell = F.least(F.lit(SCORE_CELLS - 1), F.floor((F.col("_b") - F.col("s")) / F.when(F.col("_b") > F.col("_a"), F.col("_b") - F.col("_a")).otherwise(1.0) * SCORE_CELLS)).cast("int")
    by = by.crossJoin(F.broadcast(ends)).select("s", "tp", "n", F.coalesce(cell, F.lit(SCORE_CELLS)).alias("cell"))
    above = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = by.groupBy("cell").agg(F.sum("tp").alias("ctp0"), F.sum("n").alias("cn0"))
    cells = cells.select("cell", F.coalesce(F.sum("ctp0").over(above), F.lit(0)).alias("ctp0"), F.coalesce(F.sum("cn0").over(above), F.lit(0)).alias("cn0"))
    w = Window.partitionBy("cell").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    upto = by.withColumns({"ctp": F.sum("tp").over(w), "cn": F.sum("n").over(w)}).join(F.broadcast(cells), "cell")
    upto = upto.select("s", "tp", (F.col("ctp") + F.col("ctp0")).alias("ctp"), (F.col("cn") + F.col("cn0")).alias("cn"))
    total = rows.agg(F.sum(F.col(positive).cast("long")).alias("p"))
    area = F.sum(F.try_divide(F.col("tp"), F.col("p")) * F.col("ctp") / F.col("cn"))
    return upto.crossJoin(F.broadcast(total)).agg(F.coalesce(F.when(F.max("p") > 0, area), F.lit(0.0)).alias("auprc"))


def boundary_precision(links: DataFrame, nodes: DataFrame, s: float) -> DataFrame:
    """One row: average precision of scaled jumps for edges whose ends differ in truth. nodes: node, u, truth."""
    from terrazone.functions.columns import norm

    both = gather(links.select("src", "dst"), nodes, "u", "truth")
    scored = both.select((F.col("truth_s") != F.col("truth_t")).alias("edge"), (norm(minus(F.col("u_s"), F.col("u_t"))) / s).alias("score"))
    return average_precision(scored, "edge", "score")


def separability(nodes: DataFrame, dim: int) -> DataFrame:
    """One row: the least distance of the centroids of neighbouring labels over the root mean square about them. nodes:
    z, label (0, 1, ... in order)."""
    means = nodes.groupBy("label").agg(F.array(*[F.avg(F.col("z")[k]) for k in range(dim)]).alias("c"))
    gaps = means.alias("a").join(means.alias("b"), F.col("b.label") == F.col("a.label") + 1)
    d = minus(F.col("a.c"), F.col("b.c"))
    least = gaps.agg(F.min(F.sqrt(dot(d, d))).alias("gap"))
    off = minus(F.col("z"), F.col("c"))
    spread = nodes.join(F.broadcast(means), "label").agg(F.sqrt(F.avg(dot(off, off))).alias("spread"))
    return least.crossJoin(spread).select((F.col("gap") / F.greatest("spread", F.lit(1e-12))).alias("separability"))


def boundary_counts(links: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: edges, and those whose ends differ in label."""
    both = gather(links.select("src", "dst"), labels, "label")
    return both.agg(F.count("*").alias("edges"), F.count_if(F.col("label_s") != F.col("label_t")).alias("boundary_edges"))


def summary(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, n, mean, std (sample), median and a 95 % interval of the mean. Null keys form groups."""
    v, half = F.col(value), 1.96 * F.stddev_samp(value) / F.sqrt(F.count(value))
    return rows.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.percentile(v, F.lit(0.5)).alias("median"), (F.avg(v) - half).alias("ci95_low"), (F.avg(v) + half).alias("ci95_high"))


def ranked(rows: DataFrame, site: str, *measures: str) -> DataFrame:
    """Adds rank_<measure> within each site, ties sharing the lowest."""
    return rows.withColumns({f"rank_{m}": F.rank().over(Window.partitionBy(site).orderBy(m)) for m in measures})
