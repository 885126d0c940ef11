"""Zones: k-means with seeded restarts, the number of zones, selection of settings."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrazone.functions.columns import dot, minus
from terrazone.sources.sinks import written

EPSILON = 1e-12
#: A restart draws from this far beyond the seed, times its number from 1.
RESTART_STEP = 104_729
#: Ranges of nodes whose distances are summed up before a draw is placed.
BINS = 4096


def assign(nodes: DataFrame, centers: DataFrame) -> DataFrame:
    """node, label, d2: the nearest centre of each node, ties to the lower label. centers: label, c; few, so broadcast."""
    d = minus(F.col("z"), F.col("c"))
    met = nodes.select("node", "z").crossJoin(F.broadcast(centers)).withColumn("d2", dot(d, d))
    best = met.groupBy("node").agg(F.min(F.struct("d2", "label")).alias("b"))
    return best.select("node", F.col("b.label").alias("label"), F.col("b.d2").alias("d2"))


def update(nodes: DataFrame, assigned: DataFrame, dim: int, labels: int) -> DataFrame:
    """label, c: the means of the assigned nodes; labels without a node take the farthest nodes, the first by number."""
    means = nodes.select("node", "z").join(assigned.select("node", "label"), "node").groupBy("label").agg(F.array(*[F.avg(F.col("z")[k]) for k in range(dim)]).alias("c"))
    every = nodes.sparkSession.range(labels).select(F.col("id").alias("label"))
    empty = every.join(means, "label", "left_anti").withColumn("r", F.row_number().over(Window.orderBy("label")))
    far = assigned.orderBy(F.desc("d2"), "node").limit(labels).withColumn("r", F.row_number().over(Window.orderBy(F.desc("d2"), "node")))
    filled = empty.join(far.select("r", "node"), "r").join(nodes.select("node", F.col("z").alias("c")), "node").select("label", "c")
    return means.select("label", "c").union(filled)


@dataclass
class Zones:
    labels: np.ndarray
    centers: np.ndarray
    inertia: float
    iterations: int


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.stack([((x - k) ** 2).sum(axis=1) for k in c], axis=1)


def _nearest(x: np.ndarray, xx: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, ties to the first, as `_squared` has it: |c|^2 - 2 xc has a known error, and rows with
    two centres within it are measured by differences."""
    d = x @ (-2 * c.T)
    d += (c * c).sum(axis=1)
    labels = d.argmin(axis=1)
    if len(c) > 1:
        two = np.partition(d, 1, axis=1)
        slack = 16 * (x.shape[1] + 8) * np.finfo(float).eps * (xx + (c * c).sum(axis=1).max())
        close = np.flatnonzero(~(two[:, 1] - two[:, 0] > slack))
        labels[close] = _squared(x[close], c).argmin(axis=1)
    return labels


def _spread(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ centres: the first at random, each next with a chance in proportion to its squared distance."""
    chosen = [int(rng.integers(len(x)))]
    near = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        total = near.sum()
        free = np.ones(len(x), dtype=bool)
        free[chosen] = False
        chosen.append(int(rng.choice(len(x), p=near / total)) if total > EPSILON else int(np.flatnonzero(free)[0]))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen].copy()


def restart(x: np.ndarray, k: int, seed: int, number: int, max_iter: int = 300) -> Zones:
    """One run of Lloyd's steps until no label changes."""
    rng = np.random.default_rng(seed + RESTART_STEP * (number + 1))
    centers, old, turns = _spread(x, k, rng), None, 0
    xx = (x * x).sum(axis=1)
    for turns in range(1, max_iter + 1):
        labels = _nearest(x, xx, centers)
        if old is not None and (labels == old).all():
            break
        size = np.bincount(labels, minlength=k)
        means = (labels == np.arange(k)[:, None]).astype(float) @ x / np.maximum(size, 1)[:, None]
        if not size.all():
            far = np.lexsort((np.arange(len(x)), -((x - centers[labels]) ** 2).sum(axis=1)))
            means[size == 0] = x[far[: (size == 0).sum()]]
        centers, old = means, labels
    labels = _nearest(x, xx, centers)
    return Zones(labels, centers, float(((x - centers[labels]) ** 2).sum(axis=1).sum()), turns)


def kmeans(x: np.ndarray, k: int, seed: int = 0, n_init: int = 20, max_iter: int = 300) -> Zones:
    """The best of n_init restarts; a later one must be better by more than EPSILON."""
    if not 1 <= k <= len(x) or n_init < 1 or not np.isfinite(x).all():
        raise ValueError("k is between 1 and the number of finite rows, n_init at least 1")
    best = None
    for number in range(n_init):
        got = restart(x, k, seed, number, max_iter)
        if best is None or got.inertia < best.inertia - EPSILON:
            best = got
    return best


def fit(nodes: DataFrame, ks: list[int], seed: int = 0, n_init: int = 20, with_labels: bool = True) -> DataFrame:
    """k, restart, inertia, labels of every restart of every k: one task each, over the nodes' broadcast latent values.
    Written, so that what reads the runs several times does not run them again; without labels nodes and labels are null.

    The latent values of one problem must fit a task; bigger ones use `fit_frames`.
    """
    spark = nodes.sparkSession
    held = nodes.orderBy("node").select("node", "z").toPandas()
    shared = spark.sparkContext.broadcast((held["node"].to_numpy(), np.stack(held["z"].to_numpy())))
    jobs = spark.createDataFrame([(k, r) for k in ks for r in range(n_init)], "k int, restart int").repartition(len(ks) * n_init, "k", "restart")

    def run(frames):
        ids, x = shared.value
        for pdf in frames:
            for k, r in pdf.itertuples(index=False):
                got = restart(x, int(k), seed, int(r))
                yield pd.DataFrame({"k": [k], "restart": [r], "inertia": [got.inertia], "nodes": [ids if with_labels else None], "labels": [got.labels if with_labels else None]})

    runs = jobs.mapInPandas(run, "k int, restart int, inertia double, nodes array<long>, labels array<long>")
    return written(runs, "runs")


def _drawn(near: DataFrame, draw: float) -> int:
    """The first node, in order, up to which the share of the squared distances exceeds the draw: sums of at most BINS
    ranges of nodes first, then the nodes of one range."""
    ends = near.agg(F.min("node").alias("a"), F.max("node").alias("b"), F.sum("d2").alias("s")).first()
    width = (ends.b - ends.a) // BINS + 1
    at = F.floor((F.col("node") - ends.a) / width)
    bins = sorted((r.at, r.s, r.n) for r in near.groupBy(at.alias("at")).agg(F.sum("d2").alias("s"), F.max("node").alias("n")).collect())
    want, below = draw * ends.s, 0.0
    for place, s, _ in bins:
        if below + s > want:
            upto = F.sum("d2").over(Window.orderBy("node"))  # one range of nodes
            return near.where(at == place).withColumn("u", upto + below).where(F.col("u") > want).agg(F.min("node")).first()[0]
        below += s
    return bins[-1][2]


def spread(nodes: DataFrame, k: int, rng: np.random.Generator) -> DataFrame:
    """label, c: k-means++ centres of nodes (node, z) by the draws of `_spread`, for nodes that fit no task."""
    n = nodes.count()
    if not 1 <= k <= n:
        raise ValueError("k is between 1 and the number of nodes")
    chosen = [_drawn(nodes.select("node", F.lit(1.0).alias("d2")), (int(rng.integers(n)) + 0.5) / n)]
    while True:
        centers = written(nodes.where(F.col("node").isin(chosen)).select("node", "z"), "centers")
        if len(chosen) == k:
            order = F.element_at(F.create_map(*[x for j, c in enumerate(chosen) for x in (F.lit(c), F.lit(j))]), F.col("node"))
            return centers.select(order.cast("long").alias("label"), F.col("z").alias("c"))
        near = written(assign(nodes, centers.select(F.col("node").alias("label"), F.col("z").alias("c"))).select("node", "d2"), "near")
        if near.agg(F.sum("d2")).first()[0] > EPSILON:
            chosen.append(_drawn(near, float(rng.random())))
        else:
            chosen.append(nodes.where(~F.col("node").isin(chosen)).agg(F.min("node")).first()[0])


def fit_frames(nodes: DataFrame, k: int, seed: int = 0, n_init: int = 20, max_iter: int = 300) -> tuple[DataFrame, float]:
    """node, label of the best of n_init restarts, and its inertia: the steps of `restart` as frames over written tables,
    for nodes that fit no task. The driver sees a count and a sum for each step."""
    dim = len(nodes.first().z)
    nodes = written(nodes.select("node", "z"), "nodes")
    best, least = None, float("inf")
    for number in range(n_init):
        centers, old = spread(nodes, k, np.random.default_rng(seed + RESTART_STEP * (number + 1))), None
        for _ in range(max_iter + 1):
            now = written(assign(nodes, centers), "assigned")
            if old is not None and now.join(old.select("node", F.col("label").alias("was")), "node").where("label <> was").isEmpty():
                break
            centers, old = written(update(nodes, now, dim, k), "centers"), now
        inertia = now.agg(F.sum("d2")).first()[0]
        if inertia < least - EPSILON:
            best, least = now.select("node", "label"), inertia
    return best, least


def best_runs(runs: DataFrame) -> DataFrame:
    """For each k the run that wins: inertias in order of restart, a later one only if better by more than EPSILON."""
    w = Window.partitionBy("k").orderBy("restart")
    kept = F.aggregate(F.sort_array(F.collect_list(F.struct("restart", "inertia")).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))),
                       F.struct(F.lit(-1).alias("restart"), F.lit(float("inf")).alias("inertia")), lambda a, x: F.when(x["inertia"] < a["inertia"] - EPSILON, x).otherwise(a))
    return runs.withColumn("_b", kept["restart"]).where(F.col("restart") == F.col("_b")).drop("_b")


def elbow(inertias: DataFrame, low: int = 2, high: int = 10) -> DataFrame:
    """k, inertia, q, score, best: distance below the straight line from k = low to high; the first largest inside wins."""
    ends = inertias.agg(F.max(F.when(F.col("k") == low, F.col("inertia"))).alias("a"), F.max(F.when(F.col("k") == high, F.col("inertia"))).alias("b"))
    q = F.when(F.abs(F.col("a") - F.col("b")) <= EPSILON, 0.0).otherwise((F.col("inertia") - F.col("b")) / (F.col("a") - F.col("b") + EPSILON))
    rows = inertias.crossJoin(F.broadcast(ends)).withColumn("q", q).withColumn("score", (high - F.col("k")) / (high - low) - F.col("q"))
    inner = F.col("k").between(low + 1, high - 1)
    rank = F.row_number().over(Window.orderBy(F.desc(F.when(inner, F.col("score"))), "k"))
    return rows.withColumn("best", inner & (rank == 1)).select("k", "inertia", "q", "score", "best")


def select_settings(rows: DataFrame, margin: float = 0.05) -> DataFrame:
    """Adds eligible and selected: within the margin of the least fdd, the least (fi, fdd, simplicity or position).

    rows of one method: position, config, fdd, fi, simplicity (may be null).
    """
    least = rows.agg(F.min("fdd").alias("_m"))
    both = rows.crossJoin(F.broadcast(least)).withColumn("eligible", F.col("fdd") <= (1 + margin) * F.col("_m"))
    order = [F.desc("eligible"), "fi", "fdd", F.coalesce("simplicity", "position"), "position"]
    return both.withColumn("selected", F.row_number().over(Window.orderBy(*order)) == 1).drop("_m")
