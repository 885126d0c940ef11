"""Graphs over nodes: exact nearest neighbours, affinities, edge weights, components.

An edge is (src, dst) with src < dst. Node attributes reach edges by two equi-joins and come back by a grouped sum.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrazone.functions.columns import EPSILON, affinity, clip, minus, norm, quantiles
from terrazone.operators import linkage
from terrazone.sources.sinks import written

#: Nodes of a block at most, and queries of a block of few nodes; queries whose distances are held at once, and of them
#: groups of nodes whose least one bounds the k-th; candidates of a query from which on it is sorted on its own.
BLOCK, FEW, HELD, GROUP, MANY = 16_384, 1024, 256, 32, 256
#: Points of a cell of the first grid on average, and at most.
SOME, FULL = 128, 1024


def neighbours(nodes: DataFrame, k: int, vector: str = "z") -> DataFrame:
    """node, other, distance: the k nearest other nodes of each, ties to the lower node.

    Exact in any dimension: every block of queries meets every block of nodes in a task of bounded size, which keeps
    the block's k best; the rest is a top k over k rows for each block. Products of the blocks leave few candidates, and
    those are measured and ordered as such.
    """
    n = nodes.count()
    if not 1 <= k < n:
        raise ValueError("k is at least 1 and less than the number of nodes")
    d = -(-n // BLOCK)
    q = max(d, min(nodes.sparkSession.sparkContext.defaultParallelism, -(-n // FEW)))
    rows = nodes.select("node", F.col(vector).alias("z"))
    asked = rows.select(F.pmod(F.xxhash64("node"), F.lit(q)).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(d - 1))).alias("d"), F.lit(True).alias("asks"), "node", "z")
    known = rows.select(F.explode(F.sequence(F.lit(0), F.lit(q - 1))).alias("q"), F.pmod(F.xxhash64("node", F.lit(1)), F.lit(d)).cast("int").alias("d"), F.lit(False).alias("asks"), "node", "z")

    def best(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        node = table["node"].to_numpy()
        z = np.array(table["z"].combine_chunks().flatten()).reshape(len(node), -1)
        order = np.argsort(node, kind="stable")
        own, other = order[asks[order]], order[~asks[order]]
        i, j, dist = nearest(z[own], node[own], z[other], node[other], k)
        return pa.table({"node": pa.array(node[own[i]], pa.int64()), "other": pa.array(node[other[j]], pa.int64()), "distance": pa.array(dist, pa.float64())})

    near = asked.union(known).groupBy("q", "d").applyInArrow(best, "node long, other long, distance double")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("distance", "other"))
    return near.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def nearest(x: np.ndarray, x_node: np.ndarray, y: np.ndarray, y_node: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x, their k nearest rows of y that are other nodes, and the distances; y is in order of nodes, and ties go to
    the first. Distances that are not finite do not count.

    |x|^2 + |y|^2 - 2 xy is within a known error of a squared distance, so what it puts beyond the k-th by more than that
    is no neighbour; the others' distances are summed from differences.
    """
    middle = y.mean(axis=0) if len(y) else np.zeros(x.shape[1])
    middle = np.where(np.isfinite(middle), middle, 0.0)
    near_x, near_y = x - middle, y - middle  # squares of large coordinates would hide small distances
    xx, yy = (near_x * near_x).sum(axis=1), (near_y * near_y).sum(axis=1)
    slack = 8 * (x.shape[1] + 8) * np.finfo(float).eps * (xx + yy.max(initial=0.0))
    groups = len(y) // GROUP
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]

    def kept(i: np.ndarray, j: np.ndarray) -> None:  # pairs in order of x, then y
        dist = np.sqrt(((y[j] - x[i]) ** 2).sum(axis=1))
        good = np.flatnonzero(np.isfinite(dist) & (x_node[i] != y_node[j]))
        i, j, dist = i[good], j[good], dist[good]
        order = np.lexsort((j, dist, i))
        i, j, dist = i[order], j[order], dist[order]
        first = np.searchsorted(i, i)
        top = np.arange(len(i)) - first < k
        for held, v in zip(out, (i, j, dist), strict=True):
            held.append(v[top])

    for lo in range(0, len(x), HELD):
        own = np.arange(lo, min(lo + HELD, len(x)))
        with np.errstate(invalid="ignore", over="ignore"):
            d = near_x[own] @ (-2 * near_y.T)
            d += yy
            d += xx[own, None]
            at = np.searchsorted(y_node, x_node[own])
            there = np.flatnonzero(at < len(y))
            there = there[y_node[at[there]] == x_node[own[there]]]
            d[there, at[there]] = np.inf
            if groups > k:
                least = d[:, : groups * GROUP].reshape(len(own), groups, GROUP).min(axis=2)
                limit = np.partition(least, k - 1, axis=1)[:, k - 1]
            else:
                limit = np.full(len(own), np.inf)
            far = d > (limit + 2 * slack[own])[:, None]  # what is not a number stays
        i, j = np.nonzero(~far)
        count = np.bincount(i, minlength=len(own))
        few = count[i] <= MANY
        kept(own[i[few]], j[few])
        for r in np.flatnonzero(count > MANY).tolist():
            kept(*(v.copy() for v in (np.full(count[r], own[r]), np.flatnonzero(~far[r]))))
    return tuple(np.concatenate(v) for v in out)


def cell_width(points: DataFrame, wide: float, high: float, total: int) -> float:
    """A grid's cell that holds SOME points on average, halved until no cell holds more than FULL (or it is pointless:
    points in one place share a cell at any width)."""
    width = max((wide * high * SOME / total) ** 0.5, max(wide, high) * SOME / total, 1e-9)
    for _ in range(24):
        at = lambda c: F.floor(F.col(c) / width)  # noqa: B023, E731
        most = points.groupBy(at("_x"), at("_y")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if most <= FULL:
            break
        width /= 2
    return width


def planar_neighbours(nodes: DataFrame, k: int, cell: float | None = None) -> DataFrame:
    """The same for points (x, y), by a grid: candidates come from the 3 by 3 cells around a point, and points whose
    k-th candidate is farther than a cell's width, or that have fewer than k, look again in a grid of twice the width.

    A point within the cell width is always among the candidates, so what is kept is exact. The first grid is fine
    enough for the densest part, a given cell is only its widest; what is settled there never looks at wider cells. Rounds
    are written.
    """
    points = written(nodes.select(F.col("node").alias("other"), F.col("x").alias("_x"), F.col("y").alias("_y")), "points")
    size = points.agg(F.count("*").alias("n"), (F.max("_x") - F.min("_x")).alias("w"), (F.max("_y") - F.min("_y")).alias("h")).first()
    if not 1 <= k < size.n:
        raise ValueError("k is at least 1 and less than the number of nodes")
    derived = cell_width(points, size.w, size.h, size.n)
    cell = min(cell, derived) if cell else derived
    left, parts = points.select(F.col("other").alias("node"), F.col("_x").alias("x"), F.col("_y").alias("y")), []
    while True:
        whole = cell > size.w + size.h
        at = lambda c: F.floor(F.col(c) / cell)  # noqa: B023, E731
        around = F.explode(F.array(*[F.struct((at("_x") + i).alias("cx"), (at("_y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("c")
        asked = left.select(at("x").alias("cx"), at("y").alias("cy"), F.lit(True).alias("asks"), "node", "x", "y")
        known = points.select("other", "_x", "_y", around).select("c.cx", "c.cy", F.lit(False).alias("asks"), F.col("other").alias("node"), F.col("_x").alias("x"), F.col("_y").alias("y"))
        known = known.join(asked.select("cx", "cy").distinct(), ["cx", "cy"], "left_semi")
        found = written(asked.union(known).groupBy("cx", "cy").applyInArrow(_in_cell(k, float("inf") if whole else cell), "node long, x double, y double, others array<long>, distances array<double>, good boolean"), "found")
        parts.append(found.where("good").select("node", F.explode(F.arrays_zip("others", "distances")).alias("b")).select("node", F.col("b.others").alias("other"), F.col("b.distances").alias("distance")))
        left = found.where("not good").select("node", "x", "y")
        if whole or left.isEmpty():
            break
        cell *= 2
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _in_cell(k: int, settled: float) -> Callable[[pa.Table], pa.Table]:
    """For each point that asks its k nearest among all of the group; good if there are k, none farther than settled."""

    def best(table: pa.Table) -> pa.Table:
        asks, node = table["asks"].to_numpy(), table["node"].to_numpy()
        z = np.stack([table["x"].to_numpy(), table["y"].to_numpy()], axis=1)
        order = np.argsort(node, kind="stable")
        own, other = order[asks[order]], order[~asks[order]]
        i, j, dist = nearest(z[own], node[own], z[other], node[other], k)
        order = np.argsort(i, kind="stable")
        i, j, dist = i[order], j[order], dist[order]
        first = np.searchsorted(i, np.arange(len(own) + 1))
        good = np.diff(first) == k
        good[good] = dist[first[1:][good] - 1] <= settled
        lists = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), v) for v in (pa.array(node[other[j]], pa.int64()), pa.array(dist, pa.float64()))]
        return pa.table({"node": pa.array(node[own], pa.int64()), "x": z[own, 0], "y": z[own, 1], "others": lists[0], "distances": lists[1], "good": pa.array(good)})

    return best


def edges(near: DataFrame) -> DataFrame:
    """src, dst, distance: the union of the neighbour relation and its reverse, each edge once."""
    return near.groupBy(F.least("node", "other").alias("src"), F.greatest("node", "other").alias("dst")).agg(F.min("distance").alias("distance"))


def knn_union(nodes: DataFrame, k: int, vector: str = "z") -> DataFrame:
    """The edges of the k nearest neighbours, written: what reads them several times does not search again."""
    return written(edges(neighbours(nodes, k, vector)), "edges")


def gather(links: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """Adds each column of both ends, as name_s and name_t."""
    for end, tag in (("src", "s"), ("dst", "t")):
        own = nodes.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{tag}") for c in columns])
        links = links.join(own, end)
    return links


def distances(links: DataFrame, nodes: DataFrame, vector: str, name: str) -> DataFrame:
    both = gather(links, nodes.select("node", F.col(vector).alias("_v")), "_v")
    return both.withColumn(name, norm(minus(F.col("_v_s"), F.col("_v_t")))).drop("_v_s", "_v_t")


def degrees(links: DataFrame) -> DataFrame:
    ends = links.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def divergence(links: DataFrame, dual: str, dim: int) -> DataFrame:
    """node, div: the sum of an edge vector over edges that leave a node less those that enter it."""
    ends = links.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col(dual).alias("v")), F.struct(F.col("dst").alias("node"), F.transform(dual, lambda x: -x).alias("v")))).alias("e"))
    return ends.groupBy(F.col("e.node").alias("node")).agg(F.array(*[F.sum(F.col("e.v")[k]) for k in range(dim)]).alias("div"))


def medians(links: DataFrame, **columns: Column) -> DataFrame:
    """One row: the exact median of each column."""
    return quantiles(links, {n: c for n, c in columns.items()}, [0.5]).select(*[F.col(n)[0].alias(n) for n in columns])


def jump_scale(links: DataFrame, column: str = "distance", epsilon: float = EPSILON) -> DataFrame:
    """One row: the median jump over edges, plus epsilon."""
    return medians(links, m=F.col(column)).select((F.col("m") + epsilon).alias("s_delta"))


def geometry_affinity(links: DataFrame, distance: str = "distance", epsilon: float = EPSILON) -> DataFrame:
    """Adds geometry_affinity, a Gaussian of the distance with the median as width."""
    width = medians(links, m=F.col(distance)).select(F.greatest("m", F.lit(epsilon)).alias("_s"))
    return links.crossJoin(F.broadcast(width)).withColumn("geometry_affinity", affinity(-F.pow(F.col(distance), 2) / (2 * F.pow("_s", 2)))).drop("_s")


def terrain_vector(nodes: DataFrame, degrees: bool = True) -> DataFrame:
    """node, terrain: elevation, slope, sine and cosine of aspect, curvature and ruggedness, robustly scaled."""
    from terrazone.operators.features import robust_scale

    angle = F.radians("aspect") if degrees else F.col("aspect")
    names = ["elevation", "slope", "_sin", "_cos", "curvature", "tri"]
    rows = nodes.withColumns({"_sin": F.sin(angle), "_cos": F.cos(angle)}).select("node", *names)
    return robust_scale(rows, names).select("node", F.array(*names).alias("terrain"))


def physical_graph(nodes: DataFrame, k: int, degrees: bool = True, epsilon: float = EPSILON) -> DataFrame:
    """src, dst, distance, terrain_distance, geometry_affinity, terrain_affinity. nodes: node, x, y and terrain."""
    links = edges(planar_neighbours(nodes.select("node", "x", "y"), k))
    links = distances(links, terrain_vector(nodes, degrees), "terrain", "terrain_distance")
    widths = medians(links, a=F.col("distance"), b=F.col("terrain_distance")).select(F.greatest("a", F.lit(epsilon)).alias("_s"), F.greatest("b", F.lit(epsilon)).alias("_b"))
    near = -F.pow("distance", 2) / (2 * F.pow("_s", 2))
    both = links.crossJoin(F.broadcast(widths)).withColumns({"geometry_affinity": affinity(near), "terrain_affinity": affinity(near - F.pow("terrain_distance", 2) / (2 * F.pow("_b", 2)))})
    return both.drop("_s", "_b")


def optical_gate(links: DataFrame, nodes: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Adds gate: 1 less the ends' joint reliability times the dissimilarity of their features. nodes: node, z_o, q_o."""
    both = gather(links, nodes, "z_o", "q_o").withColumn("_d", norm(minus(F.col("z_o_s"), F.col("z_o_t"))))
    width = medians(both, m=F.col("_d")).select(F.greatest("m", F.lit(epsilon)).alias("_s"))
    like = affinity(-F.pow("_d", 2) / (2 * F.pow("_s", 2)))
    gate = clip(1 - F.sqrt(F.col("q_o_s") * F.col("q_o_t")) * (1 - like), 0, 1)
    return both.crossJoin(F.broadcast(width)).withColumn("gate", gate).select(*links.columns, "gate")


def edge_weights(links: DataFrame, affinity_column: str, gate: str | None = None, epsilon: float = 1e-12) -> DataFrame:
    """Adds omega: affinity times gate, scaled to mean one; uniform where the total vanishes."""
    c = F.col(affinity_column) * (F.col(gate) if gate else 1.0)
    rows = links.withColumn("conductance", c)
    total = rows.agg(F.sum("conductance").alias("_c"), F.count("*").alias("_n"))
    return rows.crossJoin(F.broadcast(total)).withColumn("omega", F.when(F.col("_c") <= epsilon, 1.0).otherwise(F.col("conductance") * F.col("_n") / F.col("_c"))).drop("_c", "_n")


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, root: the least node that each reaches."""
    return nodes.select("node").join(linkage.roots(links), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
