"""A whole site: from its panel, points and imagery to zones and their scores; and scores of labels made elsewhere."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazone.operators import features, graph, metrics, recovery, reliability, timeaxis, zoning
from terrazone.operators.experiment import VARIANTS

EVALUATION_NEIGHBOURS = 8


@dataclass
class SiteResult:
    z: DataFrame
    rho: DataFrame
    links: DataFrame
    field: DataFrame
    labels: DataFrame
    metrics: DataFrame
    zones: int


def weights(links: DataFrame, variant: str = "Full") -> DataFrame:
    """omega of a variant: terrain or plain affinity, with or without the gate."""
    v = VARIANTS[variant]
    return graph.edge_weights(links, "terrain_affinity" if v.terrain else "geometry_affinity", "gate" if v.optical and "gate" in links.columns else None)


def evaluate(panel: DataFrame, points: DataFrame, labels: DataFrame, k: int = EVALUATION_NEIGHBOURS) -> DataFrame:
    """One row: dispersion over the test period and fragmentation of zones. points: node, x, y; labels: node, label."""
    near = graph.edges(graph.planar_neighbours(points.select("node", "x", "y"), k))
    return metrics.dispersion(panel, labels).crossJoin(metrics.fragmentation(near, labels))


def run(panel: DataFrame, points: DataFrame, k: int, lam: float, zones: int | None = None, imagery: DataFrame | None = None, quality: DataFrame | None = None, variant: str = "Full", seed: int = 0, n_init: int = 20, stage: str = "train", **solver) -> SiteResult:
    """points: node, x, y, elevation, slope, aspect (degrees), curvature, tri; imagery: node, z_o, q_o; quality: node,
    field, value, direction. Without a number of zones the elbow of the latent values gives it.

    Models see the construction stage alone; only the scores read the test period.
    """
    spark, v = panel.sparkSession, VARIANTS[variant]
    seen = timeaxis.admitted(panel, stage).persist()
    z = features.latent(seen)[0].persist()
    rho = reliability.node_reliability(seen, quality).select("node", "rho")
    links = graph.physical_graph(points, k)
    if imagery is not None:
        links = graph.optical_gate(links, imagery)
    links = weights(links, variant).persist()
    s = graph.jump_scale(graph.distances(links, z, "z", "jump"), "jump").first().s_delta
    nodes = z.join(rho, "node").select(F.lit(1).alias("site"), "node", "z", (F.col("rho") if v.reliability else F.lit(1.0)).alias("rho"))
    edges = links.select(F.lit(1).alias("site"), "src", "dst", "omega", F.lit(s).alias("s"))
    field = recovery.solve_groups(nodes, edges, ["site"], lam, "laplacian" if v.laplacian else "total_variation", **solver).drop("site").persist()
    if zones is None:
        zones = zoning.elbow(zoning.best_runs(zoning.fit(z, list(range(2, 11)), seed, n_init)).select("k", "inertia")).where("best").first().k
    runs = zoning.best_runs(zoning.fit(field.select("node", F.col("u").alias("z")), [zones], seed, n_init))
    labels = runs.select(F.explode(F.arrays_zip("nodes", "labels")).alias("r")).select(F.col("r.nodes").alias("node"), F.col("r.labels").alias("label")).persist()
    solved = field.agg(F.count("*").alias("nodes"), F.bool_and("converged").alias("converged"), F.max("iterations").alias("iterations"), F.max("objective").alias("objective"))
    scores = solved.crossJoin(evaluate(panel, points, labels, min(EVALUATION_NEIGHBOURS, points.count() - 1))).withColumn("k_star", F.lit(zones)).withColumn("seed", F.lit(seed))
    return SiteResult(z, rho, links, field, labels, spark.createDataFrame(scores.collect(), scores.schema), zones)
