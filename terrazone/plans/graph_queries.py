"""Queries over graphs of vectors and sites: neighbours, affinities, weights, recovery, zones, agreement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazone.functions.columns import times
from terrazone.operators import graph, metrics, optical, recovery, zoning
from terrazone.plans.panel_queries import r6, sql6, with_
from terrazone.sources.panels import sites, table, vectors
from terrazone.sources.sinks import written

K, LAMBDA, DIM = 8, 0.2, 64
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


VECTORS = "v AS (SELECT vec_id AS node, CAST(embedding AS DOUBLE[]) AS z, CAST(label AS BIGINT) AS label FROM embeddings)"
KNN = """
near AS (SELECT a.node, b.node AS other, list_distance(a.z, b.z) AS d, row_number() OVER (PARTITION BY a.node ORDER BY list_distance(a.z, b.z), b.node) AS r FROM v a JOIN v b ON a.node <> b.node),
edge AS (SELECT least(node, other) AS src, greatest(node, other) AS dst, min(d) AS distance FROM near WHERE r <= 8 GROUP BY 1, 2)"""
WEIGHT = """
geo AS (SELECT *, exp(greatest(-(distance ** 2) / (2 * greatest(quantile_cont(distance, 0.5) OVER (), 1e-8) ** 2), -708.3964185322641)) AS geometry_affinity FROM edge),
om AS (SELECT *, geometry_affinity * count(*) OVER () / sum(geometry_affinity) OVER () AS omega FROM geo),
js AS (SELECT quantile_cont(distance, 0.5) + 1e-8 AS s FROM edge)"""
RHO = "rho AS (SELECT node, z, label, (1 + node % 3) * count(*) OVER () / sum(1 + node % 3) OVER () AS rho, list_transform(z, lambda x: x * 0.5) AS u FROM v)"


def _links(spark, sf_dir) -> DataFrame:
    return graph.knn_union(vectors(spark, sf_dir), K)


def _weighted(spark, sf_dir) -> DataFrame:
    return _with_weights(_links(spark, sf_dir))


def _with_weights(links: DataFrame) -> DataFrame:
    return graph.edge_weights(graph.geometry_affinity(links), "geometry_affinity")


def _state(spark, sf_dir) -> DataFrame:
    """Nodes with a fidelity weight of mean one and half their latent value as an estimate."""
    rows = vectors(spark, sf_dir).withColumn("w", 1 + F.col("node") % 3)
    mean = rows.agg((F.sum("w") / F.count("*")).alias("m"))
    return rows.crossJoin(F.broadcast(mean)).select("node", "z", "label", (F.col("w") / F.col("m")).alias("rho"), times(F.col("z"), F.lit(0.5)).alias("u"))


@query(with_(VECTORS, KNN) + " SELECT src, dst, round(distance, 6) AS distance FROM edge")
def knn_union(spark, sf_dir):
    return _links(spark, sf_dir).select("src", "dst", F.round("distance", 6).alias("distance"))


_PLANAR = """
p AS (SELECT c_custkey AS node, CAST(c_acctbal AS DOUBLE) AS x, c_custkey % 997 * 1.0 AS y FROM customer),
near AS (SELECT a.node, b.node AS other, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM p a JOIN p b ON a.node <> b.node),
top AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY d, other) AS r FROM near)"""


@query(with_(_PLANAR) + " SELECT node, other, round(d, 6) AS distance FROM top WHERE r <= 4")
def planar_neighbours(spark, sf_dir):
    points = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 997).cast("double").alias("y"))
    return graph.planar_neighbours(points, 4, 150.0).select("node", "other", F.round("distance", 6).alias("distance"))


@query(with_(VECTORS, KNN) + " SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edge UNION ALL SELECT dst FROM edge) GROUP BY node")
def node_degree(spark, sf_dir):
    return graph.degrees(_links(spark, sf_dir))


@query(with_(VECTORS, KNN, WEIGHT) + " SELECT src, dst, round(geometry_affinity, 6) AS geometry_affinity FROM om")
def geometry_affinity(spark, sf_dir):
    return graph.geometry_affinity(_links(spark, sf_dir)).select("src", "dst", F.round("geometry_affinity", 6).alias("geometry_affinity"))


@query(with_(VECTORS, KNN, WEIGHT) + " SELECT src, dst, round(omega, 6) AS omega FROM om")
def edge_conductance(spark, sf_dir):
    return _weighted(spark, sf_dir).select("src", "dst", F.round("omega", 6).alias("omega"))


@query(with_(VECTORS, KNN, WEIGHT) + " SELECT round(s, 6) AS s_delta FROM js")
def jump_scale(spark, sf_dir):
    return graph.jump_scale(_links(spark, sf_dir)).select(*r6("s_delta"))


_TERRAIN = """
s AS (SELECT s_suppkey AS node, CAST(s_suppkey % 10 AS DOUBLE) AS x, CAST(floor(s_suppkey / 10) AS DOUBLE) AS y, s_acctbal AS elevation, s_nationkey * 1.5 AS slope, CAST(s_suppkey * 37 % 360 AS DOUBLE) AS aspect, s_acctbal / 1000 - s_nationkey / 10 AS curvature, s_suppkey % 7 + 0.5 AS tri FROM supplier),
near AS (SELECT a.node, b.node AS other, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, row_number() OVER (PARTITION BY a.node ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.node) AS r FROM s a JOIN s b ON a.node <> b.node),
edge AS (SELECT least(node, other) AS src, greatest(node, other) AS dst, min(d) AS distance FROM near WHERE r <= 4 GROUP BY 1, 2),
raw AS (SELECT node, unnest([elevation, slope, sin(radians(aspect)), cos(radians(aspect)), curvature, tri]) AS v, unnest(range(6)) AS i FROM s),
sc AS (SELECT node, i, (v - quantile_cont(v, 0.5) OVER (PARTITION BY i)) / (quantile_cont(v, 0.75) OVER (PARTITION BY i) - quantile_cont(v, 0.25) OVER (PARTITION BY i) + 1e-8) AS v FROM raw),
td AS (SELECT src, dst, any_value(distance) AS distance, sqrt(sum((a.v - b.v) ** 2)) AS terrain_distance FROM edge JOIN sc a ON a.node = src JOIN sc b ON b.node = dst AND a.i = b.i GROUP BY src, dst),
w AS (SELECT greatest(quantile_cont(distance, 0.5), 1e-8) AS a, greatest(quantile_cont(terrain_distance, 0.5), 1e-8) AS b FROM td)"""


@query(with_(_TERRAIN) + " SELECT src, dst, round(terrain_distance, 6) AS terrain_distance, round(exp(greatest(-(distance ** 2) / (2 * a ** 2) - terrain_distance ** 2 / (2 * b ** 2), -708.3964185322641)), 6) AS terrain_affinity FROM td, w")
def terrain_affinity(spark, sf_dir):
    return graph.physical_graph(sites(spark, sf_dir), 4).select("src", "dst", *r6("terrain_distance", "terrain_affinity"))


@query(with_(VECTORS, KNN) + """,
o AS (SELECT node, z[1:15] AS z_o, (node % 5) / 4 AS q_o FROM v),
d AS (SELECT src, dst, list_distance(a.z_o, b.z_o) AS d, sqrt(a.q_o * b.q_o) AS q FROM edge JOIN o a ON a.node = src JOIN o b ON b.node = dst),
m AS (SELECT greatest(quantile_cont(d, 0.5), 1e-8) AS m FROM d)
SELECT src, dst, round(least(greatest(1 - q * (1 - exp(greatest(-(d ** 2) / (2 * m ** 2), -708.3964185322641))), 0), 1), 6) AS gate FROM d, m""")
def optical_gate(spark, sf_dir):
    nodes = vectors(spark, sf_dir).select("node", F.slice("z", 1, 15).alias("z_o"), ((F.col("node") % 5) / 4).alias("q_o"))
    return graph.optical_gate(_links(spark, sf_dir).select("src", "dst"), nodes).select("src", "dst", *r6("gate"))


_BANDS = "b AS (SELECT l_orderkey AS node, l_linenumber AS line, l_extendedprice / 1e5 AS b02, l_discount AS b04, l_quantity / 50 AS b08, l_tax AS b11 FROM lineitem)"


@query(with_(_BANDS) + """
SELECT node, line, round(CASE WHEN abs(b08 + b04) > 1e-12 THEN (b08 - b04) / (b08 + b04) END, 6) + 0.0 AS ndvi, round(CASE WHEN abs(b08 + b11) > 1e-12 THEN (b08 - b11) / (b08 + b11) END, 6) + 0.0 AS ndmi,
  round(CASE WHEN abs(b11 + b04 + b08 + b02) > 1e-12 THEN (b11 + b04 - b08 - b02) / (b11 + b04 + b08 + b02) END, 6) + 0.0 AS bsi FROM b""")
def optical_indices(spark, sf_dir):
    from terrazone.functions.columns import spectral_indices

    made = spectral_indices(F.col("l_extendedprice") / 1e5, F.col("l_discount"), F.col("l_quantity") / 50, F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_linenumber").alias("line"), *[(F.round(c, 6) + 0.0).alias(n) for n, c in made.items()])


_MONTHLY = "m AS (SELECT l_suppkey AS node, date_trunc('month', l_shipdate) AS month, avg(l_quantity) AS a, count(*) AS b, CAST(count(*) % 4 AS DOUBLE) / 3 AS vp FROM lineitem GROUP BY 1, 2)"
_OPT = ", ".join(f"quantile_cont(CASE WHEN vp > 0 THEN {c} END, 0.5) AS {c}_median, stddev_pop(CASE WHEN vp > 0 THEN {c} END) AS {c}_std, quantile_cont(CASE WHEN vp > 0 THEN {c} END, 0.25) AS {c}_q25, quantile_cont(CASE WHEN vp > 0 THEN {c} END, 0.75) AS {c}_q75, max_by({c}, month) FILTER (vp > 0) - min_by({c}, month) FILTER (vp > 0) AS {c}_last_minus_first" for c in "ab")
_OPT_NAMES = [f"{c}_{s}" for c in "ab" for s in optical.STATISTICS]


def _monthly(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("node"), F.date_trunc("month", "l_shipdate").alias("month"))
    return rows.agg(F.avg("l_quantity").alias("a"), F.count("*").cast("double").alias("b"), ((F.count("*") % 4) / 3).alias("valid_proportion"))


@query(with_(_MONTHLY) + f" SELECT node, round(q_o, 6) AS q_o, {sql6(*_OPT_NAMES)} FROM (SELECT node, avg(vp) AS q_o, {_OPT} FROM m GROUP BY node)")
def optical_features(spark, sf_dir):
    return optical.features(_monthly(spark, sf_dir), ["a", "b"]).select("node", *r6("q_o", *_OPT_NAMES))


@query(with_(_MONTHLY) + f", f AS (SELECT node, avg(vp) AS q_o, {_OPT} FROM m GROUP BY node), l AS (SELECT node, q_o, unnest([{', '.join(_OPT_NAMES)}]) AS x, unnest(range({len(_OPT_NAMES)})) AS i FROM f), g AS (SELECT node, q_o, i, coalesce(x, quantile_cont(x, 0.5) OVER (PARTITION BY i), 0) AS x FROM l) SELECT node, round(q_o, 6) AS q_o, CAST(i AS INTEGER) AS i, round((x - quantile_cont(x, 0.5) OVER (PARTITION BY i)) / (quantile_cont(x, 0.75) OVER (PARTITION BY i) - quantile_cont(x, 0.25) OVER (PARTITION BY i) + 1e-8), 5) + 0.0 AS z FROM g")
def optical_representation(spark, sf_dir):
    made = optical.representation(_monthly(spark, sf_dir), ["a", "b"])
    return made.select("node", *r6("q_o"), F.posexplode("z_o").alias("i", "z")).withColumn("z", F.round("z", 5) + 0.0)


# recovery ---------------------------------------------------------------------------------------------------------

_FLOW = "fl AS (SELECT src, dst, omega, unnest(list_transform(range(1, 65), lambda i: omega * (a.u[i] - b.u[i]))) AS f, unnest(range(64)) AS i FROM om JOIN rho a ON a.node = src JOIN rho b ON b.node = dst), dv AS (SELECT node, i, sum(f) AS d FROM (SELECT src AS node, i, f FROM fl UNION ALL SELECT dst, i, -f FROM fl) GROUP BY node, i)"


def _flow(spark, sf_dir, links: DataFrame | None = None) -> DataFrame:
    both = graph.gather(_weighted(spark, sf_dir) if links is None else _with_weights(links), _state(spark, sf_dir).select("node", "u"), "u")
    return both.select("src", "dst", "omega", F.transform(F.arrays_zip("u_s", "u_t"), lambda x: F.col("omega") * (x["u_s"] - x["u_t"])).alias("y"))


@query(with_(VECTORS, KNN, WEIGHT, RHO, _FLOW) + " SELECT node, round(sum(d * d), 6) AS size, round(sum(d * (i + 1)), 6) + 0.0 AS mark FROM dv GROUP BY node")
def divergence(spark, sf_dir):
    rows = graph.divergence(_flow(spark, sf_dir), "y", DIM).select("node", F.posexplode("div").alias("i", "d"))
    return rows.groupBy("node").agg(F.round(F.sum(F.col("d") * F.col("d")), 6).alias("size"), (F.round(F.sum(F.col("d") * (F.col("i") + 1)), 6) + 0.0).alias("mark"))


_FID = "fid AS (SELECT sum(rho * list_sum(list_transform(range(1, 65), lambda i: (u[i] - z[i]) ** 2))) / (2 * count(*)) AS fidelity FROM rho)"
_JUMP = "jp AS (SELECT omega, list_distance(a.u, b.u) AS j FROM om JOIN rho a ON a.node = src JOIN rho b ON b.node = dst)"


@query(with_(VECTORS, KNN, WEIGHT, RHO, _FID, _JUMP) + " SELECT round(fidelity, 6) AS fidelity, round(r, 6) AS regulariser, round(fidelity + r, 6) AS objective FROM fid, (SELECT 0.2 * sum(omega * j) / (count(*) * any_value(s)) AS r FROM jp, js)")
def tv_objective(spark, sf_dir):
    links = _weighted(spark, sf_dir).persist()
    s = graph.jump_scale(links).first().s_delta
    return recovery.objective(_state(spark, sf_dir), links, s, LAMBDA).select(*r6("fidelity", "regulariser", "objective"))


@query(with_(VECTORS, KNN, WEIGHT, RHO, _FID, _JUMP) + " SELECT round(fidelity, 6) AS fidelity, round(r, 6) AS regulariser, round(fidelity + r, 6) AS objective FROM fid, (SELECT 0.2 * sum(omega * j * j) / (2 * count(*) * any_value(s) ** 2) AS r FROM jp, js)")
def gl_objective(spark, sf_dir):
    links = _weighted(spark, sf_dir).persist()
    s = graph.jump_scale(links).first().s_delta
    return recovery.objective(_state(spark, sf_dir), links, s, LAMBDA, laplacian=True).select(*r6("fidelity", "regulariser", "objective"))


_DUAL = """
y AS (SELECT src, dst, omega, i, f * 0.01 AS y FROM fl),
dz AS (SELECT node, i, coalesce(d, 0) * 0.01 AS d, rho, z[i + 1] AS z, u[i + 1] AS u FROM (SELECT node, rho, z, u, unnest(range(64)) AS i FROM rho) LEFT JOIN dv USING (node, i)),
c AS (SELECT (SELECT count(*) FROM rho) AS n, (SELECT count(*) FROM om) AS m),
sums AS (SELECT sum(d * z) AS a, sum(d * d / rho) AS b, sum((rho * (u - z) + d) ** 2) AS rr, sum((rho * (u - z)) ** 2) AS gg, sum(d * d) AS dd FROM dz),
ny AS (SELECT src, dst, any_value(omega) AS omega, sqrt(sum(y * y)) AS ny FROM y GROUP BY src, dst),
far AS (SELECT max(greatest(ny - 0.2 * n * omega / (m * s), 0)) AS over, max(0.2 * n * omega / (m * s)) AS radius FROM ny, c, js),
pr AS (SELECT fidelity + (SELECT 0.2 * sum(omega * j) / (count(*) * any_value(s)) FROM jp, js) AS primal FROM fid)"""


@query(with_(VECTORS, KNN, WEIGHT, RHO, _FID, _JUMP, _FLOW, _DUAL) + """
SELECT round(primal, 6) AS primal, round((a - b / 2) / n, 6) AS dual, round(primal - (a - b / 2) / n, 6) AS gap, round(greatest(primal - (a - b / 2) / n, 0) / greatest(abs(primal), abs((a - b / 2) / n)), 6) AS relative_gap,
  round(over / radius, 6) AS feasibility, round(sqrt(rr) / greatest(sqrt(gg), sqrt(dd)), 6) AS stationarity FROM pr, sums, far, c""")
def tv_certificate(spark, sf_dir):
    near = _links(spark, sf_dir)
    links = written(_flow(spark, sf_dir, near).withColumn("y", times(F.col("y"), F.lit(0.01))), "flow")
    s = graph.jump_scale(near).first().s_delta
    found = recovery.certificate(_state(spark, sf_dir), links, s, LAMBDA, DIM)
    return found.select(*r6("primal", "dual", "gap", "relative_gap", "feasibility", "stationarity"))


@query(with_(VECTORS, KNN, WEIGHT, RHO) + """,
c AS (SELECT (SELECT count(*) FROM rho) AS n, (SELECT count(*) FROM om) AS m),
dg AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM om UNION ALL SELECT dst FROM om) GROUP BY node),
y0 AS (SELECT src, dst, omega, i, 0.99 / (1 / sqrt(a.rho) + 1 / sqrt(b.rho)) * (a.u[i + 1] - b.u[i + 1]) AS y FROM om JOIN rho a ON a.node = src JOIN rho b ON b.node = dst, (SELECT unnest(range(64)) AS i)),
y1 AS (SELECT src, dst, i, y * least(1, 0.2 * n * omega / (m * s) / greatest(sqrt(sum(y * y) OVER (PARTITION BY src, dst)), 1e-30)) AS y FROM y0, c, js),
dv AS (SELECT node, i, sum(y) AS d FROM (SELECT src AS node, i, y FROM y1 UNION ALL SELECT dst, i, -y FROM y1) GROUP BY node, i),
t AS (SELECT node, rho, z, u, 0.99 / (greatest(degree, 1) * sqrt(rho)) AS tau FROM rho JOIN dg USING (node)),
nu AS (SELECT node, i, (u[i + 1] - tau * d + tau * rho * z[i + 1]) / (1 + tau * rho) AS u FROM t JOIN dv USING (node))
SELECT node, round(sum(u * u), 6) AS size, round(sum(u * (i + 1)), 6) + 0.0 AS mark FROM nu GROUP BY node""")
def pdhg_step(spark, sf_dir):
    links = _weighted(spark, sf_dir).withColumn("y", F.array(*[F.lit(0.0)] * DIM)).persist()
    s = graph.jump_scale(links).first().s_delta
    nodes = _state(spark, sf_dir).withColumn("u_bar", F.col("u")).join(graph.degrees(links), "node")
    stepped, _ = recovery.primal_dual_step(nodes, links, s, LAMBDA, DIM)
    rows = stepped.select("node", F.posexplode("u").alias("i", "u"))
    return rows.groupBy("node").agg(F.round(F.sum(F.col("u") * F.col("u")), 6).alias("size"), (F.round(F.sum(F.col("u") * (F.col("i") + 1)), 6) + 0.0).alias("mark"))


@query(with_(VECTORS, KNN, WEIGHT, RHO, _FLOW) + """,
c AS (SELECT 0.2 * (SELECT count(*) FROM rho) / ((SELECT count(*) FROM om) * s ** 2) AS c FROM js),
p AS (SELECT node, i, rho * u[i + 1] + c * coalesce(d, 0) AS p FROM (SELECT node, rho, u, unnest(range(64)) AS i FROM rho) LEFT JOIN dv USING (node, i), c)
SELECT node, round(sum(p * p), 6) AS size, round(sum(p * (i + 1)), 6) + 0.0 AS mark FROM p GROUP BY node""")
def gl_matvec(spark, sf_dir):
    links = _weighted(spark, sf_dir).persist()
    s = graph.jump_scale(links).first().s_delta
    rows = recovery.laplacian_product(_state(spark, sf_dir), links, s, LAMBDA, DIM).select("node", F.posexplode("product").alias("i", "p"))
    return rows.groupBy("node").agg(F.round(F.sum(F.col("p") * F.col("p")), 6).alias("size"), (F.round(F.sum(F.col("p") * (F.col("i") + 1)), 6) + 0.0).alias("mark"))


def _solved(spark, sf_dir, kind: str, **options) -> DataFrame:
    links = _weighted(spark, sf_dir).persist()
    s = graph.jump_scale(links).first().s_delta
    nodes = _state(spark, sf_dir).select(F.lit(1).alias("problem"), "node", "z", "rho")
    return recovery.solve_groups(nodes, links.select(F.lit(1).alias("problem"), "src", "dst", "omega", F.lit(s).alias("s")), ["problem"], LAMBDA, kind, **options)


@query()
def tv_recovery(spark, sf_dir):
    return _solved(spark, sf_dir, "total_variation", tol=1e-6, max_iters=3000)


@query()
def tv_recovery_dual(spark, sf_dir):
    return _solved(spark, sf_dir, "total_variation", method="dual_fista", tol=1e-6, max_iters=3000)


#: Jacobi steps, which contract by the share of the links in each row of the system.
@query(with_(VECTORS, KNN, WEIGHT, RHO).replace("WITH", "WITH RECURSIVE", 1) + """,
c AS MATERIALIZED (SELECT 0.2 * (SELECT count(*) FROM rho) / ((SELECT count(*) FROM om) * s ** 2) AS c FROM js),
nb AS MATERIALIZED (SELECT src AS node, dst AS other, c * omega AS w FROM om, c UNION ALL SELECT dst, src, c * omega FROM om, c),
sy AS MATERIALIZED (SELECT node, i, rho + w AS diagonal, rho * z[i + 1] AS b FROM (SELECT *, unnest(range(64)) AS i FROM rho) JOIN (SELECT node, sum(w) AS w FROM nb GROUP BY node) USING (node)),
st(k, node, i, u) AS (SELECT 0, node, i, b / diagonal FROM sy
  UNION ALL SELECT k + 1, node, i, (b + f) / diagonal FROM (SELECT st.k, nb.node, st.i, sum(w * u) AS f FROM nb JOIN st ON nb.other = st.node WHERE st.k < 40 GROUP BY st.k, nb.node, st.i) JOIN sy USING (node, i))
SELECT node, true AS converged, round(sum(u * u), 5) AS size, round(sum(u * (i + 1)), 5) + 0.0 AS mark FROM st WHERE k = 40 GROUP BY node""")
def gl_recovery(spark, sf_dir):
    rows = _solved(spark, sf_dir, "laplacian").select("node", "converged", F.posexplode("u").alias("i", "x"))
    return rows.groupBy("node", "converged").agg(F.round(F.sum(F.col("x") * F.col("x")), 5).alias("size"), (F.round(F.sum(F.col("x") * (F.col("i") + 1)), 5) + 0.0).alias("mark"))


# zones ------------------------------------------------------------------------------------------------------------

_CENTERS = "ce AS (SELECT node AS label, z AS c FROM v WHERE node < 10)"
_ASSIGN = "best AS (SELECT node, min({'d': list_sum(list_transform(range(1, 65), lambda i: (z[i] - c[i]) ** 2)), 'l': ce.label}) AS b FROM v, ce GROUP BY node)"


@query(with_(VECTORS, _CENTERS, _ASSIGN) + " SELECT node, b.l AS label, round(b.d, 6) AS d2 FROM best")
def lloyd_step(spark, sf_dir):
    nodes = vectors(spark, sf_dir)
    centers = nodes.where("node < 10").select(F.col("node").alias("label"), F.col("z").alias("c"))
    return zoning.assign(nodes, centers).select("node", "label", *r6("d2"))


@query(with_(VECTORS, _CENTERS, _ASSIGN) + ", x AS (SELECT b.l AS label, i, avg(z[i + 1]) AS m FROM v JOIN best USING (node), (SELECT unnest(range(64)) AS i) GROUP BY 1, 2) SELECT label, round(sum(m * m), 6) AS size, round(sum(m * (i + 1)), 6) + 0.0 AS mark FROM x GROUP BY label")
def lloyd_update(spark, sf_dir):
    nodes = vectors(spark, sf_dir)
    centers = nodes.where("node < 10").select(F.col("node").alias("label"), F.col("z").alias("c"))
    new = zoning.update(nodes, zoning.assign(nodes, centers), DIM, 10).select("label", F.posexplode("c").alias("i", "m"))
    return new.groupBy("label").agg(F.round(F.sum(F.col("m") * F.col("m")), 6).alias("size"), (F.round(F.sum(F.col("m") * (F.col("i") + 1)), 6) + 0.0).alias("mark"))


@query()
def kmeans_zones(spark, sf_dir):
    return zoning.best_runs(zoning.fit(vectors(spark, sf_dir), [5])).select("k", "restart", "inertia", F.explode(F.arrays_zip("nodes", "labels")).alias("r")).select("k", "inertia", F.col("r.nodes").alias("node"), F.col("r.labels").alias("label"))


@query()
def select_k(spark, sf_dir):
    """The number of zones by the elbow of seeded k-means inertias."""
    return zoning.elbow(zoning.best_runs(zoning.fit(vectors(spark, sf_dir), list(range(2, 11)), with_labels=False)).select("k", "inertia"))


_INERTIA = "i AS (SELECT CAST(n_regionkey + 2 AS INTEGER) AS k, sum(n_nationkey) + 100.0 / (n_regionkey + 1) AS inertia FROM nation GROUP BY n_regionkey), j AS (SELECT k, inertia FROM i UNION ALL SELECT k + 5, inertia / 4 FROM i WHERE k < 6)"


@query(with_(_INERTIA) + """,
e AS (SELECT max(CASE WHEN k = 2 THEN inertia END) AS a, max(CASE WHEN k = 10 THEN inertia END) AS b FROM j),
s AS (SELECT k, inertia, (inertia - b) / (a - b + 1e-12) AS q, (10 - k) / 8 - (inertia - b) / (a - b + 1e-12) AS score FROM j, e)
SELECT k, round(inertia, 6) AS inertia, round(q, 6) + 0.0 AS q, round(score, 6) + 0.0 AS score, k BETWEEN 3 AND 9 AND row_number() OVER (ORDER BY CASE WHEN k BETWEEN 3 AND 9 THEN score END DESC NULLS LAST, k) = 1 AS best FROM s""")
def elbow_k(spark, sf_dir):
    by = table(spark, sf_dir, "nation").groupBy((F.col("n_regionkey") + 2).alias("k"), "n_regionkey").agg(F.sum("n_nationkey").alias("s"))
    i = by.select("k", (F.col("s") + 100.0 / (F.col("n_regionkey") + 1)).alias("inertia"))
    j = i.union(i.where("k < 6").select(F.col("k") + 5, F.col("inertia") / 4))
    return zoning.elbow(j).select("k", *r6("inertia", "q", "score"), "best")


_SETTINGS = "h AS (SELECT CAST(n_nationkey AS INTEGER) AS position, n_name AS config, 1 + (n_nationkey * 7 % 25) / 400.0 AS fdd, 1 + n_nationkey * 3 % 5 AS fi, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_regionkey AS INTEGER) END AS simplicity FROM nation)"


@query(with_(_SETTINGS) + " SELECT position, config, eligible, row_number() OVER (ORDER BY eligible DESC, fi, fdd, coalesce(simplicity, position), position) = 1 AS selected FROM (SELECT *, fdd <= 1.05 * min(fdd) OVER () AS eligible FROM h)")
def select_hyperparameters(spark, sf_dir):
    n = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(n.alias("position"), F.col("n_name").alias("config"), (1 + (n * 7 % 25) / 400.0).alias("fdd"), (1 + n * 3 % 5).alias("fi"), F.when(n % 2 == 0, F.col("n_regionkey")).alias("simplicity"))
    return zoning.select_settings(rows).select("position", "config", "eligible", "selected")


# metrics ----------------------------------------------------------------------------------------------------------

_FI = """
inside AS (SELECT src, dst FROM edge JOIN v a ON a.node = src JOIN v b ON b.node = dst WHERE a.label = b.label),
sym AS (SELECT src AS x, dst AS y FROM inside UNION ALL SELECT dst, src FROM inside),
reach AS (SELECT node AS x, node AS y FROM v UNION SELECT r.x, s.y FROM reach r JOIN sym s ON r.y = s.x),
root AS (SELECT x AS node, min(y) AS root FROM reach GROUP BY x),
pc AS (SELECT label, count(DISTINCT root) AS pieces FROM root JOIN v USING (node) GROUP BY label)"""


@query(with_("RECURSIVE " + VECTORS, KNN, _FI) + " SELECT round(avg(pieces), 6) AS fi, count(*) AS zones FROM pc")
def fragmentation_index(spark, sf_dir):
    nodes = vectors(spark, sf_dir)
    return metrics.fragmentation(_links(spark, sf_dir), nodes.select("node", "label")).select(*r6("fi"), "zones")


@query(with_(VECTORS) + " SELECT round(sqrt(sum(list_sum(list_transform(z, lambda x: (x * 0.9 - x) ** 2)))) / greatest(sqrt(sum(list_sum(list_transform(z, lambda x: x * x)))), 1e-12), 6) AS nrmse FROM v")
def nrmse(spark, sf_dir):
    nodes = vectors(spark, sf_dir).withColumn("u", times(F.col("z"), F.lit(0.9)))
    return metrics.recovery_error(nodes, "u", "z").select(*r6("nrmse"))


@query("""WITH c AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2),
s AS (SELECT sum(n * (n - 1) / 2) AS b, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY quality)) AS l, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY toxic)) AS r, sum(n) * (sum(n) - 1) / 2 AS a FROM c)
SELECT round((b - l * r / a) / ((l + r) / 2 - l * r / a), 6) AS ari FROM s""")
def adjusted_rand(spark, sf_dir):
    return metrics.rand_index(table(spark, sf_dir, "labels"), "quality", "toxic").select(*r6("ari"))


@query("""WITH d AS (SELECT n_chars AS s, quality = 1 AS p FROM documents JOIN labels USING (doc_id)),
b AS (SELECT s, sum(CAST(p AS INT)) AS tp, count(*) AS n FROM d GROUP BY s),
c AS (SELECT tp, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM b WINDOW w AS (ORDER BY s DESC))
SELECT round(sum(tp / (SELECT sum(tp) FROM b) * ctp / cn), 6) AS auprc FROM c""")
def average_precision(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select((F.col("quality") == 1).alias("p"), F.col("n_chars").alias("s"))
    return metrics.average_precision(rows, "p", "s").select(*r6("auprc"))


@query(with_(VECTORS, KNN, WEIGHT) + """,
d AS (SELECT round(distance / s, 9) AS s, CAST(a.label <> b.label AS INT) AS p FROM edge JOIN v a ON a.node = src JOIN v b ON b.node = dst, js),
b AS (SELECT s, sum(p) AS tp, count(*) AS n FROM d GROUP BY s),
c AS (SELECT tp, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM b WINDOW w AS (ORDER BY s DESC))
SELECT round(sum(tp / (SELECT sum(tp) FROM b) * ctp / cn), 6) AS auprc FROM c""")
def boundary_auprc(spark, sf_dir):
    links = _links(spark, sf_dir).persist()
    s = graph.jump_scale(links).first().s_delta
    nodes = vectors(spark, sf_dir).select("node", F.col("z").alias("u"), F.col("label").alias("truth"))
    return metrics.boundary_precision(links, nodes, s).select(*r6("auprc"))


@query("""SELECT o_orderstatus AS block, o_orderpriority AS factor, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, round(quantile_cont(o_totalprice, 0.5), 4) AS median,
round(avg(o_totalprice) - 1.96 * stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS ci95_low, round(avg(o_totalprice) + 1.96 * stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS ci95_high FROM orders GROUP BY 1, 2""")
def experiment_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("block"), F.col("o_orderpriority").alias("factor"), F.col("o_totalprice").alias("value"))
    made = metrics.summary(rows, ["block", "factor"])
    return made.select("block", "factor", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "median", "ci95_low", "ci95_high")])


@query("SELECT n_regionkey AS site, n_name AS method, rank() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey % 3) AS rank_fdd FROM nation")
def site_rank_min(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("site"), F.col("n_name").alias("method"), (F.col("n_nationkey") % 3).alias("fdd"))
    return metrics.ranked(rows, "site", "fdd").select("site", "method", F.col("rank_fdd").cast("long").alias("rank_fdd"))


@query()
def zone_summary(spark, sf_dir):
    """The flagship: neighbours, weights, recovery by total variation, zones; one row for each zone."""
    nodes = vectors(spark, sf_dir)
    links = _weighted(spark, sf_dir).persist()
    s = graph.jump_scale(links).first().s_delta
    ready = nodes.select(F.lit(1).alias("problem"), "node", "z", F.lit(1.0).alias("rho"))
    got = recovery.solve_groups(ready, links.select(F.lit(1).alias("problem"), "src", "dst", "omega", F.lit(s).alias("s")), ["problem"], LAMBDA, tol=1e-5, max_iters=2000)
    field = written(got.select("node", F.col("u").alias("z")), "field")
    runs = zoning.best_runs(zoning.fit(field, [6]))
    labels = runs.select(F.explode(F.arrays_zip("nodes", "labels")).alias("r")).select(F.col("r.nodes").alias("node"), F.col("r.labels").alias("zone"))
    pieces = metrics.fragments(links, labels.withColumnRenamed("zone", "label")).withColumnRenamed("label", "zone")
    return labels.join(nodes.select("node", "label"), "node").groupBy("zone").agg(F.count("*").alias("nodes"), F.countDistinct("label").alias("classes")).join(pieces, "zone").orderBy("zone")
