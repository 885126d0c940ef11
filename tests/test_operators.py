import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrazone.functions import columns
from terrazone.operators import audits, baselines, experiment, features, graph, linkage, metrics, reliability, terrain, timeaxis, zoning
from terrazone.sources import panels


def panel(spark, values, fractions=(0.6, 0.2, 0.2)):
    t = len(values[0])
    rows = [(i, e, float(e), t, None if v is None else float(v)) for i, row in enumerate(values) for e, v in enumerate(row)]
    df = spark.createDataFrame(rows, "node long, e int, years double, n long, value double")
    return timeaxis.with_periods(df, fractions)


def test_split_floor_rule(spark):
    got = panel(spark, [[0.0] * 40]).groupBy("period").count().collect()
    assert {r.period: r["count"] for r in got} == {"train": 24, "val": 8, "test": 8}
    with pytest.raises(Exception, match="no epoch"):
        panel(spark, [[0.0, 1.0]]).collect()


@given(st.lists(st.one_of(st.none(), st.floats(-5, 5)), min_size=5, max_size=12).filter(lambda x: any(v is not None for v in x)))
@settings(max_examples=8, deadline=None)
def test_interpolation_is_linear(spark, values):
    got = [r.filled for r in timeaxis.interpolate(panel(spark, [values])).orderBy("e").collect()]
    known = [(i, v) for i, v in enumerate(values) if v is not None]
    assert np.allclose(got, np.interp(range(len(values)), [k for k, _ in known], [v for _, v in known]), atol=1e-12)


def test_segments_of_a_constant(spark):
    rows = timeaxis.segments(panel(spark, [[3.0] * 17]), "value", 17).collect()
    assert len(rows) == 12 and np.allclose([r.value for r in rows], 3.0)


def test_reliability_has_mean_one_and_is_monotone(spark):
    x = np.linspace(0, 1, 20)
    rows = [(i, "high", float(v), "higher_is_better") for i, v in enumerate(x)] + [(i, "low", float(1 - v), "lower_is_better") for i, v in enumerate(x)]
    q = reliability.metadata_reliability(spark.createDataFrame(rows, "node long, field string, value double, direction string")).orderBy("node").collect()
    assert (np.diff([r.q_meta for r in q]) >= -1e-12).all()
    rng = np.random.default_rng(1)
    p = panel(spark, [[None if rng.random() < 0.2 else v for v in rng.normal(size=30)] for _ in range(12)])
    rho = [r.rho for r in reliability.node_reliability(p).collect()]
    assert np.isfinite(rho).all() and abs(np.mean(rho) - 1) < 1e-12


def test_constant_field_traps(spark):
    df = spark.createDataFrame([(i, "f", 2.0, d) for i in range(3) for d in ("higher_is_better",)], "node long, field string, value double, direction string")
    assert {r.q_meta for r in reliability.metadata_reliability(df).collect()} == {0.0}


def test_dispersion_ignores_offsets(spark):
    p = panel(spark, [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9], [0, -1, -2, -3, -4], [8, 7, 6, 5, 4]])
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "node long, label int")
    assert metrics.dispersion(p, labels).first().fdd == 0.0
    with pytest.raises(Exception, match="no value"):
        metrics.dispersion(panel(spark, [[0, 1, 2, 3, None]]), labels).collect()


def test_graph_ties_go_to_the_lower_node(spark):
    points = [(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 2.0, 0.0), (3, 0.0, 2.0), (4, 2.0, 2.0)]
    df = spark.createDataFrame(points, "node long, x double, y double")
    flat = df.select("node", F.array("x", "y").alias("z"))
    want = experiment.nearest_edges(np.array([p[1:] for p in points]), 2)
    for near in (graph.neighbours(flat, 2), graph.planar_neighbours(df, 2, 0.7)):
        assert sorted((r.src, r.dst) for r in graph.edges(near).collect()) == sorted(map(tuple, want.tolist()))


def test_gate_is_one_without_imagery(spark):
    links = spark.createDataFrame([(0, 1, 0.2), (1, 2, 0.5), (2, 3, 0.9)], "src long, dst long, p double")
    nodes = spark.createDataFrame([(i, [10.0 * i], 0.0) for i in range(4)], "node long, z_o array<double>, q_o double")
    gated = graph.optical_gate(links, nodes)
    assert {r.gate for r in gated.collect()} == {1.0}
    assert np.mean([r.omega for r in graph.edge_weights(gated, "p", "gate").collect()]) == pytest.approx(1, abs=1e-12)
    assert {r.omega for r in graph.edge_weights(links.withColumn("p", F.lit(0.0)), "p").collect()} == {1.0}


def test_components_and_fragments(spark):
    nodes = spark.createDataFrame([(i, int(i >= 6)) for i in range(12)], "node long, label int")
    links = spark.createDataFrame([(i, i + 1) for i in range(11)], "src long, dst long")
    assert metrics.fragmentation(links, nodes).first().fi == 1.0
    cut = links.where("src <> 2")
    assert metrics.fragmentation(cut, nodes).first().fi == 1.5
    assert {r.node: r.root for r in graph.components(cut, nodes.select("node")).collect()} == {i: 0 if i < 3 else 3 for i in range(12)}


def test_kmeans_is_deterministic_and_finds_blobs(spark):
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(c, 0.1, (12, 2)) for c in (-2, 0, 2)])
    a, b = (zoning.kmeans(x, 3, seed=3, n_init=4) for _ in range(2))
    assert a.inertia == b.inertia and len({tuple(a.labels[i : i + 12]) for i in (0, 12, 24)}) == 3
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, z array<double>")
    found = zoning.elbow(zoning.best_runs(zoning.fit(nodes, list(range(2, 11)), seed=3, n_init=4))).where("best").collect()
    assert [r.k for r in found] == [3]
    step = zoning.assign(nodes, spark.createDataFrame([(0, [-2.0, -2.0]), (1, [0.0, 0.0]), (2, [90.0, 90.0])], "label long, c array<double>"))
    assert zoning.update(nodes, step, 2, 3).count() == 3


def test_equal_points_have_enough_centres():
    assert zoning.kmeans(np.zeros((5, 2)), 3, n_init=2).inertia == 0


def test_scores(spark):
    rng = np.random.default_rng(0)
    a, b, s = rng.integers(0, 3, 60), rng.integers(0, 2, 60), rng.integers(0, 5, 60)
    df = spark.createDataFrame([tuple(map(int, r)) for r in zip(a, b, s, strict=True)], "a int, b int, s int")
    assert metrics.rand_index(df, "a", "b").first().ari == pytest.approx(experiment.rand_index(a, b))
    assert metrics.rand_index(df, "a", "a").first().ari == 1.0
    assert metrics.average_precision(df, "b", "s").first().auprc == pytest.approx(experiment.average_precision(b == 1, s.astype(float)))
    assert metrics.average_precision(df.withColumn("b", F.lit(0)), "b", "s").first().auprc == 0.0


def test_reliability_undoes_noise():
    """Noise in a quarter of the nodes is undone by reliability weights and not without them; the margin is wider the
    weaker the smoothing."""

    def error(variant, lam):
        return np.mean([x for s in range(2) for _, m, x, _ in experiment.score(experiment.Condition(16, 1, 1, 2.0, 0.0), s, [variant], lam) if m == "NRMSE_U"])

    assert error("NoReliability", experiment.LAMBDA) > 1.3 * error("Full", experiment.LAMBDA)
    assert error("Full", 0.05) < 0.07 and error("NoReliability", 0.05) > 0.27
    w = experiment.realize(experiment.Condition(16, 1, 1, 2.0), 0)
    assert w["low"].sum() == 100 and np.bincount(w["label"]).tolist() == [140, 120, 140] and len(experiment.lattice_edges()) == 760
    assert experiment.diagnostics(w)["jump"] == pytest.approx(2.0)
    assert sum(len(c[4]) for c in experiment.cases()) == 33
    with pytest.raises(ValueError):
        experiment.Condition(0.5, 1, 1, 1.0)


def test_latent_space(spark):
    rng = np.random.default_rng(5)
    z, found = features.latent(panel(spark, rng.normal(size=(20, 20)).cumsum(axis=1).tolist(), (0.8, 0.1, 0.1)))
    held = np.array([r.z for r in z.collect()])
    assert held.shape == (20, found["components"]) and found["shares"][found["components"] - 1] >= 0.95 > found["shares"][found["components"] - 2]
    assert np.allclose(np.median(held, axis=0), 0, atol=1e-9)


def test_baselines(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(8, 30)), rng.normal(size=(8, 30)).cumsum(axis=1)])
    rows = baselines.descriptors(panel(spark, x.tolist()).withColumn("filled", F.col("value")))
    labels = {r.node: r.label for r in baselines.descriptor_zones(rows, 2).collect()}
    assert len(labels) == 16 and len(set(labels.values())) == 2
    assert len(set(baselines.fused_views([x, x[:, :3], x[:, :4]], 3))) == 3
    wave = np.sin(np.arange(40) / 3)
    shifted = np.stack([np.roll(wave, k) for k in range(3)] + [np.roll(np.sign(wave) * wave**2 * (np.arange(40) % 7), k) for k in range(3)])
    assert len(set(baselines.shape_clusters(shifted, 2))) == 2
    with pytest.raises(ValueError):
        baselines.fused_views([x], 2)


def test_process_graph(spark):
    from terrazone.plans.data_queries import GRAPH

    assert audits.accept_graph(spark, GRAPH, "2022-01-01").checked == 2
    with pytest.raises(audits.LeakageError):
        audits.accept_graph(spark, GRAPH, "2020-01-01")
    with pytest.raises(audits.LeakageError):
        audits.accept_graph(spark, {k: v for k, v in GRAPH.items() if k != "masked"}, "2022-01-01")


def test_cutoff(spark):
    rows = spark.createDataFrame([(1,), (5,)], "t int")
    assert audits.require(audits.times_audit(rows, F.col("t"), F.lit(5)), "train", "rows", "5").checked == 2
    with pytest.raises(audits.LeakageError):
        audits.require(audits.times_audit(rows, F.col("t"), F.lit(4)), "train", "rows", "4")


def test_utm(spark):
    df = spark.createDataFrame([(9.0, 0.0), (9.0, 45.0), (12.0, 0.0)], "lon double, lat double")
    e, n = terrain.utm(F.col("lon"), F.col("lat"), 32)
    got = [tuple(r) for r in df.select(e, n).collect()]
    assert got[0] == pytest.approx((500_000, 0), abs=1e-3)
    assert got[1] == pytest.approx((500_000, 4_982_950.400), abs=1e-2)
    assert got[2] == pytest.approx((833_978.557, 0), abs=1e-2)


def test_panels(spark, data):
    p = panels.ship_panel(spark, data)
    assert p.groupBy("node", "e").count().where("count > 1").isEmpty() and p.where("value is null").count() > 0
    assert panels.sites(spark, data).count() == 10


def test_components_in_many_tasks(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(400, 460)]
    df = spark.createDataFrame(links, "src long, dst long").repartition(5)
    got = {r.node: r.root for r in linkage.roots(df, task_links=40).collect()}
    u, v = linkage.contract(*np.array(links).T)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = {x: find(x) for x in list(parent) if find(x) != x}
    assert got == want == dict(zip(u.tolist(), v.tolist(), strict=True))


def test_kmeans_by_frames(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(15, 2)) + c for c in ((0, 0), (6, 1), (2, 7))])
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, z array<double>")
    labels, inertia = zoning.fit_frames(nodes, 3, seed=4, n_init=1)
    want = zoning.kmeans(x, 3, seed=4, n_init=1)
    assert inertia == pytest.approx(want.inertia) and [r.label for r in labels.orderBy("node").collect()] == want.labels.tolist()


def test_exact_quantiles_of_columns(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=9_000), np.where(rng.random(9_000) < 0.4, 0.0, rng.exponential(size=9_000))
    rows = spark.createDataFrame([*zip(x.tolist(), y.tolist(), strict=True), (None, None)], "x double, y double")
    qs = [0.0, 0.02, 0.5, 0.75, 1.0]
    got = columns.quantiles(rows, {"x": F.col("x"), "y": F.col("y")}, qs).first()
    assert np.allclose(got.x, np.quantile(x, qs)) and np.allclose(got.y, np.quantile(y, qs))
    assert columns.quantiles(rows.where("false"), {"x": F.col("x")}, [0.5]).first().x == [None]


@pytest.mark.parametrize("shift", [0.0, 5e6])
def test_nearest_is_exact(shift):
    """Copies, ties, large coordinates and rows that are not finite: as by all distances in order."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(900, 3)), rng.integers(0, 3, (300, 3)), np.zeros((400, 3)), [[np.nan] * 3]]) + shift
    node = np.sort(rng.choice(10_000, len(x), replace=False))
    i, j, dist = graph.nearest(x, node, x, node, 5)
    got = {}
    for a, b, c in zip(i.tolist(), j.tolist(), dist.tolist(), strict=True):
        got.setdefault(a, []).append((b, c))
    for a in range(len(x) - 1):
        d = np.sqrt(((x - x[a]) ** 2).sum(axis=1))
        d[a] = np.inf
        assert got[a] == [(int(b), d[b]) for b in np.argsort(d, kind="stable")[:5]]
    assert len(x) - 1 not in got


def test_a_wide_cell_is_narrowed(spark, monkeypatch):
    """Many points in a cell of the caller's choice: the first grid is finer, and the answer is the same."""
    cells, made = [], graph._in_cell
    monkeypatch.setattr(graph, "_in_cell", lambda k, settled: cells.append(settled) or made(k, settled))
    p = np.random.default_rng(4).uniform(0, 100, (3000, 2))
    nodes = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "node long, x double, y double")
    got = {(r.node, r.other) for r in graph.planar_neighbours(nodes, 2, 1000.0).collect()}
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    assert cells[0] < 50 and got == {(i, int(j)) for i in range(len(p)) for j in np.argsort(d[i], kind="stable")[:2]}


def test_nearest_centres_with_ties():
    """Products of rows and centres give the labels of the differences, ties to the first centre, also far from zero."""
    rng = np.random.default_rng(6)
    for shift in (0, 1 << 20):
        x = rng.integers(0, 4, (500, 3)).astype(float) + shift
        c = np.concatenate([x[:5], x[:2], x[5:9]])
        assert (zoning._nearest(x, (x * x).sum(axis=1), c) == zoning._squared(x, c).argmin(axis=1)).all()


def test_dense_and_sparse_points(spark):
    rng = np.random.default_rng(9)
    p = np.concatenate([rng.normal(scale=0.001, size=(120, 2)), rng.uniform(-50, 50, (60, 2)), np.zeros((20, 2))])
    nodes = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "node long, x double, y double")
    got = {(r.node, r.other) for r in graph.planar_neighbours(nodes, 3).collect()}
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    assert got == {(i, int(j)) for i in range(len(p)) for j in np.argsort(d[i], kind="stable")[:3]}
