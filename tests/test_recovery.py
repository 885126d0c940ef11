import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrazone.operators import graph, recovery
from terrazone.operators.recovery import Problem, laplacian, total_variation


def path(n=12, p=3, seed=0, lam=0.2):
    rng = np.random.default_rng(seed)
    edges = np.array([(i, i + 1) for i in range(n - 1)] + [(i, i + 3) for i in range(n - 3)])
    omega = rng.uniform(0.2, 2, len(edges))
    rho = rng.uniform(0.3, 2, n)
    return Problem(rng.normal(size=(n, p)), rho / rho.mean(), edges, omega / omega.mean(), 1.3, lam)


@pytest.mark.parametrize("method", ["diagonal", "scalar", "dual_fista"])
def test_three_nodes_on_a_path(method):
    """Values 0, 3, 9 with unit weights, scale 1.5 and lambda 0.25: each edge may carry 0.25 * 3 / (2 * 1.5) = 0.25 of
    flow, and as the jumps stay, the ends move by that towards the middle and the middle not at all."""
    got = total_variation(Problem(np.array([[0.0], [3.0], [9.0]]), np.ones(3), np.array([[0, 1], [1, 2]]), np.ones(2), 1.5, 0.25), method=method, max_iters=20_000, tol=1e-11)
    assert got.converged and np.allclose(got.u.ravel(), [0.25, 3.0, 8.75], atol=1e-5)


@given(st.integers(0, 10_000), st.floats(0.01, 1.0))
@settings(max_examples=15, deadline=None)
def test_methods_agree_and_prove_it(seed, lam):
    p = path(seed=seed, lam=lam)
    found = [total_variation(p, method=m, max_iters=20_000, tol=1e-9) for m in ("diagonal", "scalar", "dual_fista")]
    for got in found:
        assert got.converged and got.history[-1]["relative_gap"] <= 1e-9 and got.history[-1]["feasibility"] <= 1e-12
        assert np.allclose(got.u, found[0].u, atol=1e-3)
        assert got.objective <= p.value(p.z) + 1e-12


def test_laplacian_equals_dense():
    p = path()
    n, m = len(p.z), len(p.edges)
    k = np.zeros((m, n))
    k[np.arange(m), p.a], k[np.arange(m), p.b] = 1, -1
    system = np.diag(p.rho) + p.lam * n / (m * p.s**2) * k.T @ np.diag(p.omega) @ k
    got = laplacian(p)
    assert got.converged and np.allclose(got.u, np.linalg.solve(system, p.rho[:, None] * p.z), atol=1e-8)


def test_edges_in_blocks(monkeypatch):
    """Blocks of any size, with a node of many edges, give the transpose of the difference operator; no step changes start."""
    rng = np.random.default_rng(3)
    edges = np.unique(np.sort(np.concatenate([[(0, i) for i in range(1, 60)], rng.choice(60, (200, 2))]), axis=1), axis=0)
    edges = edges[edges[:, 0] != edges[:, 1]]
    z, k, found = rng.normal(size=(60, 4)), np.zeros((len(edges), 60)), []
    k[np.arange(len(edges)), edges[:, 0]], k[np.arange(len(edges)), edges[:, 1]] = 1, -1
    for block in (7, 64, 4096):
        monkeypatch.setattr(recovery, "EDGE_BLOCK", block)
        p = Problem(z, np.ones(60), edges, np.ones(len(edges)), 1.0, 0.3)
        y = rng.normal(size=(len(edges), 4))
        assert len(p.blocks) == -(-len(edges) // block) and np.allclose(p.divergence(y), k.T @ y) and np.allclose(p.flow(z), k.T @ k @ z)
        found.append(total_variation(p, method="dual_fista", max_iters=200, tol=-1.0))
        start = found[-1].y.copy()
        total_variation(p, start=found[-1], done=200, max_iters=210)
        assert np.array_equal(start, found[-1].y)
    assert np.allclose(found[0].u, found[1].u) and np.allclose(found[0].u, found[2].u)


def test_shortcuts_and_guards():
    p = path(lam=0.0)
    assert total_variation(p).iterations == 0 and np.array_equal(laplacian(p).u, p.z)
    with pytest.raises(ValueError):
        Problem(p.z, -p.rho, p.edges, p.omega, 1.0, 0.1)
    with pytest.raises(ValueError):
        Problem(p.z, p.rho, np.array([[1, 1]]), np.ones(1), 1.0, 0.1)


def test_checks_are_seen():
    p = path()
    seen = []
    whole = total_variation(p, method="diagonal", max_iters=300, tol=-1.0, check_every=100, on_check=lambda k, u, y, r: seen.append(k))
    assert seen == [1, 100, 200, 300] and not whole.converged


def test_frames_equal_numpy(spark):
    p = path()
    nodes = spark.createDataFrame([(i, z.tolist(), z.tolist(), z.tolist(), float(r)) for i, (z, r) in enumerate(zip(p.z, p.rho, strict=True))], "node long, z array<double>, u array<double>, u_bar array<double>, rho double")
    links = spark.createDataFrame([(int(a), int(b), float(w), [0.0] * 3) for (a, b), w in zip(p.edges, p.omega, strict=True)], "src long, dst long, omega double, y array<double>")
    nodes = nodes.join(graph.degrees(links), "node")
    for _ in range(2):
        nodes, links = recovery.primal_dual_step(nodes, links, p.s, p.lam, 3)
    u = np.array([r.u for r in nodes.orderBy("node").collect()])
    want = total_variation(p, max_iters=2, tol=-1.0)
    assert np.allclose(u, want.u, atol=1e-14)
    got = recovery.certificate(nodes, links, p.s, p.lam, 3).first()
    for name, value in p.judge(want.u, want.y).items():
        assert got[name] == pytest.approx(value, abs=1e-12)
    assert recovery.objective(nodes, links, p.s, p.lam).first().objective == pytest.approx(p.value(want.u))
    product = np.array([r.product for r in recovery.laplacian_product(nodes, links, p.s, p.lam, 3).orderBy("node").collect()])
    c = p.lam * len(p.z) / (len(p.edges) * p.s**2)
    assert np.allclose(product, p.rho[:, None] * u + c * p.divergence(p.omega[:, None] * p.differences(u)))


def test_groups(spark):
    problems = [path(seed=s) for s in range(3)]
    nodes = spark.createDataFrame([(s, i, z.tolist(), float(r)) for s, p in enumerate(problems) for i, (z, r) in enumerate(zip(p.z, p.rho, strict=True))], "site int, node long, z array<double>, rho double")
    links = spark.createDataFrame([(s, int(a), int(b), float(w), p.s) for s, p in enumerate(problems) for (a, b), w in zip(p.edges, p.omega, strict=True)], "site int, src long, dst long, omega double, s double")
    got = recovery.solve_groups(nodes, links, ["site"], 0.2).where("converged").orderBy("site", "node").collect()
    for s, p in enumerate(problems):
        assert np.allclose([r.u for r in got if r.site == s], total_variation(p).u)
    flat = recovery.solve_groups(nodes.where("site = 0"), links.where("site = 0"), ["site"], 0.2, "laplacian").agg(F.max("iterations")).first()[0]
    assert flat > 0
