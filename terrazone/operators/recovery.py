"""Recovery of a piecewise constant latent field: objectives, certificate, single steps and grouped solvers.

Fidelity: sum of rho |u - z|^2 over 2 N. Total variation adds lambda times the sum of omega |u_s - u_t| over E s;
the graph Laplacian adds lambda times the sum of omega |u_s - u_t|^2 over 2 E s^2.

The DataFrame forms evaluate one step or value over any number of nodes. A full solve takes thousands of dependent
steps on one graph, so it runs inside a task, one task for each problem: a group of rows with its nodes and edges.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazone.functions.columns import dot, minus, norm, soft_clip, times
from terrazone.operators.graph import divergence, gather

FEASIBLE = 1e-12
#: Edges that are stepped together, so that their vectors stay in a processor's cache, and edges of a block at one node
#: that are added one after another.
EDGE_BLOCK, ROUNDS = 1024, 16


# DataFrame forms --------------------------------------------------------------------------------------------------


def fidelity(nodes: DataFrame) -> DataFrame:
    """One row: fidelity. nodes: node, u, z, rho."""
    d = minus(F.col("u"), F.col("z"))
    return nodes.agg((F.sum(F.col("rho") * dot(d, d)) / (2 * F.count("*"))).alias("fidelity"))


def objective(nodes: DataFrame, links: DataFrame, s: float, lam: float, laplacian: bool = False) -> DataFrame:
    """One row: fidelity, regulariser and objective. links: src, dst, omega."""
    j = gather(links, nodes.select("node", "u"), "u").withColumn("_j", norm(minus(F.col("u_s"), F.col("u_t"))))
    size = F.sum(F.col("omega") * (F.pow("_j", 2) if laplacian else F.col("_j")))
    penalty = j.agg(F.coalesce(lam * size / (2 * F.count("*") * s * s if laplacian else F.count("*") * s), F.lit(0.0)).alias("regulariser"))
    return fidelity(nodes).crossJoin(penalty).withColumn("objective", F.col("fidelity") + F.col("regulariser"))


def certificate(nodes: DataFrame, links: DataFrame, s: float, lam: float, dim: int) -> DataFrame:
    """One row: primal, dual, gap, relative_gap, feasibility and stationarity of u and the edges' dual y."""
    counts = nodes.agg(F.count("*").alias("n")).crossJoin(links.agg(F.count("*").alias("m")))
    held = nodes.join(divergence(links, "y", dim), "node", "left").withColumn("div", F.coalesce("div", F.array(*[F.lit(0.0)] * dim)))
    g = F.transform(minus(F.col("u"), F.col("z")), lambda x: x * F.col("rho"))
    r = F.zip_with(g, F.col("div"), lambda x, y: x + y)
    sums = held.agg(F.sum(dot(F.col("div"), F.col("z"))).alias("a"), F.sum(dot(F.col("div"), F.col("div")) / F.col("rho")).alias("b"), F.sum(dot(r, r)).alias("rr"), F.sum(dot(g, g)).alias("gg"), F.sum(dot(F.col("div"), F.col("div"))).alias("dd"))
    radius = lam * F.col("n") * F.col("omega") / (F.col("m") * s)
    worst = links.crossJoin(F.broadcast(counts)).agg(F.max(F.greatest(norm(F.col("y")) - radius, F.lit(0.0))).alias("over"), F.max(radius).alias("radius"))
    tiny = F.lit(2.2250738585072014e-308)
    out = objective(nodes, links, s, lam).select(F.col("objective").alias("primal")).crossJoin(sums).crossJoin(worst).crossJoin(counts)
    out = out.withColumn("dual", (F.col("a") - F.col("b") / 2) / F.col("n")).withColumn("gap", F.col("primal") - F.col("dual"))
    return out.select(
        "primal", "dual", "gap", (F.greatest("gap", F.lit(0.0)) / F.greatest(F.abs("primal"), F.abs("dual"), tiny)).alias("relative_gap"),
        (F.coalesce("over", F.lit(0.0)) / F.greatest(F.coalesce("radius", F.lit(0.0)), tiny)).alias("feasibility"),
        (F.sqrt("rr") / F.greatest(F.sqrt("gg"), F.sqrt("dd"), tiny)).alias("stationarity"),
    )


def primal_dual_step(nodes: DataFrame, links: DataFrame, s: float, lam: float, dim: int) -> tuple[DataFrame, DataFrame]:
    """One diagonally preconditioned step. nodes: node, u, u_bar, z, rho, degree; links: src, dst, omega, y."""
    counts = nodes.agg(F.count("*").alias("_n")).crossJoin(links.agg(F.count("*").alias("_m")))
    both = gather(links, nodes.select("node", "u_bar", "rho"), "u_bar", "rho").crossJoin(F.broadcast(counts))
    sigma = 0.99 / (1 / F.sqrt("rho_s") + 1 / F.sqrt("rho_t"))
    moved = F.zip_with("y", F.zip_with("u_bar_s", "u_bar_t", lambda a, b: a - b), lambda y, d: y + sigma * d)
    new_links = both.withColumn("_y", moved).withColumn("y", soft_clip(F.col("_y"), lam * F.col("_n") * F.col("omega") / (F.col("_m") * s))).select(*links.columns)
    pull = nodes.join(divergence(new_links, "y", dim), "node", "left").withColumn("div", F.coalesce("div", F.array(*[F.lit(0.0)] * dim)))
    tau = 0.99 / (F.greatest("degree", F.lit(1)) * F.sqrt("rho"))
    u = F.transform(F.arrays_zip("u", "div", "z"), lambda x: (x["u"] - tau * x["div"] + tau * F.col("rho") * x["z"]) / (1 + tau * F.col("rho")))
    stepped = pull.withColumn("_new", u).withColumn("u_bar", F.zip_with("_new", "u", lambda a, b: 2 * a - b)).withColumn("u", F.col("_new"))
    return stepped.select(*nodes.columns), new_links


def laplacian_product(nodes: DataFrame, links: DataFrame, s: float, lam: float, dim: int) -> DataFrame:
    """node, product: (diag rho + c K'WK) u with c = lambda N / (E s^2)."""
    counts = nodes.agg(F.count("*").alias("_n")).crossJoin(links.agg(F.count("*").alias("_m")))
    flow = gather(links, nodes.select("node", "u"), "u").withColumn("_f", times(minus(F.col("u_s"), F.col("u_t")), F.col("omega")))
    both = nodes.join(divergence(flow, "_f", dim), "node", "left").crossJoin(F.broadcast(counts))
    c = lam * F.col("_n") / (F.col("_m") * s * s)
    div = F.coalesce("div", F.array(*[F.lit(0.0)] * dim))
    return both.select("node", F.zip_with("u", div, lambda a, b: F.col("rho") * a + c * b).alias("product"))


# solvers ----------------------------------------------------------------------------------------------------------


@dataclass
class Problem:
    """Latent values, fidelity weights and a weighted graph; edges are pairs of row numbers."""

    z: np.ndarray
    rho: np.ndarray
    edges: np.ndarray
    omega: np.ndarray
    s: float
    lam: float

    def __post_init__(self) -> None:
        n, m = len(self.z), len(self.edges)
        self.edges = np.asarray(self.edges, dtype=np.int64).reshape(m, 2)
        if self.z.ndim != 2 or not n or not np.isfinite(self.z).all() or (self.rho <= 0).any() or not np.isfinite(self.rho).all():
            raise ValueError("z is finite with rows and columns, rho finite and positive")
        if (self.edges < 0).any() or (self.edges >= n).any() or (self.edges[:, 0] == self.edges[:, 1]).any() or (self.omega < 0).any():
            raise ValueError("edges join different rows, with weights of at least zero")
        if self.s <= 0 or self.lam < 0:
            raise ValueError("the scale is positive, lambda at least zero")
        self.a, self.b = self.edges[:, 0], self.edges[:, 1]
        self.degree = np.bincount(self.edges.ravel(), minlength=n)
        self.radius = self.lam * n * self.omega / (m * self.s) if m else np.zeros(0)
        # blocks of edges, and how each end's edge vectors are added: rounds in which no node comes twice, or sorted runs
        self.blocks = []
        for lo in range(0, m, EDGE_BLOCK):
            own = slice(lo, min(lo + EDGE_BLOCK, m))
            ends = []
            for end in (self.a[own], self.b[own]):
                order = np.argsort(end, kind="stable")
                first = np.flatnonzero(np.diff(end[order], prepend=-1))
                size = np.diff(np.append(first, len(end)))
                place = np.arange(len(end)) - np.repeat(first, size)
                rounds = [order[place == r] for r in range(size.max())] if size.max() <= ROUNDS else None
                ends.append(([(r, end[r]) for r in rounds], None, None) if rounds else (order, first, end[order[first]]))
            self.blocks.append((own, *ends))

    def differences(self, u: np.ndarray, own: slice = slice(None)) -> np.ndarray:
        out = u.take(self.a[own], axis=0)
        out -= u.take(self.b[own], axis=0)
        return out

    def scatter(self, out: np.ndarray, block: tuple, y: np.ndarray) -> None:
        """Adds a block's edge vectors to the nodes that they leave and takes them from those that they enter."""
        for add, (how, first, node) in zip((np.add, np.subtract), block[1:], strict=True):
            if first is not None:
                out[node] = add(out[node], np.add.reduceat(y[how], first))
            else:
                for rows, at in how:
                    out[at] = add(out.take(at, axis=0), y.take(rows, axis=0))

    def divergence(self, y: np.ndarray) -> np.ndarray:
        out = np.zeros_like(self.z)
        for block in self.blocks:
            self.scatter(out, block, y[block[0]])
        return out

    def flow(self, u: np.ndarray) -> np.ndarray:
        """The divergence of the weighted differences."""
        out = np.zeros_like(self.z)
        for block in self.blocks:
            self.scatter(out, block, self.omega[block[0], None] * self.differences(u, block[0]))
        return out

    def project(self, y: np.ndarray, own: slice = slice(None)) -> np.ndarray:
        """Shortens the edge vectors to their radius, in place."""
        size = np.sqrt(np.einsum("ij,ij->i", y, y))
        y *= np.minimum(1.0, self.radius[own] / np.maximum(size, 1e-30))[:, None]
        return y

    def penalty(self, u: np.ndarray, square: bool = False) -> float:
        if not len(self.edges) or not self.lam:
            return 0.0
        j = np.concatenate([(self.differences(u, own) ** 2).sum(axis=1) for own, *_ in self.blocks])
        m = len(self.edges)
        return float(self.lam * (self.omega @ j) / (2 * m * self.s**2) if square else self.lam * (self.omega @ np.sqrt(j)) / (m * self.s))

    def value(self, u: np.ndarray, square: bool = False) -> float:
        return float((self.rho[:, None] * (u - self.z) ** 2).sum() / (2 * len(u))) + self.penalty(u, square)

    def judge(self, u: np.ndarray, y: np.ndarray) -> dict[str, float]:
        """The certificate of a primal and a dual point."""
        tiny = np.finfo(float).tiny
        div, pull = self.divergence(y), self.rho[:, None] * (u - self.z)
        primal = self.value(u)
        dual = float(((div * self.z).sum() - 0.5 * (div * div / self.rho[:, None]).sum()) / len(u))
        over = np.maximum(np.sqrt(np.einsum("ij,ij->i", y, y)) - self.radius, 0).max(initial=0)
        return {
            "primal": primal, "dual": dual, "gap": primal - dual, "relative_gap": max(primal - dual, 0) / max(abs(primal), abs(dual), tiny),
            "feasibility": float(over / max(self.radius.max(initial=0), tiny)),
            "stationarity": float(np.linalg.norm(pull + div) / max(np.linalg.norm(pull), np.linalg.norm(div), tiny)),
        }


@dataclass
class Solution:
    u: np.ndarray
    y: np.ndarray
    converged: bool
    iterations: int
    objective: float
    change: float
    history: list[dict] = field(default_factory=list)


def total_variation(p: Problem, *, method: str = "diagonal", max_iters: int = 5000, tol: float = 1e-8, check_every: int = 100, checks: int = 1, stop_on: str = "relative_gap", start: Solution | None = None, done: int = 0, on_check=None) -> Solution:
    """Primal-dual (diagonal or scalar steps) or accelerated dual ascent (dual_fista), stopped by the certificate.

    Checked at the first step, every check_every-th and the last; a check passes if the dual is feasible to 1e-12 and
    the gap (or the relative change of u) is at most tol. start and done resume an earlier run; on_check sees each
    check's step, u, y and record.
    """
    if method not in ("diagonal", "scalar", "dual_fista") or stop_on not in ("relative_gap", "change"):
        raise ValueError("unknown method or stopping rule")
    n, m = len(p.z), len(p.edges)
    if not m or not p.lam:
        return Solution(p.z.copy(), np.zeros((m, p.z.shape[1])), True, 0, p.value(p.z), 0.0)
    rho = p.rho[:, None]
    dual = method == "dual_fista"
    if dual:
        step = 0.99 / (p.degree[p.a] / p.rho[p.a] + p.degree[p.b] / p.rho[p.b])[:, None]
    elif method == "diagonal":
        root = np.sqrt(p.rho)
        tau, step = (0.99 / (np.maximum(p.degree, 1) * root))[:, None], (0.99 / (1 / root[p.a] + 1 / root[p.b]))[:, None]
    else:
        both = 0.99 / np.sqrt(2.0 * max(int(p.degree.max()), 1))
        tau, step = np.full((n, 1), both), np.full((m, 1), both)
    y = p.project(start.y.copy() if start else np.zeros((m, p.z.shape[1])))
    u = (start.u if start and not dual else p.z).copy()
    ahead, momentum, seen = (y.copy() if dual else u.copy()), 1.0, u.copy()
    pulled = p.divergence(ahead) if dual else np.zeros_like(p.z)
    out, passed = Solution(u, y, False, done, 0.0, np.inf), 0
    for k in range(done + 1, max_iters + 1):
        before = u
        if dual:
            now = p.z - pulled / rho
            after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
            pulled[:] = 0
            for block in p.blocks:
                own = block[0]
                new = p.differences(now, own)
                new *= step[own]
                new += ahead[own]
                new = p.project(new, own)
                moved = new - y[own]
                moved *= (momentum - 1) / after
                moved += new
                y[own], ahead[own] = new, moved
                p.scatter(pulled, block, moved)
            momentum = after
        else:
            pulled[:] = 0
            for block in p.blocks:
                own = block[0]
                new = p.differences(ahead, own)
                new *= step[own]
                new += y[own]
                y[own] = new = p.project(new, own)
                p.scatter(pulled, block, new)
            u = (before + tau * (rho * p.z - pulled)) / (1 + tau * rho)
            ahead = 2 * u - before
        if k == 1 or k % check_every == 0 or k == max_iters:
            if dual:
                u, before = p.z - p.divergence(y) / rho, seen
                seen = u
            change = float(np.linalg.norm(u - before) / max(np.linalg.norm(before), 1e-30))
            record = {"iteration": k, "change": change, **p.judge(u, y)}
            out.history.append(record)
            passed = passed + 1 if record["feasibility"] <= FEASIBLE and (record["relative_gap"] if stop_on == "relative_gap" else change) <= tol else 0
            out.change, out.iterations = change, k
            if on_check:
                on_check(k, u, y.copy(), record)
            if passed >= checks:
                out.converged = True
                break
    out.u, out.y, out.objective = u, y, p.value(u)
    return out


def laplacian(p: Problem, *, max_iters: int = 1000, tol: float = 1e-10) -> Solution:
    """Conjugate gradients on (diag rho + c K'WK) U = diag rho Z, all columns with common steps, from Z."""
    if not len(p.edges) or not p.lam:
        return Solution(p.z.copy(), np.zeros((len(p.edges), p.z.shape[1])), True, 0, p.value(p.z, True), 0.0)
    c, rho = p.lam * len(p.z) / (len(p.edges) * p.s**2), p.rho[:, None]
    apply = lambda v: rho * v + c * p.flow(v)
    u = p.z.copy()
    r = rho * p.z - apply(u)
    d, rr = r.copy(), float((r * r).sum())
    first, k, converged = rr, 0, rr == 0
    while not converged and k < max_iters:
        k += 1
        ad = apply(d)
        curve = float((d * ad).sum())
        if curve <= 0:
            raise ArithmeticError("the system is not positive definite")
        u = u + rr / curve * d
        r = r - rr / curve * ad
        old, rr = rr, float((r * r).sum())
        converged = (rr / first) ** 0.5 < tol
        d = r + rr / old * d
    return Solution(u, np.zeros((len(p.edges), p.z.shape[1])), converged, k, p.value(u, True), (rr / first) ** 0.5 if first else 0.0)


def solve_groups(nodes: DataFrame, links: DataFrame, keys: list[str], lam: float, kind: str = "total_variation", **options) -> DataFrame:
    """Solves one problem for each group, in parallel: keys, node, u, converged, iterations, objective.

    nodes: keys, node, z, rho; links: keys, src, dst, omega, s (the jump scale of the group, on every row).
    """
    shape = ", ".join(f"{k} {dict(nodes.dtypes)[k]}" for k in keys) + ", node long, u array<double>, converged boolean, iterations int, objective double, relative_gap double"

    def solve(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("node").reset_index(drop=True)
        right = right.sort_values(["src", "dst"])
        ends = np.searchsorted(left["node"].to_numpy(), right[["src", "dst"]].to_numpy())
        p = Problem(np.stack(left["z"].to_numpy()), left["rho"].to_numpy(float), ends, right["omega"].to_numpy(float), float(right["s"].iloc[0]) if len(right) else 1.0, lam)
        got = total_variation(p, **options) if kind == "total_variation" else laplacian(p, **options)
        gap = got.history[-1]["relative_gap"] if got.history else 0.0
        out = pd.DataFrame({k: [v] * len(left) for k, v in zip(keys, key, strict=True)})
        return out.assign(node=left["node"], u=list(got.u), converged=got.converged, iterations=got.iterations, objective=got.objective, relative_gap=gap)

    return nodes.groupBy(*keys).cogroup(links.groupBy(*keys)).applyInPandas(solve, shape)
