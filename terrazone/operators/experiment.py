"""The controlled experiment: synthetic truth on a lattice, variants of the method, scores, all problems in parallel.

A realization depends on a condition and a seed. Random draws come from independent streams, one for each role, so
that a factor can change while everything else stays paired within a seed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from terrazone.operators.recovery import Problem, laplacian, total_variation
from terrazone.operators.zoning import kmeans

# Fixed values of the experiment ------------------------------------------------------------------------------------
SIDE, DIM = 20, 3
STARTS, WIDTHS = (0, 7, 13), (7, 6, 7)
AMPLITUDE, SIGMA = 0.15, 0.05
STREAM_FIELD, STREAM_NOISE, STREAM_TERRAIN, STREAM_OPTICAL = 11, 19, 23, 37
DIRECTION = (1.0, -0.5, 0.25)
OPTICAL_BASE = (0.45, 0.08, 0.35, 0.55, 0.02, 0.25, 0.07, 0.17, 0.33, -0.01, -0.05, 0.09, -0.15, 0.05, 0.01)
OPTICAL_CONTRAST = (1.0, 0.25, 0.8, 1.2, 0.35, -0.8, 0.2, -0.7, -0.9, -0.3, 0.7, 0.2, 0.6, 0.8, 0.25)
TERRAIN_CONTRAST = (8.0, 1.2, 0.0, 0.025, 0.18)
NEIGHBOURS, LAMBDA, MAX_ITERS, TOLERANCE, ZONES, RESTARTS = 8, 0.2, 5000, 1e-7, 3, 10
# --------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Condition:
    h: float
    eta_t: int
    eta_o: int
    jump: float
    q_o: float = 0.8

    def __post_init__(self) -> None:
        if not (self.h >= 1 and self.eta_t in (0, 1, 2) and self.eta_o in (0, 1, 2) and self.jump > 0 and 0 <= self.q_o <= 1):
            raise ValueError("h >= 1, eta in 0 to 2, jump > 0, q_o in [0, 1]")


@dataclass(frozen=True)
class Variant:
    reliability: bool = True
    terrain: bool = True
    optical: bool = True
    laplacian: bool = False


VARIANTS = {"Full": Variant(), "NoReliability": Variant(reliability=False), "GeometryOnly": Variant(terrain=False), "NoOptical": Variant(optical=False), "GraphLaplacian": Variant(laplacian=True)}


def cases() -> list[tuple[str, str, str, Condition, list[str]]]:
    """(block, factor, value, condition, variants) of the whole experiment."""
    out = [("A", "H", str(h), Condition(h, 1, 1, 2.0, 0.0), ["Full", "NoReliability"]) for h in (1, 4, 8, 16)]
    out += [("B1", "eta_T", str(e), Condition(1, e, 1, 2.0, 0.0), ["Full", "GeometryOnly"]) for e in (0, 1, 2)]
    out += [("B2", "eta_O", str(e), Condition(1, 0, e, 2.0, 0.8), ["Full", "NoOptical"]) for e in (0, 1, 2)]
    out += [("C", "J", str(j), Condition(1, 1, 1, j, 0.0), ["Full", "GraphLaplacian"]) for j in (0.5, 1.0, 2.0, 4.0)]
    return [*out, ("D", "target", "combined", Condition(8, 1, 1, 2.0, 0.8), list(VARIANTS))]


def _draws(seed: int, stream: int) -> np.random.Generator:
    return np.random.default_rng(np.random.SeedSequence([seed, stream]))


def _scaled(x: np.ndarray, epsilon: float = 1e-8) -> np.ndarray:
    low, middle, high = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    return (x - middle) / (high - low + epsilon)


def lattice_edges(side: int = SIDE) -> np.ndarray:
    node = np.arange(side * side).reshape(side, side)
    across = np.stack([node[:, :-1].ravel(), node[:, 1:].ravel()], axis=1)
    down = np.stack([node[:-1].ravel(), node[1:].ravel()], axis=1)
    both = np.concatenate([across, down])
    return both[np.lexsort((both[:, 1], both[:, 0]))]


def realize(c: Condition, seed: int) -> dict[str, np.ndarray]:
    """Truth, observation, reliability, terrain and imagery of one world."""
    row, col = np.divmod(np.arange(SIDE * SIDE), SIDE)
    label = np.searchsorted(STARTS, col, side="right") - 1
    y = row / (SIDE - 1)
    draws, within = _draws(seed, STREAM_FIELD), np.zeros((len(row), DIM))
    for k, (start, width) in enumerate(zip(STARTS, WIDTHS, strict=True)):
        own = label == k
        x, v = (col[own] - start) / (width - 1), y[own]
        waves = np.stack([np.sin(np.pi * x), np.cos(np.pi * v), np.sin(np.pi * (x + v) / 2), np.cos(np.pi * (x - v) / 2)], axis=1)
        values = waves @ draws.normal(size=(4, DIM))
        within[own] = values - values.mean(axis=0)
    within *= AMPLITUDE / np.sqrt((within**2).sum(axis=1).mean())
    side = label - 1.0
    truth = c.jump * np.outer(side, np.array(DIRECTION) / np.linalg.norm(DIRECTION)) + within
    low = (row >= 5) & (row < 15) & (col >= 5) & (col < 15)
    sigma = np.where(low, SIGMA * c.h, SIGMA)
    q = np.where(low, 1.0 / c.h, 1.0) + 1e-8
    line, noise = np.arange(SIDE) / (SIDE - 1), _draws(seed, STREAM_TERRAIN).normal(size=(SIDE, 5))
    turn = 2 * np.pi * line
    profile = np.stack([
        100 + 5 * np.sin(turn) + 0.5 * noise[:, 0], 10 + 2 * np.cos(turn) + 0.2 * noise[:, 1], np.mod(0.8 + 0.5 * np.sin(turn + 0.3) + 0.04 * noise[:, 2], 2 * np.pi),
        0.08 * np.sin(2 * turn) + 0.01 * noise[:, 3], 2 + 0.35 * np.cos(turn - 0.2) + 0.04 * noise[:, 4],
    ], axis=1)
    ground = profile[row] + c.eta_t * np.outer(side, TERRAIN_CONTRAST)
    draws = _draws(seed, STREAM_OPTICAL)
    base, mixing = draws.normal(size=(SIDE, 4)), draws.normal(scale=0.018, size=(4, 15))
    imagery = (np.array(OPTICAL_BASE) + base @ mixing)[row] + 0.06 * c.eta_o * np.outer(side, OPTICAL_CONTRAST)
    return {
        "coords": np.stack([col, row], axis=1).astype(float), "label": label, "truth": truth, "z": truth + _draws(seed, STREAM_NOISE).normal(size=truth.shape) * sigma[:, None],
        "rho": q / q.mean() if np.ptp(q) else np.ones(len(q)), "terrain": ground, "z_o": _scaled(imagery), "q_o": np.full(len(row), c.q_o), "low": low, "sigma": sigma,
    }


def nearest_edges(coords: np.ndarray, k: int) -> np.ndarray:
    d = np.sqrt(((coords[:, None] - coords[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    pairs = np.stack([np.repeat(np.arange(len(coords)), k), near.ravel()], axis=1)
    return np.unique(np.sort(pairs, axis=1), axis=0)


def separability(x: np.ndarray, label: np.ndarray) -> float:
    """The least gap of neighbouring zones' centroids over the root mean square within zones."""
    centers = np.stack([x[label == k].mean(axis=0) for k in range(3)])
    spread = np.sqrt(((x - centers[label]) ** 2).sum(axis=1).mean())
    return float(min(np.linalg.norm(centers[1] - centers[0]), np.linalg.norm(centers[2] - centers[1])) / max(spread, 1e-12))


def terrain_features(ground: np.ndarray) -> np.ndarray:
    e, s, a, c, t = ground.T
    return np.stack([e, s, np.sin(a), np.cos(a), c, t], axis=1)


def diagnostics(w: dict[str, np.ndarray]) -> dict[str, float]:
    edges, label = lattice_edges(), w["label"]
    cut = label[edges[:, 0]] != label[edges[:, 1]]
    centers = np.stack([w["truth"][label == k].mean(axis=0) for k in range(3)])
    return {"edges": len(edges), "boundary_edges": int(cut.sum()), "jump": float(min(np.linalg.norm(np.diff(centers, axis=0), axis=1))), "terrain_separability": separability(terrain_features(w["terrain"]), label), "optical_separability": separability(w["z_o"], label)}


def average_precision(positive: np.ndarray, score: np.ndarray) -> float:
    if not positive.any():
        return 0.0
    value, place = np.unique(-score, return_inverse=True)
    hits, size = np.bincount(place, weights=positive, minlength=len(value)), np.bincount(place, minlength=len(value))
    return float((hits / hits.sum() * np.cumsum(hits) / np.cumsum(size)).sum())


def rand_index(a: np.ndarray, b: np.ndarray) -> float:
    table = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(table, (a, b), 1)
    two = lambda x: float((x * (x - 1) / 2).sum())
    both, left, right, every = two(table), two(table.sum(axis=1)), two(table.sum(axis=0)), two(np.array([table.sum()]))
    if every == 0 or (left + right) / 2 == left * right / every:
        return float(both == (left + right) / 2)
    return (both - left * right / every) / ((left + right) / 2 - left * right / every)


def score(c: Condition, seed: int, variants: list[str], lam: float = LAMBDA) -> list[tuple[str, str, float, bool]]:
    """(variant, metric, value, converged) of one world; graph, gate and scale are shared by its variants."""
    w = realize(c, seed)
    edges = nearest_edges(w["coords"], NEIGHBOURS)
    gap = lambda x: np.linalg.norm(x[edges[:, 0]] - x[edges[:, 1]], axis=1)
    gauss = lambda d: d**2 / (2 * max(float(np.median(d)), 1e-8) ** 2)
    far, ground = gauss(gap(w["coords"])), gauss(gap(_scaled(terrain_features(w["terrain"]))))
    geometry, terrain = np.exp(np.maximum(-far, -708.3964185322641)), np.exp(np.maximum(-far - ground, -708.3964185322641))
    like = np.exp(np.maximum(-gauss(gap(w["z_o"])), -708.3964185322641))
    gate = np.clip(1 - np.sqrt(w["q_o"][edges[:, 0]] * w["q_o"][edges[:, 1]]) * (1 - like), 0, 1)
    s, frame = float(np.median(gap(w["z"]))) + 1e-8, lattice_edges()
    cut, out = w["label"][frame[:, 0]] != w["label"][frame[:, 1]], []
    for name in variants:
        v = VARIANTS[name]
        strength = (terrain if v.terrain else geometry) * (gate if v.optical else 1.0)
        omega = strength * len(edges) / strength.sum() if strength.sum() > 1e-12 else np.ones(len(edges))
        p = Problem(w["z"], w["rho"] if v.reliability else np.ones(len(w["rho"])), edges, omega, s, lam)
        got = laplacian(p, max_iters=MAX_ITERS, tol=TOLERANCE) if v.laplacian else total_variation(p, max_iters=MAX_ITERS, tol=TOLERANCE)
        zone = kmeans(got.u, ZONES, seed=seed, n_init=RESTARTS).labels
        jumps = np.linalg.norm(got.u[frame[:, 0]] - got.u[frame[:, 1]], axis=1) / s
        error = float(np.linalg.norm(got.u - w["truth"]) / max(np.linalg.norm(w["truth"]), 1e-12))
        out += [(name, m, x, got.converged) for m, x in (("NRMSE_U", error), ("Boundary_AUPRC", average_precision(cut, jumps)), ("ARI", rand_index(zone, w["label"])))]
    return out


ROW = "subexperiment string, factor_name string, factor_value string, variant string, seed int, metric string, value double, converged boolean"


def run(spark: SparkSession, seeds: list[int], blocks: list[str] | None = None) -> DataFrame:
    """The raw rows of the experiment; every (condition, seed) is one task's work."""
    chosen = [(k, x) for k, x in enumerate(cases()) if blocks is None or x[0] in blocks]
    jobs = spark.createDataFrame([(k, s) for k, _ in chosen for s in seeds], "case_number int, seed int").repartition(min(len(chosen) * len(seeds), 512), "case_number", "seed")

    def solve(frames):
        every = cases()
        for pdf in frames:
            rows = []
            for k, s in pdf.itertuples(index=False):
                block, factor, value, condition, variants = every[int(k)]
                rows += [(block, factor, value, v, int(s), m, x, bool(ok)) for v, m, x, ok in score(condition, int(s), variants)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ROW.split(", ")])

    return jobs.mapInPandas(solve, ROW)
