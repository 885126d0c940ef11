"""Baselines: clustered descriptors of each series, and an equal fusion of three views."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazone.operators.experiment import _scaled
from terrazone.operators.zoning import kmeans

#: Descriptors of a series, in order.
DESCRIPTORS = ["abs_energy", "abs_sum_of_changes", "autocorrelation_1", "autocorrelation_2", "autocorrelation_5", "c3", "cid", "count_above_mean", "first_max", "first_min", "kurtosis", "last_max", "last_min", "longest_above", "max", "mean", "mean_change", "median", "min", "quantile_10", "quantile_90", "range", "rms", "skewness", "slope", "std", "strength_3", "sum", "turns", "variation"]


def describe(x: np.ndarray) -> list[float]:
    """The descriptors of one series without gaps; what is not defined is NaN and dropped later for all series."""
    n, d = len(x), np.diff(x)
    z = x - x.mean()
    var = float((z**2).mean())
    lag = lambda k: float((z[k:] * z[:-k]).mean() / var) if var and n > k else np.nan
    above = x > x.mean()
    edge = np.flatnonzero(np.diff(np.concatenate([[0], above.view(np.int8), [0]])))
    t = np.arange(n) - (n - 1) / 2
    pulse = np.abs(np.fft.rfft(z)[1:4])
    values = {
        "abs_energy": (x**2).sum(), "abs_sum_of_changes": np.abs(d).sum(), "autocorrelation_1": lag(1), "autocorrelation_2": lag(2), "autocorrelation_5": lag(5),
        "c3": (x[2:] * x[1:-1] * x[:-2]).mean() if n > 2 else np.nan, "cid": np.sqrt((d**2).sum()), "count_above_mean": above.sum(), "first_max": x.argmax() / n, "first_min": x.argmin() / n,
        "kurtosis": (z**4).mean() / var**2 if var else np.nan, "last_max": 1 - x[::-1].argmax() / n, "last_min": 1 - x[::-1].argmin() / n, "longest_above": (edge[1::2] - edge[::2]).max(initial=0),
        "max": x.max(), "mean": x.mean(), "mean_change": d.mean() if n > 1 else np.nan, "median": np.median(x), "min": x.min(), "quantile_10": np.quantile(x, 0.1), "quantile_90": np.quantile(x, 0.9),
        "range": np.ptp(x), "rms": np.sqrt((x**2).mean()), "skewness": (z**3).mean() / var**1.5 if var else np.nan, "slope": (t * x).sum() / (t**2).sum() if n > 1 else np.nan, "std": np.sqrt(var),
        "strength_3": pulse.sum(), "sum": x.sum(), "turns": (d[1:] * d[:-1] < 0).sum(), "variation": np.sqrt(var) / abs(x.mean()) if x.mean() else np.nan,
    }
    return [float(values[c]) for c in DESCRIPTORS]


def descriptors(panel: DataFrame, value: str = "filled") -> DataFrame:
    """node and the descriptors of its training series: one small task for each group of nodes."""

    def made(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("e")[value].to_numpy(float)
        return pd.DataFrame([[pdf["node"].iloc[0], *describe(x)]], columns=["node", *DESCRIPTORS])

    return panel.select("node", "e", value).groupBy("node").applyInPandas(made, "node long, " + ", ".join(f"{c} double" for c in DESCRIPTORS))


def principal_features(x: np.ndarray, share: float = 0.9) -> np.ndarray:
    """Columns to keep: constant ones go, loadings of the axes with `share` of the variance are clustered, and each
    cluster keeps the column nearest to its centre."""
    usable = np.flatnonzero(np.isfinite(x).all(axis=0) & (np.ptp(np.nan_to_num(x), axis=0) > 0))
    if not len(usable):
        raise ValueError("no descriptor varies")
    z = x[:, usable]
    z = (z - z.mean(axis=0)) / np.maximum(z.std(axis=0), 1e-12)
    _, size, axes = np.linalg.svd(z, full_matrices=False)
    q = min(int(np.searchsorted(np.cumsum(size**2) / max((size**2).sum(), 1e-12), share)) + 1, len(axes), z.shape[1])
    loads = axes[:q].T
    found = kmeans(loads, q, seed=0, n_init=10)
    near = ((loads - found.centers[found.labels]) ** 2).sum(axis=1)
    return usable[sorted({int(np.flatnonzero(found.labels == c)[near[found.labels == c].argmin()]) for c in np.unique(found.labels)})]


def descriptor_zones(rows: DataFrame, k: int, seed: int = 0, n_init: int = 10) -> DataFrame:
    """node, label by k-means on the kept, standardised descriptors. One row a node reaches the driver."""
    held = rows.orderBy("node").toPandas()
    x = held[DESCRIPTORS].to_numpy(float)
    x = x[:, principal_features(x)]
    x = (x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-12)
    labels = kmeans(x, k, seed=seed, n_init=n_init).labels
    return rows.sparkSession.createDataFrame(pd.DataFrame({"node": held["node"], "label": labels}), "node long, label long")


def fused_views(views: list[np.ndarray], k: int, seed: int = 0, n_init: int = 4) -> np.ndarray:
    """Labels from three views, each scaled robustly and to equal energy."""
    if len(views) != 3:
        raise ValueError("deformation, terrain and imagery")
    parts = [_scaled(np.asarray(v, dtype=float)) for v in views]
    parts = [p / max(np.sqrt((p * p).sum() / len(p)), 1e-8) for p in parts]
    return kmeans(np.concatenate(parts, axis=1) / np.sqrt(3.0), k, seed=seed, n_init=n_init).labels


def shape_clusters(x: np.ndarray, k: int, shifts: int = 5, seed: int = 0, max_iter: int = 1000) -> np.ndarray:
    """K spectral centroids: series are matched under shifts (zero padded) and scaling; a centroid is the leading axis
    of its aligned, normalised members."""
    n, t = x.shape
    moved = np.zeros((2 * shifts + 1, n, t))
    for j, s in enumerate(range(-shifts, shifts + 1)):
        moved[j, :, max(s, 0) : t + min(s, 0)] = x[:, max(-s, 0) : t - max(s, 0)]
    size = np.maximum(np.linalg.norm(moved, axis=2), 1e-12)
    labels = np.random.default_rng(seed).integers(k, size=n)
    for _ in range(max_iter):
        centers = np.zeros((k, t))
        for c in range(k):
            own = np.flatnonzero(labels == c)
            if len(own):
                first = x[own[0]]
                best = np.abs(moved[:, own] @ first / size[:, own]).argmax(axis=0)
                a = moved[best, own] / size[best, own][:, None]
                centers[c] = np.linalg.svd(a, full_matrices=False)[2][0]
        like = np.abs(np.einsum("snt,kt->snk", moved, centers) / size[:, :, None]).max(axis=0)
        new = like.argmax(axis=1)
        if (new == labels).all():
            break
        labels = new
    return labels


def view_zones(rows: DataFrame, k: int, seed: int = 0, n_init: int = 4) -> DataFrame:
    """node, label by `fused_views` of the three array columns after node. The views of one site fit the driver."""
    held = rows.orderBy("node").toPandas()
    labels = fused_views([np.stack(held[c].to_numpy()) for c in rows.columns if c != "node"], k, seed, n_init)
    return rows.sparkSession.createDataFrame(pd.DataFrame({"node": held["node"], "label": labels}), "node long, label long")


def series_clusters(panel: DataFrame, k: int, value: str = "filled", shifts: int = 5, seed: int = 0) -> DataFrame:
    """node, label by `shape_clusters` of each node's series in order of its epochs. One site's series fit the driver."""
    held = panel.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("e", value))), lambda x: x[value]).alias("x")).orderBy("node").toPandas()
    labels = shape_clusters(np.stack(held["x"].to_numpy()), k, shifts, seed)
    return panel.sparkSession.createDataFrame(pd.DataFrame({"node": held["node"], "label": labels}), "node long, label long")
