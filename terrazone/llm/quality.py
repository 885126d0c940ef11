"""Quality scores learned from preference pairs (Bradley-Terry), thresholded by a quantile of the scores.

Each pair sets a document labelled good against one labelled bad; the weights minimise the logistic loss on the
differences of their features, so that a document's utility is linear in its features. The threshold is the
quantile of the training utilities that separates the labels best, and a logistic curve through it turns
utilities into scores: 0.5 at the threshold.

Features come from the text alone: square roots of the shares of each ASCII byte, the share of other bytes, word
and line statistics, and the densest window of symbols, so that junk in a part of a long text counts.

Labelled rows are sampled: at most ``most`` of them, those with the smallest hash of doc_id. Everything else covers
all rows; scoring is one pass without a shuffle.

Defined results: null and empty texts are scored as texts without a byte. Several labels of one document: the
largest. Documents that share a key count once in training, by the least text. With labels of one kind only, or none,
every score is 0.5. Repeated rows are scored alike. Extra columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazone.llm import frames, kernels

MOST_LABELS = 20_000
PAIRS = 24_000
WIDTH = 128 + 10
_UPPER = np.array([0x41 <= b <= 0x5A for b in range(256)])
_SYMBOL = np.array([0x21 <= b < 0x7F and not chr(b).isalnum() and chr(b) not in ".,'\"-" for b in range(256)])
_PATCH = 256


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of WIDTH features for each document."""
    n = len(off) - 1
    lens = np.diff(off)
    body = data[off[0] : off[-1]]
    doc = np.repeat(np.arange(n), lens)
    shares = np.bincount(doc * 129 + np.minimum(body, 128), minlength=n * 129).reshape(n, 129) / np.maximum(lens, 1)[:, None]
    out = np.zeros((n, WIDTH))
    out[:, :128] = np.sqrt(shares[:, :128])
    part = kernels.Texts(data, off)
    starts, ends, first = part.words(kernels.NOT_SPACE)
    words, total = part.spans(starts, ends), np.diff(first)
    long = np.concatenate([[0], np.cumsum(ends - starts)])
    line_start = part.buf[:-8] == 0x0A
    lines = np.concatenate([[0], np.cumsum(line_start)])
    symbol = np.concatenate([[0], np.cumsum(_SYMBOL[part.buf])])
    for d in range(n):
        a, b = part.starts[d], part.starts[d] + lens[d]
        edges = np.append(np.arange(a, b, _PATCH), b)
        out[d, 137] = np.max(np.diff(symbol[edges]) / np.maximum(np.diff(edges), 64), initial=0)
        h = words[first[d] : first[d + 1]]
        out[d, 128] = len(np.unique(h)) / max(1, len(h)) if len(h) else 0
        pairs = kernels.grams(h, 3)
        out[d, 129] = len(np.unique(pairs)) / len(pairs) if len(pairs) else 1
    out[:, 130] = np.sqrt(shares[:, 128])
    out[:, 131] = np.log1p(lens)
    out[:, 132] = np.log1p(total)
    out[:, 133] = (long[first[1:]] - long[first[:-1]]) / np.maximum(total, 1)
    out[:, 134] = np.log1p((lines[part.starts[1:] - 1] - lines[part.starts[:-1]]))
    out[:, 135] = out[:, :128] @ np.where(_UPPER[:128], 1.0, 0.0)
    out[:, 136] = (lens == 0).astype(float)
    return out


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7, ridge: float = 2.0) -> dict:
    """Weights, threshold and slope from features and 0/1 labels."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return {"mean": np.zeros(WIDTH), "w": np.zeros(WIDTH), "at": 0.0, "slope": 1.0}
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / spread, -8, 8)
    rng = np.random.default_rng(seed)
    m = max(PAIRS, len(good), len(bad))
    a = np.concatenate([rng.permutation(good) for _ in range(-(-m // len(good)))])[:m]
    b = np.concatenate([rng.permutation(bad) for _ in range(-(-m // len(bad)))])[:m]
    d, w = z[a] - z[b], np.zeros(x.shape[1])
    for _ in range(12):  # Newton steps on the mean logistic loss of the differences
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve(d.T @ (d * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), d.T @ (1 - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    s = z @ w
    q = np.quantile(s, np.linspace(0, 1, 401))
    right = [(((s >= t) == (y == 1)).mean(), -abs((s >= t).mean() - y.mean()), t) for t in (q[:-1] + q[1:]) / 2]
    at = max(right)[2]
    return {"mean": mean, "w": w / spread, "z": spread, "at": float(at), "slope": float(4 / max(np.std(s), 1e-6))}


def score(model: dict, x: np.ndarray) -> np.ndarray:
    z = x - model["mean"]
    if "z" in model:
        z = np.clip(z, -8 * model["z"], 8 * model["z"])
    return 1 / (1 + np.exp(-np.clip(model["slope"] * (z @ model["w"] - model["at"]), -30, 30)))


def train(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", label: str = "quality", text: str = "text", most: int = MOST_LABELS) -> dict:
    """The model from at most `most` labelled documents."""
    some = labels.where(F.col(label).isNotNull() & F.col(doc).isNotNull()).groupBy(F.col(doc).cast("long").alias("d")).agg(F.max(label).alias("y")).orderBy(F.xxhash64("d"), "d").limit(most)
    held = docs.select(F.col(doc).cast("long").alias("d"), F.col(text).cast("string").alias("t"))
    # rows that share a key count once, by the text that comes first
    held = held.join(F.broadcast(some), "d").groupBy("d", "y").agg(F.min(F.coalesce("t", F.lit(""))).alias("t"))
    rows = frames.enrich(held, lambda: lambda data, off: {"x": list(features(data, off).astype(np.float32))}, "x array<float>", text="t", keep=["d", "y"]).toPandas().sort_values("d", kind="stable")
    if not len(rows):
        return fit(np.zeros((0, WIDTH)), np.zeros(0))
    return fit(np.stack(rows["x"].to_numpy()).astype(float), rows["y"].to_numpy())


def rate(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns, score (0 to 1) and predicted (1 if score >= 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(data: np.ndarray, off: np.ndarray) -> dict:
        s = score(shared.value, features(data, off))
        return {"score": s, "predicted": (s >= 0.5).astype(np.int32)}

    return frames.enrich(docs, lambda: kernel, "score double, predicted int", text=text, keep=keep)
