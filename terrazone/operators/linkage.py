"""Connected components of long edge tables, contracted inside tasks of bounded size.

A task replaces its links by one from every node to the least node that it reaches with them, which keeps what is
connected. Once all links fit one task the components are known; until then alternating large-star and small-star steps
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014) shorten the paths between contractions. Rounds are
tables in the shared folder: the plan does not grow, and a lost executor costs one round. The driver sees a count and a
checksum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazone.sources.sinks import written

TASK_LINKS = 1_000_000


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node but the least of its component, and that least node: labels sink to the smaller one and are followed."""
    ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(ids))
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(deeper := label[label], label):
            label = deeper
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        u, v = contract(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def roots(links: DataFrame, a: str = "src", b: str = "dst", task_links: int = TASK_LINKS) -> DataFrame:
    """node, root for every end of a link but the roots' own; loops and repeats are ignored."""
    now = written(links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v"), "links")
    n, seen = now.count(), None
    while n:
        tasks = -(-n // task_links)
        now = now.coalesce(tasks).mapInArrow(_inside, "u long, v long")
        if tasks == 1:
            break
        now = written(now, "links")
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        met = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = met.select("u", F.col("m").alias("v")).union(met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = written(small.distinct(), "links")
        sign = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if sign == seen:
            break
        n, seen = sign[0], sign
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
