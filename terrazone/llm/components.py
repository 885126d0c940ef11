"""Connected components of a graph of links.

Links are contracted inside tasks of at most ``TASK_LINKS`` links each: a task replaces its links by one from every
node to the least node it can reach with them, which keeps what is connected. Once all links fit one such task the
components are known; until then alternating large-star and small-star steps (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014) shorten the paths between rounds of contraction, and end by themselves when nothing
changes. Every round is written to the shared folder. Nothing is gathered: the driver sees a count and a checksum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazone.llm.store import Scratch

TASK_LINKS = 1_000_000


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node but the least of its component, and that least node."""
    ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    parent = np.arange(len(ids))
    while True:
        before = parent.copy()
        least = np.minimum(parent[a], parent[b])
        np.minimum.at(parent, parent[a], least)
        np.minimum.at(parent, parent[b], least)
        parent = parent[parent]
        if (parent == before).all() and (parent[a] == parent[b]).all():
            break
    moved = np.flatnonzero(parent != np.arange(len(ids)))
    return ids[moved], ids[parent[moved]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        u, v = contract(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def components(edges: DataFrame, a: str, b: str, scratch: Scratch, name: str, task_links: int = TASK_LINKS) -> DataFrame:
    """id, root for every end of a link but the roots' own; root is the least id that it reaches. Loops and repeats are
    ignored."""
    now = scratch.write(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v"), f"{name}-0")
    n, seen, k = now.count(), None, 0
    while n:
        tasks = -(-n // task_links)
        k += 1
        now = scratch.write(now.coalesce(tasks).mapInArrow(_local, "u long, v long"), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        if tasks == 1:
            break
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(least, "u")
        small = met.select("u", F.col("m").alias("v")).union(met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        k += 1
        now = scratch.write(small, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        sign = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if sign == seen:
            break
        n, seen = sign[0], sign
    return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
