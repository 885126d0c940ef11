"""Shards of near equal bytes by histogram sort, with DataFrame operations alone.

Rows are ordered by (hash of the text, key), so equal texts are neighbours and no order of arrival matters. The
15 splitters of 16 shards are found by counting: each round sums the exact bytes (and rows) of the bins between
probes inside every interval that still holds a splitter, over a written table of sizes, and the bin in which the
target falls becomes the next interval. It ends where the target is met within the tolerance or the bin holds one
hash; a group of equal texts that a target cuts is refined on the key in the same way. The rows are then exchanged
once.

A round brings at most ``PROBES`` sums for each open splitter to the driver, however many rows there are. A hot
text is no hot key: its rows are split by key. Only rows equal in text and key stay together.

A row's slot is its rank in (hash, key) inside its shard, at every size. Rows are counted by cell (a hash; a text of
more than a block's rows is cut by ranges of its keys), the counts are summed up inside blocks of the leading bits of
the hash and then over the at most ``CELLS`` blocks, and each cell numbers its own rows.

Defined results: the law is `bytes`; a row's size is its text's UTF-8 bytes (null: none) plus 1; with tolerance 0 each
splitter is the cut nearest to its target. Null keys come first. An empty table gives no rows. Extra
columns are kept unless they have the name of a result column.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrazone.llm import store

SHARDS = 16
PROBES = 4096
HASH_BITS = 60
#: Rows from which on a text's rows are numbered by several tasks, and least rows of a block of cells.
BLOCK_ROWS = 1_000
#: Bound of the texts of more rows than a block, and half of that of the blocks.
CELLS = 8192
_ABSENT = -(2**63)


def hash60(c: Column) -> Column:
    """The first 60 bits of the MD5 sum as a long."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 15), 16, 10).cast("long")


def _sized(docs: DataFrame, key: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.withColumns({"_h": hash60(t), "_k": F.coalesce(F.col(key).cast("long"), F.lit(_ABSENT)), "size": F.octet_length(t).cast("long") + 1})


def _bin(at: str, low: int, step: int, wide: bool) -> Column:
    if wide:  # the difference may not fit a long
        return F.floor((F.col(at).cast("decimal(20,0)") - F.lit(Decimal(low))) / F.lit(Decimal(step))).cast("long")
    return F.floor((F.col(at) - F.lit(low)) / F.lit(step)).cast("long") if step > 1 else F.col(at) - F.lit(low)


def _refine(rows: DataFrame, at: str, low: int, high: int, targets: dict[int, int], by: int, slack: float) -> dict[int, tuple[int, int, int]]:
    """For each target, the least value v of `at` so that the sizes of the rows below v, times `by`, reach the target.

    Returns v, the sum below it and 0; or, where the target falls among rows of one value, that value, the sum below
    it and the sum of those rows.
    """
    open_, done = {j: (low, high, 0) for j in targets}, {}
    while open_:
        case, some, starts = F.lit(None), F.lit(False), {}
        for lo, hi in sorted({(a, b) for a, b, _ in open_.values()}):
            step = -(-(hi - lo + 1) // PROBES)
            wide = hi - lo >= 2**52 or abs(lo) >= 2**62
            inside = F.col(at).between(lo, hi)
            case = F.when(inside, F.struct(F.lit(len(starts)).alias("part"), _bin(at, lo, step, wide).alias("bin"))).otherwise(case)
            some = some | inside
            starts[lo, hi] = len(starts)
        found = rows.where(some).groupBy(case.alias("b")).agg(F.sum("size").alias("s"), F.min(at).alias("first"), F.max(at).alias("last")).collect()
        bins: dict[int, list] = {}
        for r in sorted(found, key=lambda r: r["first"]):
            bins.setdefault(r.b.part, []).append((r.s, r["first"], r["last"]))
        for j, (lo, hi, below) in list(open_.items()):
            want, after = targets[j], True
            for s, first, last in bins.get(starts[lo, hi], []):
                if below * by >= want or (below and abs(below * by - want) <= slack * by):
                    done[j], after = (first, below, 0), False
                elif (below + s) * by >= want:
                    if first == last:
                        done[j] = (first, below, s)
                    else:
                        open_[j] = (first, last, below)
                    after = False
                if not after:
                    break
                below += s
            if after:
                done[j] = (hi + 1, below, 0)
            if j in done:
                del open_[j]
    return done


def splitters(rows: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """For each shard but the first, the least (hash, key) of its rows."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    slack = tolerance * total / shards
    found = _refine(rows, "_h", 0, (1 << HASH_BITS) - 1, {j: j * total for j in range(1, shards)}, shards, slack)
    out = {j: (h, _ABSENT) for j, (h, _, inside) in found.items() if not inside}
    groups: dict[int, list[int]] = {}
    for j, (h, _, inside) in found.items():
        if inside:
            groups.setdefault(h, []).append(j)
    for h, cut in groups.items():  # rows of one hash: cut them by key
        own, below = rows.where(F.col("_h") == h), found[cut[0]][1]
        ends = own.agg(F.min("_k").alias("a"), F.max("_k").alias("b")).first()
        wants = {j: j * total - below * shards for j in cut}
        for j, (k, under, inside) in _refine(own, "_k", ends.a, ends.b, wants, shards, slack).items():
            k += wants[j] - under * shards > (under + inside) * shards - wants[j]  # before or after these rows, whichever is nearer
            out[j] = (h, k) if k < 2**63 else (h + 1, _ABSENT)
    return [out[j] for j in range(1, shards)]


def shard(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", tolerance: float = 0.0, block_rows: int = BLOCK_ROWS, keep: list[str] | None = None) -> DataFrame:
    """The kept columns, size, text_crc32, law, shard, slot (0, 1, ... in each shard) and grown_shard (null)."""
    spark = docs.sparkSession
    scratch = store.Scratch(spark, "shards")
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    own = {c: f"own{k}" for k, c in enumerate(docs.columns)}  # names that meet none of the plan's
    sized = _sized(docs.toDF(*own.values()), own[key], own[text])
    sizes = scratch.write(sized.select("_h", "_k", "size"), "sizes")
    cuts = splitters(sizes, shards, tolerance)
    number = F.lit(0)
    for h, k in cuts:
        number = number + F.when((F.col("_h") > h) | ((F.col("_h") == h) & (F.col("_k") >= k)), 1).otherwise(0)
    n = sizes.count()
    per = max(block_rows, -(-n // CELLS))
    # texts of more than `per` rows: fewer than CELLS, so the broadcast has a bound at every size
    known = F.when(F.col("_k") != _ABSENT, F.col("_k"))
    hot = sizes.groupBy("_h").agg(F.count("*").alias("n"), F.min(known).alias("a"), F.max(known).alias("b")).where(F.col("n") > per)
    long = "decimal(20,0)"  # a difference of two keys may not fit a long
    hot = hot.select("_h", F.col("a").cast(long).alias("_a"), F.ceil((F.col("b").cast(long) - F.col("a").cast(long) + 1) / F.ceil(F.col("n") / per)).cast(long).alias("_w"))
    hot = scratch.write(hot, "hot")
    cell = F.when(F.col("_a").isNull(), 0).when(F.col("_k") == _ABSENT, -1).otherwise(F.floor((F.col("_k").cast(long) - F.col("_a")) / F.col("_w"))).cast("long")
    cells = sizes.join(F.broadcast(hot), "_h", "left").groupBy("_h", cell.alias("_c")).agg(F.count("*").alias("n"))
    block = F.shiftright("_h", HASH_BITS - (n // per).bit_length()).cast("int")
    cells = scratch.write(cells.withColumn("block", block), "cells")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = cells.groupBy("block").agg(F.sum("n").alias("n")).select("block", before(Window.orderBy("block")).alias("base"))
    starts = cells.withColumn("start", before(Window.partitionBy("block").orderBy("_h", "_c"))).join(F.broadcast(bases), "block")
    starts = starts.select("_h", "_c", (F.col("base") + F.col("start")).alias("start"))
    counts = {r[0]: r[1] for r in sizes.groupBy(number.alias("shard")).agg(F.count("*")).collect()}
    below = F.element_at(F.array(*[F.lit(sum(counts.get(i, 0) for i in range(j))).cast("long") for j in range(shards)]), F.col("shard") + 1)
    t = F.coalesce(F.col(own[text]).cast("string"), F.lit(""))
    kept = {c: own[c] for c in (docs.columns if keep is None else keep) if c not in made}
    rows = sized.select(*kept.values(), "_h", "_k", "size", F.crc32(t.cast("binary")).alias("text_crc32"), number.cast("int").alias("shard"))
    rows = rows.join(F.broadcast(hot), "_h", "left").withColumn("_c", cell)
    within = F.row_number().over(Window.partitionBy("_h", "_c").orderBy("_k")) - 1
    placed = rows.withColumn("_n", within).join(starts, ["_h", "_c"])
    slot = (F.col("start") + F.col("_n") - below).cast("long")
    return placed.select(*[F.col(o).alias(c) for c, o in kept.items()], "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
