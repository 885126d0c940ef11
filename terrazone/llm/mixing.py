"""Mixing sources by temperature, with DataFrame operations alone.

A source's weight is its share of all tokens to the power alpha, normalised. alpha is the largest exponent in [0, 1]
whose weights have the wanted entropy (a part of the entropy of equal weights), unless a source would then be read
more than ``repeats`` times: then the smallest that keeps to the limit. It is bracketed in a hundred sections a
round; each round is one aggregate over the sources.

A source's budget is its weight's part of all tokens to draw. Whole epochs take every document; the rest is drawn
from a permutation of blocks of documents (by hash), and inside the block where the budget ends from a permutation
of its documents. Both cuts are thresholds of a hash, one row for each source, so the documents themselves are
selected where they are read and never shuffled. Sums over a hot source are combined before they are shuffled; a
window sees the sums of at most 4,096 bins of its blocks, and then the blocks of the one bin where the budget ends.

Defined results: tokens are runs without ASCII white space. A null source is a source of its own. A source without
tokens has weight 0 and no uses. Rows equal in key and source are drawn together. An empty table gives no rows.
Extra columns are kept unless they have the name of a result column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrazone.llm import store
from terrazone.llm.sharding import HASH_BITS, hash60

ENTROPY = 0.95
REPEATS = 2.0
BLOCK_DOCS = 1000
SECTIONS, ROUNDS = 100, 6
#: Bins of the order of a source's blocks that are summed up first.
BIN_BITS = 12


def tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def exponent(sources: DataFrame, budget: int, total: int, entropy: float, repeats: float) -> float:
    """alpha, from a table with a row for each source and its share."""
    known = sources.where("share > 0")
    first = known.agg(F.count("*").alias("n"), F.min("share").alias("least")).first()
    if first.n <= 1:
        return 1.0
    want = entropy * math.log(first.n)

    def sums(exponents: list[float]) -> list[tuple[float, float]]:
        # the exponents are one array, so that every round runs the same compiled code
        at = known.select("share", F.posexplode(F.array(*map(F.lit, exponents))).alias("i", "a"))
        rows = at.groupBy("i").agg(F.sum(F.pow("share", "a")).alias("z"), F.sum(F.pow("share", "a") * F.log("share")).alias("y")).collect()
        return [(r.z, r.y) for r in sorted(rows, key=lambda r: r.i)]

    def good(a: float, z: float, y: float) -> tuple[bool, bool]:
        """Enough entropy; not too many repeats."""
        return math.log(z) - a * y / z >= want, budget / total * first.least ** (a - 1) / z <= repeats

    low, width = 0.0, 1.0
    for k in range(ROUNDS):  # the last section edge with enough entropy, which falls with alpha
        edges = [low + width * i / SECTIONS for i in range(SECTIONS + 1)]
        fit = [i for i, (a, (z, y)) in enumerate(zip(edges, sums(edges), strict=True)) if good(a, z, y)[0]]
        if not fit:
            break
        if fit[-1] == SECTIONS and k == 0:
            return 1.0
        low, width = edges[fit[-1]], width / SECTIONS
    z, y = sums([low])[0]
    if good(low, z, y)[1]:
        return low
    high, width = low, 1.0 - low  # the first edge within the limit, which repeats fall towards
    for _ in range(ROUNDS):
        edges = [high + width * i / SECTIONS for i in range(SECTIONS + 1)]
        fit = [i for i, (a, (z, y)) in enumerate(zip(edges, sums(edges), strict=True)) if good(a, z, y)[1]]
        if not fit:
            return 1.0
        if fit[0] == 0:
            return high
        high, width = edges[fit[0] - 1], width / SECTIONS
    return high + width


def plan(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", budget: int | None = None, entropy: float = ENTROPY, repeats: float = REPEATS, block_docs: int = BLOCK_DOCS, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """A row for each source with its weight and cuts; and the documents with the columns that the cuts are applied to."""
    spark = docs.sparkSession
    scratch = store.Scratch(spark, "mixing")
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-"))
    marked = docs.withColumns({"_source": name, "n_tokens": tokens(F.col(text)), "_id": F.coalesce(F.col(key).cast("string"), F.lit(""))})
    slim = scratch.write(marked.select("_source", "n_tokens", "_id"), "slim")
    sources = slim.groupBy("_source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    drawn = total if budget is None else budget
    shares = scratch.write(sources.withColumn("share", F.col("tokens") / F.lit(max(1, total))), "shares")
    alpha = exponent(shares, drawn, max(1, total), entropy, repeats) if total else 1.0
    z = shares.where("share > 0").agg(F.sum(F.pow("share", F.lit(alpha)))).first()[0] or 1.0
    weight = F.when(F.col("share") > 0, F.pow("share", F.lit(alpha)) / z).otherwise(0.0)
    quota = F.floor(weight * drawn + 1e-6)
    shares = shares.withColumns({"weight": weight, "quota": quota}).withColumns({
        "epochs": F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.greatest(F.col("tokens"), F.lit(1)))).otherwise(0),
        "blocks": F.ceil(F.col("n") / block_docs).cast("long"),
    }).withColumn("rest", F.col("quota") - F.col("epochs") * F.col("tokens"))

    def hashed(df: DataFrame) -> DataFrame:
        block = F.pmod(hash60(F.concat_ws("|", F.lit(f"block{seed}"), "_id")), F.col("blocks"))
        df = df.withColumn("_b", block)
        return df.withColumns({"_u": hash60(F.concat_ws("|", F.lit(f"order{seed}"), "_source", F.col("_b").cast("string"))), "_v": hash60(F.concat_ws("|", F.lit(f"inner{seed}"), "_id"))})

    known = shares.select("_source", "blocks", "rest")
    by_block = hashed(slim.join(known, "_source")).groupBy("_source", "_u").agg(F.sum("n_tokens").alias("s"), F.first("rest").alias("rest"))
    # in two steps, so that no task orders all blocks of a source: sums of bins of the order first, then the bin with the edge
    by_block = scratch.write(by_block.withColumn("bin", F.shiftright("_u", HASH_BITS - BIN_BITS).cast("int")), "blocks")
    so_far = lambda order: F.sum("s").over(Window.partitionBy("_source").orderBy(order))
    bins = by_block.groupBy("_source", "bin").agg(F.sum("s").alias("s"), F.first("rest").alias("rest")).withColumn("sum", so_far("bin"))
    bins = bins.where("sum > rest").groupBy("_source").agg(F.min_by(F.struct("bin", (F.col("sum") - F.col("s")).alias("before")), "bin").alias("b")).select("_source", "b.*")
    inside = by_block.join(bins, ["_source", "bin"]).withColumn("sum", F.col("before") + so_far("_u"))
    edge = inside.where("sum > rest").groupBy("_source").agg(F.min_by(F.struct("_u", (F.col("rest") - F.col("sum") + F.col("s")).alias("left")), "_u").alias("e")).select("_source", F.col("e._u").alias("edge_u"), F.col("e.left").alias("left"))
    cut = known.join(edge, "_source")
    inner = hashed(slim.join(cut, "_source")).where("_u = edge_u")
    upto = inner.withColumn("sum", F.sum("n_tokens").over(Window.partitionBy("_source").orderBy("_v"))).where("sum <= left").groupBy("_source").agg(F.max("_v").alias("edge_v"))
    # without an edge the rest is all of the source, that is nothing or no tokens
    cuts = shares.join(edge.drop("left"), "_source", "left").join(upto, "_source", "left").select("_source", "share", "weight", "epochs", "blocks", "tokens", F.coalesce("edge_u", F.lit(-1)).alias("edge_u"), F.coalesce("edge_v", F.lit(-1)).alias("edge_v"))
    cuts = scratch.write(cuts.withColumn("alpha", F.lit(alpha)), "cuts")
    uses = F.col("epochs") + F.when((F.col("_u") < F.col("edge_u")) | ((F.col("_u") == F.col("edge_u")) & (F.col("_v") <= F.col("edge_v"))), 1).otherwise(0)
    chosen = hashed(marked.join(cuts, "_source")).withColumn("n_uses", F.when(F.col("tokens") > 0, uses).otherwise(0).cast("int"))
    return cuts, chosen


def _chosen(docs: DataFrame, key: str, source: str, text: str, how: dict) -> tuple[DataFrame, dict[str, str]]:
    """The documents with their cuts applied, their own columns under names that meet no other."""
    own = {c: f"own{k}" for k, c in enumerate(docs.columns)}
    return plan(docs.toDF(*own.values()), own[key], own[source], own[text], **how)[1], own


def uses(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", keep: list[str] | None = None, **how) -> DataFrame:
    """Each row's kept columns, n_tokens, weight (of its source), block_order and n_uses."""
    rows, own = _chosen(docs, key, source, text, how)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_tokens", "weight", "block_order", "n_uses")]
    return rows.select(*[F.col(own[c]).alias(c) for c in keep], "n_tokens", "weight", F.col("_u").alias("block_order"), "n_uses")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """The documents, each as often as it is used and not at all if that is never; columns as in docs."""
    rows, own = _chosen(docs, key, source, text, how)
    rows = rows.where("n_uses > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(1), F.col("n_uses"))))
    return rows.select(*[F.col(o).alias(c) for c, o in own.items()])
