"""Near-duplicate documents: MinHash with tensored banding, links confirmed on full shingle sets.

Two collections of ``ATOMS`` small hashes (each of ``DEPTH`` minhashes) are drawn; the key of table (i, j) joins atom i
of the first with atom j of the second. 2 * ATOMS * DEPTH minhashes thus feed ATOMS**2 tables of 2 * DEPTH minhashes.
Two sets of likeness s meet in a table unless either collection agrees nowhere: with 12 atoms of 3, a pair at 0.8 is
missed with a probability of about 4e-4, at 0.9 of about 3e-7; at 0.03, as unrelated texts here, it meets with 1e-7.

Nodes are distinct shingle sets, so exact copies are one node from the start, and a hot text is combined before any
shuffle. Keys travel as packed arrays, one row for each map task and bucket of keys; of many nodes of a task that share
a key one goes to the bucket, so that a bucket holds a bounded part of a hot key.

Candidates of a key are verified in two rounds, and a pair whose ends are already connected is not verified again,
which cannot change a component:
1. in small groups (up to ``SMALL`` nodes) all pairs, in larger ones a star;
2. in larger groups that still hold several components, everything outside the largest against everything, in
   blocks of texts inside which the sets are intersected.
So no candidate link between different texts is lost, while the rows made stay near the number of texts.

Defined results: words are runs without ASCII white space, lower-cased A-Z; a text of fewer than n words is one
shingle; null, empty and blank texts have no shingle, are linked with nothing and kept. Components take the smallest
key; null keys count as smaller than all others and come back as null. Repeated rows are members of one component.
Extra columns are ignored by `near_duplicates`. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazone.llm import frames, kernels, store
from terrazone.llm.components import components

WORDS = 5
PERCENT = 80
ATOMS, DEPTH = 12, 3
SMALL = 3
#: Texts of a block of nodes outside a cluster's largest component, and of all its nodes.
MINOR_BLOCK, MAJOR_BLOCK = 256, 512
#: Keys of a bucket, and keys that a task holds before it sends them.
BUCKET_KEYS, SENT_KEYS = 1_000_000, 500_000
MEMBERS = 64
#: Nodes of a task with one key from which on a hub goes to the bucket for them; tasks over which the nodes of such a key are
#: dealt at most, and nodes of a piece for each of those, so that their number follows that of the nodes.
PIECE, SALTS, SPREAD = 32, 256, 4
_ABSENT = -(2**63)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, one text after another, and each text's first (n + 1)."""
    part = kernels.Texts(data, off, lower=True)
    starts, ends, first = part.words(kernels.NOT_SPACE)
    words, count = part.spans(starts, ends), np.diff(first)
    runs = kernels.grams(words, n)
    sets = []
    for d in range(part.n):
        if count[d] >= n:
            sets.append(np.unique(runs[first[d] : first[d + 1] - n + 1]))
        elif count[d]:
            sets.append(kernels.grams(words[first[d] : first[d + 1]], int(count[d])))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return np.concatenate([*sets, np.zeros(0, np.uint64)]), np.cumsum([0, *map(len, sets)])


def _seeds(atoms: int, depth: int) -> np.ndarray:
    rng = np.random.default_rng(20_240_607)
    return rng.integers(0, 2**64 - 1, size=(2 * atoms * depth, 2), dtype=np.uint64)


def sketch(data: np.ndarray, off: np.ndarray, n: int, atoms: int, depth: int) -> dict:
    """n_shingles, a fingerprint of the set, and the atoms as packed 64-bit integers."""
    x, first = shingles(data, off, n)
    size = np.diff(first)
    f = np.zeros(len(size), dtype=np.uint64)
    some = np.flatnonzero(size)
    out = np.zeros((len(size), 2 * atoms), dtype=np.uint64)
    if len(some):
        at = first[some]
        f[some] = kernels.mix(np.add.reduceat(kernels.mix(x + _PRIME), at) ^ (np.add.reduceat(kernels.mix(x ^ _PRIME), at) * _PRIME))
        seeds = _seeds(atoms, depth)
        for k in range(2 * atoms):
            h = np.full(len(some), k, dtype=np.uint64)
            for a, b in seeds[k * depth : (k + 1) * depth]:
                least = np.minimum.reduceat((((x ^ b) * (a | np.uint64(1))) >> np.uint64(32)).astype(np.uint32), at)
                h = kernels.mix(h * _PRIME + least)
            out[some, k] = h
    width = 16 * atoms
    raw = out.tobytes()
    return {"n_shingles": size, "f": f.view(np.int64), "atoms": [raw[d * width : (d + 1) * width] if size[d] else b"" for d in range(len(size))]}


def _keys(nodes: DataFrame, atoms: int, buckets: int) -> DataFrame:
    """bucket, keys, ids, piece, hubs: the table keys of all nodes, packed for each task and bucket.

    Where more than PIECE nodes of a task share a key, only one of them, marked as a hub, goes to the key's bucket. The
    nodes themselves are a piece, a row of its own that any bucket may pass on: a hot key fills no bucket.
    """

    def packed(key: np.ndarray, node: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(key, kind="stable")
        key, node, bucket = key[order], node[order], bucket[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        alone, hub = np.ones(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
        pieces = []
        for a, m in zip(first[size > PIECE].tolist(), size[size > PIECE].tolist(), strict=True):
            own = node[a : a + m]
            lead = _hub(own[None, :])[0]
            alone[a : a + m], alone[a + lead], hub[a + lead] = False, True, True
            # a task's pieces with the same hub go to one bucket, which makes their pairs once
            pieces.append((int(kernels.mix(own[lead : lead + 1].view(np.uint64))[0] % np.uint64(buckets)), key[a : a + 1].tobytes(), own.tobytes()))
        key, node, bucket, hub = key[alone], node[alone], bucket[alone], hub[alone]
        order = np.argsort(bucket, kind="stable")
        key, node, bucket, hub = key[order], node[order], bucket[order], hub[order]
        full = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        cut = lambda x: [x[i:j].tobytes() for i, j in zip(full, np.append(full[1:], len(bucket)), strict=True)]
        rows = [bucket[full].tolist() + [p[0] for p in pieces], cut(key) + [p[1] for p in pieces], cut(node) + [p[2] for p in pieces], [False] * len(full) + [True] * len(pieces), cut(hub) + [None] * len(pieces)]
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(rows, (pa.int32(), pa.binary(), pa.binary(), pa.bool_(), pa.binary()), strict=True)], names=["bucket", "keys", "ids", "piece", "hubs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            data, off = kernels.flat(batch.column(1))
            m = batch.num_rows
            if not m:
                continue
            table = np.frombuffer(data[off[0] : off[-1]].tobytes(), dtype=np.uint64).reshape(m, 2 * atoms)
            node = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(atoms):
                key = kernels.mix(table[:, i : i + 1] * _PRIME + table[:, atoms:] + np.arange(i * atoms, (i + 1) * atoms, dtype=np.uint64)[None, :])
                # all tables of an atom of the first collection share a bucket, so that a pair that meets in several is made once
                bucket = (kernels.mix(table[:, i] + np.uint64(i)) % np.uint64(buckets)).astype(np.int32)
                held.append((key.ravel(), np.repeat(node, atoms), np.repeat(bucket, atoms)))
            size += m * atoms * atoms
            if size > SENT_KEYS:
                yield packed(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size = [], 0
        if held:
            yield packed(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return nodes.select("f", "atoms").mapInArrow(run, "bucket int, keys binary, ids binary, piece boolean, hubs binary")


def _hub(members: np.ndarray) -> np.ndarray:
    """Of each row the member that comes first in an order that all keys share, so that hubs are few."""
    return kernels.mix(members.view(np.uint64)).argmin(axis=1)


def _groups(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys that several nodes share, their nodes one after another, each key's first (n + 1), and whether one is a hub."""
    key, node, hub = (np.concatenate([np.frombuffer(x, kind) for x in table[c].to_pylist()] or [np.zeros(0, kind)]) for c, kind in (("keys", np.uint64), ("ids", np.int64), ("hubs", np.bool_)))
    order = np.argsort(key, kind="stable")
    key, node, hub = key[order], node[order], hub[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(key)))
    many = size > 1
    hot = np.logical_or.reduceat(hub, first)[many] if len(first) else np.zeros(0, bool)
    return key[first[many]], node[kernels.ragged(first[many], size[many])], np.cumsum([0, *size[many]]), hot


def _candidates(keyed: DataFrame, small: int) -> DataFrame:
    """Rows of two kinds: pairs (a < b), and larger groups (key, ids), of which several may have the same key."""

    def run(table: pa.Table) -> pa.Table:
        piece = table["piece"].to_numpy(zero_copy_only=False).astype(bool)
        key, node, first, hot = _groups(table.filter(pa.array(~piece)))
        size = np.diff(first)
        left, right = [], []

        def star(members: np.ndarray) -> None:
            left.append(np.repeat(members[np.arange(len(members)), _hub(members)], members.shape[1]))
            right.append(members.ravel())

        for s in np.unique(size):
            rows = np.flatnonzero(size == s)
            members = node[first[rows][:, None] + np.arange(s)]
            if s <= small:
                i, j = np.triu_indices(s, 1)
                left.append(members[:, i].ravel())
                right.append(members[:, j].ravel())
            else:
                star(members)
        passed = table.filter(pa.array(piece))
        groups = [(int(np.frombuffer(k, np.int64)[0]), x) for k, x in zip(passed["keys"].to_pylist(), passed["ids"].to_pylist(), strict=True)]
        for _, x in groups:
            star(np.frombuffer(x, np.int64)[None, :])
        # a hub stands for its piece, so what it meets is set against the piece's nodes as well
        groups += [(int(key[g : g + 1].view(np.int64)[0]), node[first[g] : first[g + 1]].tobytes()) for g in np.flatnonzero((size > small) | hot).tolist()]
        a, b = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (left, right))
        a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        none = len(new)
        return pa.table({
            "a": pa.array(np.concatenate([a[new], np.array([k for k, _ in groups], dtype=np.int64)])), "b": pa.array(np.concatenate([b[new], np.zeros(len(groups), np.int64)])),
            "ids": pa.array([None] * none + [x for _, x in groups], pa.binary()),
        })

    return keyed.groupBy("bucket").applyInArrow(run, "a long, b long, ids binary")


def _verify(pairs: DataFrame, texts: DataFrame, n: int, percent: int, parts: int) -> DataFrame:
    """The pairs (hub, node) whose sets are alike enough. Each node's text is sent once for a pair, a hub's once for
    MEMBERS pairs; pairs of one hub are spread by salt."""
    degree = pairs.groupBy("hub").agg(F.count("*").alias("d"))
    salted = pairs.join(degree, "hub").withColumn("salt", F.pmod(F.xxhash64("node"), F.ceil(F.col("d") / MEMBERS)))
    members = salted.select("hub", "salt", F.col("node").alias("f"))
    hubs = salted.select("hub", "salt").distinct().select("hub", "salt", F.col("hub").alias("f"))
    rows = members.union(hubs).join(texts, "f").select("hub", "salt", "f", "text")
    dealt = rows.repartition(parts, "hub", "salt").sortWithinPartitions("hub", "salt", (F.col("f") != F.col("hub")).cast("int"), "f")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mine = None, None
        for batch in batches:
            hub, f = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            data, off = kernels.flat(batch.column(3))
            left, right = [], []
            for lo, hi in kernels.slices(off):
                x, first = shingles(data, off[lo : hi + 1], n)
                for k in range(lo, hi):
                    own = x[first[k - lo] : first[k - lo + 1]]
                    if f[k] == hub[k]:
                        now, mine = hub[k], own.copy()
                        continue
                    assert now == hub[k], "a hub's text comes before its nodes'"
                    if 100 * min(len(own), len(mine)) < percent * max(len(own), len(mine)):
                        continue
                    at = np.searchsorted(mine, own)
                    at[at == len(mine)] = 0
                    both = int((mine[at] == own).sum())
                    if 100 * both >= percent * (len(own) + len(mine) - both):
                        left.append(hub[k])
                        right.append(f[k])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["hub", "node"])

    return dealt.mapInArrow(run, "hub long, node long")


def _across(groups: DataFrame, labels: DataFrame, texts: DataFrame, n: int, percent: int, parts: int, scratch: store.Scratch) -> DataFrame:
    """Links across the components of the groups that still hold several: one for each node and component it reaches.

    Components that meet in a group form a cluster. In each, the nodes outside its largest component are set against
    all its nodes, block by block: a text is sent once for each block that it meets, not once for each pair.
    """
    members = groups.select(F.col("a").alias("key"), "ids").mapInArrow(_unpack, "key long, f long, salts int")
    named = members.join(labels, members.f == labels.id, "left").select("key", "f", "salts", F.coalesce("root", "f").alias("root"))
    mixed = named.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.max("salts").alias("salts")).where("x <> y")
    mixed = mixed.select("key", "x", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    salted = named.withColumn("salt", F.pmod(F.xxhash64("f"), F.col("salts")).cast("int"))  # the nodes of a large group go to many tasks
    held = scratch.write(salted.join(mixed, ["key", "salt"]).select("x", "root", "f").distinct(), "mixed")
    met = components(held.select("x", "root").distinct(), "x", "root", scratch, "cc-mixed").select(F.col("id").alias("root"), F.col("root").alias("cluster"))
    nodes = held.select("root", "f").distinct().join(met, "root", "left").select(F.coalesce("cluster", "root").alias("cluster"), "root", "f")
    sizes = nodes.groupBy("cluster", "root").agg(F.count("*").alias("m"))
    shape = sizes.groupBy("cluster").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.sum("m").alias("all"), F.max("m").alias("most"))
    shape = shape.withColumns({"rows": F.ceil((F.col("all") - F.col("most")) / MINOR_BLOCK).cast("int"), "columns": F.ceil(F.col("all") / MAJOR_BLOCK).cast("int")})
    placed = nodes.join(shape, "cluster")
    spread = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
    row, column = F.pmod(F.xxhash64("f"), F.col("rows")).cast("int"), F.pmod(F.xxhash64("f", F.lit(1)), F.col("columns")).cast("int")
    minor = placed.where("root <> main").select("cluster", row.alias("r"), F.explode(spread("columns")).alias("c"), F.lit(1).alias("minor"), "root", "f")
    major = placed.select("cluster", F.explode(spread("rows")).alias("r"), column.alias("c"), F.lit(0).alias("minor"), "root", "f")
    dealt = minor.union(major).join(texts, "f").select("cluster", "r", "c", "minor", "root", "f", "text").repartition(parts, "cluster", "r", "c").sortWithinPartitions("cluster", "r", "c")

    def judge(block: list[tuple[int, int, int, np.ndarray]]) -> Iterator[tuple[int, int]]:
        asked, known = [x for x in block if x[0]], [x for x in block if not x[0]]
        if not asked or not known:
            return
        size, root = np.array([len(x[3]) for x in known]), np.array([x[1] for x in known])
        shingle, owner = np.concatenate([x[3] for x in known]), np.repeat(np.arange(len(known)), size)
        order = np.argsort(shingle, kind="stable")
        shingle, owner = shingle[order], owner[order]
        for _, mine, f, own in asked:
            lo, hi = np.searchsorted(shingle, own), np.searchsorted(shingle, own, side="right")
            both = np.bincount(owner[kernels.ragged(lo, hi - lo)], minlength=len(known))
            good = np.flatnonzero((100 * both >= percent * (size + len(own) - both)) & (root != mine))
            for k in np.unique(root[good], return_index=True)[1]:
                yield f, known[good[k]][2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            data, off = kernels.flat(batch.column(6))
            links = []
            for lo, hi in kernels.slices(off):
                x, first = shingles(data, off[lo : hi + 1], n)
                for k in range(lo, hi):
                    place = (columns[0][k], columns[1][k], columns[2][k])
                    if place != now:
                        links += judge(block)
                        now, block = place, []
                    block.append((columns[3][k], columns[4][k], columns[5][k], x[first[k - lo] : first[k - lo + 1]].copy()))
            yield made(links)
        yield made(list(judge(block)))

    def made(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["hub", "node"])

    return dealt.mapInArrow(run, "hub long, node long")


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            f = np.frombuffer(ids, np.int64)
            salts = np.full(len(f), min(SALTS, -(-len(f) // SPREAD)) if len(f) > PIECE else 1, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), key)), pa.array(f), pa.array(salts)], names=["key", "f", "salts"])


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS, percent: int = PERCENT, atoms: int = ATOMS, depth: int = DEPTH, small: int = SMALL) -> DataFrame:
    """For each row: the key, n_shingles, component_id and kept."""
    spark = docs.sparkSession
    scratch = store.Scratch(spark, "minhash")
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_ABSENT)).alias("k"), F.col(text).cast("string").alias("text"))
    sketches = frames.enrich(rows, lambda: lambda data, off: sketch(data, off, n, atoms, depth), "n_shingles long, f long, atoms binary", keep=["k"])
    sketches = scratch.write(sketches, "sketches")
    nodes = sketches.where("n_shingles > 0").groupBy("f").agg(F.min("k").alias("k"), F.first("atoms").alias("atoms"))
    nodes = scratch.write(nodes, "nodes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, -(-nodes.count() * atoms * atoms // BUCKET_KEYS))
    found = scratch.write(_candidates(_keys(nodes, atoms, buckets), small), "found")
    pairs = scratch.write(found.where("ids is null").select("a", "b").distinct(), "pairs")
    groups = found.where("ids is not null").select("a", "ids")

    # one text for each node of a pair; nodes of larger groups are in its star
    ends = pairs.select(F.col("a").alias("f")).union(pairs.select(F.col("b").alias("f"))).distinct().join(nodes.select("f", "k"), "f")
    held = frames.enrich(ends.join(rows, "k"), lambda: lambda data, off: {"g": sketch(data, off, n, 0, 0)["f"]}, "g long", keep=["f", "text"])
    texts = scratch.write(held.where("f = g").groupBy("f").agg(F.first("text").alias("text")), "texts")

    links = scratch.write(_verify(pairs.select(F.col("a").alias("hub"), F.col("b").alias("node")), texts, n, percent, parts), "links1")
    labels = components(links, "hub", "node", scratch, "cc1")
    if not groups.isEmpty():
        more = scratch.write(_across(groups, labels, texts, n, percent, parts, scratch), "links2")
        if not more.isEmpty():
            labels = components(links.union(more), "hub", "node", scratch, "cc2")

    scratch.drop("found", "pairs", "texts", "links1", "links2", "mixed")  # the result reads the others

    named = nodes.select("f", "k").join(labels.withColumnRenamed("id", "f"), "f", "left").select("f", "k", F.coalesce("root", "f").alias("root"))
    least = named.groupBy("root").agg(F.min("k").alias("c"))
    classes = named.join(least, "root").select("f", "c")
    out = sketches.select("k", "n_shingles", "f").join(classes, "f", "left").withColumn("c", F.when(F.col("n_shingles") > 0, F.col("c")).otherwise(F.col("k")))
    real = [F.when(F.col(c) != _ABSENT, F.col(c)) for c in ("k", "c")]
    return out.select(real[0].alias(key), "n_shingles", real[1].alias("component_id"), (F.col("k") == F.col("c")).alias("kept"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents that are kept, one of each component; rows that share a key stay or go together."""
    own = {c: f"own{k}" for k, c in enumerate(docs.columns)}  # names that meet none of the result's
    rows = docs.toDF(*own.values())
    kept = near_duplicates(rows, own[key], own[text], **how).where("kept").select(F.col(own[key]).alias("kept_key"))
    return rows.join(kept, F.col(own[key]).eqNullSafe(F.col("kept_key")), "left_semi").toDF(*docs.columns)
