"""Suffix dedup: bytes covered by a string of `length` bytes that also starts elsewhere, in bounded memory and disk.

Two suffixes matter to each other only if they agree on `length` bytes, so suffixes are told apart that far:

1. Cover sample. D is a difference cover modulo v (a perfect one, v = q**2 + q + 1 with q + 1 members): for any two
   positions i and j some d < v brings both i + d and j + d into the sample, position modulo v taken in each text.
   The ranks (here: names) of the sample's suffixes to a depth of length - v + 1 bytes are worked out first, bucket by
   bucket of names. Equal strings of `length` bytes at i and j have a sample position with equal names within v bytes.
2. Suffixes with no repeated name within v bytes are therefore unique; only the rest are sorted.
3. Blockwise: the suffixes left are divided by an independent hash into ``PASSES`` suffix buckets and sorted one bucket
   at a time, so that disk holds one bucket's keys and a task a bounded part of it. A key is a hash of the whole
   `length` bytes: order among different strings has no use here, so long ties never need a second look.

A name that repeats within a task is known to repeat, is not asked about and sends one witness, so a passage that a
third of all texts share reaches its bucket once for each task. Texts are exchanged by chunk once, and those without
a suffix left are done then. Keys are 64 bits beside the bits of bucket and pass from a second hash.

Defined results: null counts as empty. Matches never cross texts and may overlap, also with themselves. Equal texts
of at least `length` bytes are removed whole, every one. Texts of any length are read whole; repeated rows count as
separate texts; null keys come back null; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazone.llm import kernels, store

LENGTH = 400
PASSES = 4
CHUNK_BYTES = 2 << 20
BUCKET_KEYS = 1_000_000
FLUSH = 1_000_000
_BLOCK = 1 << 20


@lru_cache
def cover(q: int) -> tuple[int, np.ndarray]:
    """v and a perfect difference cover modulo v (Singer): exponents of a cubic field's generator without a square term."""
    v = q * q + q + 1
    for code in range(q**3):
        a, b, c = code // q // q, code // q % q, code % q
        p, d = (1, 0, 0), []
        for i in range(v):
            if p[2] == 0:
                d.append(i)
            p = (-p[2] * c % q, (p[0] - p[2] * b) % q, (p[1] - p[2] * a) % q)
        if len(d) == q + 1 and len({(x - y) % v for x in d for y in d if x != y}) == v - 1:
            return v, np.array(d)
    raise ValueError("q must be a prime")


def cover_for(length: int) -> tuple[int, np.ndarray]:
    """The largest cover that leaves names at least as deep as v, so that few unrelated texts share one."""
    prime = [q for q in range(2, 100) if all(q % k for k in range(2, q)) and 2 * (q * q + q + 1) <= length]
    return cover(prime[-1]) if prime else (1, np.array([0]))


class Rolling:
    """Polynomial hashes modulo 2**64 of byte strings, through prefix sums of blocks."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(2**62, 2**63)) * 2 + 1
        self.base, self.back = np.uint64(base), np.uint64(pow(base, -1, 2**64))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            for name, base in (("up", self.base), ("down", self.back)):
                p = np.full(n, base, dtype=np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def hash(self, body: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        """Of the strings of one length at ascending starts."""
        out = np.empty(len(starts), dtype=np.uint64)
        self.powers(min(len(body), _BLOCK + length) + 1)
        lo = 0
        while lo < len(starts):
            at = int(starts[lo])
            hi = int(np.searchsorted(starts, at + _BLOCK))
            part = body[at : at + _BLOCK + length]
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(self.table[part] * self.up[: len(part)], out=sums[1:])
            s = starts[lo:hi] - at
            out[lo:hi] = kernels.mix((sums[s + length] - sums[s]) * self.down[s])
            lo = hi
        return out


_FIRST, _SECOND = Rolling(11), Rolling(29)


def _samples(off: np.ndarray, length: int, v: int, d: np.ndarray, depth: int) -> np.ndarray:
    """Sample positions, in texts that can hold a string of `length` bytes."""
    parts = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if b - a >= length:
            p = (np.arange(0, b - a, v)[:, None] + d).ravel()
            parts.append(p[p + depth <= b - a] + a)
    return np.concatenate([*parts, np.zeros(0, np.int64)])


class Mail:
    """Keys on their way to their buckets: rows (bucket, kind, keys, chunks), one for each bucket and kind."""

    ASK, WITNESS, KNOWN = 0, 1, 2
    SCHEMA = "bucket int, kind int, keys binary, chunks binary"

    def __init__(self, buckets: int, told: bool):
        self.buckets, self.told = buckets, told
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, key: np.ndarray, chunk: np.ndarray, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((key, chunk.astype(np.int32), bucket.astype(np.int32)))
        self.size += len(key)
        if self.size >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        key, chunk, bucket = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        order = np.argsort(key)
        key, chunk, bucket = key[order], chunk[order], bucket[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(key))) > 1
        single = np.zeros(len(key), dtype=bool)
        single[first[~many]] = True
        sent = [(self.ASK, key[single], chunk[single], bucket[single])]
        wit = first[many]
        sent.append((self.WITNESS, key[wit], np.full(len(wit), -1, np.int32), bucket[wit]))
        if self.told:  # who holds a repeated key must hear of it; any bucket may pass it on
            sent.append((self.KNOWN, key[~single], chunk[~single], chunk[~single] % self.buckets))
        rows = {"bucket": [], "kind": [], "keys": [], "chunks": []}
        for kind, k, c, b in sent:
            if not len(k):
                continue
            order = np.lexsort((c, b))
            k, c, b = k[order], c[order], b[order]
            edge = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            for lo, hi in zip(edge, np.append(edge[1:], len(b)), strict=True):
                rows["bucket"].append(int(b[lo]))
                rows["kind"].append(kind)
                rows["keys"].append(k[lo:hi].tobytes())
                rows["chunks"].append(c[lo:hi].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(rows["bucket"], pa.int32()), pa.array(rows["kind"], pa.int32()), pa.array(rows["keys"], pa.binary()), pa.array(rows["chunks"], pa.binary())], names=list(rows))


def _answers(mail: DataFrame, repeated: bool) -> DataFrame:
    """chunk, keys: of the keys that it asked about those that repeat, or those that don't."""

    def run(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        keys = [np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()]
        chunks = [np.frombuffer(x, np.int32) for x in table["chunks"].to_pylist()]
        live = [k for k in range(len(kind)) if kind[k] != Mail.KNOWN]
        key = np.concatenate([*(keys[k] for k in live), np.zeros(0, np.uint64)])
        chunk = np.concatenate([*(chunks[k] for k in live), np.zeros(0, np.int32)])
        order = np.argsort(key)
        key, chunk = key[order], chunk[order]
        same = np.zeros(len(key), dtype=bool)
        same[1:] = key[1:] == key[:-1]
        same[:-1] |= same[1:]
        want = (same if repeated else ~same) & (chunk >= 0)
        key, chunk = key[want], chunk[want]
        if repeated:
            key = np.concatenate([key, *(keys[k] for k in range(len(kind)) if kind[k] == Mail.KNOWN)])
            chunk = np.concatenate([chunk, *(chunks[k] for k in range(len(kind)) if kind[k] == Mail.KNOWN)])
        order = np.argsort(chunk, kind="stable")
        key, chunk = key[order], chunk[order]
        edge = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])) if len(key) else np.zeros(0, np.int64)
        ends = np.append(edge[1:], len(key))
        return pa.table({"chunk": pa.array(chunk[edge], pa.int32()), "keys": pa.array([key[a:b].tobytes() for a, b in zip(edge, ends, strict=True)] if len(key) else [], pa.binary())})

    return mail.groupBy("bucket").applyInArrow(run, "chunk int, keys binary")


def _known(table: pa.Table) -> np.ndarray:
    return np.sort(np.concatenate([*(np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()), np.zeros(0, np.uint64)]))


def _within(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), dtype=bool)
    at = np.searchsorted(known, x)
    at[at == len(known)] = 0
    return known[at] == x


_HELD = "key long, n_bytes long, kept string, chunk int, has binary, keys binary, lens binary, body binary, begins binary, ends binary"


def _suffixes(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return kernels.ragged(begins, ends - begins)


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, passes: int = PASSES, chunk_bytes: int = CHUNK_BYTES, bucket_keys: int = BUCKET_KEYS, with_text: bool = False) -> DataFrame:
    """For each row: the key, n_bytes, n_removed, n_spans and kept_sha256; with_text, also `kept`, the bytes left."""
    spark = docs.sparkSession
    store.tune(spark)
    scratch = store.Scratch(spark, "suffix")
    v, d = cover_for(length)
    depth = length - v + 1
    raw = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    sized = docs.select(F.col(key).cast("long").alias("k"), raw.alias("b"))
    total = sized.agg(F.sum(F.octet_length("b"))).first()[0] or 0
    chunks = max(1, -(-total // chunk_bytes))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, -(-total * len(d) // v // bucket_keys))
    rows = sized.withColumn("chunk", F.pmod(F.xxhash64("k", "b"), F.lit(chunks)).cast("int"))

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mail = Mail(buckets, told=True)
        for batch in batches:
            data, off = kernels.flat(batch.column(0))
            chunk = batch.column(1).to_numpy()
            for lo, hi in kernels.slices(off):
                own = off[lo : hi + 1] - off[lo]
                at = _samples(own, length, v, d, depth)
                h = _FIRST.hash(data[off[lo] : off[hi]], at, depth)
                of = np.searchsorted(own, at, side="right") - 1
                yield from mail.add(h, chunk[lo:hi][of], (h >> np.uint64(40)) % np.uint64(buckets))
        yield from mail.flush()

    ranked = scratch.write(_answers(rows.where(F.octet_length("b") >= length).select("b", "chunk").mapInArrow(names, Mail.SCHEMA), True), "names")
    store.release(spark)

    def sift(table: pa.Table, answers: pa.Table) -> pa.Table:
        """Texts without a suffix left are done; the others are held with the runs of their suffixes to sort."""
        known = _known(answers)
        keys = table["k"].combine_chunks()
        data, off = kernels.flat(table["b"])
        out = {n: [] for n in ("key", "n_bytes", "kept", "body")}
        held, begins, ends = [], [], []
        base = 0
        for lo, hi in kernels.slices(off):
            own = off[lo : hi + 1] - off[lo]
            body = data[off[lo] : off[hi]]
            at = _samples(own, length, v, d, depth)
            at = at[_within(_FIRST.hash(body, at, depth), known)]
            of = np.searchsorted(own, at, side="right") - 1
            a, b = np.maximum(at - v + 1, own[of]), np.minimum(at + 1, own[of + 1] - length + 1)
            some = np.zeros(hi - lo, dtype=bool)
            some[of[a < b]] = True
            edge = np.zeros(len(body) + 1, dtype=np.int32)
            np.add.at(edge, a[a < b], 1)
            np.add.at(edge, b[a < b], -1)
            flag = np.cumsum(edge) > 0
            # runs of two texts never touch: a text's last suffixes are shorter than `length`
            x, y = kernels.runs(flag)
            for k in np.flatnonzero(~some).tolist():
                out["key"].append(keys[lo + k].as_py())
                out["n_bytes"].append(int(own[k + 1] - own[k]))
                rest = body[own[k] : own[k + 1]].tobytes()
                out["kept"].append(hashlib.sha256(rest).hexdigest())
                out["body"].append(rest if with_text else None)
            lens = np.diff(own)
            shift = own[:-1] - (np.cumsum(np.where(some, lens, 0)) - np.where(some, lens, 0))  # bytes of done texts before
            of = np.searchsorted(own, x, side="right") - 1
            begins.append(x - shift[of] + base)
            ends.append(y - shift[of] + base)
            held += [lo + k for k in np.flatnonzero(some).tolist()]
            base += int(lens[some].sum())
        n = len(out["key"])
        more = int(bool(held))
        pick = keys.take(pa.array(held, pa.int64()))
        body = b"".join([data[off[k] : off[k + 1]].tobytes() for k in held])
        one = lambda x: pa.array([None] * n + [x] * more, pa.binary())
        return pa.table({
            "key": pa.array(out["key"] + [None] * more, pa.int64()), "n_bytes": pa.array(out["n_bytes"] + [None] * more, pa.int64()), "kept": pa.array(out["kept"] + [None] * more, pa.string()),
            "chunk": pa.array([None] * n + [table["chunk"][0].as_py() if len(table) else None] * more, pa.int32()), "has": one(np.asarray(pick.is_valid().to_numpy(zero_copy_only=False)).tobytes()),
            "keys": one(pick.fill_null(0).to_numpy(zero_copy_only=False).tobytes()), "lens": one(np.diff(off)[held].astype(np.int64).tobytes()), "body": pa.array(out["body"] + [body] * more, pa.binary()),
            "begins": one(np.concatenate([*begins, np.zeros(0, np.int64)]).astype(np.int64).tobytes()), "ends": one(np.concatenate([*ends, np.zeros(0, np.int64)]).astype(np.int64).tobytes()),
        })

    sifted = scratch.write(rows.groupBy("chunk").cogroup(ranked.groupBy("chunk")).applyInArrow(sift, _HELD), "sifted")
    scratch.drop("names")
    store.release(spark)
    held = sifted.where("chunk is not null").select("chunk", "has", "keys", "lens", "body", "begins", "ends")
    left = held.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    buckets3 = max(parts, -(-left // passes // bucket_keys))
    alone = None
    for turn in range(passes):

        def suffixes(batches: Iterator[pa.RecordBatch], turn: int = turn) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    mail = Mail(buckets3, told=False)
                    body = np.frombuffer(r["body"], np.uint8)
                    begins, ends = np.frombuffer(r["begins"], np.int64), np.frombuffer(r["ends"], np.int64)
                    at = _suffixes(begins, ends)
                    second = _SECOND.hash(body, at, length)
                    at, second = at[second % np.uint64(passes) == turn], second[second % np.uint64(passes) == turn]
                    mail.held = [(_FIRST.hash(body, at, length), np.full(len(at), r["chunk"], np.int32), ((second >> np.uint64(24)) % np.uint64(buckets3)).astype(np.int32))]
                    mail.size = len(at)
                    yield from mail.flush()

        found = _answers(held.select("chunk", "body", "begins", "ends").mapInArrow(suffixes, Mail.SCHEMA), False)
        found = scratch.write(found, f"alone{turn}")
        alone = found if alone is None else alone.union(found)
        store.release(spark)

    fields = "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        unique = _known(answers)
        out = {n: [] for n in ("key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for r in table.to_pylist():
            body, lens = np.frombuffer(r["body"], np.uint8), np.frombuffer(r["lens"], np.int64)
            at = _suffixes(np.frombuffer(r["begins"], np.int64), np.frombuffer(r["ends"], np.int64))
            at = at[~_within(_FIRST.hash(body, at, length), unique)]
            edge = np.zeros(len(body) + 1, dtype=np.int32)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + length, -1)
            gone = np.cumsum(edge)[:-1] > 0
            off = np.cumsum([0, *lens])
            has, keys = np.frombuffer(r["has"], bool), np.frombuffer(r["keys"], np.int64)
            for k in range(len(lens)):
                own = gone[off[k] : off[k + 1]]
                rest = body[off[k] : off[k + 1]][~own].tobytes()
                out["key"].append(int(keys[k]) if has[k] else None)
                out["n_bytes"].append(int(lens[k]))
                out["n_removed"].append(int(own.sum()))
                out["n_spans"].append(len(kernels.runs(own)[0]))
                out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
                out["kept"].append(rest)
        kinds = {"kept_sha256": pa.string(), "kept": pa.binary()}
        return pa.table({n: pa.array(x, kinds.get(n, pa.int64())) for n, x in out.items() if with_text or n != "kept"})

    changed = held.groupBy("chunk").cogroup(alone.groupBy("chunk")).applyInArrow(cut, fields)
    zero = F.lit(0).cast("long")
    done = sifted.where("chunk is null").select("key", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("kept").alias("kept_sha256"), *([F.col("body").alias("kept")] if with_text else []))
    return changed.union(done).withColumnRenamed("key", key)
