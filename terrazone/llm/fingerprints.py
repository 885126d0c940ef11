"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of seven bytes closes a chunk where its low k bits are zero, or fewer bits in a stretch where that does
not happen for long; each chunk adds one of 64 characters to the signature. A fingerprint is `k:signature at k:signature at k + 1`, k from the length in bytes, so that texts
within a factor of two in length have a block size in common. Likeness is one less the edit distance of two
signatures of a common block size over the longer one's length, 0 where they share no short run of characters.

A chunk that the text had before adds no further character, so a repeated passage takes up a signature once. Where
more than ``MOST`` chunks are left, those that end at the windows of least hash stay apart and the others join the
chunk after them: every byte counts and no part of the text is preferred.

Defined results: null counts as empty; two empty texts, like any two equal fingerprints, have likeness 1, an empty
and another text 0. Texts of any length are hashed whole. How often a chunk is repeated is not told.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from terrazone.llm import kernels, store

WINDOW = 7
#: Of a signature's runs of one character three count: repeated chunks say little.
_RUN = re.compile(r"([^:])\1{3,}")
MOST = 128
_PICK = np.uint64(0xA0761D6478BD642F)
#: A stretch is long from this many times the expected chunk.
WIDE = 4
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)
#: Rows of a bucket of the neighbour search, and the most buckets (their edges are gathered on the driver).
BUCKET_ROWS, MOST_BUCKETS = 2_000, 4_000


def _blocks(lens: np.ndarray) -> np.ndarray:
    """k: between 24 and 48 chunks are expected of a text with distinct windows."""
    return np.maximum(1, np.floor(np.log2(np.maximum(lens, 1) / 24))).astype(np.int64)


def fingerprints(data: np.ndarray, off: np.ndarray) -> list[str]:
    out: list[str] = []
    for lo, hi in kernels.slices(off):
        out += _slice(data, off[lo : hi + 1])
    return out


def _chunks(close: np.ndarray, first: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends and begins of all chunks; a text's last chunk ends with it."""
    ends = np.union1d(close + 1, first[1:][lens > 0])
    return ends, np.concatenate([[0], ends[:-1]])[: len(ends)]


def _signatures(chunk: np.ndarray, own: np.ndarray, window: np.ndarray, n: int) -> list[str]:
    """The characters of each text's chunks: their hashes, texts and the hashes of the windows that close them."""
    order = np.lexsort((chunk, own))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (chunk[order[1:]] != chunk[order[:-1]]) | (own[order[1:]] != own[order[:-1]])
    at = np.sort(order[new])  # the sort is stable: first occurrences
    chunk, own, window = chunk[at], own[at], window[at]
    edge = np.searchsorted(own, np.arange(n + 1))
    out = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        h = chunk[a:b]
        if len(h) > MOST:
            ends = np.sort(np.argsort(kernels.mix(window[a : b - 1] ^ _PICK), kind="stable")[: MOST - 1])
            h = kernels.mix(np.add.reduceat(h, np.concatenate([[0], ends + 1])))
        out.append(_ALPHABET[(h >> np.uint64(58)).astype(np.int64)].tobytes().decode())
    return out


def _slice(data: np.ndarray, off: np.ndarray) -> list[str]:
    part = kernels.Texts(data, off, gap=8)
    n, lens, k = part.n, part.lens, _blocks(part.lens)
    at = kernels.ragged(part.starts[:-1], lens)
    rolled = kernels.mix(part.wide()[at - WINDOW] >> np.uint64(8))  # the seven bytes that end at each position
    doc = np.repeat(np.arange(n), lens)
    first = np.concatenate([[0], np.cumsum(lens)])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(rolled * np.uint64(0x9E3779B97F4A7C15), dtype=np.uint64)])
    signs = []
    for level in (0, 1):
        low = ((np.int64(1) << (k + level)) - 1).astype(np.uint64)
        close = np.flatnonzero((rolled & np.repeat(low, lens)) == 0)
        ends, begins = _chunks(close, first, lens)
        # a long stretch without such a window (a text that repeats itself) closes at fewer zero bits, step by step;
        # that depends on the stretch alone, so it is cut alike in another text
        for fewer in range(1, int(k.max(initial=0)) + level):
            own = doc[ends - 1]
            wide = np.flatnonzero((ends - begins > WIDE << (k[own] + level)) & (fewer < k[own] + level))
            if not len(wide):
                break
            inside = kernels.ragged(begins[wide], ends[wide] - begins[wide])
            fits = ((np.int64(1) << np.maximum(k[doc[inside]] + level - fewer, 0)) - 1).astype(np.uint64)
            close = np.concatenate([close, inside[(rolled[inside] & fits) == 0]])
            ends, begins = _chunks(close, first, lens)
        signs.append(_signatures(kernels.mix(sums[ends] - sums[begins]), doc[ends - 1], rolled[ends - 1], n))
    out = []
    for d in range(n):
        out.append(f"{k[d]}:{signs[0][d]}:{signs[1][d]}")
    return out


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """Edit distances of pairs of strings, all pairs at once, row by row."""
    n = len(a)
    if not n:
        return np.zeros(0, dtype=np.int64)
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    w, h = int(lb.max()), int(la.max())
    left, right = np.zeros((n, h), np.uint8), np.zeros((n, w), np.uint8)
    for k in range(n):
        left[k, : la[k]] = np.frombuffer(a[k].encode(), np.uint8)
        right[k, : lb[k]] = np.frombuffer(b[k].encode(), np.uint8)
    col = np.arange(w + 1, dtype=np.int16)
    row = np.broadcast_to(col, (n, w + 1)).copy()
    out = np.where(la == 0, lb, 0)
    for i in range(h):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (right != left[:, i : i + 1]), out=new[:, 1:])
        row = np.minimum.accumulate(new - col, axis=1) + col  # insertions run along the row
        done = np.flatnonzero(la == i + 1)
        out[done] = row[done, lb[done]]
    return out


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """Likeness of pairs of fingerprints, 0 to 1."""
    out = np.zeros(len(a))
    pair, left, right = [], [], []
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        if x == y:
            out[k] = 1
            continue
        (i, s0, s1), (j, t0, t1) = (_RUN.sub(r"\1\1\1", z).split(":") for z in (x, y))
        gap = int(i) - int(j)
        tries = [(s0, t0), (s1, t1)] if gap == 0 else [(s0, t1)] if gap == 1 else [(s1, t0)] if gap == -1 else []
        for m, (s, t) in enumerate(tries):
            short = min(len(s), len(t))
            if not short or (m and short < 16):
                continue
            need = 4 if short >= 24 else 3 if short >= 12 else 2 if short >= 4 else 1
            if {s[q : q + need] for q in range(len(s) - need + 1)} & {t[q : q + need] for q in range(len(t) - need + 1)}:
                pair.append(k)
                left.append(s)
                right.append(t)
    order = np.argsort([len(x) for x in left], kind="stable") if left else []
    for lo in range(0, len(left), 512):
        rows = order[lo : lo + 512]
        s, t = [left[r] for r in rows], [right[r] for r in rows]
        like = 1 - distances(s, t) / np.maximum([len(x) for x in s], [len(x) for x in t])
        np.maximum.at(out, np.array(pair)[rows], like)
    return out


def fingerprint(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and fingerprint. One pass without a shuffle."""
    from terrazone.llm import frames

    return frames.enrich(docs, lambda: lambda data, off: {"fingerprint": fingerprints(data, off)}, "fingerprint string", text=text, keep=keep)


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Every row, its fingerprint, its text edited with the next row's, and their likenesses.

    Rows are ordered by descending key (nulls last), then by text; after the last comes the first. The edit replaces
    the last half of the code points by as many of the next text's first. One shuffle: rows go to buckets between
    quantiles of the key, each bucket also gets the first row of the following one, and is streamed in order. Rows
    are spread over buckets by the key's quantiles, so no range of keys is hot.

    Columns: the key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    spark = docs.sparkSession
    store.tune(spark)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    n = rows.count()
    buckets = int(min(MOST_BUCKETS, max(1, n // bucket_rows)))
    found = rows.agg(F.percentile_approx("k", [float((b + 1) / buckets) for b in range(buckets)], 100_000).alias("e"), F.max("k").alias("m")).first()
    edges = np.unique([*(found.e or []), *([found.m] if found.m is not None else [])]).astype(np.int64)
    heads = {int(e): b for b, e in enumerate(edges)}
    last = len(edges) - 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(0)
            ids = k.fill_null(-(2**63)).to_numpy(zero_copy_only=False)
            bucket = np.minimum(np.searchsorted(edges, ids), max(last, 0)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.zeros(len(ids), dtype=bool)), k, batch.column(1)], names=names)
            if last > 0:
                at = [i for i, x in enumerate(ids.tolist()) if x in heads and k[i].is_valid]
                if at:
                    more = batch.take(pa.array(at))
                    to = np.array([(heads[int(ids[i])] + 1) % (last + 1) for i in at], dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.ones(len(at), dtype=bool)), more.column(0), more.column(1)], names=names)

    names = ["bucket", "halo", "k", "t"]
    kinds = StructType([StructField("bucket", IntegerType()), StructField("halo", BooleanType()), StructField("k", rows.schema["k"].dataType), StructField("t", StringType())])
    dealt = rows.mapInArrow(deal, kinds)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 20_000))
    ordered = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "halo", F.desc_nulls_last("k"), "t")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[tuple[int | None, str]] = []  # rows of the bucket whose next row is not seen yet
        first: tuple | None = None
        now, closed = None, True
        for batch in batches:
            ks, ts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            pairs = []
            for bucket, halo, k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ks, ts, strict=True):
                if bucket != now:
                    if wait and not closed:
                        pairs.append((*wait[0], first[1]))
                    now, first, wait, closed = bucket, None, [], False
                if halo:
                    if wait:
                        pairs.append((*wait[0], t))
                    wait, closed = [], True
                    continue
                if wait:
                    pairs.append((*wait[0], t))
                first = first or (k, t)
                wait = [(k, t)]
            yield from made(pairs)
        if wait and not closed:
            yield from made([(*wait[0], first[1])])

    def made(pairs: list[tuple[int | None, str, str]]) -> Iterator[pa.RecordBatch]:
        lo = 0
        while lo < len(pairs):
            hi, size = lo, 0
            while hi < len(pairs) and (hi == lo or size < 4 * kernels.SLICE_BYTES):
                size += len(pairs[hi][1]) + len(pairs[hi][2])
                hi += 1
            yield judged(pairs[lo:hi])
            lo = hi

    def judged(pairs: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        edited = []
        for _, t, after in pairs:
            half = len(t) // 2
            edited.append(t[: len(t) - half] + after[:half])
        prints = []
        for texts in ([p[1] for p in pairs], edited, [p[2] for p in pairs]):
            raws = [x.encode() for x in texts]
            if len(prints) == 1:
                hashes = [hashlib.sha256(x).hexdigest() for x in raws]
            if len(prints) == 2:  # most next texts are the following row's own
                same = [i for i in range(len(pairs) - 1) if pairs[i][2] is pairs[i + 1][1]]
                known = dict(zip(same, (prints[0][i + 1] for i in same), strict=True))
                rest = [i for i in range(len(pairs)) if i not in known]
                known |= dict(zip(rest, of([raws[i] for i in rest]), strict=True))
                prints.append([known[i] for i in range(len(pairs))])
            else:
                prints.append(of(raws))
        return pa.RecordBatch.from_arrays([
            pa.array([p[0] for p in pairs], pa.int64()), pa.array([len(p[1]) for p in pairs], pa.int64()), pa.array(hashes, pa.string()), pa.array(prints[0], pa.string()), pa.array(prints[1], pa.string()),
            pa.array(likeness(prints[0], prints[1])), pa.array(likeness(prints[0], prints[2])),
        ], names=["k", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def of(raws: list[bytes]) -> list[str]:
        return fingerprints(np.frombuffer(b"".join(raws), dtype=np.uint8), np.cumsum([0, *map(len, raws)]))

    return ordered.mapInArrow(walk, "k long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("k", key)
