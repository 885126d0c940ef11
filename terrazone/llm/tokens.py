"""Token ids of whole texts in a binary format of bit or byte planes, and back.

Encoding: documents go to range partitions by key and are streamed in order. A pre-token's ids do not depend on its
neighbours in byte-level BPE, so each worker keeps a bounded table of the pre-tokens that it has met and asks the
tokenizer for new ones only; texts with characters whose class needs the tokenizer's own tables go to it whole.

Format (written and read by Spark, so it works on any store): one row for each chunk of whole documents, with its
shard (the number of its range partition), its number in it, the ids before it in the shard, the keys and lengths of
its documents, and `planes`. Ids are cut into blocks of ``BLOCK`` ids; a block's ids are transposed into byte planes (or
bit planes), as many as the largest id of the chunk needs, and the blocks of each plane are compressed with
zstandard as one frame each. `index` holds the same rows without planes: where every document starts, readable
without touching a plane.

Defined results: null text counts as empty and is the end id alone. Order is by key, nulls first, then by text;
repeated rows are kept. Extra columns are not stored. Texts of any length are encoded whole, a chunk never splits one.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrazone.llm import kernels, store

BLOCK = 65_536
CHUNK_IDS = 1 << 20
LEVEL = 3
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, dtype=np.int8)
_CLASS[[0x09, 0x0A, 0x0D, 0x20]] = _SPACE
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = _LETTER
#: Bytes of texts that are split here: printable ASCII, tab and line ends, and letters from U+00C0 to U+024F.
_ODD = np.array([b < 0x20 and b not in (0x09, 0x0A, 0x0D) or b == 0x7F or b in (0xC0, 0xC1, 0xC2) or b > 0xC8 for b in range(256)])
_TAILS = {b"s", b"t", b"m", b"d", b"re", b"ve", b"ll"}


def split(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of plain texts: optional space and a run of letters, digits or others, runs of
    space less their last character before text, English contractions."""
    n = int(off[-1])
    kind = _CLASS[buf[:n]]
    fresh = np.zeros(n + 1, dtype=bool)
    fresh[off] = True  # document starts, and the end
    run = fresh.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(run)
    begin, end = at[:-1], at[1:]
    space = kind[begin] == _SPACE
    mark = run.copy()
    # a run of space before text gives up its last character
    inner = space & ~fresh[end]
    mark[end[inner] - 1] = True
    glued = end[inner & (buf[end - 1] == 0x20)]
    mark[glued] = False
    # contractions
    quote = np.flatnonzero((buf[begin] == 0x27) & (end - begin == 1) & ~fresh[end])
    for q in quote.tolist():
        p = int(begin[q])
        if (p and not fresh[p] and buf[p - 1] == 0x20) or kind[p + 1] != _LETTER:
            continue
        stop = int(end[q + 1])
        for m in (1, 2):
            if p + 1 + m <= stop and buf[p + 1 : p + 1 + m].tobytes() in _TAILS:
                mark[p + 1] = False
                mark[p + 1 + m] = True
                break
    at = np.flatnonzero(mark)
    return at[:-1], at[1:]


class Encoder:
    """A tokenizer with a bounded table of the ids of pre-tokens."""

    SLOTS, MOST = 1 << 20, 600_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.width = np.uint16 if max(vocab.values()) < 65_536 else np.uint32
        self.opens = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, k in vocab.items():
            self.opens[k] = token.startswith("Ġ")
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(self.SLOTS, dtype=np.uint64)
        self.head = np.zeros(self.SLOTS, dtype=np.uint64)
        self.first = np.zeros(self.SLOTS, dtype=np.uint32)
        self.count = np.zeros(self.SLOTS, dtype=np.uint32)
        self.pool = np.zeros(1 << 20, dtype=self.width)
        self.used = self.held = 0

    def find(self, h: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Slots of known pre-tokens, -1 of others. Hash and first eight bytes must agree."""
        out = np.full(len(h), -1, dtype=np.int64)
        live = np.arange(len(h))
        slot = (h & np.uint64(self.SLOTS - 1)).astype(np.int64)
        while len(live):
            k = self.key[slot]
            same = (k == h[live]) & (self.head[slot] == head[live])
            out[live[same]] = slot[same]
            on = ~same & (k != 0)
            live, slot = live[on], (slot[on] + 1) & (self.SLOTS - 1)
        return out

    def add(self, h: np.ndarray, head: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> None:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        first = self.used + np.cumsum(lens) - lens
        self.used += len(ids)
        self.held += len(h)
        live = np.arange(len(h))
        slot = (h & np.uint64(self.SLOTS - 1)).astype(np.int64)
        while len(live):
            free = self.key[slot] == 0
            self.key[slot[free]] = h[live[free]]  # of several, the last stays
            mine = free & (self.key[slot] == h[live])
            self.head[slot[mine]], self.first[slot[mine]], self.count[slot[mine]] = head[live[mine]], first[live[mine]], lens[live[mine]]
            live, slot = live[~mine], (slot[~mine] + 1) & (self.SLOTS - 1)

    def learn(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, head: np.ndarray) -> None:
        """Pre-tokens of a space and letters are encoded as one text, in which each opens with a space; others singly."""
        kind = _CLASS[buf[np.minimum(starts + 1, len(buf) - 1)]]
        many = (buf[starts] == 0x20) & (kind == _LETTER)
        raw = buf.tobytes()
        for part in np.array_split(np.flatnonzero(many), max(1, many.sum() // 20_000)):
            text = b"".join([raw[a:b] for a, b in zip(starts[part].tolist(), ends[part].tolist(), strict=True)]).decode()
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids if len(part) else [], dtype=self.width)
            open_ = np.flatnonzero(self.opens[ids])
            assert len(open_) == len(part)
            self.add(h[part], head[part], ids, np.diff(np.append(open_, len(ids))))
        rest = np.flatnonzero(~many)
        if len(rest):
            found = [e.ids for e in self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)], add_special_tokens=False)]
            self.add(h[rest], head[rest], np.array([x for y in found for x in y], dtype=self.width), np.array(list(map(len, found))))

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some documents one after another, and each one's first (n + 1)."""
        n = len(off) - 1
        body = data[off[0] : off[-1]]
        buf = np.concatenate([body, np.zeros(8, dtype=np.uint8)])
        base = off - off[0]
        bad = np.concatenate([[0], np.cumsum(_ODD[body] | ((body == 0xC3) & ((buf[1 : len(body) + 1] == 0x97) | (buf[1 : len(body) + 1] == 0xB7))))])
        odd = bad[base[1:]] > bad[base[:-1]]
        raw = body.tobytes()
        for s in self.special:
            if s in raw:
                odd |= np.array([s in raw[a:b] for a, b in zip(base[:-1], base[1:], strict=True)])
        if self.held > self.MOST:
            self.clear()
        pieces: list[np.ndarray] = [np.zeros(0, self.width)] * n
        plain = np.flatnonzero(~odd)
        if len(plain):
            lens = np.diff(base)[plain]
            if odd.any():
                buf = np.concatenate([body[kernels.ragged(base[plain], lens)], np.zeros(8, dtype=np.uint8)])
            own = np.cumsum([0, *lens])
            starts, ends = split(buf, own)
            wide = np.ndarray(shape=(len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
            h = kernels.spans(wide, starts, ends) | np.uint64(1)
            u, where, back = np.unique(h, return_index=True, return_inverse=True)
            head = wide[starts[where]] & kernels._LOW[np.minimum(ends[where] - starts[where], 8)]
            slot = self.find(u, head)
            new = np.flatnonzero(slot < 0)
            if len(new):
                self.learn(buf, starts[where[new]], ends[where[new]], u[new], head[new])
                slot = self.find(u, head)
            at = slot[back]
            count = self.count[at].astype(np.int64)
            ids = self.pool[kernels.ragged(self.first[at].astype(np.int64), count)]
            upto = np.concatenate([[0], np.cumsum(count)])
            cut = upto[np.searchsorted(starts, own)]
            if not odd.any():
                return ids, cut
            for k, d in enumerate(plain):
                pieces[d] = ids[cut[k] : cut[k + 1]]
        for d in np.flatnonzero(odd):
            pieces[d] = np.array(self.tokenizer.encode(raw[base[d] : base[d + 1]].decode(), add_special_tokens=False).ids, dtype=self.width)
        return np.concatenate([*pieces, np.zeros(0, self.width)]), np.cumsum([0, *map(len, pieces)])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pack(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Compressed planes of a chunk: for each plane, the number of blocks, their sizes, and their frames."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=LEVEL)
    top = int(ids.max(initial=0))
    planes = max(1, top.bit_length() if bits else (top.bit_length() + 7) // 8)
    out: list[list[bytes]] = [[] for _ in range(planes)]
    for lo in range(0, len(ids), BLOCK):
        octets = ids[lo : lo + BLOCK].astype("<u4").view(np.uint8).reshape(-1, 4)
        rows = np.unpackbits(octets, axis=1, bitorder="little", count=planes).T if bits else octets.T[:planes]
        for k in range(planes):
            out[k].append(squeeze.compress(np.packbits(rows[k]).tobytes() if bits else rows[k].tobytes()))
    return [np.array([len(x), *map(len, x)], dtype="<u4").tobytes() + b"".join(x) for x in out]


def unpack(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    import zstandard

    expand = zstandard.ZstdDecompressor()
    out = np.zeros(n, dtype=np.uint32)
    for k, raw in enumerate(planes):
        blocks = int(np.frombuffer(raw[:4], "<u4")[0])
        at = 4 + 4 * blocks
        for b, size in enumerate(np.frombuffer(raw[4:at], "<u4").tolist()):
            m = min(BLOCK, n - b * BLOCK)
            row = np.frombuffer(expand.decompress(raw[at : at + size]), dtype=np.uint8)
            out[b * BLOCK : b * BLOCK + m] |= (np.unpackbits(row, count=m) if bits else row).astype(np.uint32) << np.uint32(k if bits else 8 * k)
            at += size
    return out


_CHUNK = "shard int, chunk int, n_docs long, n_ids long, before long, keys binary, has_key binary, lens binary, planes array<binary>"


def write(docs: DataFrame, path: str, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int = 2, bits: bool = False, partitions: int | None = None) -> None:
    """Writes `path`/chunks and `path`/index. vocabulary: the tokenizer's file, at the same place on every machine."""
    spark = docs.sparkSession
    store.tune(spark)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    rows = rows.repartitionByRange(parts, F.asc_nulls_first("k")).sortWithinPartitions(F.asc_nulls_first("k"), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard = encoder(vocabulary), TaskContext.get().partitionId()
        held, keys, lens, chunk, before = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            ids, size = np.concatenate(held), np.concatenate(lens)
            ks = pa.concat_arrays(keys)
            has = np.asarray(ks.is_valid().to_numpy(zero_copy_only=False))
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([chunk], pa.int32()), pa.array([len(size)]), pa.array([len(ids)]), pa.array([before]),
                pa.array([ks.fill_null(0).to_numpy(zero_copy_only=False).tobytes()], pa.binary()), pa.array([np.packbits(has).tobytes()], pa.binary()),
                pa.array([size.astype("<u4").tobytes()], pa.binary()), pa.array([pack(ids, bits)], pa.list_(pa.binary())),
            ], names=["shard", "chunk", "n_docs", "n_ids", "before", "keys", "has_key", "lens", "planes"])

        size = 0
        for batch in batches:
            data, off = kernels.flat(batch.column(1))
            for lo, hi in kernels.slices(off):
                ids, first = own.encode(data, off[lo : hi + 1])
                held.append(np.insert(ids, first[1:], end_id))
                keys.append(batch.column(0).slice(lo, hi - lo))
                lens.append(np.diff(first) + 1)
                size += len(held[-1])
                if size >= CHUNK_IDS:
                    yield flush()
                    held, keys, lens, chunk, before, size = [], [], [], chunk + 1, before + size, 0
        if held:
            yield flush()

    rows.mapInArrow(run, _CHUNK).write.mode("overwrite").option("compression", "uncompressed").parquet(f"{path}/chunks")
    made = spark.read.schema(_CHUNK).parquet(f"{path}/chunks")
    made.select("shard", "chunk", "n_docs", "n_ids", "before", "keys", "has_key", "lens").write.mode("overwrite").parquet(f"{path}/index")


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """shard, start: the ids before each shard. As many rows as range partitions, so small enough to broadcast."""
    index = spark.read.schema(_CHUNK).parquet(f"{path}/index").groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return index.select("shard", F.coalesce(before, F.lit(0)).alias("start"))


def read(spark: SparkSession, path: str, key: str = "doc_id", bits: bool = False, with_ids: bool = False) -> DataFrame:
    """For each document: the key, start, n_tokens, ids_crc32 and, if asked for, its ids."""
    chunks = spark.read.schema(_CHUNK).parquet(f"{path}/chunks").join(F.broadcast(shard_starts(spark, path)), "shard")
    fields = "k long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, size = unpack(r["planes"], r["n_ids"], bits), np.frombuffer(r["lens"], "<u4").astype(np.int64)
                has = np.unpackbits(np.frombuffer(r["has_key"], np.uint8), count=len(size)).astype(bool)
                ends = np.cumsum(size)
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * (e - m) : 4 * e]) for e, m in zip(ends.tolist(), size.tolist(), strict=True)]
                columns = [pa.array(np.frombuffer(r["keys"], np.int64), mask=~has), pa.array(r["start"] + r["before"] + ends - size), pa.array(size), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["k", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    held = chunks.select("n_ids", "before", "keys", "has_key", "lens", "planes", "start")
    return held.mapInArrow(run, fields).withColumnRenamed("k", key)
