"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against every training window.

Words are maximal runs of letters, digits and non-ASCII characters after lower-casing A-Z. A window is 13
consecutive words of an item, or the whole item where it has fewer. Windows are looked up by a 64-bit hash and
each hit is verified byte by byte on the normalised words. One pass over the documents, no shuffle.

The windows are gathered on the driver in blocks of at most ``block_bytes`` of benchmark text (an item larger than
that is a block of its own), as arrays of some 40 bytes a word, which bounds the driver and every broadcast; a larger
benchmark takes one pass for each block, with the marks so far kept in a written table.

Defined results: a null or empty text, or one without words, has no words, no hits and is not contaminated. An
item without words has no window. Items of equal text are all reported. Repeated rows are judged one by one. An
empty benchmark marks nothing. Extra columns are kept unless they have the name of a result column. Texts of any
length are scanned whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazone.llm import frames, kernels, store

WINDOW = 13
BLOCK_BYTES = 8 << 20
_FILTER_BITS = 20


def _normalised(part: kernels.Texts, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes, a space after each, and where each word begins (n + 1)."""
    size = ends - starts + 1
    begin = np.concatenate([[0], np.cumsum(size)])
    out = part.buf[kernels.ragged(starts, size)]
    out[begin[1:] - 1] = 0x20
    return out, begin


def windows(items: list[tuple[int, str | None]], n: int = WINDOW) -> dict:
    """The items' normalised words; for each length of window: the sorted hashes, a place of each, and which items hold it."""
    raws = [(text or "").encode() for _, text in items]
    part = kernels.Texts(np.frombuffer(b"".join(raws), dtype=np.uint8), np.cumsum([0, *map(len, raws)]), lower=True)
    starts, ends, first = part.words(kernels.ALNUM)
    words, count = part.spans(starts, ends), np.diff(first)
    text, begin = _normalised(part, starts, ends)
    ids = np.array([k for k, _ in items], dtype=np.int64)
    out = {"text": text, "sizes": {}}
    for size in np.unique(np.minimum(count[count > 0], n)).tolist():
        own = np.flatnonzero(count >= n if size == n else count == size)
        at = kernels.ragged(first[own], count[own] - size + 1)
        h, item = kernels.grams(words, size)[at], np.repeat(ids[own], count[own] - size + 1)
        order = np.lexsort((item, h))
        h, item, at = h[order], item[order], at[order]
        # windows of one hash are split by their bytes where two texts have it
        new = np.concatenate([[True], h[1:] != h[:-1]])
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        if not _equal(text, begin[at], begin[at + size], text, begin[at[lead]], begin[at[lead] + size]).all():
            raise ValueError("two windows of the benchmark share a 64-bit hash")
        held = new | np.concatenate([[True], item[1:] != item[:-1]])
        group = np.cumsum(new)[held] - 1
        bits = np.zeros(1 << _FILTER_BITS, dtype=bool)
        bits[h[new] >> np.uint64(64 - _FILTER_BITS)] = True
        out["sizes"][size] = {"hash": h[new], "bits": bits, "a": begin[at[new]].astype(np.int32), "b": begin[at[new] + size].astype(np.int32), "first": np.searchsorted(group, np.arange(int(new.sum()) + 1)), "items": item[held]}
    return out


def _equal(x: np.ndarray, a: np.ndarray, b: np.ndarray, y: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Whether the bytes x[a:b] and y[c:d] are the same, pair by pair, some megabytes at once."""
    same = b - a == d - c
    left = np.flatnonzero(same)
    for part in np.array_split(left, max(1, int((b - a)[left].sum()) >> 22)):
        size = (b - a)[part]
        if len(part):
            ends = np.cumsum(size)
            same[part] = np.add.reduceat((x[kernels.ragged(a[part], size)] != y[kernels.ragged(c[part], size)]).astype(np.int32), ends - size) == 0
    return same


def scan(tables: dict, data: np.ndarray, off: np.ndarray) -> tuple[kernels.Texts, tuple, np.ndarray, list[set[int]]]:
    """The texts, their words, which words are hit, and each document's items."""
    part = kernels.Texts(data, off, lower=True)
    starts, ends, first = part.words(kernels.ALNUM)
    words, text = part.spans(starts, ends), None
    cover = np.zeros(len(starts) + 1, dtype=np.int64)
    items: list[set[int]] = [set() for _ in range(part.n)]
    for size, t in tables["sizes"].items():
        g = kernels.grams(words, size)
        at = np.flatnonzero(t["bits"][g >> np.uint64(64 - _FILTER_BITS)])
        row = np.searchsorted(t["hash"], g[at])
        row[row == len(t["hash"])] = 0
        same = t["hash"][row] == g[at]
        at, row = at[same], row[same]
        doc = np.searchsorted(first, at, side="right") - 1
        inside = at + size <= first[doc + 1]
        at, row, doc = at[inside], row[inside], doc[inside]
        if not len(at):
            continue
        if text is None:
            text, begin = _normalised(part, starts, ends)
        real = _equal(text, begin[at], begin[at + size], tables["text"], t["a"][row], t["b"][row])
        at, row, doc = at[real], row[real], doc[real]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + size, -1)
        for d, r in set(zip(doc.tolist(), row.tolist(), strict=True)):
            items[d].update(t["items"][t["first"][r] : t["first"][r + 1]].tolist())
    return part, (starts, ends, first), np.cumsum(cover)[:-1] > 0, items


def blocks(benchmark: DataFrame, item: str, text: str, most: int) -> list[DataFrame]:
    """Parts of the benchmark of about `most` bytes of text."""
    total = benchmark.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    n = total // most + 1
    keyed = benchmark.select(F.col(item).alias("item"), F.col(text).cast("string").alias("text"))
    return [keyed] if n == 1 else [keyed.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k) for k in range(n)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = WINDOW, keep: list[str] | None = None, spans: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The kept columns, n_words, n_hit, item_ids (sorted as strings) and contaminated; with spans, also clean_text.

    contaminated: at least one word in twenty is hit. clean_text is the text without the hit words, each run of
    them taken out from its first to its last byte.
    """
    spark = docs.sparkSession
    scratch = store.Scratch(spark, "decontam")
    made = ["n_words", "n_hit", "item_ids", "contaminated", *["clean_text"] * spans]
    own = {c: f"own{k}" for k, c in enumerate(docs.columns)}  # names that meet none of the marks'
    kept = {own[c]: c for c in (docs.columns if keep is None else keep) if c not in made}
    now, source = docs.toDF(*own.values()), own[text]
    parts = blocks(benchmark, item, item_text, block_bytes)
    for k, block in enumerate(parts):
        tables = spark.sparkContext.broadcast(windows([tuple(r) for r in block.collect()], n))
        last, before = k == len(parts) - 1, k > 0
        carried = [*kept] if last or source in kept else [*kept, source]  # later blocks read the text again
        now = _pass(now, tables, source, [*carried, *(["_hit", "_items"] if before else [])], last, spans)
        if not last:
            now = scratch.write(now, f"pass{k}")
            scratch.drop(f"pass{k - 1}")
    return now.toDF(*kept.values(), *made)


def _pass(docs: DataFrame, tables, text: str, keep: list[str], last: bool, spans: bool) -> DataFrame:
    """One block of windows. Marks of earlier blocks come as packed bits and lists of items."""
    before = "_hit" in keep
    carried = [c for c in keep if c not in ("_hit", "_items")]
    if before:
        docs = docs.withColumn("_text", F.concat_ws("\x00", F.base64("_hit"), F.concat_ws(",", F.col("_items").cast("array<string>")), F.coalesce(F.col(text), F.lit(""))))
        text = "_text"

    def setup() -> frames.Kernel:
        known = tables.value

        def kernel(data: np.ndarray, off: np.ndarray) -> dict:
            old_bits, old_items = [], []
            if before:
                import base64

                raws = []
                for a, b in zip(off[:-1], off[1:], strict=True):
                    bits, ids, raw = data[a:b].tobytes().split(b"\x00", 2)
                    old_bits.append(np.unpackbits(np.frombuffer(base64.b64decode(bits), dtype=np.uint8)))
                    old_items.append({int(x) for x in ids.split(b",") if x})
                    raws.append(raw)
                data, off = np.frombuffer(b"".join(raws), dtype=np.uint8), np.cumsum([0, *map(len, raws)])
            part, (starts, ends, first), hit, items = scan(known, data, off)
            for d, (bits, more) in enumerate(zip(old_bits, old_items, strict=True)):
                hit[first[d] : first[d + 1]] |= bits[: first[d + 1] - first[d]].astype(bool)
                items[d] |= more
            if not last:
                return {"_hit": [np.packbits(hit[first[d] : first[d + 1]]).tobytes() for d in range(part.n)], "_items": [sorted(x) for x in items]}
            total = np.concatenate([[0], np.cumsum(hit)])
            n_words, n_hit = np.diff(first), total[first[1:]] - total[first[:-1]]
            out = {"n_words": n_words, "n_hit": n_hit, "item_ids": [sorted(x, key=str) for x in items], "contaminated": (n_hit > 0) & (20 * n_hit >= n_words)}
            if spans:
                out["clean_text"] = []
                for d in range(part.n):
                    raw, at, pieces = data[off[d] : off[d + 1]].tobytes(), 0, []
                    a, b = kernels.runs(hit[first[d] : first[d + 1]])
                    for x, y in zip(starts[first[d] + a] - part.starts[d], ends[first[d] + b - 1] - part.starts[d], strict=True):
                        pieces.append(raw[at:x])
                        at = y
                    out["clean_text"].append(b"".join([*pieces, raw[at:]]).decode("utf-8", "replace"))
            return out

        return kernel

    fields = "_hit binary, _items array<long>" if not last else "n_words long, n_hit long, item_ids array<long>, contaminated boolean" + ", clean_text string" * spans
    return frames.enrich(docs, setup, fields, text=text, keep=carried)
