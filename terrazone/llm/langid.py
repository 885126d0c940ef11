"""Language identification by language-bitmask n-gram filters.

Every byte n-gram (3 and 5 bytes of lower-cased text, everything but letters turned into one space) that makes up
at least ``share`` of a language's n-grams is put into one bit-sliced Bloom filter: each of its positions holds a
mask with a bit for each language, so that one look-up, the AND of ``HASHES`` positions, returns all languages
that hold the n-gram. A document's popcounts for each language, corrected for that language's false-positive
rate, decide; ties go to the language with more training n-grams, then by name.

The share bounds the filter: at most 1 / share n-grams for each language and n, whatever the corpus. Counts cover
all training documents and are combined on the executors before they are shuffled.

Defined results: null text, empty text and text without a letter are `und` with score 0. Without training
documents everything is `und`. Text with letters but no known n-gram gets the largest language with score 0.
Repeated rows count as often as they occur. Extra columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazone.llm import frames, kernels, store

SIZES = (3, 5)
SHARE = 1e-5
HASHES = 3
BITS_PER_GRAM = 12
_LETTER = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
_PLAIN = np.where(_LETTER, kernels.LOWER, np.uint8(0x20))
_FLUSH = 2_000_000


def ngrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams as integers tagged by n, and the index of each document's first (n + 1 entries)."""
    part = kernels.Texts(data, off, gap=8)
    buf = _PLAIN[part.buf]
    keep = np.ones(len(buf), dtype=bool)
    keep[1:] = (buf[1:] != 0x20) | (buf[:-1] != 0x20)  # one space for any run of others
    buf = np.concatenate([buf[keep], np.full(8, 0x20, dtype=np.uint8)])
    ends = np.cumsum(keep)[part.starts - 1]  # kept bytes up to the gap before each document
    wide = np.ndarray(shape=(len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    out, lens = [], []
    for size in SIZES:
        at = np.arange(0, ends[-1] - size + 1)
        value = (wide[at] & np.uint64((1 << (8 * size)) - 1)) | np.uint64(size << 56)
        # starts from the space before the document's first letter to the one after its last
        doc = np.searchsorted(ends - 1, at, side="right") - 1
        inside = at + size <= ends[np.minimum(doc + 1, part.n)]
        out.append(value[inside])
        lens.append(doc[inside])
    doc = np.concatenate(lens)
    order = np.argsort(doc, kind="stable")
    return np.concatenate(out)[order], np.searchsorted(doc[order], np.arange(part.n + 1))


def count(training: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, gram, n of all training documents."""
    store.tune(training.sparkSession)
    rows = training.select(F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            g, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return g, np.bincount(back, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                g, n = merged(parts)
                for k in range(0, len(g), 100_000):
                    m = len(g[k : k + 100_000])
                    yield pa.RecordBatch.from_arrays([pa.array([name] * m), pa.array(g[k : k + m].view(np.int64)), pa.array(n[k : k + m])], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            data, off = kernels.flat(batch.column(1))
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            for lo, hi in kernels.slices(off):
                g, first = ngrams(data, off[lo : hi + 1])
                which, tag = np.unique(names[lo:hi].astype(str), return_inverse=True)
                of = np.repeat(tag, np.diff(first))
                for k, name in enumerate(which.tolist()):
                    held.setdefault(name, []).append(np.unique(g[of == k], return_counts=True))
                    size += len(held[name][-1][0])
            if size > _FLUSH:
                for name in held:
                    held[name] = [merged(held[name])]
                size = sum(len(p[0][0]) for p in held.values())
                if size > _FLUSH // 2:
                    yield from flush()
                    size = 0
        yield from flush()

    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(training: DataFrame, text: str = "text", lang: str = "lang", share: float = SHARE) -> dict:
    """The filter: masks (positions, words of 64 languages), the languages and their false-positive rates."""
    scratch = store.Scratch(training.sparkSession, "langid")
    counts = scratch.write(count(training.where(F.col(lang).isNotNull()), text, lang).withColumn("size", F.shiftrightunsigned("gram", 56)), "counts")
    total = {(r.lang, r.size): r.n for r in counts.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}
    langs = sorted({x for x, _ in total})
    sums = training.sparkSession.createDataFrame([(*k, float(v)) for k, v in total.items()], "lang string, size long, total double")
    kept = counts.join(F.broadcast(sums), ["lang", "size"]).where((F.col("n") >= 2) & (F.col("n") >= share * F.col("total"))).select("lang", "gram").toPandas()
    scratch.drop("counts")
    sizes = [int((kept["lang"] == x).sum()) for x in langs]
    positions = 1 << int(np.ceil(np.log2(max([1024, *sizes]) * BITS_PER_GRAM)))
    masks = np.zeros((positions, -(-max(1, len(langs)) // 64)), dtype=np.uint64)
    for k, name in enumerate(langs):
        g = kept["gram"].to_numpy(dtype=np.int64)[(kept["lang"] == name).to_numpy()].view(np.uint64)
        for at in places(g, positions):
            masks[at, k // 64] |= np.uint64(1 << (k % 64))
    full = [float(((masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean()) ** HASHES for k in range(len(langs))]
    if len(langs) <= 8:
        masks = masks.astype(np.uint8)
    return {"masks": masks, "langs": langs, "false": np.array(full), "weight": np.array([sum(v for (x, _), v in total.items() if x == name) for name in langs], dtype=float)}


def places(g: np.ndarray, positions: int) -> Iterator[np.ndarray]:
    for k in range(HASHES):
        yield (kernels.mix(g + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & np.uint64(positions - 1)).astype(np.int64)


def scores(model: dict, data: np.ndarray, off: np.ndarray) -> dict:
    """lang_pred and score of each document."""
    n, langs = len(off) - 1, model["langs"]
    g, first = ngrams(data, off)
    masks, held = model["masks"], None
    for at in places(g, len(masks)):
        held = masks[at] if held is None else held & masks[at]
    grams = np.maximum(np.diff(first), 1)
    est = np.zeros((n, max(1, len(langs))))
    for k in range(len(langs)):
        bit = (held[:, k // 64] >> held.dtype.type(k % 64)) & held.dtype.type(1)
        total = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
        est[:, k] = np.clip(((total[first[1:]] - total[first[:-1]]) / grams - model["false"][k]) / (1 - model["false"][k] + 1e-9), 0, 1)
    if langs:
        order = sorted(range(len(langs)), key=lambda k: (-model["weight"][k], langs[k]))
        best = np.array(order)[est[:, order].argmax(axis=1)]
    names, score = [], np.zeros(n)
    for d in range(n):
        raw = data[off[d] : off[d + 1]]
        plain = raw[raw < 0x80]
        letters = bool(_LETTER[plain].any()) or (len(plain) < len(raw) and any(map(str.isalpha, raw.tobytes().decode("utf-8", "replace"))))
        if not langs or not letters:
            names.append("und")
            continue
        names.append(langs[best[d]])
        score[d] = est[d, best[d]] / max(est[d].sum(), 1e-12)
    return {"lang_pred": names, "score": score}


def identify(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns, lang_pred and score. One pass; the filter's size is bounded by the share of train()."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return frames.enrich(docs, lambda: lambda data, off: scores(shared.value, data, off), "lang_pred string, score double", text=text, keep=keep)
