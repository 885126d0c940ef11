"""Operators that SQL can't express against plain versions: Python loops over the definitions, exact sets, gradient descent."""

import math
import re
from collections import Counter

import numpy as np

from terrazone.llm import fingerprints, kernels, langid, quality, store
from tests.llm.test_operators import plain_distance

M = (1 << 64) - 1


def mix(x):
    x ^= x >> 32
    x = x * 0xFF51AFD7ED558CCD & M
    x ^= x >> 32
    x = x * 0xC4CEB9FE1A85EC53 & M
    return x ^ x >> 32


def plain_signature(t, rolled, bits):
    """Chunks end where the low bits of the rolling hash are zero; in long stretches fewer bits are asked for, step by step."""
    ends = sorted({i + 1 for i in range(len(t)) if rolled[i] & ((1 << bits) - 1) == 0} | ({len(t)} if t else set()))
    for fewer in range(1, bits):
        begins = [0, *ends[:-1]]
        wide = [(a, b) for a, b in zip(begins, ends, strict=False) if b - a > 4 << bits]
        if not wide:
            break
        ends = sorted({*ends, *(i + 1 for a, b in wide for i in range(a, b) if rolled[i] & ((1 << (bits - fewer)) - 1) == 0)})
    chunks, seen = [], set()
    for a, b in zip([0, *ends[:-1]], ends, strict=False):
        h = mix(sum(rolled[a:b]) * 0x9E3779B97F4A7C15 & M)
        if h not in seen:
            seen.add(h)
            chunks.append((h, rolled[b - 1]))
    if len(chunks) > 128:  # the ones that end at the windows of least hash stay apart
        picked = sorted(sorted(range(len(chunks) - 1), key=lambda i: (mix(chunks[i][1] ^ 0xA0761D6478BD642F), i))[:127])
        edges = [0, *(i + 1 for i in picked), len(chunks)]
        chunks = [(mix(sum(h for h, _ in chunks[a:b]) & M), 0) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    return "".join(letters[h >> 58] for h, _ in chunks)


def plain_fingerprint(t):
    k = max(1, math.floor(math.log2(max(len(t), 1) / 24)))
    before = b" " * 7 + t
    rolled = [mix(int.from_bytes(before[i + 1 : i + 8], "little")) for i in range(len(t))]
    return f"{k}:{plain_signature(t, rolled, k)}:{plain_signature(t, rolled, k + 1)}"


def plain_likeness(a, b):
    if a == b:
        return 1.0
    (i, *s), (j, *t) = (re.sub(r"([^:])\1{3,}", r"\1\1\1", x).split(":") for x in (a, b))
    best = 0.0
    for x in (0, 1):
        for y in (0, 1):
            if int(i) + x != int(j) + y or (x == y == 1 and min(len(s[1]), len(t[1])) < 16):
                continue  # block sizes differ, or both are coarse and one is short
            p, q = s[x], t[y]
            short = min(len(p), len(q))
            need = 4 if short >= 24 else 3 if short >= 12 else 2 if short >= 4 else 1
            if short and any(p[m : m + need] in q for m in range(len(p) - need + 1)):
                best = max(best, 1 - plain_distance(p, q) / max(len(p), len(q)))
    return best


def test_fingerprints_by_loops(spark, data):
    rng = np.random.default_rng(2)
    texts = [(r.text or "").encode() for r in store.table(spark, data, "documents").orderBy("doc_id").limit(40).collect()]
    texts = [t for t in texts if len(t) <= 6000] + [b"", b"a", b"\x00" * 300, b"ab" * 2000, b"line of text\n" * 200 + bytes(rng.integers(97, 123, 4000, dtype=np.uint8))]
    texts.append(b" ".join(b"%d" % x for x in rng.integers(0, 10**9, 3000)))
    got = fingerprints.fingerprints(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert got == [plain_fingerprint(t) for t in texts]
    pairs = [(got[i], got[j]) for i in range(len(got)) for j in (i, (i + 1) % len(got), (i * 7) % len(got))]
    edited = [plain_fingerprint(t[: len(t) - len(t) // 2] + u[: len(t) // 2]) for t, u in zip(texts, [*texts[1:], texts[0]], strict=True)]
    pairs += list(zip(got, edited, strict=True))
    assert np.allclose(fingerprints.likeness(*map(list, zip(*pairs, strict=True))), [plain_likeness(*p) for p in pairs])


def test_languages_by_exact_sets(spark, data):
    """The filter against sets that hold every n-gram exactly: false positives near the model's own rate, the same languages."""
    rows = [(r.doc_id, r.text or "", r.lang) for r in store.table(spark, data, "documents").orderBy("doc_id").collect()]
    training = [r for r in rows if r[0] % 3 and r[2]]
    grams = lambda t: langid.ngrams(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0].tolist()
    counts = {lang: Counter() for lang in {r[2] for r in training}}
    for _, t, lang in training:
        counts[lang].update(grams(t))
    sets = {}
    for lang, own in counts.items():
        total = Counter()
        for g, n in own.items():
            total[g >> 56] += n
        sets[lang] = {g for g, n in own.items() if n >= 2 and n >= langid.SHARE * total[g >> 56]}
    model = langid.train(spark.createDataFrame(training, "doc_id long, text string, lang string"))
    strange = kernels.mix(np.arange(1, 20_001, dtype=np.uint64))
    held = None
    for at in langid.places(strange, len(model["masks"])):
        held = model["masks"][at] if held is None else held & model["masks"][at]
    for k, lang in enumerate(model["langs"]):
        assert abs(float(((held[:, k // 64] >> held.dtype.type(k % 64)) & held.dtype.type(1)).mean()) - model["false"][k]) < 0.01
        known = np.array(sorted(sets[lang]), dtype=np.uint64)
        for at in langid.places(known, len(model["masks"])):
            assert ((model["masks"][at][:, k // 64] >> model["masks"].dtype.type(k % 64)) & model["masks"].dtype.type(1)).all()  # nothing that is in is missed
    agree = 0
    for _, t, _ in rows:
        g = grams(t)
        plain = {lang: sum(x in s for x in g) / max(1, len(g)) for lang, s in sets.items()}
        best = max(plain.values())
        found = langid.scores(model, np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))["lang_pred"][0]
        agree += found == "und" or plain[found] >= best - 0.02
    assert agree >= 0.99 * len(rows)


def test_ranking_by_gradient_descent():
    """The weights of Newton's steps on drawn pairs near those of plain descent on all pairs; the cut is the best of all."""
    rng = np.random.default_rng(3)
    y = np.array([1] * 30 + [0] * 20)
    x = rng.normal(size=(50, 4)) + y[:, None] * np.array([1.0, 0.5, 0.0, -0.7])
    model = quality.fit(x, y)
    z = np.clip((x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6), -8, 8)
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, 4)
    w = np.zeros(4)
    for _ in range(20_000):  # the loss of as many pairs as are drawn, and the same ridge
        p = 1 / (1 + np.exp(-d @ w))
        w += 0.5 * (d.T @ (1 - p) / len(d) - 2.0 / quality.PAIRS * w)
    assert np.allclose(model["w"] * model["z"], w, rtol=0.05, atol=0.02)
    s = z @ (model["w"] * model["z"])
    right = max(((s >= t) == (y == 1)).mean() for t in np.append(np.sort(s) - 1e-9, np.inf))
    assert (((s >= model["at"]) == (y == 1)).mean()) == right
    assert ((quality.score(model, x) >= 0.5) == (s >= model["at"])).all()
