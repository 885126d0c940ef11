"""The training-data operators against plain versions, on odd texts and on the smallest tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrazone.llm import components, decontam, editing, fingerprints, fuzzylines, kernels, langid, minhash, mixing, quality, queries, sharding, store, suffix, tokens
from tests.conftest import same

LONG = " ".join(f"word{i % 977} tail{i % 13}" for i in range(60_000))
ROWS = [
    (5, "The quick brown fox jumps over the lazy dog near the old river bank at dawn", "en", "a"),
    (3, "the quick brown fox jumps over the lazy dog near the old river bank at dawn", None, "a"),
    (9, None, "en", "b"),
    (1, "", "de", None),
    (2, "   \n\t ", "de", "a"),
    (7, "The quick brown fox jumps over the lazy dog near the old river bank at dusk", "en", "a"),
    (7, "The quick brown fox jumps over the lazy dog near the old river bank at dusk", "en", "a"),
    (11, LONG, "en", "a"),
    (12, LONG + " end", "en", "b"),
    (4, "été çà ñandú Straße 中文 😀 \x00 don't I'd've", "fr", "b"),
    (6, "a", "fr", "b"),
    (8, "line one is here to stay\nline two is here to stay\nline one is here to stay\n\nshort", "en", "a"),
    (None, "no key at all but some words in it", "en", "a"),
]
CLASH = "n_words long, n_hit long, score double, predicted int, shard int, slot long, size long, n_tokens long, n_uses int, c0 string, t string, fingerprint string, lang_pred string, weight double, alpha double, _doc long, block long, _kept boolean, _hit string, _items string, _text string, _bytes string, _h long, _k long, _c string, _label string, k long, g long, f long, h long, b string, b0 long, line long, root long, source_ string, own0 string, held string, item string, _n long, start long, chunk int, key long"


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    extra = [F.lit(None).cast(k).alias(n) for n, k in (x.split() for x in CLASH.split(", "))]
    return df.repartition(3).select("*", *extra)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def docs(rows):
    return [(r.doc_id, r.text or "") for r in rows.collect()]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, data, duck, name):
    assert same(queries.queries()[name](spark, data).toPandas(), duck.sql(queries.oracle_sql()[name]).df())


# kernels ----------------------------------------------------------------------------------------------------------


def test_hashes_tell_words_and_runs_apart():
    rng = np.random.default_rng(0)
    raw = " ".join("".join(rng.choice(list("ab"), rng.integers(1, 20))) for _ in range(3000)).encode()
    part = kernels.Texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    a, b, _ = part.words(kernels.NOT_SPACE)
    words, h = raw.split(), part.spans(a, b)
    assert len(set(words)) == len(set(h.tolist())) and len(words) == len(h)
    for n in (1, 2, 3, 5, 13):
        assert len(set(kernels.grams(h, n).tolist())) == len(set(zip(*(words[k:] for k in range(n)), strict=False)))
    assert len(kernels.grams(h[:3], 4)) == 0


# 1 ----------------------------------------------------------------------------------------------------------------


def plain_repeats(rows, length):
    seen = defaultdict(int)
    raws = [(k, t.encode()) for k, t in rows]
    for _, b in raws:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] += 1
    out = []
    for k, b in raws:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        rest = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((k, len(b), int(gone.sum()), len(kernels.runs(gone)[0]), hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def test_covers():
    for q in (2, 3, 5, 7, 11, 13):
        v, d = suffix.cover(q)
        assert len(d) == q + 1 and {(x - y) % v for x in d for y in d} == set(range(v))


@pytest.mark.parametrize("length", [8, 20, 60])
def test_suffixes(spark, odd, empty, length):
    rng = np.random.default_rng(length)
    base = ["".join(rng.choice(list("abcdef "), 150)) for _ in range(6)]
    made = [(100 + i, "".join(base[j][rng.integers(0, 60) : rng.integers(60, 150)] for j in rng.integers(0, 6, 4)) + "".join(rng.choice(list("xyz"), 20))) for i in range(60)]
    made += [(200, "ab" * 90), (201, "q" * 7), (202, "z" * length)]
    small = odd.where("doc_id is null or doc_id not in (11, 12)").select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    got = suffix.repeats(small, length=length, passes=2, chunk_bytes=3000, bucket_keys=500, with_text=True).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == plain_repeats(docs(small), length)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert suffix.repeats(empty).count() == 0


# 2 ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [False, True])
def test_tokens(spark, odd, empty, bits):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary())
    path = store.Scratch(spark, "test").path("ids")
    tokens.write(odd, path, queries.vocabulary(), bits=bits, partitions=3)
    got = tokens.read(spark, path, bits=bits, with_ids=True).orderBy("start").collect()
    want, start = sorted(docs(odd), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode())), 0
    for (k, t), r in zip(want, got, strict=True):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (k, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    tokens.write(empty, path, queries.vocabulary())
    assert tokens.read(spark, path).count() == 0


def test_planes_round_trip():
    rng = np.random.default_rng(1)
    for top, n in ((1, 0), (2, 5), (300, 70_000), (1 << 17, 200_001)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        for bits in (False, True):
            assert (tokens.unpack(tokens.pack(ids, bits), n, bits) == ids).all()


# 3 ----------------------------------------------------------------------------------------------------------------


def plain_components(rows, n, percent):
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", t.encode().translate(bytes(kernels.LOWER)))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        low[find(i)].append(-1 if k is None else k)
    least = [min(low[find(i)]) for i in range(len(rows))]
    return sorted(((k, len(s), None if m == -1 else m, (-1 if k is None else k) == m) for (k, _), s, m in zip(rows, sets, least, strict=True)), key=str)


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates(spark, odd, empty, n):
    rng = np.random.default_rng(n)
    base = [f"w{i}" for i in rng.integers(0, 400, 120)]
    made = []
    for i in range(150):  # a group whose members are alike in part: links are a web, not a clique
        words = list(base if i % 3 or not made else made[rng.integers(0, len(made))][1].split())
        for _ in range(rng.integers(0, 8)):
            words[rng.integers(0, len(words))] = f"x{rng.integers(0, 10**6)}"
        made.append((1000 + i, " ".join(words)))
    rows = odd.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    with pytest.MonkeyPatch.context() as patch:  # 4: keys of many nodes leave hubs for their pieces, in several rounds of a task
        patch.setattr(minhash, "PIECE", 3 if n == 4 else minhash.PIECE)
        patch.setattr(minhash, "SENT_KEYS", 2_000 if n == 4 else minhash.SENT_KEYS)
        patch.setattr(store, "BATCH_ROWS", 20)
        got = minhash.near_duplicates(rows, n=n, small=2)
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain_components(docs(rows), n, 80)
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.deduplicate(odd, n=n)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in minhash.near_duplicates(odd, n=n).where("kept").collect()}


def test_hot_keys_fill_no_bucket(spark):
    """Of 3,000 nodes that share every key a bucket gets a hub for each round of a task; candidates reach all of them."""
    same_atoms = np.arange(24, dtype=np.uint64).tobytes()
    nodes = spark.createDataFrame([(i * 7919 + 1, bytearray(same_atoms)) for i in range(3_000)], "f long, atoms binary").repartition(6)
    keyed = minhash._keys(nodes, 12, 8)
    assert keyed.where("not piece").agg(F.sum(F.length("ids") / 8)).first()[0] <= 6 * 144
    met = minhash._candidates(keyed, minhash.SMALL)
    ends = met.where("ids is null").select(F.explode(F.array("a", "b")).alias("f"))
    assert ends.distinct().count() == 3_000 and met.where("ids is null").count() < 5 * 3_000


def test_components_in_many_tasks(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(400, 460)]
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    got = {r.id: r.root for r in components.components(df, "a", "b", store.Scratch(spark, "test"), "cc", task_links=40).collect()}
    u, v = components.contract(*np.array(links).T)
    assert got == dict(zip(u.tolist(), v.tolist(), strict=True))


# 4 ----------------------------------------------------------------------------------------------------------------


def test_quality(spark, data, odd, empty):
    got = queries.op4_quality_ranking(spark, data).join(store.table(spark, data, "labels"), "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.9 and got["score"].between(0, 1).all()
    labels = spark.createDataFrame([(5, 1), (3, 1), (8, 0), (2, 0), (77, 1), (5, 0), (None, 1)], "doc_id long, quality int")
    model = quality.train(odd, labels)
    rated = quality.rate(odd, model)
    assert rated.count() == len(ROWS) and set(rated.columns) == set(odd.columns) and rated.where("score is null or predicted <> cast(score >= 0.5 as int)").isEmpty()
    assert {r.score for r in quality.rate(odd, quality.train(odd, labels.where("quality = 1"))).collect()} == {0.5}
    assert quality.rate(empty, quality.train(empty, labels)).count() == 0


# 5 ----------------------------------------------------------------------------------------------------------------


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a, b = ("".join(rng.choice(list("abc"), rng.integers(0, 12))) for _ in range(2))
        assert editing.distance(a, b) == plain_distance(a, b)


def test_pairs_within_a_distance():
    """Side by side in blocks, one by one, and with symbols that the other string lacks; limits on both sides of the distance."""
    rng = np.random.default_rng(1)
    for letters, n in (("ab", 150), ("abcdé中😀", 300), ("".join(map(chr, range(0x4E00, 0x4F00))), 120)):
        left, right = [], []
        for k in range(n):
            x = list(rng.choice(list(letters), rng.integers(0, 12) if k % 3 else rng.integers(60, 140)))
            y = list(x)
            for _ in range(rng.integers(0, 6)):
                at = rng.integers(0, len(y) + 1)
                y[at : at + rng.integers(0, 2)] = rng.choice([*letters, "?"], rng.integers(0, 2)).tolist()
            left.append("".join(x))
            right.append("".join(y) if k % 5 else "".join(rng.choice(list(letters), len(x))))
        real = np.array([plain_distance(a, b) for a, b in zip(left, right, strict=True)])
        for off in (-1, 0, 2):
            assert (editing.within(left, right, real + off) == (off >= 0)).all()
        assert [editing.distance(a, b, d) for a, b, d in zip(left, right, real.tolist(), strict=True)] == real.tolist()


def test_pairs_within_a_distance_of_any_size():
    """The band of diagonals holds for limits of several words, for unlike lengths and for limits beyond the strings."""
    rng = np.random.default_rng(4)
    left = ["".join(rng.choice(list("abcd"), rng.integers(1, 260))) for _ in range(120)]
    right = [x[int(rng.integers(0, 1 + len(x) // 4)) :] + "".join(rng.choice(list("abcd"), rng.integers(0, 60))) for x in left]
    real = np.array([editing.distance(a, b) for a, b in zip(left, right, strict=True)])
    for off in (-20, -1, 0, 1, 70, 500):
        assert (editing.within(left, right, real + off) == (off >= 0)).all()


def test_lines_of_rows_that_share_a_key(spark):
    """Rows of one key, or without one, with other texts are documents of their own; equal rows share their lines."""
    a, b, c = "the harbour opened before dawn today", "seventeen crates of mixed tools arrived", "no train ran over the northern bridge"
    rows = [(1, a), (2, a), (2, f"{b}\n{c}"), (None, a), (None, c), (3, c), (4, b), (4, b)]
    got = sorted(((r.doc_id or 0, r.n_lines, r.kept_text) for r in fuzzylines.dedup(spark.createDataFrame(rows, "doc_id long, text string"), distance=None, min_words=1, with_text=True).collect()))
    assert got == sorted([(0, 1, a), (0, 1, c), (1, 1, ""), (2, 1, ""), (2, 2, b), (3, 1, ""), (4, 1, ""), (4, 1, "")])


def test_lines(spark, odd, empty, data):
    more = [(50 + i, "\n".join([f"Item {i}: the shipment left the eastern harbour with seventeen crates of mixed tools and {w} before noon today", "unique " * 3 + str(hash((i, 1)) % 997 * 7919)])) for i, w in enumerate(["parts", "part", "parts", "pieces of rope", "wheat"] * 8)]
    rows = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).union(store.table(spark, data, "documents").select(F.col("doc_id") + 1000, "text"))
    got = {(r.doc_id, r.n_lines, r.n_removed, r.kept_sha256) for r in fuzzylines.dedup(rows, with_text=True).collect()}
    want, seen = docs(rows), []
    for d, (k, t) in enumerate(want):
        raw = t.encode()
        part, x = fuzzylines.lines(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 4)
        for i in range(len(x["line"])):
            a = x["first"][i]
            text = " ".join(part.buf[s:e].tobytes().decode() for s, e in zip(x["starts"][a : a + x["count"][i]], x["ends"][a : a + x["count"][i]], strict=True))
            plain = re.findall(r"[^ ]+", "".join(chr(fuzzylines._PLAIN[c]) if c < 128 else c.to_bytes(1, "big").decode("latin-1") for c in raw.split(b"\n")[x["line"][i]]))
            assert [p.encode("latin-1") for p in plain] == text.encode().split(b" ")
            seen.append((-1 if k is None else k, int(x["line"][i]), d, text, x["sim"][i]))
    nodes = sorted({s[3] for s in seen})
    sims, root = {s[3]: s[4] for s in seen}, {t: t for t in nodes}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    sim = np.array([sims[t] for t in nodes])
    for i in range(len(nodes)):
        for j in np.flatnonzero(np.bitwise_count(sim[i] ^ sim[:i]) <= 3):
            if fuzzylines.similar([nodes[i]], [nodes[j]], 0.8)[0]:
                root[find(nodes[i])] = find(nodes[j])
    first = {}
    for k, line, _, t, _ in sorted(seen, key=lambda s: s[:2]):
        first.setdefault(find(t), (k, line))
    gone = defaultdict(set)
    for k, line, d, t, _ in seen:
        if first[find(t)] != (k, line):
            gone[d].add(line)
    expected = set()
    for d, (k, t) in enumerate(want):
        own = t.split("\n")
        expected.add((k, len(own), len(gone[d]), hashlib.sha256("\n".join(x for i, x in enumerate(own) if i not in gone[d]).encode()).hexdigest()))
    assert got == expected and sum(map(len, gone.values())) > 30
    assert fuzzylines.dedup(empty).count() == 0


def removed_by_similarity(rows, min_words):
    """Lines removed for each row by brute force on edit similarity alone."""
    nodes, seen = {}, []
    for k, t in rows:
        for i, x in enumerate(t.split("\n")):
            w = "".join(chr(fuzzylines._PLAIN[ord(c)]) if ord(c) < 128 else c for c in x).split()
            if len(w) >= max(min_words, 1):
                nodes.setdefault(" ".join(w), None)
                seen.append((k, i, " ".join(w)))
    names = sorted(nodes)
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(names):
        for y in names[:i]:
            if 5 * abs(len(x) - len(y)) <= max(len(x), len(y)) and find(x) != find(y) and 5 * plain_distance(x, y) <= max(len(x), len(y)):
                root[find(x)] = find(y)
    first, gone = {}, defaultdict(set)
    for k, i, x in sorted(seen):
        if first.setdefault(find(x), (k, i)) != (k, i):
            gone[k].add(i)
    return {k: len(gone[k]) for k, _ in rows}


def test_salts_follow_the_nodes_of_a_key():
    """The rows that a key's salts make stay below its nodes, in small pieces and large ones."""
    sizes = [2, 32, 33, 40, 300, 5000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array([np.arange(n).tobytes() for n in sizes], pa.binary())], names=["key", "ids"])
    salts = [int(b.column(2)[0].as_py()) for b in minhash._unpack(iter([batch]))]
    assert salts == [1, 1, 9, 10, 75, 256] and all(4 * s <= n + 3 for s, n in zip(salts[2:], sizes[2:], strict=True))


def test_screening_of_lines_loses_no_similar_pair():
    """Profiles let every pair of edit similarity 0.8 pass, long runs of one character too, and few unrelated pairs."""
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("etaoinshrdlucmfg"), rng.integers(2, 9))) for _ in range(800)]
    base = [" ".join(rng.choice(vocabulary, rng.integers(1, 25))) for _ in range(200)] + ["", "a", "ab", "a" * 900, "a" * 800 + "b" * 100, "中文 é😀" * 9]
    other = [x for share in (0.0, 0.1, 0.19) for x in typing(rng, [b or "x" for b in base], share)]
    left, right = [*base * 3, *base], [*other, *np.roll(base, 1).tolist()]
    held, n = fuzzylines.profiles(left + right)
    may = fuzzylines.screened(held, n, np.arange(len(left)), np.arange(len(left), 2 * len(left)), 0.8)
    assert may[fuzzylines.similar(left, right, 0.8)].all()
    assert may[-len(base) : -6].sum() < 0.2 * len(base)


def test_keys_of_lines_are_the_same_in_parts(spark):
    """Tables dealt out a few at a time hold the keys of all tables at once."""
    rng = np.random.default_rng(9)
    rows = [(int(h), 60, *(int(x) for x in rng.integers(0, 3, 4)), *[None] * 4) for h in rng.integers(1, 1 << 40, 50)]
    nodes = spark.createDataFrame(rows, "h long, n long, " + ", ".join(f"{m} long" for m in fuzzylines._MINHASHES))
    tables = lambda combos: {(r.mask, r.bucket, bytes(r.h), bytes(r.key)) for r in fuzzylines._edit_keys(nodes.coalesce(1), 3, combos).collect()}
    every = list(range(len(fuzzylines.COMBOS)))
    assert tables(every) == tables(every[:7]) | tables(every[7:])


def typing(rng, lines_, share):
    """Each line with this share of its characters (one at least) replaced."""
    out = []
    for x in lines_:
        y = list(x)
        for p in rng.choice(len(x), max(1, int(share * len(x))), replace=False):
            y[p] = chr(97 + (ord(y[p]) + int(rng.integers(1, 20))) % 26)
        out.append("".join(y))
    return out


def test_large_groups_make_links_and_no_rows_of_pairs(spark):
    """Lines that share a key become pairs only in small groups, so that rows of pairs grow with the lines and not their square."""
    for size, pairs in ((fuzzylines.LARGE, fuzzylines.LARGE * (fuzzylines.LARGE - 1) // 2), (60, 0)):
        rows = [(h, 60, *[7] * 4, *[None] * 4) for h in range(1, size + 1)]
        nodes = spark.createDataFrame(rows, "h long, n long, " + ", ".join(f"{m} long" for m in fuzzylines._MINHASHES))
        met = fuzzylines._edit_candidates(fuzzylines._edit_keys(nodes.coalesce(1), 1, [0, 1]), 0.8).collect()
        assert sum(r.h is None for r in met) == pairs
        assert [len(r.h) // 8 for r in met if r.h is not None] == [size] * (2 if not pairs else 0)


def test_lines_of_large_groups_are_joined_as_by_all_pairs():
    """Groups that overlap, of several tables and of tiny lines: each similar pair of a group is connected, nothing else is."""
    rng = np.random.default_rng(6)
    passage = "a passage of some length that many lines have in common "
    vocabulary = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(200)]
    base = [passage + " ".join(rng.choice(vocabulary, rng.integers(3, 18))) for _ in range(60)]
    told = [*base, *typing(rng, base[:30], 0), *typing(rng, base[20:40], 0.1), *["ab", "abc", "hello", "hallo", "hullo"]]
    for many in (False, True):
        sim = rng.integers(0, 1 << 63, len(told)).astype(np.uint64) & np.uint64(0xFFFFFF)  # within FAR bits
        groups, tables = [], np.zeros((len(told), 3), np.int32)
        for t in range(3):
            dealt = rng.integers(0, 3, len(told))
            for g in range(3):
                groups.append((t, np.flatnonzero(dealt == g)))
                tables[groups[-1][1], t] = 3 * t + g + 1
        tiny = np.arange(len(told) - 5, len(told))
        groups += [(3, tiny[:3]), (3, tiny[1:]), (3, tiny)]
        root = np.arange(len(told)) * 5
        root[1] = root[0]
        held = {(i, j) for _, own in groups for i in own.tolist() for j in own.tolist() if i < j}
        near = [(i, j) for i, j in sorted(held) if 5 * plain_distance(told[i], told[j]) <= max(len(told[i]), len(told[j]))]
        x, y = fuzzylines.joined(told, (sim, np.full(len(told), many)), root, tables, groups, 0.8)
        assert {tuple(sorted(p)) for p in zip(x.tolist(), y.tolist(), strict=True)} <= set(near)
        least = []
        for links in (near, list(zip(x.tolist(), y.tolist(), strict=True))):
            label = np.arange(len(told))
            for i, j in [(0, 1), *links]:
                label[label == max(label[i], label[j])] = min(label[i], label[j])
            least.append(label.tolist())
        assert least[0] == least[1] and len(near) > 30


def test_lines_that_share_a_passage(spark):
    """More lines than a small group has share a passage; edited copies among them are found and no other line goes."""
    rng = np.random.default_rng(12)
    vocabulary = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(3000)]
    passage = " ".join(rng.choice(vocabulary, 14))
    base = [f"{passage} {' '.join(rng.choice(vocabulary, 16))}" for _ in range(40)]
    rows = [(i, x) for i, x in enumerate([*base, *typing(rng, base[:20], 0)])]
    got = {r.doc_id: r.n_removed for r in fuzzylines.dedup(spark.createDataFrame(rows, "doc_id long, text string"), distance=None).collect()}
    assert got == removed_by_similarity(rows, 4) and sum(got.values()) == 20


def test_lines_by_edit_similarity_alone(spark):
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(3000)]
    base = [" ".join(rng.choice(vocabulary, rng.integers(4, 25))) for _ in range(80)]
    rows = [(i, x) for i, x in enumerate([*base, *typing(rng, base, 0)])]
    want = removed_by_similarity(rows, 4)
    got = {r.doc_id: r.n_removed for r in fuzzylines.dedup(spark.createDataFrame(rows, "doc_id long, text string"), distance=None).collect()}
    assert sum(want.values()) == 80 and all(got[k] <= n for k, n in want.items())
    assert sum(got.values()) >= 0.97 * 80


def test_short_lines_and_lines_without_spaces(spark, tmp_path):
    han = "".join(chr(0x4E00 + 37 * i % 5000) for i in range(40))
    rows = [
        (1, "les\nab cd ef\n" + han), (2, "LES.\nab cd ef\n" + han), (3, "let\n\nab cd eg\n" + han[:20] + "x" + han[21:]),
        (4, "\n\nhello\n" + han[::-1]), (5, "hallo\n" + han[:8]), (6, han[:8] + "\n" + han[1:6]), (7, "hallo you\n" + han[:3] + "y" + han[4:8]),
    ]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    got = {r.doc_id: r.n_removed for r in queries.op5_fuzzy_lines(spark, str(tmp_path)).collect()}
    assert got == removed_by_similarity(rows, 1) == {1: 0, 2: 3, 3: 2, 4: 0, 5: 1, 6: 1, 7: 1}


# 6 ----------------------------------------------------------------------------------------------------------------


def test_shards(spark, data, odd, empty):
    table = store.table(spark, data, "documents")
    got = queries.op6_histogram_shards(spark, data).toPandas()
    by = got.groupby("shard")
    assert len(got) == table.count() and sorted(got["shard"].unique()) == list(range(16))
    assert by["size"].sum().max() - by["size"].sum().min() <= 2 * got["size"].max()
    for _, own in by["slot"]:
        assert sorted(own) == list(range(len(own)))
    crc = {r.doc_id: zlib.crc32(r.text.encode()) for r in table.collect()}
    assert all(crc[k] == c for k, c in zip(got["doc_id"], got["text_crc32"], strict=True))
    copies = spark.createDataFrame([(i, "same text") for i in range(-400, 400)] + [(i, f"other {i}") for i in range(1000, 1100)], "doc_id long, text string")
    hot = sharding.shard(copies, block_rows=10).toPandas()
    assert hot.groupby("shard")["size"].sum().agg(["min", "max"]).diff().iloc[1] <= 20 and (hot.groupby("shard")["slot"].max() + 1 == hot.groupby("shard").size()).all()
    # the slot is the rank in (hash, key) at every size of block
    few = sharding.shard(copies.union(spark.createDataFrame([(None, "same text"), (2**62, "same text"), (-(2**62), "other 1000")], copies.schema)), block_rows=5).toPandas()
    order = few.assign(m=[hashlib.md5(t.encode()).hexdigest()[:15] for t in few["text"]], doc_id=few["doc_id"].fillna(-(2**63)).astype(object)).sort_values(["m", "doc_id"])
    assert (order.groupby("shard").cumcount() == order["slot"]).all() and order["shard"].is_monotonic_increasing
    o = sharding.shard(odd)
    assert o.count() == len(ROWS) and set(o.columns) == {*odd.columns, "text_crc32", "law", "grown_shard"}
    assert {r["size"] for r in o.where("text is null or text = ''").collect()} == {1}
    assert sharding.shard(empty).count() == 0
    assert sharding.shard(copies, tolerance=0.05).groupBy("shard").agg(F.sum("size").alias("s")).agg(F.max("s") - F.min("s")).first()[0] <= 0.2 * 8000


# 7 ----------------------------------------------------------------------------------------------------------------


def test_mixing(spark, odd, empty):
    rows = spark.createDataFrame([(i, "w " * (3 + i % 7), "big" if i < 3000 else f"s{i % 9}") for i in range(4000)], "doc_id long, text string, source string")
    used = mixing.uses(rows, block_docs=50, entropy=0.95, repeats=3.0).toPandas()
    drawn = (used["n_uses"] * used["n_tokens"]).groupby(used["source"]).sum()
    weight, total = used.groupby("source")["weight"].first(), used["n_tokens"].sum()
    assert weight.sum() == pytest.approx(1) and (abs(drawn - weight * total) <= 10 + 1).all()
    entropy = -(weight * np.log(weight)).sum() / np.log(len(weight))
    assert entropy == pytest.approx(0.95, abs=1e-6) and used["n_uses"].max() > 1
    limited = mixing.uses(rows, entropy=1.0, repeats=1.5).toPandas()
    held = limited.groupby("source")["n_tokens"].sum()
    assert (limited.groupby("source")["weight"].first() * total / held).max() == pytest.approx(1.5, abs=1e-6)
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.where("doc_id = 1").isEmpty()
    assert mixing.uses(odd).count() == len(ROWS) and mixing.uses(empty).count() == 0 and mixing.mix(empty).count() == 0
    with pytest.MonkeyPatch.context() as patch:  # one bin for all blocks: a single window, as the definition has it
        found = []
        for bits in (0, 3):
            patch.setattr(mixing, "BIN_BITS", bits)
            found.append(mixing.uses(rows, keep=["doc_id"], block_docs=5, entropy=0.9).toPandas())
        assert same(*found)
    natural = mixing.uses(rows, entropy=0.0).toPandas()
    assert set(natural["n_uses"]) == {1}


# 8 ----------------------------------------------------------------------------------------------------------------


def plain_hits(rows, items, n=13):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.encode().translate(bytes(kernels.LOWER)))
    known = defaultdict(set)
    for k, t in items:
        w = words(t or "")
        for i in range(len(w) - min(n, len(w)) + 1 if w else 0):
            known[tuple(w[i : i + min(n, len(w))])].add(k)
    out = []
    for k, t in rows:
        w, hit, found = words(t), set(), set()
        for size in {len(g) for g in known}:
            for i in range(len(w) - size + 1):
                if (g := tuple(w[i : i + size])) in known:
                    hit |= set(range(i, i + size))
                    found |= known[g]
        out.append((k, len(w), len(hit), sorted(found, key=str), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_benchmark_tables_are_arrays():
    items = [(k, " ".join(f"w{j % 97}" for j in range(k, k + 40))) for k in range(30)] + [(1, "w1 w2"), (2, "w1  W2")]
    found = decontam.windows(items)
    assert set(found["sizes"]) == {2, 13}
    for size, t in found["sizes"].items():
        want = defaultdict(set)
        for k, x in items:
            w = x.lower().split()
            for i in range(len(w) - size + 1 if min(13, len(w)) == size else 0):
                want[" ".join(w[i : i + size]) + " "].add(k)
        got = {found["text"][a:b].tobytes().decode(): set(t["items"][i:j].tolist()) for a, b, i, j in zip(t["a"], t["b"], t["first"][:-1], t["first"][1:], strict=True)}
        assert got == want and (np.diff(t["hash"].view(np.int64).astype(object) % 2**64) > 0).all()


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 120])
def test_decontamination(spark, odd, empty, block):
    items = [(1, "Quick brown fox"), (20, "JUMPS over, the lazy dog -- near the old river bank at dawn. Extra words that differ"), (3, None), (100, "..."), (4, "don"), (7, "quick brown FOX")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.decontaminate(odd, bench, keep=["doc_id", "text"], block_bytes=block, spans=True)
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in got.collect()], key=str) == plain_hits(docs(odd), items)
    clean = {r.doc_id: r.clean_text for r in got.collect()}
    assert clean[5] == "The  jumps over the lazy dog near the old river bank at dawn" and clean[6] == "a" and clean[9] == ""
    assert decontam.decontaminate(odd, bench.where("false")).where("n_hit > 0").isEmpty() and decontam.decontaminate(empty, bench).count() == 0


def test_decontamination_by_blocks_keeps_only_the_key(spark, odd):
    items = [(i, f"{w} brown fox") for i, w in enumerate(["quick", "slow", "red"] * 4)] + [(20, "the lazy dog near the old river bank at dawn"), (21, "line two is here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(decontam.blocks(bench, "item_id", "text", 60)) > 2
    got = decontam.decontaminate(odd, bench, keep=["doc_id"], block_bytes=60)
    assert got.columns == ["doc_id", "n_words", "n_hit", "item_ids", "contaminated"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_hits(docs(odd), items)


# 9 ----------------------------------------------------------------------------------------------------------------


def test_fingerprints(spark, odd, empty):
    rows = odd.where("doc_id is null or doc_id <> 7").select("doc_id", "text")
    for size in (3, 2000):
        got = {r.doc_id: r for r in fingerprints.with_next(rows, bucket_rows=size).collect()}
        order = sorted(docs(rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
        assert len(got) == len(order)
        for (k, t), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
            edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
            assert got[k].n_chars == len(t) and got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            prints = fingerprints.fingerprints(np.frombuffer(b"".join(x.encode() for x in (t, edited, after)), np.uint8), np.cumsum([0, *(len(x.encode()) for x in (t, edited, after))]))
            assert (got[k].fingerprint, got[k].edited_fingerprint) == tuple(prints[:2])
            assert [got[k].near_edited, got[k].near_next] == fingerprints.likeness([prints[0]] * 2, prints[1:]).tolist()
    assert fingerprints.with_next(empty).count() == 0
    one = fingerprints.with_next(rows.where("doc_id = 8")).first()
    assert one.near_next == 1.0


def test_likeness_tells_edits_from_strangers(spark, data):
    got = queries.op9_piecewise_fingerprint(spark, data).toPandas()
    assert got["near_edited"].median() > 0.45 and got["near_next"].median() == 0 and got[["near_edited", "near_next"]].stack().between(0, 1).all()
    rng = np.random.default_rng(0)
    a, b = (["".join(rng.choice(list("abc"), rng.integers(0, 9))) for _ in range(200)] for _ in range(2))
    assert fingerprints.distances(a, b).tolist() == [plain_distance(x, y) for x, y in zip(a, b, strict=True)]


def test_repeats_leave_room_for_the_rest_of_a_text():
    rng = np.random.default_rng(4)
    prose = lambda n: " ".join("".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(n))
    of = lambda *t: fingerprints.fingerprints(np.frombuffer("".join(t).encode(), np.uint8), np.cumsum([0, *map(len, t)]))
    block, tail = (prose(30)[:99] + "\n") * 250, prose(14_000)[:78_000]
    a, b, c = of(block + tail, block + prose(14_000)[:78_000], block + tail[:40_000] + "changed" + tail[40_007:])
    _, a0, a1 = a.split(":")
    assert len(a0) > 20 and len(a1) > 10 and max(len(a0), len(a1)) <= fingerprints.MOST
    other, edited = fingerprints.likeness([a, a], [b, c]).tolist()
    assert other < 0.5 and 0.8 < edited < 1
    shuffled = "".join(rng.permutation([x + "\n" for x in (prose(3) for _ in range(4_000))]))
    many = fingerprints._signatures(kernels.mix(np.arange(1, 1001, dtype=np.uint64)), np.zeros(1000, np.int64), kernels.mix(np.arange(5, 1005, dtype=np.uint64)), 1)[0]
    late = kernels.mix(np.arange(1, 1001, dtype=np.uint64))
    late[900] += np.uint64(1)
    moved = fingerprints._signatures(late, np.zeros(1000, np.int64), kernels.mix(np.arange(5, 1005, dtype=np.uint64)), 1)[0]
    assert len(many) == fingerprints.MOST and sum(x != y for x, y in zip(many, moved, strict=True)) <= 1
    assert len(of(shuffled)[0]) <= 2 * fingerprints.MOST + 5


# 10 ---------------------------------------------------------------------------------------------------------------


def test_languages(spark, data, odd, empty):
    got = queries.op10_language_filters(spark, data).join(store.table(spark, data, "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.9 and got["score"].between(0, 1).all()
    model = langid.train(odd)
    rows = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert {k for k, r in rows.items() if r.lang_pred == "und"} == {9, 1, 2} and rows[9].score == 0 and rows[5].lang_pred == "en"
    digits = spark.createDataFrame([(1, "123 !"), (2, "×÷ 5"), (3, "é")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in langid.identify(digits, model).orderBy("doc_id").collect()] == [True, True, False]
    none = langid.train(empty)
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"} and langid.identify(empty, none).count() == 0


# pipeline ---------------------------------------------------------------------------------------------------------


def test_stages_leave_other_columns_alone(spark, data, odd):
    import corpus_pipeline

    marked = odd.withColumns({c: F.lit(7).cast(odd.schema[c].dataType) for c in ("score", "predicted", "n_words", "n_hit", "n_tokens", "weight", "_kept", "_hit")})
    for _, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, marked, data)
        assert got.columns == marked.columns and got.where("score <> 7 or predicted <> 7 or n_words <> 7 or n_hit <> 7 or weight <> 7").isEmpty()


def test_pipeline(spark, data):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "temperature mixing", "token ids"]
    table, scratch, inputs = store.table(spark, data, "documents"), store.Scratch(spark, "test"), []
    now = table
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(now)
        now = scratch.write(stage(spark, now, data), f"s{k}")
        if k < 4:
            assert now.columns == table.columns
    ids = lambda df: {r.doc_id for r in df.collect()}
    model = quality.train(table, store.table(spark, data, "labels"))
    assert ids(inputs[1]) == ids(quality.rate(table, model).where("predicted = 1"))
    assert ids(inputs[2]) == {k for k, _, c, kept in plain_components(docs(inputs[1]), 5, 80) if kept}
    bench = [(r.item_id, r.text) for r in store.table(spark, data, "benchmark").collect()]
    assert ids(inputs[3]) == {k for k, *_, bad in plain_hits(docs(inputs[2]), bench) if not bad}
    used = {r.doc_id: r.n_uses for r in mixing.uses(inputs[3], keep=["doc_id"]).collect()}
    assert sum(used.values()) == inputs[4].count() == now.count()
    whole = corpus_pipeline.run(spark, data)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, now.collect()))


def test_stages_take_odd_and_empty_tables(spark, data, odd, empty):
    import corpus_pipeline

    for docs_ in (odd, empty):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            got = stage(spark, docs_, data)
            assert got.columns == docs_.columns if k < 4 else got.count() == docs_.count()
            got.write.format("noop").mode("overwrite").save()
