"""Registered queries of the training-data operators: each over its whole table, returning its contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazone.llm import decontam, fingerprints, fuzzylines, langid, minhash, mixing, quality, sharding, store, suffix, tokens
from terrazone.llm.store import table


def op1_suffix_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeats(table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (SELECT doc_id, i, md5(h[2 * i + 1:2 * i + 800]) AS g FROM (SELECT doc_id, h, unnest(range(n - 399)) AS i FROM d WHERE n >= 400)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS c FROM s) WHERE c > 1),
e AS (SELECT doc_id, i, sum(CASE WHEN i <= last + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS last FROM r)),
x AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS b FROM e GROUP BY doc_id, run),
y AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM x GROUP BY doc_id),
z AS (SELECT x.doc_id, string_agg(h[2 * b + 1:2 * nxt], '' ORDER BY a) AS rest, min(a) AS head FROM (SELECT *, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), 1000000000) AS nxt FROM x) x JOIN d USING (doc_id) GROUP BY x.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN rest IS NULL THEN h ELSE h[1:2 * head] || rest END)) AS kept_sha256
FROM d LEFT JOIN y USING (doc_id) LEFT JOIN z USING (doc_id)
"""


#: File name of the vocabulary of op2; the package finds its place on the machine.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.Scratch(spark, "tokens").path("ids")
    tokens.write(table(spark, sf_dir, "documents"), path, vocabulary())
    return tokens.read(spark, path)


def op3_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), n=4)


OP3_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN c cx ON x = cx.doc_id JOIN c cy ON y = cy.doc_id WHERE 100 * common >= 80 * (cx.n + cy.n - common)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT x, min(y) AS least FROM r GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least AS component_id, d.doc_id = least AS kept
FROM d LEFT JOIN c USING (doc_id) JOIN m ON d.doc_id = m.x
"""


def op4_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    return quality.rate(docs, model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzylines.dedup(table(spark, sf_dir, "documents"), min_words=1, distance=None)


def op6_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), keep=["doc_id"])


#: CRC-32 by its table of 256 remainders, a byte at a time; cuts nearest to the sixteenths of all bytes.
OP6_SQL = """
WITH RECURSIVE t(i, c, k) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM t WHERE k = 8),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) + 1 AS size, substr(md5(coalesce(text, '')), 1, 15) AS m FROM documents),
b AS (SELECT doc_id, list_transform(range(size - 1), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT)) AS b FROM d),
c AS (SELECT doc_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda x, y: xor(x >> 8, tab[(xor(x, y) & 255) + 1])), 4294967295) AS text_crc32 FROM b, tab),
o AS (SELECT doc_id, size, m, sum(size) OVER (ORDER BY m, doc_id) - size AS before, sum(size) OVER () AS total FROM d),
cuts AS (SELECT CASE WHEN j * total - before * 16 > (before + size) * 16 - j * total THEN before + size ELSE before END AS cut FROM o, range(1, 16) g(j) WHERE before * 16 < j * total AND (before + size) * 16 >= j * total),
s AS (SELECT *, (SELECT count(*) FROM cuts WHERE cut <= before) AS shard FROM o)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY m, doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s JOIN c USING (doc_id)
"""


def op7_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.uses(table(spark, sf_dir, "documents"), keep=["doc_id", "source"])
    return found.withColumn("weight", F.round("weight", 9))


_H60 = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"
_EDGES = """
g{k} AS (SELECT (SELECT lo FROM a{j}) + (SELECT width FROM a{j}) * i / 100 AS a FROM range(101) t(i)),
a{k} AS (SELECT coalesce(max(a), 0) AS lo, (SELECT width FROM a{j}) / 100 AS width FROM (
  SELECT a, sum(pow(share, a)) AS z, sum(pow(share, a) * ln(share)) AS y, count(*) AS n FROM g{k}, shares WHERE share > 0 GROUP BY a) WHERE ln(z) - a * y / z >= 0.95 * ln(n))"""
OP7_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce('=' || source, '-') AS src, CAST(doc_id AS VARCHAR) AS id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
shares AS (SELECT src, sum(n_tokens) AS tokens, count(*) AS n, sum(n_tokens) / (SELECT CAST(sum(n_tokens) AS DOUBLE) FROM d) AS share FROM d GROUP BY src),
a0 AS (SELECT CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS width),{",".join(_EDGES.format(k=k, j=k - 1) for k in range(1, 7))},
w AS (SELECT *, floor(weight * (SELECT sum(n_tokens) FROM d) + 1e-6) AS quota FROM (SELECT *, pow(share, least(lo, 1)) / sum(pow(share, least(lo, 1))) OVER () AS weight FROM shares, a6)),
e AS (SELECT *, floor(quota / tokens) AS epochs, quota - floor(quota / tokens) * tokens AS rest, CAST(ceil(n / 1000.0) AS BIGINT) AS blocks FROM w),
h AS (SELECT d.*, e.weight, e.epochs, e.rest, {_H60.format("'block1|' || id")} % blocks AS b, {_H60.format("'inner1|' || id")} AS v FROM d JOIN e USING (src)),
u AS (SELECT *, {_H60.format("'order1|' || src || '|' || CAST(b AS VARCHAR)")} AS u FROM h),
s AS (SELECT src, u, sum(n_tokens) AS s, any_value(rest) AS rest FROM u GROUP BY src, u),
c AS (SELECT *, coalesce(sum(s) OVER (PARTITION BY src ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
i AS (SELECT u.doc_id, u.source, u.n_tokens, u.weight, u.epochs, u.u, c.before, c.s, u.rest, sum(u.n_tokens) OVER (PARTITION BY u.src, u.u ORDER BY v) AS inner_sum FROM u JOIN c ON u.src = c.src AND u.u = c.u)
SELECT doc_id, source, n_tokens, round(weight, 9) AS weight, u AS block_order,
  CAST(epochs + CASE WHEN before + s <= rest THEN 1 WHEN before <= rest AND before + inner_sum <= rest THEN 1 ELSE 0 END AS INTEGER) AS n_uses FROM i
"""


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    digest = F.sha2(F.concat_ws(",", F.col("item_ids").cast("array<string>")), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


OP8_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op9_piecewise_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(table(spark, sf_dir, "documents"))


def op10_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.train(docs.where(~held_out))
    return langid.identify(docs, model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_blocks": op1_suffix_blocks,
        "op2_token_planes": op2_token_planes,
        "op3_minhash_components": op3_minhash_components,
        "op4_quality_ranking": op4_quality_ranking,
        "op5_fuzzy_lines": op5_fuzzy_lines,
        "op6_histogram_shards": op6_histogram_shards,
        "op7_temperature_mixing": op7_temperature_mixing,
        "op8_decontaminate": op8_decontaminate,
        "op9_piecewise_fingerprint": op9_piecewise_fingerprint,
        "op10_language_filters": op10_language_filters,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_blocks": OP1_SQL, "op3_minhash_components": OP3_SQL, "op6_histogram_shards": OP6_SQL, "op7_temperature_mixing": OP7_SQL, "op8_decontaminate": OP8_SQL}
