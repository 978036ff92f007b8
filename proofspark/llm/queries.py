"""Registered queries of the training-data operators, each over its whole table, with SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from proofspark.llm import chat, exact, jaccard, langid, mixing, orc, orchard, packing, prefix_trie, quality, secret_scan, tiff, toxicity
from proofspark.llm.common import read
from proofspark.session import scratch_dir

BYTE_LEVEL, WORD_LEVEL = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repaired(read(spark, sf_dir, "conversations"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = packing.token_table(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_LEVEL))
    return packing.pieces(tokens, keep=False).drop("ids")


def op4_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.features(tiff.tiff_pages(tiff.stored(read(spark, sf_dir, "documents"))))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(read(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(read(spark, sf_dir, "documents"))


def _places(mixture: DataFrame) -> DataFrame:
    return mixture.select("_row.doc_id", "_row.source", F.col("_block").alias("block"), F.col("_slot").alias("slot"), F.col("_start").alias("start"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(mixing.mix(read(spark, sf_dir, "documents"), carry=["doc_id", "source"]))


def op8_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact.exact_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("full")).alias("text_sha256"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents")).drop("mark")


def op10_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "token-files")
    orc.write_token_files(read(spark, sf_dir, "documents"), folder, public_tokenizers.path(WORD_LEVEL))
    return orc.token_digests(spark, folder)


def op11_orchard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orchard.clusters(read(spark, sf_dir, "embeddings"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_chat, op2_quality, op3_packing, op4_tiff, op5_language, op6_secrets, op7_mixing, op8_exact, op9_jaccard, op10_orc,
                                      op11_orchard, op12_trie, op13_toxicity, pipeline)}

ORACLES = {
    "op7_mixing": f"""
WITH RECURSIVE
d AS (SELECT doc_id, source, coalesce('=' || source, 'none') AS key, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
             greatest(1, coalesce(length(text), 0)) AS size FROM documents),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY key ORDER BY digest, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d),
t AS (SELECT key, sum(size)::BIGINT AS size, floor(sqrt(sum(size)))::BIGINT AS weight FROM d GROUP BY key),
s AS (SELECT key, greatest(1, weight) AS share, (size + {mixing.BLOCK} - 1) // {mixing.BLOCK} AS blocks,
             row_number() OVER (ORDER BY key) AS i FROM t),
jobs AS MATERIALIZED (SELECT s.i, s.key, k, (sum(least(o.blocks * s.share, o.share * (k - 1))) // s.share)::BIGINT AS release,
                ((sum(least(o.blocks * s.share, o.share * k)) + s.share - 1) // s.share)::BIGINT AS deadline
         FROM (SELECT *, unnest(range(1, blocks + 1)) AS k FROM s) s, s o GROUP BY s.i, s.key, s.share, k),
run AS (SELECT -1::BIGINT AS slot, (SELECT list(0::BIGINT ORDER BY i) FROM s) AS placed, 0::BIGINT AS i, 0::BIGINT AS k
        UNION ALL
        SELECT r.slot + 1, list_concat(r.placed[1:j.i - 1], [j.k], r.placed[j.i + 1:]), j.i, j.k
        FROM run r, LATERAL (SELECT j.i, j.k FROM jobs j WHERE j.k = r.placed[j.i] + 1 AND j.release <= r.slot + 1 ORDER BY j.deadline, j.key LIMIT 1) j)
SELECT p.doc_id, p.source, (p.start // {mixing.BLOCK} + 1)::BIGINT AS block, run.slot, p.start
FROM p JOIN s USING (key) JOIN run ON run.i = s.i AND run.k = p.start // {mixing.BLOCK} + 1""",
    "op8_exact": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n""",
    "op9_jaccard": r"""
WITH RECURSIVE
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, least(documents.doc_id, coalesce(m.m, documents.doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = documents.doc_id""",
}


def _assign(k: int) -> str:
    """Every vector with its nearest centroid of round k."""
    return f"""
p{k} AS (SELECT v.vec_id, v.r, v.v, c.c, list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - c.w[i]) * (v.v[i] - c.w[i])))::BIGINT AS d FROM v, c{k} c),
a{k} AS (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(c, (d, c)) AS c, min(d) AS d FROM p{k} GROUP BY r)"""


def _moved(k: int) -> str:
    """Centroids of round k + 1: floors of the means, those without vectors as they were."""
    return f"""
s{k} AS (SELECT c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{k}, range(1, 65) t(i) GROUP BY c, i),
m{k} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS w FROM s{k} GROUP BY c),
c{k + 1} AS (SELECT c.c, coalesce(m.w, c.w) AS w FROM c{k} c LEFT JOIN m{k} m USING (c))"""


ORACLES["op11_orchard"] = f"""
WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1)::INT AS c, v AS w FROM v QUALIFY c < 16),
{",".join(_assign(k) + "," + _moved(k) for k in range(orchard.ROUNDS))},{_assign(orchard.ROUNDS)}
SELECT a.vec_id, a.c AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.w, ',')) AS centroid_sha256
FROM a{orchard.ROUNDS} a JOIN c{orchard.ROUNDS} c USING (c)"""

ORACLES["op12_trie"] = """
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS e,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS t
           FROM conversations WHERE conv_id IS NOT NULL),
-- unsigned crc32 of the decimal id, bit by bit
b AS (SELECT DISTINCT conv_id, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT) AS bytes FROM o),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS family, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda z, x:
             list_reduce(list_prepend(xor(z, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, k: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 6 AS h FROM b),
head AS (SELECT c.conv_id, o.t AS d, o.e, length(o.text) AS w FROM c JOIN o ON o.conv_id = c.family AND o.t <= c.h),
m AS (SELECT c.conv_id, c.h, count(head.d) AS m FROM c LEFT JOIN head USING (conv_id) GROUP BY ALL),
x AS (SELECT * FROM head UNION ALL SELECT o.conv_id, o.t - m.h + m.m, o.e, length(o.text) FROM o JOIN m USING (conv_id) WHERE o.t > m.h),
l AS (SELECT m.conv_id, coalesce(list(x.e ORDER BY x.d) FILTER (x.e IS NOT NULL), []) AS e, coalesce(list(x.w ORDER BY x.d) FILTER (x.e IS NOT NULL), []) AS w FROM m LEFT JOIN x USING (conv_id) GROUP BY 1),
p AS MATERIALIZED (SELECT conv_id, d, sha256(array_to_string(e[1:d], ',')) AS key, d = len(e) AS last, CASE WHEN d = 0 THEN 0 ELSE w[d] END AS w
                   FROM (SELECT *, unnest(range(0, len(e) + 1)) AS d FROM l)),
n AS MATERIALIZED (SELECT d, key, min(conv_id) AS conv_id, count(*) AS n, max(w) AS w, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '') AS ends FROM p GROUP BY d, key),
u AS MATERIALIZED (SELECT n.*, q.key AS up FROM n LEFT JOIN p q ON q.conv_id = n.conv_id AND q.d = n.d - 1),
k AS MATERIALIZED (SELECT u.d, u.key, u.conv_id, u.n, u.w, u.ends, r.conv_id AS parent, (SELECT count(*) FROM u y WHERE y.up = u.key AND y.d = u.d + 1) AS kids
      FROM u LEFT JOIN n r ON r.key = u.up AND r.d = u.d - 1),
t AS (SELECT q.d, q.key, count(*) FILTER (k.kids = 0) AS leaves, sum((k.n - 1) * k.w) AS saved FROM k JOIN p q ON q.conv_id = k.conv_id AND q.d <= k.d GROUP BY q.d, q.key)
SELECT k.conv_id, k.d::BIGINT AS depth, k.parent AS parent_conv_id, k.n AS n_convs, k.kids AS n_children, t.leaves AS n_leaves, t.saved::BIGINT AS saved_tokens, sha256(k.ends) AS ends_sha256
FROM k JOIN t USING (d, key)"""
