"""Queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity as t

    docs = table(spark, sf_dir, "documents")
    model = t.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return t.score(docs, model, ["doc_id", "lang"]).select("doc_id", t.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "threshold", "flagged")


def op2_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import stream_dedup

    return stream_dedup.groups(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate as d

    got = d.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), F.expr(d.CONTAMINATED).alias("contaminated"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import url_filter

    return url_filter.judge(table(spark, sf_dir, "pages"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from . import pieces

    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licences

    return licences.digests(licences.scan(table(spark, sf_dir, "documents")))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from . import token_files

    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard_join

    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import surrogates

    return surrogates.replace(table(spark, sf_dir, "documents")).select("doc_id", "n_entities", "kinds", "text")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import prefix_trie

    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from . import token_counts

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import subvectors

    return subvectors.with_inertia(*subvectors.clusters(table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_stream_dedup": op2_stream_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_warc": op4_warc,
    "op5_url_filter": op5_url_filter,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_licences": op7_licences,
    "op8_token_files": op8_token_files,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_surrogates": op10_surrogates,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_token_counts": op12_token_counts,
    "op13_centroids": op13_centroids,
}

#: Four letters of base32 for each five hex digits of a SHA-1.
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {i}, 5) AS INTEGER) >> {k}) & 31 AS INTEGER) + 1, 1)" for i in range(1, 41, 5) for k in (15, 10, 5, 0))



def _round(i: int) -> str:
    """Vectors to the nearest of the centroids c{i}, and the floors of their means as c{i + 1}."""
    return f"""a{i} AS MATERIALIZED (SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, c, list_sum(list_transform(list_zip(x.v, y.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM x, c{i} y) GROUP BY vec_id),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(n.v, o.v) AS v FROM c{i} o LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (SELECT c, i, sum(q)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS q, generate_subscripts(v, 1) AS i FROM x JOIN a{i} USING (vec_id)) GROUP BY c, i) GROUP BY c) n USING (c))"""


ORACLES: dict[str, str] = {
    "op11_prefix_trie": """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384)))) % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT h.conv_id, 0 AS part, i, role, text FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 100 AND i <= h UNION ALL SELECT conv_id, 1, i, role, text FROM t JOIN h USING (conv_id) WHERE i > h),
p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS d, role, text FROM r),
f AS (SELECT conv_id, d, list([role, text]) OVER (PARTITION BY conv_id ORDER BY d) AS front, length(text) AS len FROM p UNION ALL SELECT conv_id, 0, [], 0 FROM h),
n AS MATERIALIZED (SELECT front, d, min(conv_id) AS c, count(*) AS n, any_value(len) AS len FROM f GROUP BY front, d),
m AS MATERIALIZED (SELECT n.d, n.c, n.n, n.len, u.c AS parent FROM n LEFT JOIN n u ON u.d = n.d - 1 AND u.front = n.front[1 : n.d - 1]),
k AS MATERIALIZED (SELECT d - 1 AS d, parent AS c, count(*) AS n_children FROM m WHERE d > 0 GROUP BY 1, 2),
w AS MATERIALIZED (SELECT conv_id, f.d, c FROM f JOIN n USING (front, d)),
s AS (SELECT w.d, w.c, sum((b.n - 1) * b.len) AS saved, count(*) FILTER (WHERE k.c IS NULL) AS n_leaves FROM m b JOIN w ON w.conv_id = b.c AND w.d <= b.d LEFT JOIN k ON k.d = b.d AND k.c = b.c GROUP BY 1, 2),
e AS (SELECT d, c, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max(d) AS d FROM f GROUP BY conv_id) JOIN w USING (conv_id, d) GROUP BY d, c)
SELECT m.c AS conv_id, m.d AS depth, m.parent AS parent_conv_id, m.n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM m JOIN s USING (d, c) LEFT JOIN k USING (d, c) LEFT JOIN e USING (d, c)
""",
    "op13_centroids": f"""
WITH x AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('2:' || vec_id) AS h, v FROM x ORDER BY h LIMIT 40)),
{', '.join(_round(i) for i in range(6))}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(v, ',')) AS centroid_sha256 FROM a5 JOIN c5 USING (c)
""",
    "op4_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, strlen(t) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f
""",
    "op9_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS c FROM d UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.node)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.c) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.node = d.doc_id GROUP BY d.doc_id
""",
    "op2_stream_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
g AS (SELECT doc_id, h, count(*) OVER (PARTITION BY h) AS group_size, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g
""",
    "op3_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT item, w, least(13, len(w)) AS k, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT dw.doc_id, dw.i, dw.k, bw.item FROM dw JOIN bw USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
""",
}
