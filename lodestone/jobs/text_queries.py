"""Queries of chunking, terms, snippets and hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, index
from .common import table

MOST_BYTES = 6000
LIMITS = chunking.Limits(target=1500, overlap=200, most=None)
SQL_MOST = 80  # the SQL of the chunks stops here, after about 104,000 characters; the queries do not


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def file_filter(spark, sf_dir):
    size = F.octet_length("text").cast("long")
    rows = _docs(spark, sf_dir).select("doc_id", size.alias("size"))
    big = F.col("size") > MOST_BYTES
    return rows.select("doc_id", "size", F.when(big, "too_large").otherwise("indexed").alias("reason"), F.when(big, F.concat(F.col("size").cast("string"), F.lit(f" bytes > {MOST_BYTES} bytes"))).alias("detail"))


def skip_summary(spark, sf_dir):
    rows = file_filter(spark, sf_dir)
    first = F.array_join(F.slice(F.sort_array(F.collect_list("doc_id")), 1, 5), ",")
    # five samples a reason: the least ids of each task meet in the end
    low = rows.groupBy("reason").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    sample = rows.select("reason", "doc_id").where(F.col("reason") == "too_large").orderBy("doc_id").limit(5).groupBy("reason").agg(first.alias("samples"))
    return low.join(F.broadcast(sample), "reason", "left")  # one row


def content_hash(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("hash"), F.length("text").cast("long").alias("chars"))


def dedupe_by_hash(spark, sf_dir):
    rows = content_hash(spark, sf_dir)
    return rows.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def _chunks(spark, sf_dir):
    files = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), "text")
    return chunking.chunk_files(files, LIMITS)


def chunk_text(spark, sf_dir):
    return _chunks(spark, sf_dir).select(F.col("path").cast("long").alias("doc_id"), "ordinal", "start_line", "end_line", F.length("text").alias("chars"), "hash")


def chunk_stats(spark, sf_dir):
    return chunking.chunk_stats(_chunks(spark, sf_dir))


def keyword_terms(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.array_join(T.keyword_terms(F.coalesce("text", F.lit(""))), " ").alias("terms"))


def split_identifier(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    name = F.concat(F.lit("onUser"), F.initcap("event_type"), F.lit("_eventID2Value"))
    return rows.select("event_type", "n", F.array_join(T.split_identifier(name), " ").alias("words"))


def query_terms(spark, sf_dir):
    rows = table(spark, sf_dir, "pages")
    return rows.select("page_id", F.array_join(T.query_terms(F.coalesce("url", F.lit(""))), " ").alias("terms"))


def compact_snippet(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.compact_snippet(F.col("text"), 240).alias("snippet"), T.truncate_text(F.col("text"), 120).alias("short"))


def token_estimate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.estimate_tokens(F.length("text")).cast("long").alias("tokens"))


def grep_keywords(spark, sf_dir):
    rows = table(spark, sf_dir, "pages")
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return rows.select("page_id", F.array_join(T.grep_keywords(F.lit("find processPayment logging"), path), " ").alias("words"))


def match_reason(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("embedding")[0].cast("double") + 1).alias("distance"))
    n = F.col("vec_id") % 5
    kinds = F.when(n == 0, F.array(F.lit("semantic"), F.lit("keyword"))).when(n == 1, F.array(F.lit("keyword"))).when(n == 2, F.array(F.lit("local"))).otherwise(F.array(F.lit("semantic")))
    distance = F.when(n < 4, F.round("distance", 4))
    return rows.select("vec_id", T.match_reason(kinds, distance, F.lit(None).cast("double")).alias("reason"))


def embedding_text(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark")
    return rows.select("item_id", T.embedding_text("query", F.col("text")).alias("query"), T.embedding_text("document", F.col("text"), F.concat(F.lit("item "), F.col("item_id").cast("string"))).alias("document"))


def valid_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows.groupBy("label").agg(F.count_if(T.valid_vector(F.col("embedding"), 64)).alias("valid"), F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (file_filter, skip_summary, content_hash, dedupe_by_hash, chunk_text, chunk_stats, keyword_terms, split_identifier, query_terms, compact_snippet, token_estimate, grep_keywords, match_reason, embedding_text, valid_vectors)}

_CHUNKS = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS (
  SELECT doc_id, 0 AS ordinal, 1 AS line, CAST(0 AS BIGINT) AS pos, CASE WHEN length(t) <= {LIMITS.target} THEN length(t) ELSE
    CASE WHEN strpos(substr(t, {LIMITS.target} + 1, 241), chr(10)) > 0 THEN {LIMITS.target} + strpos(substr(t, {LIMITS.target} + 1, 241), chr(10)) ELSE {LIMITS.target} END END AS fin FROM d
  UNION ALL
  SELECT doc_id, ordinal + 1, line + length(substr(t, pos + 1, nxt - pos)) - length(replace(substr(t, pos + 1, nxt - pos), chr(10), '')), nxt,
    CASE WHEN nxt + {LIMITS.target} >= length(t) THEN length(t) ELSE nxt + {LIMITS.target} + CASE WHEN strpos(substr(t, nxt + {LIMITS.target} + 1, 241), chr(10)) > 0 THEN strpos(substr(t, nxt + {LIMITS.target} + 1, 241), chr(10)) ELSE 0 END END
  FROM (SELECT c.*, d.t, CASE WHEN b <= pos THEN fin ELSE b END AS nxt FROM (
    SELECT c.*, CASE WHEN strpos(substr(d.t, greatest(pos, fin - {LIMITS.overlap}) + 1, fin - greatest(pos, fin - {LIMITS.overlap})), chr(10)) > 0
      THEN greatest(pos, fin - {LIMITS.overlap}) + strpos(substr(d.t, greatest(pos, fin - {LIMITS.overlap}) + 1, fin - greatest(pos, fin - {LIMITS.overlap})), chr(10)) ELSE greatest(pos, fin - {LIMITS.overlap}) END AS b
    FROM c JOIN d USING (doc_id) WHERE fin < length(d.t) AND ordinal + 1 < {SQL_MOST}) c JOIN d USING (doc_id)) x
),
k AS (SELECT doc_id, ordinal, line AS start_line, substr(t, pos + 1, fin - pos) AS part FROM c JOIN d USING (doc_id)),
e AS (SELECT *, start_line + greatest(1, length(part) - length(replace(part, chr(10), '')) + CASE WHEN part LIKE '%' || chr(10) THEN 0 ELSE 1 END) - 1 AS end_line FROM k)
"""
_T = "coalesce(text, '')"
ORACLES = {
    "file_filter": f"SELECT doc_id, strlen({_T}) AS size, CASE WHEN strlen({_T}) > {MOST_BYTES} THEN 'too_large' ELSE 'indexed' END AS reason, CASE WHEN strlen({_T}) > {MOST_BYTES} THEN CAST(strlen({_T}) AS VARCHAR) || ' bytes > {MOST_BYTES} bytes' END AS detail FROM documents",
    "skip_summary": f"WITH f AS (SELECT doc_id, strlen({_T}) AS size, CASE WHEN strlen({_T}) > {MOST_BYTES} THEN 'too_large' ELSE 'indexed' END AS reason FROM documents) SELECT reason, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, CASE WHEN reason = 'too_large' THEN array_to_string(list_slice(list(doc_id ORDER BY doc_id), 1, 5), ',') END AS samples FROM f GROUP BY reason",
    "content_hash": f"SELECT doc_id, sha256({_T}) AS hash, length({_T}) AS chars FROM documents",
    "dedupe_by_hash": f"SELECT sha256({_T}) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "chunk_text": _CHUNKS + "SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, CAST(length(part) AS INTEGER) AS chars, sha256(CAST(doc_id AS VARCHAR) || chr(10) || start_line || chr(10) || end_line || chr(10) || part) AS hash FROM e",
    "chunk_stats": _CHUNKS + "SELECT count(DISTINCT doc_id) AS files, count(*) AS chunks, CAST(sum(length(part)) AS BIGINT) AS characters FROM e",
    "keyword_terms": r"WITH w AS (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_.$/-]{2,}') AS a FROM conversations) SELECT conv_id, turn, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ' ') AS terms FROM w",
    "split_identifier": r"SELECT event_type, count(*) AS n, 'on user ' || lower(event_type) || ' event id2 value' AS words FROM events GROUP BY event_type",
    "query_terms": r"""WITH w AS (SELECT page_id, regexp_extract_all(coalesce(url, ''), '[\p{L}\p{N}_.$/-]{2,}') AS a FROM pages),
x AS (SELECT page_id, flatten(list_transform(a, lambda t: list_concat([lower(t)], list_filter(list_transform(string_split_regex(regexp_replace(t, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+'), lambda p: lower(p)), lambda p: length(p) >= 2)))) AS b FROM w)
SELECT page_id, array_to_string(list_filter(b, lambda v, i: list_position(b, v) = i), ' ') AS terms FROM x""",
    "compact_snippet": rf"WITH d AS (SELECT doc_id, {_T} AS text, regexp_replace({_T}, '\s+$', '') AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 240 THEN substr(t, 1, 237) || '...' ELSE t END AS snippet, CASE WHEN length(text) > 120 THEN regexp_replace(substr(text, 1, 104), '\s+$', '') || chr(10) || '... [truncated]' ELSE text END AS short FROM d",
    "token_estimate": f"SELECT doc_id, CAST(ceil(length({_T}) / 4.0) AS BIGINT) AS tokens FROM documents",
    "grep_keywords": r"WITH w AS (SELECT page_id, list_concat(['find', 'processPayment', 'logging'], list_filter(string_split_regex(regexp_replace(url, '^[a-z]+://', ''), '[/._-]+'), lambda p: length(p) >= 3)) AS a FROM pages) SELECT page_id, array_to_string(list_slice(list_filter(a, lambda v, i: list_position(a, v) = i), 1, 8), ' ') AS words FROM w",
    "match_reason": "SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN 'semantic similarity plus keyword/path match' WHEN 1 THEN 'keyword/path match' WHEN 2 THEN 'local code-aware related file' WHEN 3 THEN 'semantic similarity distance ' || printf('%.4f', round(CAST(embedding[1] AS DOUBLE) + 1, 4)) ELSE 'ranked match' END AS reason FROM embeddings",
    "embedding_text": "SELECT item_id, 'task: code retrieval | query: ' || text AS query, 'title: item ' || item_id || ' | text: ' || text AS document FROM benchmark",
    "valid_vectors": "SELECT label, count(*) FILTER (WHERE len(embedding) = 64) AS valid, count(*) AS n FROM embeddings GROUP BY label",
}
