"""Queries of keyword, vector and hybrid search, and of budgets of context."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import pack, postings, search, vectors
from .common import kept, table

QUERY = "thand Ingsh eableon schach"
TERMS = [t.lower() for t in QUERY.split()]
K = 10


def _files(spark, sf_dir):
    path = F.concat(F.lit("docs/d"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.coalesce("text", F.lit("")).alias("text"))


def _postings(spark, sf_dir):
    """The keyword index of documents as files: built by the first query that asks, opened by the others."""
    one = lambda c: F.lit(1).alias(c)
    make = lambda: postings.build(_files(spark, sf_dir).select("path", F.lit(0).alias("ordinal"), one("start_line"), one("end_line"), "text"))
    return kept(spark, sf_dir, "document postings", make)


def keyword_index(spark, sf_dir):
    """What the keyword index holds."""
    index = _postings(spark, sf_dir)
    own = index.blocks.where(F.col("gram") >= 0)
    return own.agg(F.lit(index.n).alias("files"), F.countDistinct("gram").alias("grams"), F.sum(F.col("n").cast("long")).alias("postings"), F.sum(F.col("n_places").cast("long")).alias("places"))


def fts_match(spark, sf_dir):
    index = _postings(spark, sf_dir)
    rows = index.docs.join(postings.matching(index, {"q": TERMS}), "number")
    return rows.select(F.regexp_extract("path", r"d(\d+)\.md$", 1).cast("long").alias("doc_id"))


def bm25_topk(spark, sf_dir):
    index = _postings(spark, sf_dir)
    asked = spark.createDataFrame([("q", TERMS)], "query_id string, terms array<string>")
    return index.docs.join(F.broadcast(postings.search(index, asked, K)), "number").select("path", "score")  # K rows


def bm25_all(spark, sf_dir):
    return search.bm25(_files(spark, sf_dir), TERMS).withColumn("score", F.round("score", 6))


def like_fallback(spark, sf_dir):
    return search.like_fallback(_files(spark, sf_dir), "Q_").orderBy("score", "path").limit(50)


def _probe(spark, sf_dir):
    """One stored vector as the query: a row by its key."""
    return [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 3").first()["embedding"]]


def knn_l2_topk(spark, sf_dir):
    found = search.nearest(table(spark, sf_dir, "embeddings"), _probe(spark, sf_dir), K)
    return found.withColumn("distance", F.round("distance", 6))


def _vectors(spark, sf_dir):
    return kept(spark, sf_dir, "vectors", lambda: vectors.build(table(spark, sf_dir, "embeddings").where("vec_id IS NOT NULL"), ["vec_id"], "embedding", 64))


def _asked(spark, sf_dir):
    """Every vector whose id is divisible by 50."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def knn_table(spark, sf_dir):
    """The nearest vectors of a table of queries, over the clustered index."""
    near, _ = vectors.nearest(_vectors(spark, sf_dir), _asked(spark, sf_dir), K)
    return near.select("query_id", F.col("position").cast("long").alias("position"), "vec_id", F.round("distance", 6).alias("distance"))


def knn_visits(spark, sf_dir):
    """How much of the index exact and approximate answers look at, and what the approximate ones find."""
    index, asked = _vectors(spark, sf_dir), _asked(spark, sf_dir)
    exact, met = vectors.nearest(index, asked, K)
    near, fewer = vectors.nearest(index, asked, K, probes=vectors.probes_for(index, K))
    hits = exact.select("query_id", "vec_id").join(near.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    return hits.join(met.select("query_id", F.col("share").alias("exact_share")), "query_id").join(fewer.select("query_id", F.col("share").alias("approximate_share")), "query_id")


def _legs(spark, sf_dir):
    semantic = search.nearest(table(spark, sf_dir, "embeddings"), _probe(spark, sf_dir), 2 * K).select(F.col("vec_id").alias("key"), F.round("distance", 9).alias("distance"))
    files = _files(spark, sf_dir)
    keyword = search.bm25(files, TERMS).join(files.select("path", "doc_id"), "path").select(F.col("doc_id").alias("key"), F.round("score", 9).alias("score")).orderBy("score", "key").limit(2 * K)
    return semantic, keyword


def hybrid_merge(spark, sf_dir):
    got = search.fuse(*_legs(spark, sf_dir), 3 * K)
    return got.select("key", F.round("score", 6).alias("score"), F.array_join("kinds", "+").alias("kinds"), F.round("distance", 6).alias("distance"), F.round("keyword_score", 6).alias("keyword_score"))


def line_search_rank(spark, sf_dir):
    found = search.line_search(_files(spark, sf_dir), TERMS)
    return found.select("path", F.round("score", 6).alias("score"), F.col("first_line").cast("long").alias("first_line")).orderBy(F.desc("score"), "first_line", "path").limit(25)


def _ranked_snippets(spark, sf_dir):
    """Each source's ten longest documents as results of a query that is the source's name."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("query"), F.coalesce("text", F.lit("")).alias("text"))
    at = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.length("text")), "doc_id"))
    return docs.withColumn("position", at).where("position <= 10").select("query", "position", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), T.compact_snippet(F.col("text"), 800).alias("snippet"))


def context_budget(spark, sf_dir):
    got = pack.budgeted(_ranked_snippets(spark, sf_dir), 3000)
    return got.select("query", "position", "path", F.sha2("snippet", 256).alias("snippet_hash"), F.length("snippet").alias("chars"), "truncated")


def context_summary(spark, sf_dir):
    return pack.summary(pack.budgeted(_ranked_snippets(spark, sf_dir), 3000))


QUERIES = {f.__name__: f for f in (keyword_index, fts_match, bm25_topk, bm25_all, like_fallback, knn_l2_topk, knn_table, knn_visits, hybrid_merge, line_search_rank, context_budget, context_summary)}

_FILES = "f AS (SELECT doc_id, 'docs/d' || doc_id || '.md' AS path, coalesce(text, '') AS text FROM documents)"
_count = lambda c, t: f"CAST((length({c}) - length(replace({c}, '{t}', ''))) / {len(t)} AS INTEGER)"
_BM25 = f"""{_FILES}, o AS (SELECT doc_id, path, 2 * greatest(length(path) - 2, 0) + greatest(length(text) - 2, 0) AS d, {', '.join(f"2 * {_count('lower(path)', t)} + {_count('lower(text)', t)} AS f{i}" for i, t in enumerate(TERMS))} FROM f),
s AS (SELECT count(*) AS n, avg(d) AS m, {', '.join(f'count(*) FILTER (WHERE f{i} > 0) AS n{i}' for i in range(len(TERMS)))} FROM o),
b AS (SELECT doc_id, path, -({' + '.join(f'(CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * d / m))' for i in range(len(TERMS)))}) AS score FROM o, s WHERE {' OR '.join(f'f{i} > 0' for i in range(len(TERMS)))})"""
_KNN = f"v AS (SELECT e.vec_id, sqrt(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) ** 2))) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q ORDER BY distance, vec_id LIMIT "
_SNIPPETS = r"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, 'none') AS query, coalesce(text, '') AS text FROM documents),
r AS (SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY length(text) DESC, doc_id) AS INTEGER) AS position, 'd' || doc_id AS path, regexp_replace(text, '\s+$', '') AS t FROM d),
s AS (SELECT query, position, path, CASE WHEN length(t) > 800 THEN substr(t, 1, 797) || '...' ELSE t END AS snippet FROM r WHERE position <= 10),
w AS (SELECT query, 0 AS position, '' AS path, '' AS snippet, 3000 AS remaining, false AS truncated FROM (SELECT DISTINCT query FROM s)
  UNION ALL
  SELECT query, position, path, new, remaining - length(new), cut FROM (
    SELECT s.query, s.position, s.path, w.remaining, length(s.snippet) > w.remaining AS cut, CASE WHEN length(s.snippet) <= w.remaining THEN s.snippet
      WHEN w.remaining >= 16 THEN regexp_replace(substr(s.snippet, 1, w.remaining - 16), '\s+$', '') || chr(10) || '... [truncated]'
      WHEN w.remaining >= 15 THEN '... [truncated]' ELSE '' END AS new
    FROM w JOIN s ON s.query = w.query AND s.position = w.position + 1) x),
p AS (SELECT * FROM w WHERE position > 0) """
ORACLES = {
    "keyword_index": f"WITH {_FILES}, g AS (SELECT doc_id, lower(path) AS x FROM f UNION ALL SELECT doc_id, lower(text) FROM f), w AS (SELECT doc_id, substr(x, i, 3) AS gram FROM (SELECT doc_id, x, unnest(range(1, length(x) - 1)) AS i FROM g WHERE length(x) >= 3)) SELECT (SELECT count(*) FROM f) AS files, count(DISTINCT gram) AS grams, count(DISTINCT (doc_id, gram)) AS postings, count(*) AS places FROM w",
    "knn_table": f"SELECT * FROM (SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(d, 9), e_id) AS position, e_id AS vec_id, round(d, 6) AS distance FROM (SELECT q.vec_id, e.vec_id AS e_id, sqrt(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) ** 2))) AS d FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q) q) WHERE position <= {K}",
    "fts_match": f"WITH {_FILES} SELECT doc_id FROM f WHERE {' OR '.join(f'contains(lower(path || chr(10) || text), {t!r})' for t in TERMS)}",
    "bm25_topk": f"WITH {_BM25} SELECT path, round(score, 6) AS score FROM b ORDER BY 2, 1 LIMIT {K}",
    "bm25_all": f"WITH {_BM25} SELECT path, round(score, 6) AS score FROM b",
    "like_fallback": f"WITH {_FILES}, g AS (SELECT path, translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS p, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM f) SELECT path, CASE WHEN p LIKE '%q_%' THEN -10.0::DOUBLE ELSE -1.0::DOUBLE END AS score FROM g WHERE p LIKE '%q_%' OR t LIKE '%q_%' ORDER BY score, path LIMIT 50",
    "knn_l2_topk": f"WITH {_KNN}{K}) SELECT vec_id, round(distance, 6) AS distance FROM v",
    "hybrid_merge": f"""WITH {_BM25}, {_KNN}{2 * K}), s AS (SELECT vec_id AS key, round(distance, 9) AS distance, row_number() OVER (ORDER BY round(distance, 9), vec_id) - 1 AS i FROM v),
w AS (SELECT doc_id AS key, round(score, 9) AS score, row_number() OVER (ORDER BY round(score, 9), doc_id) - 1 AS i FROM b ORDER BY round(score, 9), doc_id LIMIT {2 * K}),
x AS (SELECT coalesce(s.key, w.key) AS key, CASE WHEN s.key IS NULL THEN 0 ELSE 1 / (1 + greatest(distance, 0)) + greatest(0, 0.2 - 0.01 * s.i) END + CASE WHEN w.key IS NULL THEN 0 ELSE 1.2 + greatest(0, 0.3 - 0.02 * w.i) + least(0.5, abs(score) / 10) END AS total, s.key IS NOT NULL AS a, w.key IS NOT NULL AS k, distance, score FROM s FULL OUTER JOIN w ON s.key = w.key)
SELECT key, round(total, 6) AS score, CASE WHEN a AND k THEN 'semantic+keyword' WHEN a THEN 'semantic' ELSE 'keyword' END AS kinds, round(distance, 6) AS distance, round(x.score, 6) AS keyword_score FROM x ORDER BY total DESC, key LIMIT {3 * K}""".replace("s AS (SELECT count(*) AS n,", "st AS (SELECT count(*) AS n,").replace("FROM o, s WHERE", "FROM o, st WHERE"),
    "line_search_rank": f"""WITH {_FILES}, l AS (SELECT path, unnest(string_split(text, chr(10))) AS c, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM f),
h AS (SELECT path, line, {' + '.join(_count('lower(c)', t) for t in TERMS)} AS hits, {' + '.join(f"CASE WHEN contains(lower(c), '{t}') THEN 1 ELSE 0 END" for t in TERMS)} AS kinds FROM l)
SELECT path, CAST(round(sum(hits + 0.25 * kinds), 6) AS DOUBLE) AS score, min(line) AS first_line FROM h WHERE hits > 0 GROUP BY path ORDER BY score DESC, first_line, path LIMIT 25""",
    "context_budget": _SNIPPETS + "SELECT query, position, path, sha256(snippet) AS snippet_hash, CAST(length(snippet) AS INTEGER) AS chars, truncated FROM p",
    "context_summary": _SNIPPETS + "SELECT query, count(*) AS results, CAST(sum(length(snippet)) AS BIGINT) AS used_chars, CAST(ceil(sum(length(snippet)) / 4.0) AS BIGINT) AS tokens, count(*) FILTER (WHERE truncated) AS truncated FROM p GROUP BY query",
}
