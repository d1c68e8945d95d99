"""Queries of index maintenance: what is fresh, pending, covered, and the next version of the index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking, index, retrieval, store, structure
from ..storage import scratch
from .common import table

LIMITS = chunking.Limits(target=2000, overlap=0, most=None)


def _snapshots(spark, sf_dir):
    """Two states of the documents: some changed, some touched, some new, some gone."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.col("doc_id")
    old = docs.where(n % 11 != 0).select("path", "text", F.octet_length("text").cast("long").alias("size"), n.cast("double").alias("mtime"), F.sha2("text", 256).alias("hash"))
    text = F.when(n % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = docs.where(n % 13 != 0).withColumn("text", text).select("path", "text", F.octet_length("text").cast("long").alias("size"), (n + F.when(n % 5 == 0, 3.0).otherwise(0.0)).cast("double").alias("mtime"), F.sha2("text", 256).alias("hash"))
    return old, new


def freshness_diff(spark, sf_dir):
    return index.freshness(*_snapshots(spark, sf_dir))


def freshness_summary(spark, sf_dir):
    return index.freshness_counts(freshness_diff(spark, sf_dir))


def stale_delete(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return index.stale_delete(old, new).select("path", "hash")


def _cut(files):
    return chunking.chunk_files(files, LIMITS)


def reindex_merge(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    got = index.reindex(_cut(old), old, new, _cut)
    return got.groupBy("path").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("chars"), F.max("end_line").cast("long").alias("lines"))


def index_status(spark, sf_dir):
    """Rows of each table of the index."""
    docs = table(spark, sf_dir, "documents")
    chunks = _cut(docs.select(F.col("doc_id").cast("string").alias("path"), "text"))
    part = lambda name, df: df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
    return part("files", docs).unionByName(part("chunks", chunks)).unionByName(part("embeddings", table(spark, sf_dir, "embeddings")))


def embedding_coverage(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    sets = e.select("label").distinct().select(F.col("label").alias("set_id")).unionByName(e.agg((F.max("label") + 1).alias("set_id")))
    return index.coverage(sets, e.select(F.col("label").alias("set_id"), F.col("vec_id").alias("chunk_id")))


def pending_embeddings(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("d"), F.col("doc_id") % 10).alias("path"), F.lit(1).alias("start_line"))
    return index.pending(chunks, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"))).select("chunk_id", "path")


def embed_missing(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"))
    todo = chunks.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id")), "chunk_id", "left_anti")
    got = index.embed(todo, index.length_provider(4), 4)
    return got.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.size("vector").alias("size"), F.round(F.col("vector")[0].cast("double"), 6).alias("first"))


def latest_order(spark, sf_dir):
    """The last order of each customer: the first row of a key."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    got = index.first_of_key(orders.withColumn("back", -F.unix_micros(F.col("o_orderdate").cast("timestamp"))), ["o_custkey"], ["back", "o_orderkey"])
    return got.select("o_custkey", "o_orderkey", "o_totalprice")


def upsert_files(spark, sf_dir):
    """The file table of the first state after the second one came in."""
    old, new = _snapshots(spark, sf_dir)
    return index.upsert(old.select("path", F.concat(F.lit("id"), "path").alias("id"), "hash"), new)


def _postings(files):
    """gram, path of every trigram of a file's text."""
    return files.select("path", F.explode(retrieval.grams(F.col("text"))).alias("gram"))


def repair_postings(spark, sf_dir):
    """Postings of the first state, of which some files' rows are lost and others belong to no file, brought to the second."""
    old, new = _snapshots(spark, sf_dir)
    held = _postings(old.where("CAST(path AS BIGINT) % 17 <> 0")).unionByName(_postings(old.limit(1)).withColumn("path", F.lit("nowhere")))
    return index.repaired(held, old, new, _postings).groupBy("path").agg(F.count(F.lit(1)).alias("grams"), F.min("gram").alias("first_gram"))


def _words(files):
    """path, line, first_word of every line with words: a stand-in for symbol and dependency rows."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("at", "content"))
    return lines.select("path", (F.col("at") + 1).cast("long").alias("line"), F.regexp_extract("content", "([A-Za-z]+)", 1).alias("name")).where("name <> ''")


def repair_lines(spark, sf_dir):
    """Rows by line of the first state brought to the second: changed files alone are read again."""
    old, new = _snapshots(spark, sf_dir)
    return index.repaired(_words(old), old, new, _words).groupBy("path").agg(F.count(F.lit(1)).alias("rows"), F.max("line").alias("last_line"), F.min("name").alias("first_name"))


def recommended_actions(spark, sf_dir):
    """What the index of the first state needs: its chunks, of which only those of three letters or more have postings, the
    vectors there are, and the second state's files."""
    old, new = _snapshots(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings").agg(F.count_if(F.size("embedding") == 64).alias("embeddings"))
    chunks = _cut(old).agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.length("text") >= 3).alias("posting_chunks"))
    files = old.agg(F.count(F.lit(1)).alias("files"))
    rows = _words(old).agg(F.count(F.lit(1)).alias("symbols"), F.lit(0).cast("long").alias("dependencies"))
    state = index.freshness_counts(index.freshness(old, new)).select("status")
    whole = files.crossJoin(F.broadcast(chunks)).crossJoin(F.broadcast(rows)).crossJoin(F.broadcast(e)).crossJoin(F.broadcast(state))
    return index.next_actions(whole)


def capability_records(spark, sf_dir):
    """The last event of each user and type, on top of those of every second user, as records by key."""
    events = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("kind"), F.col("event_id").alias("at"), F.round("value", 6).alias("value"))
    held = index.first_of_key(events.where("user_id % 2 = 0"), ["user_id", "kind"], ["at"])
    return index.latest_records(held, events.where("user_id % 3 <> 0"), ["user_id", "kind"]).select("user_id", "kind", "at", "value")


def _makers():
    """The tables of an index: each is made of changed files alone."""
    vectors = lambda f: _cut(f).select("path", "start_line", retrieval.letter_vector(F.col("text")).alias("vector"))
    return {"chunks": _cut, "symbols": structure.symbols, "dependencies": structure.dependencies, "postings": _postings, "vectors": vectors}


def _two_runs(spark, sf_dir):
    """An index on disk of the first state of the documents, brought to the second."""
    path = scratch(spark, "stored-index")
    return path, [store.update(path, state, _makers()) for state in _snapshots(spark, sf_dir)]


def stored_index(spark, sf_dir):
    """What the tables of the stored index hold of each file after two runs."""
    path, _ = _two_runs(spark, sf_dir)
    n = lambda t: store.read(spark, path, t).groupBy("path").agg(F.count(F.lit(1)).alias(t))
    rows = store.read(spark, path, "files").select("path", "hash")
    for t in ("chunks", "postings", "vectors"):
        rows = rows.join(n(t), "path", "left").withColumn(t, F.coalesce(t, F.lit(0)))
    return rows


def store_runs(spark, sf_dir):
    """Files by state of each of the two runs."""
    _, runs = _two_runs(spark, sf_dir)
    return spark.createDataFrame([(r.version, *r.states.values()) for r in runs], "version long, new long, modified long, missing long, kept long")


QUERIES = {f.__name__: f for f in (recommended_actions, capability_records, freshness_diff, freshness_summary, stale_delete, reindex_merge, index_status, embedding_coverage, pending_embeddings, embed_missing, latest_order, upsert_files, repair_postings, repair_lines, stored_index, store_runs)}

_SNAP = """WITH RECURSIVE b AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS path, coalesce(text, '') AS t FROM documents),
o AS (SELECT path, t, strlen(t) AS size, CAST(doc_id AS DOUBLE) AS mtime, sha256(t) AS hash FROM b WHERE doc_id % 11 <> 0),
n AS (SELECT path, t, strlen(t) AS size, doc_id + CASE WHEN doc_id % 5 = 0 THEN 3.0 ELSE 0.0 END AS mtime, sha256(t) AS hash FROM (SELECT doc_id, path, CASE WHEN doc_id % 7 = 0 THEN t || '!' ELSE t END AS t FROM b WHERE doc_id % 13 <> 0)),
s AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'missing' WHEN (o.size <> n.size OR abs(o.mtime - n.mtime) > 0.001) AND o.hash <> n.hash THEN 'modified' WHEN o.size <> n.size OR abs(o.mtime - n.mtime) > 0.001 THEN 'metadata_changed' ELSE 'fresh' END AS state FROM o FULL OUTER JOIN n ON o.path = n.path)"""
_CUT = """c AS (SELECT path, 0 AS i, CAST(0 AS BIGINT) AS pos, 1 AS line, {end0} AS fin FROM {src} UNION ALL
SELECT path, i + 1, fin, line + length(substr(t, pos + 1, fin - pos)) - length(replace(substr(t, pos + 1, fin - pos), chr(10), '')), CASE WHEN fin + 2000 >= length(t) THEN length(t) WHEN strpos(substr(t, fin + 2001, 241), chr(10)) > 0 THEN fin + 2000 + strpos(substr(t, fin + 2001, 241), chr(10)) ELSE fin + 2000 END
FROM c JOIN {src} USING (path) WHERE fin < length(t)),
k AS (SELECT path, line, substr(t, pos + 1, fin - pos) AS part FROM c JOIN {src} USING (path))"""
_END = "CASE WHEN length(t) <= 2000 THEN length(t) WHEN strpos(substr(t, 2001, 241), chr(10)) > 0 THEN 2000 + strpos(substr(t, 2001, 241), chr(10)) ELSE 2000 END"
ORACLES = {
    "stored_index": f"{_SNAP}, {_CUT.format(src='n', end0=_END)}, g AS (SELECT path, count(DISTINCT lower(substr(t, i, 3))) AS postings FROM (SELECT path, lower(t) AS t, unnest(range(1, length(t) - 1)) AS i FROM n WHERE length(t) >= 3) GROUP BY path), m AS (SELECT path, count(*) AS chunks FROM k GROUP BY path) SELECT path, hash, chunks, coalesce(postings, 0) AS postings, chunks AS vectors FROM n JOIN m USING (path) LEFT JOIN g USING (path)",
    "store_runs": f"{_SNAP}, x AS (SELECT o.path AS a, n.path AS b, o.hash = n.hash AS same FROM o FULL OUTER JOIN n ON o.path = n.path) SELECT 1 AS version, count(*) AS new, 0 AS modified, 0 AS missing, 0 AS kept FROM o UNION ALL SELECT 2, count(*) FILTER (WHERE a IS NULL), count(*) FILTER (WHERE NOT same), count(*) FILTER (WHERE b IS NULL), count(*) FILTER (WHERE same) FROM x",
    "freshness_diff": _SNAP + " SELECT * FROM s",
    "freshness_summary": _SNAP + " SELECT " + ", ".join(f"count(*) FILTER (WHERE state = '{x}') AS {x}" for x in ("new", "missing", "modified", "metadata_changed", "fresh")) + ", CASE WHEN count(*) FILTER (WHERE state IN ('new', 'missing', 'modified')) > 0 THEN 'stale' ELSE 'fresh' END AS status FROM s",
    "recommended_actions": _SNAP + ", " + _CUT.format(src="o", end0=_END) + """, m AS (SELECT (SELECT count(*) FROM o) AS files, (SELECT count(*) FROM k) AS chunks, (SELECT count(*) FROM k WHERE length(part) >= 3) AS posted, (SELECT count(*) FROM o WHERE regexp_matches(t, '[A-Za-z]')) AS symbols, (SELECT count(*) FROM embeddings WHERE len(embedding) = 64) AS vectors, (SELECT count(*) FROM s WHERE state IN ('new', 'missing', 'modified')) AS stale),
a AS (SELECT 1 AS i, 'refresh changed files' AS action FROM m WHERE stale > 0 UNION ALL SELECT 2, 'index files and chunks' FROM m WHERE files = 0 OR chunks = 0 UNION ALL SELECT 3, 'repair missing postings' FROM m WHERE posted < chunks UNION ALL SELECT 4, 'extract symbols' FROM m WHERE symbols = 0 AND files > 0 UNION ALL SELECT 5, 'extract dependencies' FROM m WHERE files > 1 UNION ALL SELECT 6, 'embed chunks' FROM m WHERE vectors = 0 UNION ALL SELECT 7, 'embed missing chunks' FROM m WHERE vectors > 0 AND vectors < chunks)
SELECT row_number() OVER (ORDER BY i) AS position, action FROM (SELECT * FROM a UNION ALL SELECT 8, 'ready' WHERE NOT EXISTS (SELECT 1 FROM a))""",
    "capability_records": "WITH h AS (SELECT user_id, event_type AS kind, min(event_id) AS at_ FROM events WHERE user_id % 2 = 0 GROUP BY 1, 2), n AS (SELECT user_id, event_type AS kind, max(event_id) AS at_ FROM events WHERE user_id % 3 <> 0 GROUP BY 1, 2), u AS (SELECT * FROM n UNION ALL SELECT h.* FROM h ANTI JOIN n USING (user_id, kind)) SELECT u.user_id, kind, at_ AS \"at\", round(value, 6) AS value FROM u JOIN events e ON e.event_id = at_ AND e.user_id = u.user_id",
    "stale_delete": _SNAP + " SELECT o.path, o.hash FROM o WHERE path IN (SELECT path FROM n)",
    "reindex_merge": _SNAP + ", " + _CUT.format(src="n", end0=_END) + " SELECT path, count(*) AS chunks, CAST(sum(length(part)) AS BIGINT) AS chars, CAST(max(line + greatest(1, length(part) - length(replace(part, chr(10), '')) + CASE WHEN part LIKE '%' || chr(10) THEN 0 ELSE 1 END) - 1) AS BIGINT) AS lines FROM k GROUP BY path",
    "index_status": _SNAP + ", " + _CUT.format(src="b", end0=_END) + " SELECT 'files' AS name, count(*) AS rows FROM documents UNION ALL SELECT 'chunks', count(*) FROM k UNION ALL SELECT 'embeddings', count(*) FROM embeddings",
    "embedding_coverage": "SELECT label AS set_id, count(vec_id) AS n FROM embeddings GROUP BY label UNION ALL SELECT max(label) + 1, 0 FROM embeddings",
    "pending_embeddings": "SELECT doc_id AS chunk_id, 'd' || doc_id % 10 AS path FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "embed_missing": "SELECT doc_id AS chunk_id, CAST(4 AS INTEGER) AS size, round(length(coalesce(text, '')) % 10 / 10.0, 6)::DOUBLE AS first FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "upsert_files": _SNAP + " SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN substr(sha256(n.path), 1, 16) ELSE 'id' || o.path END AS id, coalesce(n.hash, o.hash) AS hash, CASE WHEN o.path IS NULL THEN 'inserted' WHEN n.hash <> o.hash THEN 'updated' ELSE 'kept' END AS change FROM o FULL OUTER JOIN n ON o.path = n.path",
    "repair_postings": _SNAP + ", g AS (SELECT DISTINCT path, lower(substr(t, i, 3)) AS gram FROM (SELECT path, lower(t) AS t, unnest(range(1, length(t) - 1)) AS i FROM n WHERE length(t) >= 3)) SELECT path, count(*) AS grams, min(gram) AS first_gram FROM g GROUP BY path",
    "repair_lines": _SNAP + ", w AS (SELECT path, line, regexp_extract(c, '([A-Za-z]+)', 1) AS name FROM (SELECT path, unnest(string_split(t, chr(10))) AS c, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS line FROM n)) SELECT path, count(*) AS rows, max(line) AS last_line, min(name) AS first_name FROM w WHERE name <> '' GROUP BY path",
    "latest_order": "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS i FROM orders) WHERE i = 1",
}
