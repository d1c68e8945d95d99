"""Queries of chunk search over a project made of the documents: keyword, vector, hybrid, ranked, and packed for a reader.

The queries searched are the first four words of every benchmark item, and every language's name.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, evaluate, graph, lines, pack, retrieval, structure
from ..storage import stored
from .common import kept, table

LIMITS = chunking.Limits(target=2000, overlap=0, most=None)
K = 5
SEEDS, RELATED, DEPTH, ITEMS = 3, 6, 2, 3
EACH, SNIPPET, BUDGET = 2, 300, 1500


def _files(spark, sf_dir):
    """Three documents in a row are a source, its test, and a page about it; each imports the next three's source."""
    n = F.col("doc_id")
    stem = F.floor(n / 3).cast("string")
    path = F.when(n % 3 == 0, F.concat(F.lit("src/p"), stem, F.lit(".ts"))).when(n % 3 == 1, F.concat(F.lit("src/p"), stem, F.lit(".test.ts"))).otherwise(F.concat(F.lit("docs/p"), stem, F.lit(".md")))
    head = F.concat(F.lit("import { x } from '"), F.when(n % 3 == 2, "../src/p").otherwise("./p"), (F.floor(n / 3) + 1).cast("string"), F.lit(".js';\nexport function searchIndex"), stem, F.lit("() {}\n"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))


def _chunks(spark, sf_dir):
    make = lambda: stored(chunking.chunk_files(_files(spark, sf_dir), LIMITS).select("path", "ordinal", "start_line", "end_line", "text"), "chunks")
    return kept(spark, sf_dir, "chunks", make)


def _queries(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("query"))
    langs = table(spark, sf_dir, "documents").where("lang IS NOT NULL").select(F.concat(F.lit("l"), F.col("lang")).alias("query_id"), F.col("lang").alias("query")).distinct()
    return items.unionByName(langs)


def _keyword(spark, sf_dir, chunks, k):
    """Places of a term are counted as the SQL's replace() takes them out: one that overlaps the one before does not count."""
    index = kept(spark, sf_dir, "chunk postings", lambda: retrieval.postings_index(chunks))
    return retrieval.keyword(chunks, index, _queries(spark, sf_dir), k, apart=True)


def _semantic(spark, sf_dir, chunks, k):
    index = kept(spark, sf_dir, "chunk vectors", lambda: retrieval.vector_index(chunks, retrieval.letter_vector(F.col("text")), 8))
    return retrieval.semantic(chunks, index, _queries(spark, sf_dir).select("query_id", retrieval.letter_vector(F.col("query")).alias("vector")), k)


def _shown(df, *cols):
    line = lambda c: F.col(c).cast("long").alias(c)
    return df.select("query_id", line("position"), "path", line("ordinal"), line("start_line"), line("end_line"), *cols, F.sha2("snippet", 256).alias("snippet_hash"))


def keyword_chunks(spark, sf_dir):
    return _shown(_keyword(spark, sf_dir, _chunks(spark, sf_dir), K), "score")


def semantic_chunks(spark, sf_dir):
    return _shown(_semantic(spark, sf_dir, _chunks(spark, sf_dir), K), F.round("distance", 6).alias("distance"))


def _hybrid(spark, sf_dir, chunks):
    """Stored: ranking reads it several times, and each time would read all chunks twice."""
    return stored(retrieval.fuse(_semantic(spark, sf_dir, chunks, 2 * K), _keyword(spark, sf_dir, chunks, 2 * K), 3 * K), "fused")


def hybrid_chunks(spark, sf_dir):
    return _shown(_hybrid(spark, sf_dir, _chunks(spark, sf_dir)), "score", F.array_join("kinds", "+").alias("kinds"))


def _graph(spark, sf_dir):
    files = _files(spark, sf_dir)
    return files, stored(structure.resolve(structure.dependencies(files), files), "resolved")


def _known(fused, files, resolved):
    """Symbols and degrees of the files that ranking may ask for; lines of no other file are looked at."""
    own = files.join(F.broadcast(retrieval.candidate_paths(fused)), "path", "left_semi")  # paths of bounded results
    return stored(structure.symbols(own).select("path", "name", "line"), "symbols"), stored(graph.degrees(own.select("path"), resolved), "degrees")


def _ranked(spark, sf_dir, chunks, files, resolved):
    fused = _hybrid(spark, sf_dir, chunks)
    return retrieval.rerank(fused, _queries(spark, sf_dir), chunks, *_known(fused, files, resolved), K)


def rerank_chunks(spark, sf_dir):
    return _shown(_ranked(spark, sf_dir, _chunks(spark, sf_dir), *_graph(spark, sf_dir)), "rank_score", F.array_join("kinds", "+").alias("kinds"))


def _related(found, resolved):
    """query_id, path, depth, via, position: the files near each query's first results, in the import graph."""
    first = found.groupBy("query_id", "path").agg(F.min("position").alias("position"))
    seeds = retrieval.best(first.withColumnRenamed("position", "order"), ["order", "path"], min(SEEDS, RELATED)).select("query_id", "path", "order")
    return graph.walks(resolved, seeds, DEPTH, RELATED, ITEMS)


def _snippets(found, related, chunks):
    """Snippets of the related files that are no results themselves."""
    others = related.join(found.select("query_id", "path").distinct(), ["query_id", "path"], "left_anti")
    return pack.related_snippets(others.select("query_id", F.col("position").alias("at"), "path"), chunks, EACH, SNIPPET, BUDGET)


def related_graph_queries(spark, sf_dir):
    found = stored(_keyword(spark, sf_dir, _chunks(spark, sf_dir), K), "found")
    got = _related(found, _graph(spark, sf_dir)[1])
    return got.select("query_id", F.col("position").cast("long").alias("position"), "path", F.col("depth").cast("long").alias("depth"), "via")


def related_snippets(spark, sf_dir):
    chunks, (_, resolved) = _chunks(spark, sf_dir), _graph(spark, sf_dir)
    found = stored(_keyword(spark, sf_dir, chunks, K), "found")
    got = _snippets(found, _related(found, resolved), chunks)
    line = lambda c: F.col(c).cast("long").alias(c)
    return got.select("query_id", line("at"), "path", line("start_line"), line("end_line"), F.sha2("snippet", 256).alias("snippet_hash"), "truncated")


def context_pack(spark, sf_dir):
    chunks, (_, resolved) = _chunks(spark, sf_dir), _graph(spark, sf_dir)
    found = stored(_keyword(spark, sf_dir, chunks, K), "found")
    related = _related(found, resolved)
    primary = pack.budgeted(found.select(F.col("query_id").alias("query"), "position", "path", "snippet"), BUDGET).withColumnRenamed("query", "query_id")
    near = related.select("query_id", F.col("position").alias("at"), "path")
    got = pack.context_pack(primary, resolved, near, _snippets(found, related, chunks), ITEMS)
    return got.withColumn("paths", F.array_join("paths", ","))


def _expected(spark, sf_dir):
    """case_id, path: the files that hold an item's first six words, one after the other: an equi-join on them."""
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("case_id"), F.array_join(F.slice(F.split("text", " "), 1, 6), " ").alias("words"))
    return lines.holding(_files(spark, sf_dir).select("path", "text"), items, 6).select("case_id", "path").distinct()


def _ranks(spark, sf_dir):
    found = _keyword(spark, sf_dir, _chunks(spark, sf_dir), 20)
    return evaluate.ranks(found.select(F.col("query_id").alias("case_id"), "path", "position"), stored(_expected(spark, sf_dir), "expected"))


def retrieval_ranks(spark, sf_dir):
    return _ranks(spark, sf_dir).select("case_id", F.coalesce("rank", F.lit(0)).cast("long").alias("rank"))


def retrieval_metrics(spark, sf_dir):
    got = evaluate.gate(evaluate.measures(_ranks(spark, sf_dir)))
    return got.select("cases", *[F.round(c, 6).alias(c) for c in ("hit1", "hit3", "hit5", "mrr")], F.col("p95_rank").cast("long").alias("p95_rank"), "passed")


def _ranked_cases(found, expected):
    """case_id, rank, tokens of the expected cases; tokens are those of all snippets that a case's results show."""
    rows = found.select(F.col("query_id").alias("case_id"), "path", "position", "snippet")
    tokens = rows.groupBy("case_id").agg(T.estimate_tokens(F.sum(F.length("snippet"))).alias("tokens"))
    return evaluate.ranks(rows, expected).join(tokens, "case_id", "left")


def rerank_comparison(spark, sf_dir):
    """Measures of the hybrid search with ranking and without, and what ranking adds."""
    chunks, (files, resolved), expected = _chunks(spark, sf_dir), _graph(spark, sf_dir), stored(_expected(spark, sf_dir), "expected")
    fused = _hybrid(spark, sf_dir, chunks)
    auto = stored(retrieval.rerank(fused, _queries(spark, sf_dir), chunks, *_known(fused, files, resolved), K), "ranked")
    runs = _ranked_cases(auto, expected).withColumn("mode", F.lit("auto")).unionByName(_ranked_cases(fused.where(F.col("position") <= K), expected).withColumn("mode", F.lit("off")))
    measured = stored(evaluate.measures_by(runs, "mode"), "measured")
    names = ["hit1", "hit3", "hit5", "mrr", "tokens", "hit5_per_1k"]
    both = measured.select("mode", *names).unionByName(evaluate.delta(measured, "mode", "auto", "off", names).withColumn("mode", F.lit("delta")))
    return both.select("mode", *[F.round(n, 6).alias(n) for n in names])


def suite_metrics(spark, sf_dir):
    """Measures of the keyword search by suite: a case is in those of the languages of its expected files, and in "full".

    Pages about a source are no results and no expected files.
    """
    expected = stored(_expected(spark, sf_dir).where("path NOT LIKE 'docs/%'"), "expected")
    found = stored(_keyword(spark, sf_dir, _chunks(spark, sf_dir), 20).select(F.col("query_id").alias("case_id"), "path", "position", "snippet"), "found")
    pages = _files(spark, sf_dir).where("path LIKE 'docs/%'").select("path")
    langs = _files(spark, sf_dir).select("doc_id", "path").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    own = expected.join(langs, "path").where("lang IS NOT NULL").select("case_id", F.col("lang").alias("suite")).distinct()
    suites = own.unionByName(expected.select("case_id").distinct().withColumn("suite", F.lit("full")))
    tokens = found.groupBy("case_id").agg(T.estimate_tokens(F.sum(F.length("snippet"))).alias("tokens"))
    ranked = evaluate.ranks(found, expected, pages).join(tokens, "case_id", "left")
    got = evaluate.measures_by(suites.join(ranked, "case_id"), "suite")
    return got.select("suite", "cases", *[F.round(n, 6).alias(n) for n in ("hit1", "hit3", "hit5", "mrr", "tokens", "hit5_per_1k")])


def token_sections(spark, sf_dir):
    """Mean estimated tokens of each section of a context pack, over all queries with results."""
    packs = context_pack(spark, sf_dir)
    four = {"primary": T.estimate_tokens(F.col("primary_chars")), "related_snippets": F.col("related_tokens"), "suggested_paths": T.estimate_tokens(F.length("paths")), "snippets": F.col("tokens")}
    rows = packs.select(F.explode(F.create_map(*[x for n, c in four.items() for x in (F.lit(n), c.cast("double"))])).alias("section", "n"))
    return rows.groupBy("section").agg(F.round(F.avg("n"), 6).alias("mean_tokens"), F.max("n").cast("long").alias("most_tokens"))


#: The profiles whose measures are compared.
PROFILES = [
    {"name": "off", "mode": "off"},
    {"name": "default"},
    {"name": "path-heavy", "weights": {"path": 1.45, "symbol": 0.85, "snippet": 0.9}},
    {"name": "symbol-heavy", "weights": {"path": 0.9, "symbol": 1.45, "graph": 1.15}},
    {"name": "docs-heavy", "weights": {"path": 1.1, "snippet": 1.25, "role": 1.35, "symbol": 0.75}},
]


def profile_matrix(spark, sf_dir):
    """Measures of the hybrid search under every profile of weights, from one pass over the candidates."""
    chunks, (files, resolved), expected = _chunks(spark, sf_dir), _graph(spark, sf_dir), stored(_expected(spark, sf_dir), "expected")
    fused = _hybrid(spark, sf_dir, chunks)
    got = retrieval.rerank_profiles(fused, _queries(spark, sf_dir), chunks, *_known(fused, files, resolved), retrieval.profiles(spark, PROFILES), K)
    places = got.groupBy("profile", F.col("query_id").alias("case_id"), "path").agg(F.min("position").alias("first")).withColumn("place", F.row_number().over(Window.partitionBy("profile", "case_id").orderBy("first", "path")))
    hit = places.join(expected, ["case_id", "path"]).groupBy("profile", "case_id").agg(F.min("place").alias("rank"))
    cases = expected.select("case_id").distinct().join(F.broadcast(spark.createDataFrame([(p["name"],) for p in PROFILES], "profile string")))  # a stated list
    measured = evaluate.measures_by(cases.join(hit, ["profile", "case_id"], "left").withColumn("tokens", F.lit(0)), "profile")
    return measured.select("profile", "cases", *[F.round(n, 6).alias(n) for n in ("hit1", "hit3", "hit5", "mrr")])


def _line_cases(spark, sf_dir):
    return _queries(spark, sf_dir).where("query_id LIKE 'b%'").withColumnRenamed("query_id", "case_id")


def line_search_cases(spark, sf_dir):
    """The five best files of every case by line search, all cases in one pass over the files."""
    got = lines.search_cases(_files(spark, sf_dir).select("path", "text"), _line_cases(spark, sf_dir))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc(F.round("score", 6)), "first_line", "path"))
    return got.withColumn("position", place).where(F.col("position") <= K).select("case_id", F.col("position").cast("long").alias("position"), "path", F.round("score", 6).alias("score"), "first_line")


def method_comparison(spark, sf_dir):
    """Measures of line search, keyword search and hybrid search over the same cases."""
    chunks, expected = _chunks(spark, sf_dir), stored(_expected(spark, sf_dir), "expected")
    by_line = line_search_cases(spark, sf_dir).select("case_id", "path", "position")
    words = _keyword(spark, sf_dir, chunks, K).select(F.col("query_id").alias("case_id"), "path", "position")
    both = _hybrid(spark, sf_dir, chunks).where(F.col("position") <= K).select(F.col("query_id").alias("case_id"), "path", "position")
    runs = [evaluate.ranks(rows, expected).withColumn("method", F.lit(name)) for name, rows in (("lines", by_line), ("keyword", words), ("hybrid", both))]
    every = runs[0].unionByName(runs[1]).unionByName(runs[2]).withColumn("tokens", F.lit(0))
    return evaluate.measures_by(every, "method").select("method", "cases", *[F.round(n, 6).alias(n) for n in ("hit1", "hit3", "hit5", "mrr")])


QUERIES = {f.__name__: f for f in (keyword_chunks, semantic_chunks, hybrid_chunks, rerank_chunks, related_graph_queries, related_snippets, context_pack, retrieval_ranks, retrieval_metrics, rerank_comparison, suite_metrics, token_sections, profile_matrix, line_search_cases, method_comparison)}

_BASE = r"""WITH RECURSIVE f AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'src/p' || (doc_id // 3) || '.ts' WHEN 1 THEN 'src/p' || (doc_id // 3) || '.test.ts' ELSE 'docs/p' || (doc_id // 3) || '.md' END AS path,
  'import { x } from ''' || CASE doc_id % 3 WHEN 2 THEN '../src/p' ELSE './p' END || (doc_id // 3 + 1) || '.js'';' || chr(10) || 'export function searchIndex' || (doc_id // 3) || '() {}' || chr(10) || coalesce(text, '') AS t FROM documents),
cut AS (SELECT path, t, CAST(0 AS BIGINT) AS ordinal, CAST(0 AS BIGINT) AS pos, CAST(1 AS BIGINT) AS line, CASE WHEN length(t) <= 2000 THEN length(t) WHEN strpos(substr(t, 2001, 241), chr(10)) > 0 THEN 2000 + strpos(substr(t, 2001, 241), chr(10)) ELSE 2000 END AS fin FROM f
  UNION ALL SELECT path, t, ordinal + 1, fin, line + length(substr(t, pos + 1, fin - pos)) - length(replace(substr(t, pos + 1, fin - pos), chr(10), '')), CASE WHEN fin + 2000 >= length(t) THEN length(t) WHEN strpos(substr(t, fin + 2001, 241), chr(10)) > 0 THEN fin + 2000 + strpos(substr(t, fin + 2001, 241), chr(10)) ELSE fin + 2000 END FROM cut WHERE fin < length(t)),
c AS (SELECT path, ordinal, line AS start_line, line + greatest(1, length(text) - length(replace(text, chr(10), '')) + CASE WHEN right(text, 1) = chr(10) THEN 0 ELSE 1 END) - 1 AS end_line, text, lower(text) AS lt, lower(path) AS lp FROM (SELECT path, ordinal, line, substr(t, pos + 1, fin - pos) AS text FROM cut)),
q AS (SELECT 'b' || item_id AS query_id, array_to_string(string_split(text, ' ')[1 : 4], ' ') AS query FROM benchmark UNION ALL SELECT DISTINCT 'l' || lang, lang FROM documents WHERE lang IS NOT NULL)"""
_SNIP = r"CASE WHEN length(regexp_replace(text, '\s+$', '')) > 400 THEN substr(regexp_replace(text, '\s+$', ''), 1, 397) || '...' ELSE regexp_replace(text, '\s+$', '') END"
_TERMS = r"regexp_extract_all(query, '[\p{L}\p{N}_.$/-]{2,}')"
_HITS = "CAST((length({h}) - length(replace({h}, term, ''))) / length(term) AS BIGINT)"


def _words(k: int) -> str:
    fold = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""{_BASE},
qt AS (SELECT DISTINCT query_id, lower(term) AS term FROM (SELECT query_id, unnest({_TERMS}) AS term FROM q) WHERE length(term) >= 3),
h AS (SELECT term, path, ordinal, start_line, end_line, text, 2 * {_HITS.format(h='lp')} + {_HITS.format(h='lt')} AS n, 2 * greatest(length(path) - 2, 0) + greatest(length(text) - 2, 0) AS d FROM c JOIN (SELECT DISTINCT term FROM qt) ON contains(lt, term) OR contains(lp, term)),
st AS (SELECT count(*) AS n_all, avg(2 * greatest(length(path) - 2, 0) + greatest(length(text) - 2, 0)) AS mean FROM c),
df AS (SELECT term, count(*) AS m FROM h GROUP BY term),
ws AS (SELECT query_id, path, ordinal, start_line, end_line, any_value(text) AS text, round(-sum((CASE WHEN ln((n_all - m + 0.5) / (m + 0.5)) > 0 THEN ln((n_all - m + 0.5) / (m + 0.5)) ELSE 1e-6 END) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * d / mean))), 6) AS score FROM h JOIN df USING (term) JOIN qt USING (term), st GROUP BY query_id, path, ordinal, start_line, end_line),
lq AS (SELECT query_id, {fold.format(_TERMS + '[1]')} AS term FROM q WHERE query_id NOT IN (SELECT query_id FROM ws) AND len({_TERMS}) > 0),
lw AS (SELECT query_id, path, ordinal, start_line, end_line, text, CASE WHEN {fold.format('path')} LIKE '%' || term || '%' THEN -10.0 ELSE -1.0 END::DOUBLE AS score FROM lq JOIN c ON {fold.format('path')} LIKE '%' || term || '%' OR {fold.format('text')} LIKE '%' || term || '%'),
kw AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, path, start_line, ordinal) AS position, path, ordinal, start_line, end_line, score, {_SNIP} AS snippet FROM (SELECT * FROM ws UNION ALL SELECT query_id, path, ordinal, start_line, end_line, text, score FROM lw)) WHERE position <= {k})"""


_LETTERS = "[" + ", ".join(f"(length({{0}}) - length(replace(lower({{0}}), '{x}', ''))) / greatest(length({{0}}), 1)" for x in "aeionstr") + "]"


def _near(k: int) -> str:
    return f"""cv AS (SELECT path, ordinal, start_line, end_line, text, {_LETTERS.format('text')} AS v FROM c), qv AS (SELECT query_id, {_LETTERS.format('query')} AS w FROM q),
dist AS (SELECT query_id, path, ordinal, start_line, end_line, text, round(sqrt({' + '.join(f'(v[{i}] - w[{i}]) * (v[{i}] - w[{i}])' for i in range(1, 9))}), 9) AS distance FROM cv, qv),
nr AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, path, start_line, ordinal) AS position, path, ordinal, start_line, end_line, distance, {_SNIP} AS snippet FROM dist) WHERE position <= {k})"""


_FUSED = f"""{_words(2 * K)}, {_near(2 * K)},
x AS (SELECT coalesce(n.query_id, k.query_id) AS query_id, coalesce(n.path, k.path) AS path, coalesce(n.ordinal, k.ordinal) AS ordinal, coalesce(n.start_line, k.start_line) AS start_line, coalesce(n.end_line, k.end_line) AS end_line,
  round(CASE WHEN n.path IS NULL THEN 0 ELSE 1 / (1 + greatest(distance, 0)) + greatest(0, 0.2 - 0.01 * (n.position - 1)) END + CASE WHEN k.path IS NULL THEN 0 ELSE 1.2 + greatest(0, 0.3 - 0.02 * (k.position - 1)) + least(0.5, abs(score) / 10) END, 9) AS total,
  CASE WHEN n.path IS NOT NULL AND k.path IS NOT NULL THEN 'semantic+keyword' WHEN k.path IS NULL THEN 'semantic' ELSE 'keyword' END AS kinds, CASE WHEN n.path IS NULL OR length(k.snippet) > length(n.snippet) THEN k.snippet ELSE n.snippet END AS snippet
  FROM nr n FULL OUTER JOIN kw k ON n.query_id = k.query_id AND n.path = k.path AND n.ordinal = k.ordinal),
fu AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, path, start_line, ordinal) AS position, path, ordinal, start_line, end_line, total AS score, kinds, snippet FROM x) WHERE position <= {3 * K})"""
#: The project is regular: a file of group g imports the source of group g + 1 where there is one.
_GRAPH = "r AS (SELECT path, 'src/p' || (doc_id // 3 + 1) || '.ts' AS resolved_path FROM f WHERE 3 * (doc_id // 3 + 1) IN (SELECT doc_id FROM documents))"
_INTENT = lambda kind: "list_has_any(terms, [" + ", ".join(f"'{w}'" for w in T.INTENT[kind]) + "])"
_RANKED = f"""{_FUSED}, {_GRAPH},
ct AS (SELECT query_id, replace(path, '.test.ts', '.ts') AS path, greatest(0, score * 0.85) AS score FROM fu WHERE path LIKE '%.test.ts'),
fc AS (SELECT * FROM c WHERE ordinal = 0),
al AS (SELECT query_id, path, ordinal, start_line, end_line, score, kinds, snippet, 1 AS own FROM fu UNION ALL SELECT query_id, path, ordinal, start_line, end_line, score, 'local', {_SNIP}, 0 FROM ct JOIN fc USING (path)),
ca AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path, ordinal, start_line, end_line ORDER BY score DESC, own DESC) AS best FROM al) WHERE best = 1),
qq AS (SELECT query_id, list_filter(list_distinct(flatten(list_transform({_TERMS}, lambda t: list_concat([lower(t)], list_filter(list_transform(string_split_regex(regexp_replace(t, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda p: lower(p)), lambda p: length(p) >= 2))))), lambda t: length(t) >= 2) AS terms FROM q),
l AS (SELECT path, unnest(string_split(t, chr(10))) AS line_text FROM f),
sy AS (SELECT path, list(regexp_extract(line_text, 'function (searchIndex[0-9]+)', 1)) AS names FROM l WHERE regexp_matches(line_text, '^export function searchIndex[0-9]+') GROUP BY path),
wd AS (SELECT path, flatten(list_transform(names, lambda x: [lower(x), 'search', lower(substr(x, 7))])) AS words FROM sy),
dg AS (SELECT f.path, coalesce(o.n, 1) AS n_imports, coalesce(i.n, 0) AS n_imported_by FROM f LEFT JOIN (SELECT path, count(*) AS n FROM l WHERE starts_with(line_text, 'import {{ x }} from ') GROUP BY path) o USING (path) LEFT JOIN (SELECT resolved_path AS path, count(*) AS n FROM r GROUP BY 1) i USING (path)),
rk AS (SELECT query_id, path, ordinal, start_line, end_line, kinds, snippet, round(CASE WHEN len(terms) = 0 THEN score ELSE score
  + least(2.5, list_sum(list_transform(terms, lambda t: CASE WHEN contains(lower(path), t) THEN 0.25 ELSE 0 END + CASE WHEN contains(regexp_extract(lower(path), '([^/]*)$', 1), t) THEN 0.2 ELSE 0 END)))
  + least(0.8, list_sum(list_transform(terms, lambda t: CASE WHEN contains(lower(snippet), t) THEN 0.08 ELSE 0 END)))
  + least(2.2, list_sum(list_transform(terms, lambda t: CASE WHEN list_contains(words, t) THEN 0.7 WHEN len(list_filter(words, lambda x: contains(x, t))) > 0 THEN 0.25 ELSE 0 END)))
  + CASE WHEN path LIKE '%.test.ts' THEN CASE WHEN {_INTENT('test')} THEN 0.4 WHEN {_INTENT('code')} THEN -0.85 ELSE -0.25 END WHEN path LIKE 'docs/%' THEN CASE WHEN {_INTENT('docs')} THEN 0.65 WHEN {_INTENT('code')} THEN -0.8 ELSE -0.15 END ELSE CASE WHEN {_INTENT('docs')} THEN 0.05 WHEN {_INTENT('code')} THEN 0.65 ELSE 0.15 END END
  + least(0.5, 0.04 * n_imports + 0.08 * n_imported_by) END, 9)::DOUBLE AS rank_score FROM ca JOIN qq USING (query_id) JOIN wd USING (path) JOIN dg USING (path)),
rr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, path, start_line, ordinal) AS position FROM rk) WHERE position <= {K})"""
_ROLE = "CASE WHEN path LIKE '%.test.ts' THEN 2 WHEN path LIKE 'docs/%' THEN 1 ELSE 0 END"
_LEVEL = lambda d: f"""w{d} AS (SELECT query_id, to_ AS path, arg_min((v.path, v."at", ed.n), (v."at", ed.n)) AS way FROM v{d - 1} v JOIN ed ON ed.path = v.path WHERE v.depth = {d - 1} AND (query_id, to_) NOT IN (SELECT (query_id, path) FROM v{d - 1}) GROUP BY 1, 2),
v{d} AS (SELECT * FROM v{d - 1} UNION ALL SELECT query_id, i + done, path, {d}, way[1] FROM (SELECT query_id, path, way, row_number() OVER (PARTITION BY query_id ORDER BY {_ROLE}, way[2], way[3], path) AS i FROM w{d}) JOIN (SELECT query_id, count(*) AS done FROM v{d - 1} GROUP BY 1) USING (query_id) WHERE i + done <= {RELATED})"""  # noqa: E731
_LEVELS = f"""ed AS (SELECT path, resolved_path AS to_, 1 AS n FROM r UNION ALL SELECT * FROM (SELECT resolved_path, path, {ITEMS} + row_number() OVER (PARTITION BY resolved_path ORDER BY path) AS n FROM r) WHERE n <= {2 * ITEMS}),
sd AS (SELECT * FROM (SELECT query_id, path, min(position) AS o, row_number() OVER (PARTITION BY query_id ORDER BY min(position), path) AS i FROM kw GROUP BY 1, 2) WHERE i <= {min(SEEDS, RELATED)}),
v0 AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY {_ROLE}, o, path) AS "at", path, 0 AS depth, CAST(NULL AS VARCHAR) AS via FROM sd),
{', '.join(_LEVEL(d) for d in range(1, DEPTH + 1))},
rl AS (SELECT * FROM v{DEPTH})"""
_RELATED = f"""{_words(K)}, {_GRAPH},
{_LEVELS},
rp AS (SELECT query_id, "at", path FROM rl WHERE (query_id, path) NOT IN (SELECT (query_id, path) FROM kw)),
hd AS (SELECT * FROM (SELECT path, start_line, end_line, regexp_replace(text, '\\s+$', '') AS text, row_number() OVER (PARTITION BY path ORDER BY ordinal) AS n FROM c) WHERE n <= {EACH}),
sn AS (SELECT query_id, "at", path, start_line, end_line, row_number() OVER (PARTITION BY query_id ORDER BY "at", n) AS i, length(text) > {SNIPPET} AS cut, CASE WHEN length(text) > {SNIPPET} THEN regexp_replace(substr(text, 1, {SNIPPET - 16}), '\\s+$', '') || chr(10) || '... [truncated]' ELSE text END AS s FROM rp JOIN hd USING (path)),
fo AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS i, '' AS new, CAST({BUDGET} AS BIGINT) AS room, false AS cut FROM sn UNION ALL
  SELECT query_id, i, new, room - length(new), cut FROM (SELECT sn.query_id, sn.i, fo.room, sn.cut OR length(s) > fo.room AS cut, CASE WHEN length(s) <= fo.room THEN s WHEN fo.room <= 0 THEN '' WHEN fo.room <= 15 THEN substr('... [truncated]', 1, fo.room) ELSE regexp_replace(substr(s, 1, fo.room - 16), '\\s+$', '') || chr(10) || '... [truncated]' END AS new FROM fo JOIN sn ON sn.query_id = fo.query_id AND sn.i = fo.i + 1) y),
rs AS (SELECT sn.query_id, sn."at", sn.path, sn.start_line, sn.end_line, fo.new AS snippet, fo.cut AS truncated FROM fo JOIN sn ON sn.query_id = fo.query_id AND sn.i = fo.i WHERE fo.i > 0 AND length(fo.new) > 0)"""
_PACKED = f"""{_RELATED},
pw AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS position, '' AS new, CAST({BUDGET} AS BIGINT) AS room FROM kw UNION ALL
  SELECT query_id, position, new, room - length(new) FROM (SELECT kw.query_id, kw.position, pw.room, CASE WHEN length(kw.snippet) <= pw.room THEN kw.snippet WHEN pw.room >= 16 THEN regexp_replace(substr(kw.snippet, 1, pw.room - 16), '\\s+$', '') || chr(10) || '... [truncated]' WHEN pw.room >= 15 THEN '... [truncated]' ELSE '' END AS new FROM pw JOIN kw ON kw.query_id = pw.query_id AND kw.position = pw.position + 1) z),
pn AS (SELECT query_id, count(*) AS primary_count, CAST(sum(length(new)) AS BIGINT) AS primary_chars FROM pw WHERE position > 0 GROUP BY query_id),
rn AS (SELECT query_id, count(*) AS related_count FROM rl GROUP BY query_id), cn AS (SELECT query_id, count(*) AS snippet_count, CAST(sum(length(snippet)) AS BIGINT) AS related_chars FROM rs GROUP BY query_id),
im AS (SELECT resolved_path AS path, path AS to_, row_number() OVER (PARTITION BY resolved_path ORDER BY path) AS n FROM r),
pl AS (SELECT query_id, path AS to_, position AS a, 0 AS b, 0 AS n FROM kw UNION ALL SELECT query_id, r.resolved_path, 1000 + "at", 1, 1 FROM rl JOIN r ON r.path = rl.path UNION ALL SELECT query_id, to_, 1000 + "at", 2, n FROM rl JOIN im ON im.path = rl.path WHERE n <= {ITEMS}),
ps AS (SELECT query_id, string_agg(to_, ',' ORDER BY a, b, n) AS paths FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, to_ ORDER BY a, b, n) AS k FROM pl) WHERE k = 1) GROUP BY query_id)"""
_HOLDING = """fw AS (SELECT path, string_split_regex(t, '[ \\n]') AS w FROM f), g6 AS (SELECT DISTINCT path, array_to_string(w[i : i + 5], ' ') AS words FROM (SELECT path, w, unnest(range(1, len(w) - 4)) AS i FROM fw WHERE len(w) >= 6)),
e AS (SELECT DISTINCT 'b' || item_id AS case_id, path FROM benchmark JOIN g6 ON words = array_to_string(string_split(text, ' ')[1 : 6], ' '))"""
_PLACES = lambda src, where="true": f"(SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY least_, path) AS place FROM (SELECT query_id, path, min(position) AS least_ FROM {src} WHERE {where} GROUP BY 1, 2))"
_EXPECTED = f"{_words(20)}, {_HOLDING}, hr AS (SELECT e.case_id, min(place) AS rank FROM e LEFT JOIN {_PLACES('kw')} p ON p.query_id = e.case_id AND p.path = e.path GROUP BY e.case_id)"
_HIT = lambda k: f"avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END)"
_TOKENS = "CAST(ceil(sum(length(snippet)) / 4) AS BIGINT)"
_SIX = {"hit1": _HIT(1), "hit3": _HIT(3), "hit5": _HIT(5), "mrr": "avg(coalesce(1.0 / rank, 0.0))", "tokens": "avg(coalesce(tokens, 0))", "hit5_per_1k": f"{_HIT(5)} / greatest(0.001, avg(coalesce(tokens, 0)) / 1000)"}
_RUN = lambda mode, src: f"SELECT '{mode}' AS mode, case_id, rank, tokens FROM (SELECT e.case_id, min(place) AS rank FROM e LEFT JOIN {_PLACES(src)} p ON p.query_id = e.case_id AND p.path = e.path GROUP BY e.case_id) LEFT JOIN (SELECT query_id AS case_id, {_TOKENS} AS tokens FROM {src} GROUP BY 1) USING (case_id)"
_COMPARED = f"""{_RANKED}, {_HOLDING}, f5 AS (SELECT * FROM fu WHERE position <= {K}), ru AS ({_RUN('auto', 'rr')} UNION ALL {_RUN('off', 'f5')}),
me AS (SELECT mode, {', '.join(f'{x} AS {n}' for n, x in _SIX.items())} FROM ru GROUP BY mode)
SELECT mode, {', '.join(f'round({n}, 6) AS {n}' for n in _SIX)} FROM me UNION ALL SELECT 'delta', {', '.join(f'round(a.{n} - o.{n}, 6)' for n in _SIX)} FROM me a, me o WHERE a.mode = 'auto' AND o.mode = 'off'"""
_SUITES = f"""{_words(20)}, {_HOLDING}, ee AS (SELECT * FROM e WHERE path NOT LIKE 'docs/%'),
rk AS (SELECT ee.case_id, min(place) AS rank FROM ee LEFT JOIN {_PLACES('kw', "path NOT LIKE 'docs/%'")} p ON p.query_id = ee.case_id AND p.path = ee.path GROUP BY ee.case_id),
su AS (SELECT DISTINCT case_id, lang AS suite FROM ee JOIN f USING (path) JOIN documents USING (doc_id) WHERE lang IS NOT NULL UNION ALL SELECT DISTINCT case_id, 'full' FROM ee)
SELECT suite, count(*) AS cases, {', '.join(f'round({x}, 6) AS {n}' for n, x in _SIX.items())} FROM su JOIN rk USING (case_id) LEFT JOIN (SELECT query_id AS case_id, {_TOKENS} AS tokens FROM kw GROUP BY 1) USING (case_id) GROUP BY suite"""
_PACK = f"{_PACKED} SELECT query_id, primary_count, coalesce(related_count, 0) AS related_count, coalesce(snippet_count, 0) AS snippet_count, primary_chars, coalesce(related_chars, 0) AS related_chars, CAST(ceil((primary_chars + coalesce(related_chars, 0)) / 4) AS BIGINT) AS tokens, CAST(ceil(coalesce(related_chars, 0) / 4) AS BIGINT) AS related_tokens, paths FROM pn LEFT JOIN rn USING (query_id) LEFT JOIN cn USING (query_id) JOIN ps USING (query_id)"
_MEASURED = ", ".join(f"round({x}, 6) AS {n}" for n, x in _SIX.items() if n in ("hit1", "hit3", "hit5", "mrr"))
_FIRST = lambda src, by: f"(SELECT {by}, path, row_number() OVER (PARTITION BY {by} ORDER BY least_, path) AS place FROM (SELECT {by}, path, min(position) AS least_ FROM {src} GROUP BY {by}, path))"
_WEIGHTED = ("base", "path", "snippet", "symbol", "role", "graph", "counterpart")
_VALUES = ", ".join("(" + ", ".join([f"'{p['name']}'", str(p.get("mode") == "off").lower(), *[str(float((retrieval.WEIGHTS | p.get("weights", {}))[w])) + "::DOUBLE" for w in _WEIGHTED]]) + ")" for p in PROFILES)
_PROFILED = f"""{_RANKED}, {_HOLDING}, pf(profile, off, {', '.join('w_' + w for w in _WEIGHTED)}) AS (VALUES {_VALUES}),
pc AS (SELECT profile, query_id, path, ordinal, start_line, end_line, score, score AS b, 1 AS own, snippet FROM fu, pf UNION ALL SELECT profile, query_id, replace(fu.path, '.test.ts', '.ts'), fc.ordinal, fc.start_line, fc.end_line, score, greatest(0, score * w_counterpart), 0, {_SNIP.replace('text', 'fc.text')} FROM fu JOIN fc ON fc.path = replace(fu.path, '.test.ts', '.ts'), pf WHERE fu.path LIKE '%.test.ts' AND NOT off),
po AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile, query_id, path, ordinal, start_line, end_line ORDER BY b DESC, own DESC) AS best FROM pc) WHERE best = 1),
pr AS (SELECT profile, query_id, path, ordinal, start_line, round(CASE WHEN off OR len(terms) = 0 THEN score ELSE w_base * b
  + w_path * least(2.5, list_sum(list_transform(terms, lambda t: CASE WHEN contains(lower(path), t) THEN 0.25 ELSE 0 END + CASE WHEN contains(regexp_extract(lower(path), '([^/]*)$', 1), t) THEN 0.2 ELSE 0 END)))
  + w_snippet * least(0.8, list_sum(list_transform(terms, lambda t: CASE WHEN contains(lower(snippet), t) THEN 0.08 ELSE 0 END)))
  + w_symbol * least(2.2, list_sum(list_transform(terms, lambda t: CASE WHEN list_contains(words, t) THEN 0.7 WHEN len(list_filter(words, lambda x: contains(x, t))) > 0 THEN 0.25 ELSE 0 END)))
  + w_role * CASE WHEN path LIKE '%.test.ts' THEN CASE WHEN {_INTENT('test')} THEN 0.4 WHEN {_INTENT('code')} THEN -0.85 ELSE -0.25 END WHEN path LIKE 'docs/%' THEN CASE WHEN {_INTENT('docs')} THEN 0.65 WHEN {_INTENT('code')} THEN -0.8 ELSE -0.15 END ELSE CASE WHEN {_INTENT('docs')} THEN 0.05 WHEN {_INTENT('code')} THEN 0.65 ELSE 0.15 END END
  + w_graph * least(0.5, 0.04 * n_imports + 0.08 * n_imported_by) END, 9)::DOUBLE AS rank_score FROM po JOIN pf USING (profile) JOIN qq USING (query_id) JOIN wd USING (path) JOIN dg USING (path)),
pp AS (SELECT * FROM (SELECT profile, query_id AS case_id, path, row_number() OVER (PARTITION BY profile, query_id ORDER BY rank_score DESC, path, start_line, ordinal) AS position FROM pr) WHERE position <= {K}),
ph AS (SELECT profile, e.case_id, min(place) AS rank FROM (SELECT profile, case_id, path FROM e, pf) e LEFT JOIN {_FIRST('pp', 'profile, case_id')} z USING (profile, case_id, path) GROUP BY 1, 2)
SELECT profile, count(*) AS cases, {_MEASURED} FROM ph GROUP BY profile"""
_LINES = f"""lt AS (SELECT query_id AS case_id, lower(term) AS term, len(list_filter(range(1, length(term)), lambda i: starts_with(lower(term), substr(lower(term), i + 1)))) > 0 AS own FROM (SELECT query_id, unnest(list_filter({_TERMS}, lambda t, i: length(t) >= 3 AND list_position({_TERMS}, t) = i)[1 : 10]) AS term FROM q WHERE query_id LIKE 'b%')),
ll AS (SELECT path, unnest(string_split(lower(t), chr(10))) AS c, generate_subscripts(string_split(lower(t), chr(10)), 1) AS line FROM f),
lh AS (SELECT case_id, path, line, sum(CASE WHEN own THEN len(list_filter(range(1, length(c) - length(term) + 2), lambda i: substr(c, i, length(term)) = term)) ELSE CAST((length(c) - length(replace(c, term, ''))) / length(term) AS BIGINT) END) + 0.25 * count(*) AS s FROM ll JOIN lt ON contains(c, term) GROUP BY 1, 2, 3),
ln AS (SELECT * FROM (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY round(sum(s), 6) DESC, min(line), path) AS position, path, CAST(round(sum(s), 6) AS DOUBLE) AS score, min(line) AS first_line FROM lh GROUP BY case_id, path) WHERE position <= {K})"""
_METHODS = f"""{_FUSED}, {_HOLDING}, {_LINES}, mt AS (SELECT 'lines' AS method, case_id, path, position FROM ln UNION ALL SELECT 'keyword', query_id, path, position FROM kw WHERE position <= {K} UNION ALL SELECT 'hybrid', query_id, path, position FROM fu WHERE position <= {K}),
mr AS (SELECT method, e.case_id, min(place) AS rank FROM (SELECT method, case_id, path FROM e, (SELECT unnest(['lines', 'keyword', 'hybrid']) AS method)) e LEFT JOIN {_FIRST('mt', 'method, case_id')} z USING (method, case_id, path) GROUP BY 1, 2)
SELECT method, count(*) AS cases, {_MEASURED} FROM mr GROUP BY method"""
_TAIL = "path, ordinal, start_line, end_line"
ORACLES = {
    "keyword_chunks": f"{_words(K)} SELECT query_id, position, {_TAIL}, score, sha256(snippet) AS snippet_hash FROM kw",
    "semantic_chunks": f"{_BASE}, {_near(K)} SELECT query_id, position, {_TAIL}, round(distance, 6) AS distance, sha256(snippet) AS snippet_hash FROM nr",
    "hybrid_chunks": f"{_FUSED} SELECT query_id, position, {_TAIL}, score, kinds, sha256(snippet) AS snippet_hash FROM fu",
    "rerank_chunks": f"{_RANKED} SELECT query_id, position, {_TAIL}, rank_score, kinds, sha256(snippet) AS snippet_hash FROM rr",
    "related_graph_queries": f"{_words(K)}, {_GRAPH}, {_LEVELS} SELECT query_id, \"at\" AS position, path, depth, via FROM rl",
    "related_snippets": f"{_RELATED} SELECT query_id, \"at\", path, start_line, end_line, sha256(snippet) AS snippet_hash, truncated FROM rs",
    "context_pack": _PACK,
    "token_sections": f"WITH pk AS ({_PACK}), z AS (SELECT 'primary' AS section, ceil(primary_chars / 4) AS n FROM pk UNION ALL SELECT 'related_snippets', related_tokens FROM pk UNION ALL SELECT 'suggested_paths', ceil(length(paths) / 4) FROM pk UNION ALL SELECT 'snippets', tokens FROM pk) SELECT section, round(avg(n), 6) AS mean_tokens, CAST(max(n) AS BIGINT) AS most_tokens FROM z GROUP BY section",
    "rerank_comparison": _COMPARED,
    "profile_matrix": _PROFILED,
    "line_search_cases": f"{_BASE}, {_LINES} SELECT case_id, position, path, score, first_line FROM ln",
    "method_comparison": _METHODS,
    "suite_metrics": _SUITES,
    "retrieval_ranks": f"{_EXPECTED} SELECT case_id, coalesce(rank, 0) AS rank FROM hr",
    "retrieval_metrics": f"{_EXPECTED} SELECT count(*) AS cases, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit3, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit5, round(avg(coalesce(1.0 / rank, 0.0)), 6) AS mrr, quantile_disc(rank, 0.95) AS p95_rank, avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END) >= 1 AND avg(coalesce(1.0 / rank, 0.0)) >= 0.85 AS passed FROM hr",
}
