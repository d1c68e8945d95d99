"""Chunk search for a table of queries: keywords over stored posting blocks, vectors, their fusion, and code-aware ranking.

Queries are a stated, bounded set (`MOST_QUERIES` at most, checked), so their terms and vectors are broadcast; chunks,
postings and files are joined by key. Every list of results is cut to its best rows within tasks before it is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import discard, stored
from . import postings, vectors

MOST_QUERIES = 10_000
KEY = ["path", "ordinal", "start_line", "end_line"]  # chunks of one long line share its number
ORDER = ["path", "start_line", "ordinal"]
#: Extensions of source files that tests stand beside, and the weights of the parts of a rank.
EXTENSIONS = [".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs"]
TEST = r"^(.*)\.(?:test|spec)\.(?:[mc]?[tj]s|[tj]sx)$"
WEIGHTS = {"base": 1.0, "path": 1.0, "snippet": 1.0, "symbol": 1.0, "role": 1.0, "graph": 1.0, "counterpart": 0.85}


def bounded(queries: DataFrame) -> DataFrame:
    """The queries (query_id, query), for a broadcast: more than MOST_QUERIES are refused."""
    if len(queries.limit(MOST_QUERIES + 1).select("query_id").collect()) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries: search them in several calls")
    return F.broadcast(queries)


def best(rows: DataFrame, by: list, k: int) -> DataFrame:
    """The first k rows of each query, with their position from 1; tasks cut their lists before they are shuffled."""
    if k <= 0:
        raise ValueError("k must be positive")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*by))).where(F.col("position") <= k)


def grams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case: a match at every place, each three signs wide."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?s)(?=(.{3}))"), F.lit(1)))


def postings_index(chunks: DataFrame) -> postings.Index:
    """The keyword index of chunks, written to the shared folder."""
    return postings.build(chunks)


def pattern_terms(word: Column) -> Column:
    """The parts between "_" of a pattern's word that the index finds: ASCII, three letters or more, in lower case."""
    return F.filter(F.transform(F.split(word, "_"), F.lower), lambda p: (F.length(p) >= 3) & ~F.rlike(p, F.lit(r"[^\x00-\x7F]")))


def keyword(chunks: DataFrame, index: postings.Index, queries: DataFrame, k: int, snippet: int = 400, apart: bool = False) -> DataFrame:
    """query_id, position, path, ordinal, start_line, end_line, score, snippet: the k best chunks of each query by its terms.

    Weights are those of BM25 over trigram columns, where path counts as path and as title. A query that no chunk matches goes
    by its first word as a pattern, in paths (-10) or texts (-1), where "_" stays wild; the longest part of such a word without
    wild signs is looked up in the index, and only a word without a part of three letters is looked for in all chunks. With
    `apart` places of a term that overlap do not count, see `postings.search`.
    """
    queries = bounded(queries)
    terms = F.array_distinct(F.transform(T.search_terms(F.col("query")), F.lower))
    ranked = postings.search(index, queries.select("query_id", terms.alias("terms")), k, apart)
    keys = F.broadcast(ranked)  # k rows a query
    found = stored(index.docs.join(keys, "number").select("query_id", *KEY, "score"), "found")
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    word = fold(F.get(T.keyword_terms(F.col("query")), F.lit(0)))
    left = queries.join(found.select("query_id").distinct(), "query_id", "left_anti").select("query_id", word.alias("term")).where("term IS NOT NULL")
    parts = F.array_sort(pattern_terms(F.col("term")), lambda a, b: F.length(b) - F.length(a))
    left = stored(left.select("query_id", "term", F.get(parts, F.lit(0)).alias("part")), "patterns")
    wild, pattern = F.contains("term", F.lit("_")), F.expr("concat('%', term, '%')")
    holds = lambda c: F.when(wild, F.like(c, pattern)).otherwise(F.contains(c, F.col("term")))
    folded = lambda rows: rows.withColumns({"low_path": fold(F.col("path")), "low_text": fold(F.col("text"))})

    def fits(rows: DataFrame) -> DataFrame:
        return rows.withColumn("score", F.when(holds(F.col("low_path")), -10.0).when(holds(F.col("low_text")), -1.0)).where("score IS NOT NULL").select("query_id", *KEY, "score")

    tried = []
    asked = {r["query_id"]: r["part"] for r in left.collect()}  # a bounded set
    if any(p is not None for p in asked.values()):
        named = postings.matching(index, {str(q): [p] for q, p in asked.items() if p is not None})
        rows = index.docs.join(named, "number").select(F.col("set").alias("_set"), *KEY)
        with_text = folded(rows.join(chunks.select(*KEY, "text"), KEY))
        tried.append(fits(with_text.join(F.broadcast(left.withColumn("_set", F.col("query_id").cast("string"))), "_set")))
    if any(p is None for p in asked.values()):
        tried.append(fits(folded(chunks.select(*KEY, "text")).join(F.broadcast(left.where("part IS NULL")))))
    rows = best(found, ["score", *ORDER], k)
    for t in tried:
        rows = rows.unionByName(best(t, ["score", *ORDER], k))
    cols = ["query_id", "position", *KEY, "score"]
    placed = stored(rows.select(*cols), "placed")
    discard(ranked, found, left)
    return chunks.join(F.broadcast(placed), KEY).select(*cols, T.compact_snippet(F.col("text"), snippet).alias("snippet"))  # k rows a query


def letter_vector(text: Column, letters: str = "aeionstr") -> Column:
    """An offline provider: the shares of some letters in a text."""
    low = F.lower(text)
    return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(x), F.lit("")))) / F.greatest(F.length(low), F.lit(1)) for x in letters])


def semantic(chunks: DataFrame, found: vectors.VectorIndex, queries: DataFrame, k: int, snippet: int = 400) -> DataFrame:
    """query_id, position, path, ordinal, start_line, end_line, distance, snippet: the k chunks nearest to each query's vector.

    `found` is the vector index of chunks by ORDER's key, `queries` has query_id and vector. The texts of the k best alone are
    joined.
    """
    near, met = vectors.nearest(found, queries, k)
    discard(met)
    rows = chunks.join(F.broadcast(near), KEY)  # k rows a query
    return rows.select("query_id", "position", *KEY, "distance", T.compact_snippet(F.col("text"), snippet).alias("snippet"))


def vector_index(chunks: DataFrame, vector: Column, dims: int) -> vectors.VectorIndex:
    """The vector index of chunks, whose equal distances go by path, first line and place."""
    return vectors.build(chunks.select(*KEY, vector.alias("vector")), [*ORDER, "end_line"], "vector", dims)


def fuse(near: DataFrame, words: DataFrame, k: int) -> DataFrame:
    """query_id, position, path, ordinal, start_line, end_line, score, kinds, distance, keyword_score, snippet of both lists together.

    A chunk in both has the sum of its scores and the longer snippet, the semantic one if they are as long.
    """
    s = near.select("query_id", *KEY, "distance", F.col("snippet").alias("s_snippet"), (1 / (1 + F.greatest("distance", F.lit(0.0))) + F.greatest(F.lit(0.0), 0.2 - 0.01 * (F.col("position") - 1))).alias("s"))
    w = words.select("query_id", *KEY, F.col("score").alias("keyword_score"), F.col("snippet").alias("w_snippet"), (1.2 + F.greatest(F.lit(0.0), 0.3 - 0.02 * (F.col("position") - 1)) + F.least(F.lit(0.5), F.abs("score") / 10)).alias("w"))
    both = s.join(w, ["query_id", *KEY], "full_outer")
    kinds = F.array_compact(F.array(F.when(F.col("s").isNotNull(), "semantic"), F.when(F.col("w").isNotNull(), "keyword")))
    text = F.when(F.col("s").isNull() | (F.length("w_snippet") > F.length("s_snippet")), F.col("w_snippet")).otherwise(F.col("s_snippet"))
    rows = both.select("query_id", *KEY, F.round(F.coalesce("s", F.lit(0.0)) + F.coalesce("w", F.lit(0.0)), 9).alias("score"), kinds.alias("kinds"), "distance", "keyword_score", text.alias("snippet"))
    return best(rows, [F.desc("score"), *ORDER], k)


def candidate_paths(found: DataFrame) -> DataFrame:
    """path: the files of results, and those that may be sources of tests among them; of bounded results, so for a broadcast."""
    beside = found.select(F.regexp_extract("path", TEST, 1).alias("base")).where("base <> ''")
    sources = beside.select(F.explode(F.array(*[F.concat("base", F.lit(x)) for x in EXTENSIONS])).alias("path"))
    return found.select("path").unionByName(sources).distinct()


def with_counterparts(found: DataFrame, chunks: DataFrame, ratio: float, snippet: int = 400, only: bool = False) -> DataFrame:
    """Results (query_id, path, ordinal, start_line, end_line, score, snippet, kinds) with the sources that found tests stand beside.

    A source comes with its first chunk and a share of the test's score; of one chunk the higher score stays. With `only`,
    just the sources.
    """
    tests = found.withColumn("base", F.regexp_extract("path", TEST, 1)).where("base <> ''")
    sources = tests.select("query_id", F.explode(F.array(*[F.concat("base", F.lit(x)) for x in EXTENSIONS])).alias("path"), F.greatest(F.lit(0.0), F.col("score") * ratio).alias("score"))
    first = chunks.join(F.broadcast(sources.select("path").distinct()), "path", "left_semi").groupBy("path").agg(F.min_by(F.struct("ordinal", "start_line", "end_line", "text"), "ordinal").alias("c"))  # paths: those of bounded results
    first = stored(first, "beside")  # chunks are read once, however often the rows below are
    added = sources.join(first, "path").select("query_id", "path", "c.ordinal", "c.start_line", "c.end_line", "score", T.compact_snippet(F.col("c.text"), snippet).alias("snippet"), F.array(F.lit("local")).alias("kinds"), F.lit(0).alias("own"))
    rows = added if only else found.select("query_id", *KEY, "score", "snippet", "kinds", F.lit(1).alias("own")).unionByName(added)
    return rows.groupBy("query_id", *KEY).agg(F.max_by(F.struct("score", "snippet", "kinds"), F.struct("score", "own")).alias("r")).select("query_id", *KEY, "r.*")


def rank_parts(rows: DataFrame, queries: DataFrame, symbols: DataFrame, degrees: DataFrame) -> DataFrame:
    """rows (query_id, KEY, snippet, ...) with n_terms and the parts of a rank without weights: in_path, in_text, in_names, role, graph.

    `symbols` has path, name, line, `degrees` path, n_imports, n_imported_by. Only rows of result files are joined.
    """
    rows = rows.join(bounded(queries).select("query_id", T.query_terms(F.col("query")).alias("terms")), "query_id")
    paths = F.broadcast(rows.select("path").distinct())  # those of bounded results
    names = symbols.join(paths, "path", "left_semi").groupBy("path").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("line", "name"))), lambda s: s["name"]), 1, 80).alias("names"))
    near = degrees.join(paths, "path", "left_semi")
    rows = rows.join(names, "path", "left").join(near, "path", "left")
    own = F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda s: F.concat(F.array(F.lower(s)), T.split_identifier(s)))
    rows = rows.withColumn("words", F.array_distinct(F.flatten(own)))
    path, text, zero = F.lower("path"), F.lower("snippet"), F.lit(0.0)
    name = F.regexp_extract(path, "([^/]*)$", 1)
    terms = F.col("terms")
    in_path = F.aggregate(terms, zero, lambda s, t: s + F.when(F.contains(path, t), 0.25).otherwise(0.0) + F.when(F.contains(name, t), 0.2).otherwise(0.0))
    in_text = F.aggregate(terms, zero, lambda s, t: s + F.when(F.contains(text, t), 0.08).otherwise(0.0))
    in_names = F.aggregate(terms, zero, lambda s, t: s + F.when(F.array_contains(F.col("words"), t), 0.7).when(F.exists("words", lambda x: F.contains(x, t)), 0.25).otherwise(0.0))
    graph = F.least(F.lit(0.5), 0.04 * F.coalesce("n_imports", F.lit(0)) + 0.08 * F.coalesce("n_imported_by", F.lit(0)))
    parts = {"n_terms": F.size(terms), "in_path": F.least(F.lit(2.5), in_path), "in_text": F.least(F.lit(0.8), in_text), "in_names": F.least(F.lit(2.2), in_names), "role": T.role_score_of(F.col("path"), terms), "graph": graph}
    return rows.withColumns(parts).drop("terms", "names", "words", "n_imports", "n_imported_by")


def rerank(found: DataFrame, queries: DataFrame, chunks: DataFrame, symbols: DataFrame, degrees: DataFrame, k: int, weights: dict[str, float] | None = None) -> DataFrame:
    """query_id, position, path, ordinal, start_line, end_line, rank_score, kinds, snippet: results by what their files are and hold.

    A query without terms keeps its results as they are.
    """
    w = WEIGHTS | (weights or {})
    termless = queries.where(F.size(T.query_terms(F.col("query"))) == 0).select("query_id")
    plain = found.join(F.broadcast(termless), "query_id", "left_semi").select("query_id", *KEY, "score", "snippet", "kinds")  # of a bounded set
    rest = with_counterparts(found.join(F.broadcast(termless), "query_id", "left_anti"), chunks, w["counterpart"])
    rows = rank_parts(rest.unionByName(plain), queries, symbols, degrees)
    total = w["base"] * F.col("score") + w["path"] * F.col("in_path") + w["snippet"] * F.col("in_text") + w["symbol"] * F.col("in_names") + w["role"] * F.col("role") + w["graph"] * F.col("graph")
    return best(rows.withColumn("rank_score", F.round(F.when(F.col("n_terms") > 0, total).otherwise(F.col("score")), 9)), [F.desc("rank_score"), *ORDER], k).select("query_id", "position", *KEY, "rank_score", "kinds", "snippet")


def profiles(spark: SparkSession, listed: list[dict]) -> DataFrame:
    """profile, off and the weights of profiles {name, mode ("auto" or "off"), weights}: names are unique, weights known and finite."""
    names = [p.get("name") for p in listed]
    if any(not isinstance(n, str) or not n.strip() for n in names) or len(set(names)) != len(names):
        raise ValueError("profiles need names of their own")
    for p in listed:
        w = p.get("weights") or {}
        if p.get("mode", "auto") not in ("auto", "off") or set(w) - set(WEIGHTS) or any(isinstance(x, bool) or not isinstance(x, int | float) or not math.isfinite(x) for x in w.values()):
            raise ValueError(f"profile {p['name']}: mode is auto or off, weights are finite numbers of {', '.join(WEIGHTS)}")
    rows = [(p["name"], p.get("mode", "auto") == "off", *[float(x) for x in (WEIGHTS | (p.get("weights") or {})).values()]) for p in listed]
    return spark.createDataFrame(rows, "profile string, off boolean, " + ", ".join(f"w_{n} double" for n in WEIGHTS))


def rerank_profiles(found: DataFrame, queries: DataFrame, chunks: DataFrame, symbols: DataFrame, degrees: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """profile, query_id, position, path, ordinal, start_line, end_line, rank_score: the k best of every profile at once.

    The parts of a candidate's rank are worked out once; each profile weighs them. A counterpart's share is a weight too, so
    candidates stay apart until a profile has chosen the better score. "off" keeps the scores that came.
    """
    own = found.select("query_id", *KEY, "score", "snippet", F.lit(1).alias("own"))
    beside = with_counterparts(found, chunks, 1.0, only=True).select("query_id", *KEY, "score", "snippet", F.lit(0).alias("own"))
    parts = rank_parts(own.unionByName(beside), queries, symbols, degrees)
    rows = parts.join(F.broadcast(table)).where((F.col("own") == 1) | ~F.col("off") & (F.col("n_terms") > 0))  # profiles: a stated list
    base = F.when(F.col("own") == 1, F.col("score")).otherwise(F.greatest(F.lit(0.0), F.col("score") * F.col("w_counterpart")))
    total = F.col("w_base") * base + F.col("w_path") * F.col("in_path") + F.col("w_snippet") * F.col("in_text") + F.col("w_symbol") * F.col("in_names") + F.col("w_role") * F.col("role") + F.col("w_graph") * F.col("graph")
    scored = rows.withColumn("base", base).withColumn("rank_score", F.round(F.when(F.col("off") | (F.col("n_terms") == 0), F.col("score")).otherwise(total), 9))
    once = scored.groupBy("profile", "query_id", *KEY).agg(F.max_by("rank_score", F.struct("base", "own")).alias("rank_score"))
    place = F.row_number().over(Window.partitionBy("profile", "query_id").orderBy(F.desc("rank_score"), *ORDER))
    return once.withColumn("position", place).where(F.col("position") <= k).select("profile", "query_id", "position", *KEY, "rank_score")
