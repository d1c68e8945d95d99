"""Keyword, vector and hybrid search, and the code-aware ranking of what they find."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text as T

GRAM = 3  # letters of a trigram index's terms


def matches(files: DataFrame, terms: list[str]) -> DataFrame:
    """Files that have any of the terms in path or text, in any case."""
    hay = F.lower(F.concat_ws("\n", "path", "text"))
    use = [t.lower() for t in terms if len(t) >= GRAM]
    if not use:
        return files.where("false")
    found = F.lit(False)
    for t in use:
        found = found | F.contains(hay, F.lit(t))
    return files.where(found)


def bm25(files: DataFrame, terms: list[str]) -> DataFrame:
    """path, score (the less the better) of files that have any term.

    Path counts twice, as path and title, beside the text; a column of n letters has n - 2 trigrams. Two passes: one global
    aggregate for the collection's numbers (one row, broadcast), one projection for the scores.
    """
    use = list(dict.fromkeys(t.lower() for t in terms if len(t) >= GRAM))
    path, text = F.lower("path"), F.lower("text")
    size = 2 * F.greatest(F.length("path") - 2, F.lit(0)) + F.greatest(F.length("text") - 2, F.lit(0))
    rows = files.select("path", size.alias("d"), *[(2 * T.occurrences(path, t) + T.occurrences(text, t)).alias(f"f{i}") for i, t in enumerate(use)])
    stats = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.avg("d").alias("mean"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(use))])
    score = F.lit(0.0)
    for i in range(len(use)):
        raw = F.log((F.col("n_rows") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        weight = F.when(raw > 0, raw).otherwise(1e-6)
        f = F.col(f"f{i}")
        score = score - weight * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * F.col("d") / F.col("mean")))
    some = F.greatest(*[F.col(f"f{i}") for i in range(len(use))], F.lit(0)) if use else F.lit(0)
    return rows.where(some > 0).join(F.broadcast(stats)).select("path", score.alias("score"))  # stats is one row


def like_fallback(files: DataFrame, term: str) -> DataFrame:
    """path, score of files with a pattern in path (-10) or text (-1), folding ASCII case; "_" and "%" stay wild."""
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pattern = "%" + term.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) + "%"
    in_path, in_text = fold(F.col("path")).like(pattern), fold(F.col("text")).like(pattern)
    return files.where(in_path | in_text).select("path", F.when(in_path, -10.0).otherwise(-1.0).alias("score"))


def l2(vector: Column, query: list[float]) -> Column:
    wanted = F.array(*[F.lit(float(x)) for x in query])
    return F.sqrt(F.aggregate(F.zip_with(vector, wanted, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id") -> DataFrame:
    """The k rows nearest to a query vector by Euclidean distance: a scan with a bounded heap in each task."""
    if k <= 0 or any(not math.isfinite(x) for x in query):
        raise ValueError("k must be positive and the query finite")
    ok = vectors.where(T.valid_vector(F.col("embedding"), len(query)))
    return ok.select(key, l2(F.col("embedding"), query).alias("distance")).orderBy("distance", key).limit(k)


def fuse(semantic: DataFrame, keyword: DataFrame, k: int) -> DataFrame:
    """key, score, kinds, distance, keyword_score of the two top lists, the best k first."""
    rank = lambda order: F.row_number().over(Window.orderBy(*order)) - 1  # noqa: E731  over top lists of 2k rows
    s = semantic.withColumn("i", rank(["distance", "key"])).select("key", "distance", (1 / (1 + F.greatest("distance", F.lit(0.0))) + F.greatest(F.lit(0.0), 0.2 - 0.01 * F.col("i"))).alias("s"))
    w = keyword.withColumn("i", rank(["score", "key"])).select("key", F.col("score").alias("keyword_score"), (1.2 + F.greatest(F.lit(0.0), 0.3 - 0.02 * F.col("i")) + F.least(F.lit(0.5), F.abs("score") / 10)).alias("w"))
    both = s.join(w, "key", "full_outer")
    kinds = F.array_compact(F.array(F.when(F.col("s").isNotNull(), "semantic"), F.when(F.col("w").isNotNull(), "keyword")))
    return both.select("key", (F.coalesce("s", F.lit(0.0)) + F.coalesce("w", F.lit(0.0))).alias("score"), kinds.alias("kinds"), "distance", "keyword_score").orderBy(F.desc("score"), "key").limit(k)


def _any_has(words: Column, term: str) -> Column:
    return F.exists(words, lambda x: F.contains(x, F.lit(term)))


def rerank(found: DataFrame, terms: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """Adds `rank_score` to rows of path, snippet, score, symbols (names), n_imports, n_imported_by."""
    w = {k: 1.0 for k in ("base", "path", "snippet", "symbol", "role", "graph")} | (weights or {})
    path, snippet = F.lower("path"), F.lower("snippet")
    name = F.regexp_extract(path, "([^/]*)$", 1)
    parts = F.transform(F.col("symbols"), lambda s: F.concat(F.array(F.lower(s)), T.split_identifier(s)))
    words = F.array_distinct(F.flatten(parts))
    zero = F.lit(0.0)
    in_path, in_snippet, in_symbol = zero, zero, zero
    for t in terms:
        in_path = in_path + F.when(F.contains(path, F.lit(t)), 0.25).otherwise(0.0) + F.when(F.contains(name, F.lit(t)), 0.2).otherwise(0.0)
        in_snippet = in_snippet + F.when(F.contains(snippet, F.lit(t)), 0.08).otherwise(0.0)
        in_symbol = in_symbol + F.when(F.array_contains(words, t), 0.7).when(_any_has(words, t), 0.25).otherwise(0.0)
    graph = F.least(F.lit(0.5), 0.04 * F.col("n_imports") + 0.08 * F.col("n_imported_by"))
    total = w["base"] * F.col("score") + w["path"] * F.least(F.lit(2.5), in_path) + w["snippet"] * F.least(F.lit(0.8), in_snippet) + w["symbol"] * F.least(F.lit(2.2), in_symbol) + w["role"] * T.role_score(F.col("path"), terms) + w["graph"] * graph
    return found.withColumn("rank_score", total if terms else F.col("score"))


def line_search(files: DataFrame, terms: list[str]) -> DataFrame:
    """path, score, first_line: matches of up to ten terms line by line, each line with a quarter more for each term it has."""
    use = [t.lower() for t in terms if len(t) >= 3][:10]
    low = F.lower("content")
    hits, kinds = F.lit(0), F.lit(0)
    for t in use:
        n = T.occurrences(low, t)
        hits, kinds = hits + n, kinds + F.when(n > 0, 1).otherwise(0)
    rows = files.select("path", F.posexplode(F.split("text", "\n")).alias("at", "content")).select("path", (F.col("at") + 1).alias("line"), hits.alias("hits"), kinds.alias("kinds")).where("hits > 0")
    return rows.groupBy("path").agg(F.sum(F.col("hits") + 0.25 * F.col("kinds")).alias("score"), F.min("line").alias("first_line"))
