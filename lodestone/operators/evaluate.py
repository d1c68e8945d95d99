"""Measure retrieval: ranks of expected files, and what the measures make of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


CASE = "id string, query string, expectedPaths array<string>, notes string, tags array<string>"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """case_id, query, path (each expected one), tags of a JSON file of cases; raises ValueError if a case is not valid.

    An id and a query must not be blank, an id stands once, there is an expected path at least, none is absolute or climbs
    out of the project, and no tag is blank. The check is one aggregate; no case goes to the driver.
    """
    cases = spark.read.schema(CASE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    clean = F.transform("expectedPaths", lambda p: F.regexp_replace(F.replace(p, F.lit("\\"), F.lit("/")), r"^(\./)+", ""))
    bad_path = F.exists("expectedPaths", lambda p: blank(p) | p.rlike(r"^(/|\\|[A-Za-z]:)|(^|[/\\])\.\.([/\\]|$)"))
    faults = {
        "cases without an id, a query or an expected path": F.count_if(blank(F.col("id")) | blank(F.col("query")) | (F.coalesce(F.size("expectedPaths"), F.lit(0)) < 1)),
        "ids that stand more than once": F.count("id") - F.count_distinct("id"),
        "cases with a path outside the project": F.count_if(bad_path),
        "cases with a blank tag": F.count_if(F.exists("tags", blank)),
    }
    found = cases.agg(*[n.alias(f"n{i}") for i, n in enumerate(faults.values())]).first()
    wrong = [f"{n} {name}" for name, n in zip(faults, found) if n]
    if wrong:
        raise ValueError("; ".join(wrong))
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.trim(t))
    return cases.select(F.col("id").alias("case_id"), "query", F.explode(F.array_distinct(clean)).alias("path"), tags.alias("tags"))


def in_suites(cases: DataFrame, suites: list[str]) -> DataFrame:
    """Cases with a tag among `suites`; "full" stands for all. Raises ValueError for a suite that no case has."""
    if "full" in suites:
        return cases
    wanted = F.array(*[F.lit(x) for x in suites])
    known = cases.select(F.explode(F.array_intersect("tags", wanted)).alias("tag")).distinct()  # at most the suites asked for
    unknown = set(suites) - {r.tag for r in known.collect()}
    if unknown:
        raise ValueError(f"unknown suites: {', '.join(sorted(unknown))}")
    return cases.where(F.arrays_overlap("tags", wanted))


def first_places(results: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """case_id, path, position of results (case_id, path, position): each path once, at the place of its first, counted anew.

    `excluded` paths (path) are left out before places are counted.
    """
    rows = results if excluded is None else results.join(excluded.select("path").distinct(), "path", "left_anti")
    once = rows.groupBy("case_id", "path").agg(F.min("position").alias("first"))
    return once.select("case_id", "path", F.row_number().over(Window.partitionBy("case_id").orderBy("first", "path")).alias("position"))


def ranks(results: DataFrame, expected: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """case_id, rank: the best place of an expected path among the distinct paths of a case's results, or null."""
    hit = first_places(results, excluded).join(expected, ["case_id", "path"]).groupBy("case_id").agg(F.min("position").alias("rank"))
    return expected.select("case_id").distinct().join(hit, "case_id", "left")


def measures_by(ranked: DataFrame, *keys: str) -> DataFrame:
    """A row for each value of the keys: cases, hit1, hit3, hit5, mrr, tokens, hit5_per_1k of rank and tokens."""
    hit = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))
    tokens = F.avg(F.coalesce("tokens", F.lit(0)))
    cols = [hit(k).alias(f"hit{k}") for k in (1, 3, 5)]
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("cases"), *cols, F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"), tokens.alias("tokens"), (hit(5) / F.greatest(F.lit(0.001), tokens / 1000)).alias("hit5_per_1k"))


def delta(measured: DataFrame, key: str, one: str, other: str, names: list[str], *by: str) -> DataFrame:
    """The row of measured where `key` is `one` less that where it is `other`, for each of `by`: one aggregate, no join."""
    of = lambda c, v: F.max(F.when(F.col(key) == v, F.col(c)))
    return measured.groupBy(*by).agg(*[(of(c, one) - of(c, other)).alias(c) for c in names])


def measures(ranked: DataFrame) -> DataFrame:
    """One row: cases, hit1, hit3, hit5, mrr, p95_rank of case_id, rank."""
    hit = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"hit{k}")
    return ranked.agg(F.count(F.lit(1)).alias("cases"), hit(1), hit(3), hit(5), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY rank)").alias("p95_rank"))


def gate(measured: DataFrame, least_hit5: float = 1.0, least_mrr: float = 0.85) -> DataFrame:
    """Adds `passed`."""
    return measured.withColumn("passed", (F.col("hit5") >= least_hit5) & (F.col("mrr") >= least_mrr))
