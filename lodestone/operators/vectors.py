"""A clustered vector index: exact nearest neighbours by triangle inequality, and an approximate mode.

Centroids are fitted on a bounded sample of rows; every row is then put to its nearest centroid and written in ranges of
(cluster, distance to the centroid), with each cluster's count and its nearest and farthest member. A table of queries is
answered in two passes. The first visits each query's nearest clusters, as few as hold k rows: the k-th distance there is
one that the answer does not exceed. The second visits the other clusters that may hold a nearer row, and of these only rows
whose distance to the centroid allows it: a row at distance r from a centroid that is c away from the query is at least
|c - r| away from the query. Distances come from a matrix product for each run of rows of a cluster; those that may be among
the k best are worked out again from differences, and each task keeps the k best of each query.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..storage import discard, scratch, stored

SAMPLE = 20_000  # rows that centroids are fitted on
MOST_CLUSTERS = 1024
ROUNDS = 8
MOST_QUERIES = 10_000
PLACES = 9  # distances are compared after rounding


class VectorIndex(NamedTuple):
    rows: DataFrame  #: key columns, vector, cluster, radius (distance to the centroid)
    key: list[str]
    centroids: np.ndarray
    least: np.ndarray  #: of each cluster, the smallest radius,
    most: np.ndarray  #: the largest,
    n: np.ndarray  #: and how many rows
    path: str


def _near(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and the distance to it, from differences."""
    out = (-2.0 * v @ c.T + (c * c).sum(1)).argmin(1)
    return out, np.sqrt(((v - c[out]) ** 2).sum(1))


def fitted(sample: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """k centroids of a sample, or fewer where it has fewer distinct rows."""
    distinct = np.unique(sample, axis=0)
    c = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]]
    for _ in range(ROUNDS):
        own = _near(sample, c)[0]
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _usable(vector: str, dims: int):
    v = F.col(vector)
    return v.isNotNull() & F.coalesce((F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def drawn_rows(rows: DataFrame, number: Column, total: int, n: int) -> list[list[float]]:
    """The vectors of the n rows with the smallest numbers, which are hashes; rows are `total`.

    Each task sends its n smallest to the driver, so rows are first cut at a number below which some more than n are expected:
    what all tasks send together does not grow with the rows. Should fewer be there, the cut is widened.
    """
    share = (n + 6 * n**0.5 + 20) / max(total, 1)
    while True:
        some = rows.where(number <= F.lit(int(-(2**63) + share * 2**64))) if share < 1 else rows
        got = [r["vector"] for r in some.orderBy(number).limit(n).select("vector").collect()]  # a bounded sample
        if len(got) == n or share >= 1:
            return got
        share *= 4


def build(rows: DataFrame, key: list[str], vector: str, dims: int, clusters: int | None = None, sample: int = SAMPLE, path: str | None = None) -> VectorIndex:
    """The index of all rows whose vector has `dims` finite elements; others are left out. Rows may repeat.

    `sample` rows, those whose keys have the smallest hashes, fit the centroids; by default as many as the root of the
    number of rows, up to MOST_CLUSTERS.
    """
    spark = rows.sparkSession
    path = path or scratch(spark, "vector-index")
    # stored, as five passes follow, and a vector may be costly to make
    given = stored(rows.select(*key, F.col(vector).cast("array<double>").alias("vector")), "vectors")
    good = given.where(_usable("vector", dims))
    total = good.count()
    drawn = drawn_rows(good, F.xxhash64(*key), total, sample)
    centroids = fitted(np.array(drawn).reshape(-1, dims), clusters or min(MOST_CLUSTERS, max(1, int(total**0.5)))) if drawn else np.zeros((0, dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, radius = _near(np.asarray(b["vector"].flatten()).reshape(-1, dims), centroids)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int32()), pa.array(radius)], names=[*b.schema.names, "cluster", "radius"])

    schema = T.StructType([*good.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("radius", T.DoubleType())])
    order = ["cluster", "radius"]
    good.mapInArrow(run, schema).repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
    discard(given)
    held = spark.read.schema(schema).parquet(path)
    least, most, n = np.zeros(len(centroids)), np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
    for r in held.groupBy("cluster").agg(F.min("radius").alias("least"), F.max("radius").alias("most"), F.count(F.lit(1)).alias("n")).collect():  # a row a cluster
        least[r["cluster"]], most[r["cluster"]], n[r["cluster"]] = r["least"], r["most"], r["n"]
    return VectorIndex(held, key, centroids, least, most, n, path)


def _visit(index: VectorIndex, asked: np.ndarray, plan: list[np.ndarray], far: np.ndarray, bound: np.ndarray, k: int) -> DataFrame:
    """q, key columns, distance of the k best rows of each task, of the clusters that `plan` has each query visit; and, in rows
    without a key, how many rows each query met (`met`)."""
    by_cluster: dict[int, list[int]] = {}
    for q, cs in enumerate(plan):
        for c in cs.tolist():
            by_cluster.setdefault(c, []).append(q)
    wanted = {c: np.array(q) for c, q in by_cluster.items()}
    key, kinds = index.key, [index.rows.schema[c] for c in index.key]
    dims = asked.shape[1]
    norms = (asked * asked).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}  # query: distances, key columns
        met: dict[int, int] = {}
        for b in batches:
            cluster, radius = b["cluster"].to_numpy(), b["radius"].to_numpy()
            v = np.asarray(b["vector"].flatten()).reshape(-1, dims)
            edges = np.append(np.flatnonzero(np.append(True, cluster[1:] != cluster[:-1])), len(cluster)) if len(cluster) else np.zeros(1, np.int64)
            for x, y in zip(edges[:-1], edges[1:]):
                qs = wanted.get(int(cluster[x]))
                if qs is None:
                    continue
                run_v, run_r = v[x:y], radius[x:y]
                square = -2.0 * run_v @ asked[qs].T + (run_v * run_v).sum(1)[:, None] + norms[qs]
                slack = 1e-9 * (1.0 + norms[qs].max() + float((run_v * run_v).sum(1).max()))
                for j, q in enumerate(qs.tolist()):
                    here = np.flatnonzero(np.abs(far[q, cluster[x]] - run_r) <= bound[q])  # rows that the triangle leaves
                    met[q] = met.get(q, 0) + len(here)
                    d = square[here, j]
                    cut = min(bound[q], best[q][0][-1] if q in best and len(best[q][0]) == k else np.inf)
                    ok = d <= cut * cut + slack + 2e-9
                    if len(d) > k:
                        ok &= d <= np.partition(d, k - 1)[k - 1] + 2 * slack + 4e-9
                    pick = here[ok]
                    if not len(pick):
                        continue
                    exact = np.round(np.sqrt(((run_v[pick] - asked[q]) ** 2).sum(1)), PLACES)
                    cols = [b[c].take(pa.array(x + pick)).to_numpy(zero_copy_only=False) for c in key]
                    if q in best:
                        exact = np.concatenate((best[q][0], exact))
                        cols = [np.concatenate((o, n)) for o, n in zip(best[q][1], cols)]
                    first = np.lexsort((*cols[::-1], exact))[:k]
                    best[q] = exact[first], [c[first] for c in cols]
        for q, (d, cols) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([q] * len(d), pa.int32()), pa.array(d), pa.array([None] * len(d), pa.int64()), *[pa.array(c.tolist(), t) for c, t in zip(cols, types)]], names=names)
        if met:
            yield pa.RecordBatch.from_arrays([pa.array(list(met), pa.int32()), pa.nulls(len(met), pa.float64()), pa.array(list(met.values()), pa.int64()), *[pa.nulls(len(met), t) for t in types]], names=names)

    types = [to_arrow_type(f.dataType) for f in kinds]
    names = ["q", "distance", "met", *key]
    schema = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("distance", T.DoubleType()), T.StructField("met", T.LongType()), *kinds])
    rows = index.rows.where(F.col("cluster").isin(sorted(wanted))) if wanted else index.rows.where("false")
    return rows.mapInArrow(run, schema)


def nearest(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, query_id: str = "query_id", vector: str = "vector") -> tuple[DataFrame, DataFrame]:
    """query_id, position, key columns, distance of the k nearest rows of each query; and query_id, met, share: the rows that it
    met, and their share of all.

    Queries (query_id, vector) are a bounded set; those with another length or non-finite elements get no rows. With `probes`
    only so many clusters are visited, and rows may be missed; without, the answer is exact. Distances are rounded to nine
    places, and equal ones go by the key columns.
    """
    if k <= 0 or probes is not None and probes <= 0:
        raise ValueError("k and probes must be positive")
    spark, dims = queries.sparkSession, index.centroids.shape[1]
    if len(queries.limit(MOST_QUERIES + 1).select(query_id).collect()) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries: search them in several calls")
    got = queries.where(_usable(vector, dims)).select(query_id, F.col(vector).cast("array<double>").alias("v")).collect()  # a bounded set
    names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(got)], T.StructType([T.StructField("q", T.IntegerType()), T.StructField("query_id", queries.schema[query_id].dataType)]))
    asked = np.array([r["v"] for r in got], np.float64).reshape(-1, dims)
    far = np.array([np.sqrt(((index.centroids - a) ** 2).sum(1)) for a in asked]).reshape(len(asked), len(index.centroids))
    order = far.argsort(1, kind="stable")
    filled = np.cumsum(index.n[order], 1) if len(index.centroids) else np.zeros((len(asked), 0))
    front = [o[: probes or int(np.searchsorted(f, k)) + 1] for o, f in zip(order, filled)]
    none = np.full(len(asked), np.inf)
    ranked = lambda rows: rows.where("met IS NULL").withColumn("position", F.row_number().over(Window.partitionBy("q").orderBy("distance", *index.key))).where(F.col("position") <= k)
    first = stored(_visit(index, asked, front, far, none, k), "near")
    parts = [first]
    if probes is None:
        bound = none.copy()
        for r in ranked(first).where(F.col("position") == k).collect():  # a row a query
            bound[r["q"]] = r["distance"] + 2 * 10.0**-PLACES
        low = np.maximum(np.maximum(far - index.most, index.least - far), 0) if len(index.centroids) else far
        rest = [np.setdiff1d(np.flatnonzero((low[q] <= bound[q]) & (index.n > 0)), front[q]) for q in range(len(asked))]
        parts.append(stored(_visit(index, asked, rest, far, bound, k), "farther"))
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    out = stored(ranked(every).join(F.broadcast(names), "q").select("query_id", "position", *index.key, "distance"), "nearest")  # k rows a query
    met = every.where("met IS NOT NULL").groupBy("q").agg(F.sum("met").alias("met")).join(F.broadcast(names), "q")
    share = stored(met.select("query_id", "met", (F.col("met") / F.lit(int(index.n.sum()))).alias("share")), "met")
    discard(*parts)
    return out, share


def probes_for(index: VectorIndex, k: int, recall: float = 0.9, sample: int = 200, margin: float = 0.03) -> int:
    """How many clusters an approximate search visits to find `recall` of the k nearest rows, measured on stored rows.

    `sample` rows, those whose keys have the smallest hashes, ask for their nearest other rows exactly; where these stand in
    the order of clusters gives the recall of every number of clusters at once.
    """
    if not len(index.centroids):
        return 1
    spark = index.rows.sparkSession
    drawn = drawn_rows(index.rows, F.xxhash64(F.lit("probe"), *index.key), int(index.n.sum()), sample)
    asked = spark.createDataFrame(list(enumerate(drawn)), "query_id int, vector array<double>")
    near, met = nearest(index, asked, k + 1)
    found = near.where("position > 1").join(index.rows.select(*index.key, "cluster"), index.key).select("query_id", "cluster").collect()  # sample times k rows
    discard(near, met)
    far = np.array([((index.centroids - np.array(v)) ** 2).sum(1) for v in drawn])
    place = far.argsort(1, kind="stable").argsort(1)
    ranks = np.sort([place[r["query_id"], r["cluster"]] for r in found])
    if not len(ranks):
        return len(index.centroids)
    need = min(len(ranks), int(np.ceil(min(1.0, recall + margin) * len(ranks))))
    return int(ranks[need - 1]) + 1
