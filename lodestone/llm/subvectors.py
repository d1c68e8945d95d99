"""Centroid clustering of vectors over dictionaries of distinct subvectors.

Components become integers, so that distances and means are exact. Vectors are dealt into segments of some ten thousand. In a
segment each block of neighbouring dimensions is coded without loss: a dictionary of the distinct subvectors, and a code a
vector. The width of blocks is the segment's own: the widest for which dictionaries are a good deal shorter than the segment,
as far as single dimensions. A round works out the squared distance of each dictionary entry to each centroid's block once,
and a vector's distance is the sum of its entries' distances, looked up by code. Sums for the next centroids go the same way:
how often each code occurs in each cluster, times the entries. What leaves a segment in a round is one row a cluster; a round
is one narrow pass over the coded segments and one aggregate of that, and only centroids (their number times the dimensions)
come to the driver.

Defined results: vectors that are null, of another length, or with null or non-finite components are left out; a component
beyond `MOST` after scaling raises an error, as squares would not fit 64 bits; repeated rows are vectors of their own; rows of
one id that is drawn as a first centroid are told apart by their components; a null id is drawn last; with fewer vectors than
centroids each is a centroid; no vectors give no rows; other columns are not read. Equal distances go to the smaller number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, stored

DIMS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 256, 40, 5, 2
SEGMENT = 16_384  # vectors that share dictionaries
WIDTHS = (8, 4, 2, 1)  # dimensions of a block, the first that pays
MOST = 1 << 27  # components' bound: 64 squares of differences fit 64 bits
_PARTS = "cluster int, n long, sums array<long>"


def kept(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """id, v: the vectors that count, as integers floor(scale * x)."""
    x = F.col(vector)
    fine = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    small = F.forall("v", lambda c: F.abs(c) <= MOST)
    rows = vectors.where(x.isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(key).alias("id"), scaled.alias("v"))
    return rows.withColumn("v", F.when(small, F.col("v")).otherwise(F.raise_error(F.lit(f"a component is beyond {MOST}")).cast("array<bigint>")).cast("array<int>"))


def first_centroids(rows: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The vectors whose ids have the k smallest hashes, in the order of these: k rows come to the driver."""
    drawn = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "v")
    return np.array([r["v"] for r in drawn.orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()], np.int64)


class Segment:
    """Vectors of one segment, coded: `entries` and `codes` by block."""

    def __init__(self, v: np.ndarray | None, parts: dict | None = None):
        if parts is not None:
            n, self.width = parts["n"], parts["width"]
            self.entries = [np.frombuffer(e, "<i4").reshape(-1, self.width).astype(np.int64) for e in parts["entries"]]
            self.codes = [np.frombuffer(c, "<u2" if len(c) == 2 * n else "<u4") for c in parts["codes"]]
            return
        for self.width in WIDTHS:
            if v.shape[1] % self.width:
                continue
            self.entries, self.codes = [], []
            for b in range(0, v.shape[1], self.width):
                entry, code = distinct_rows(v[:, b : b + self.width])
                if self.width > 1 and 4 * len(entry) > len(v):  # nothing gained by this width
                    break
                self.entries.append(entry)
                self.codes.append(code)
            else:
                return

    def parts(self) -> tuple[list[bytes], list[bytes]]:
        kind = lambda e: "<u2" if len(e) <= 1 << 16 else "<u4"
        return [e.astype("<i4").tobytes() for e in self.entries], [c.astype(kind(e)).tobytes() for e, c in zip(self.entries, self.codes)]

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's nearest centroid and squared distance: entries' distances, worked out once, summed by code."""
        total = np.zeros((len(self.codes[0]), len(centroids)), np.int64)
        for b, (entry, code) in enumerate(zip(self.entries, self.codes)):
            c = centroids[:, b * self.width : (b + 1) * self.width]
            table = np.zeros((len(entry), len(c)), np.int64)  # distinct subvectors x centroids
            for i in range(self.width):
                table += (entry[:, i, None] - c[None, :, i]) ** 2
            total += table[code]
        return total.argmin(1), total.min(1)

    def sums(self, cluster: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Vectors and component sums of each cluster, from how often each code is in it."""
        out = [(np.bincount(cluster * len(e) + c, minlength=k * len(e)).reshape(k, len(e)) @ e) for e, c in zip(self.entries, self.codes)]
        return np.bincount(cluster, minlength=k), np.concatenate(out, 1)


def distinct_rows(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a matrix, and each row's number among them."""
    if v.shape[1] == 1:
        entry, code = np.unique(v[:, 0], return_inverse=True)
        return entry[:, None], code
    order = np.lexsort(v.T)
    by = v[order]
    new = np.append(True, (by[1:] != by[:-1]).any(1))
    code = np.empty(len(v), np.int64)
    code[order] = np.cumsum(new) - 1
    return by[new], code


def coded(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """n, width, ids, entries, codes of each segment of rows (id, v): a narrow pass, to be stored."""
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("width", T.IntegerType()), T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField("entries", T.ArrayType(T.BinaryType())), T.StructField("codes", T.ArrayType(T.BinaryType()))])

    def one(ids: pa.Array, v: np.ndarray) -> pa.RecordBatch:
        s = Segment(v)
        entries, codes = s.parts()
        held = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int64()), pa.array([s.width], pa.int32()), held, pa.array([entries], pa.list_(pa.binary())), pa.array([codes], pa.list_(pa.binary()))], names=["n", "width", "ids", "entries", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vs, held = [], [], 0
        for batch in batches:
            flat = batch["v"].flatten()
            v = np.asarray(flat, np.int64).reshape(len(batch), -1)
            at = 0
            while at < len(batch):
                take = min(segment - held, len(batch) - at)
                ids.append(batch["id"].slice(at, take))
                vs.append(v[at : at + take])
                held, at = held + take, at + take
                if held == segment:
                    yield one(pa.concat_arrays(ids), np.concatenate(vs))
                    ids, vs, held = [], [], 0
        if held:
            yield one(pa.concat_arrays(ids), np.concatenate(vs))

    return rows.mapInArrow(run, schema)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, Segment]]:
    for batch in batches:
        for i in range(len(batch)):
            n = batch["n"][i].as_py()
            yield batch, i, Segment(None, {"n": n, "width": batch["width"][i].as_py(), "entries": batch["entries"][i].as_py(), "codes": batch["codes"][i].as_py()})


def moved(segments: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact floors of means; a centroid without vectors stays."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, s in _segments(batches):
            n, sums = s.sums(s.nearest(centroids)[0], k)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some], pa.int64()), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = segments.select("n", "width", "entries", "codes").mapInArrow(run, _PARTS)
    wide = parts.select("cluster", "n", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    out = centroids.copy()
    for r in wide.collect():  # centroids x dimensions
        out[r["cluster"], r["at"]] = int(r["x"]) // r["n"]
    return out


def assigned(segments: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, cluster, distance (squared) of every vector."""
    kind = segments.schema["ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, s in _segments(batches):
            cluster, distance = s.nearest(centroids)
            yield pa.RecordBatch.from_arrays([batch["ids"][i].values, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["id", "cluster", "distance"])

    return segments.mapInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]))


def clusters(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, segment: int = SEGMENT) -> tuple[DataFrame, np.ndarray]:
    """Each vector's (id, cluster, distance), stored, and the final centroids."""
    rows = kept(vectors, key, vector, dims, scale)
    segments = stored(coded(rows, segment), "segments")
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return stored(rows.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), "assigned"), centroids
    for _ in range(rounds):
        centroids = moved(segments, centroids)
    done = stored(assigned(segments, centroids), "assigned")
    discard(segments)
    return done, centroids


def with_inertia(done: DataFrame, centroids: np.ndarray, key: str = "vec_id") -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256 of what clusters() gives."""
    spark = done.sparkSession
    sums = done.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    digest = spark.createDataFrame([(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)], "cluster int, centroid_sha256 string")  # a row a centroid
    whole = done.agg(F.sum("distance").alias("inertia"))
    facts = sums.join(F.broadcast(digest), "cluster").join(F.broadcast(whole))  # a row a centroid, and one row
    return done.join(F.broadcast(facts), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
