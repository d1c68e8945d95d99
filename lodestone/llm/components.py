"""Connected components of a graph given by its edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest reachable node) of the nodes of edges (a, b) of longs.

    Each round works on edges alone and is written to the shared folder; rounds end when every node that an edge leaves
    has one target and no edge leaves a target, since such stars cannot touch. Without edges there are none.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        # large star: a node's larger neighbours move to the least node near it
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "edges")
        # small star: a node and its smaller neighbours move to the least of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        new = stored(small, "edges")
        discard(now, large)
        now = new
        ends = now.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("leaves")), F.struct(F.col("v").alias("node"), F.lit(0).alias("leaves")))).alias("e")).select("e.*")
        if ends.groupBy("node").agg(F.sum("leaves").alias("out"), F.min("leaves").alias("least")).where("out > 1 OR out > 0 AND least = 0").isEmpty():
            break
    roots = now.select(F.col("v").alias("node")).distinct().join(now.select(F.col("u").alias("node")), "node", "left_anti")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
