"""The graph of files that import each other: neighbours, degrees, and a bounded walk from some files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import discard, stored


def degrees(files: DataFrame, resolved: DataFrame) -> DataFrame:
    """path, n_imports, n_imported_by of every file."""
    out = resolved.groupBy("path").agg(F.count(F.lit(1)).alias("n_imports"))
    into = resolved.where("resolved_path IS NOT NULL").groupBy(F.col("resolved_path").alias("path")).agg(F.count(F.lit(1)).alias("n_imported_by"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return files.select("path").distinct().join(out, "path", "left").join(into, "path", "left").select("path", zero("n_imports"), zero("n_imported_by"))


def neighbours(resolved: DataFrame, symbols: DataFrame, most: int) -> DataFrame:
    """path, kind (symbol, import or imported_by), item, line, at: the first `most` of each kind of every file."""
    rows = (
        symbols.select("path", F.lit("symbol").alias("kind"), F.col("name").alias("item"), "line")
        .unionByName(resolved.select("path", F.lit("import").alias("kind"), F.col("specifier").alias("item"), "line"))
        .unionByName(resolved.where("resolved_path IS NOT NULL").select(F.col("resolved_path").alias("path"), F.lit("imported_by").alias("kind"), F.col("path").alias("item"), "line"))
    )
    by_item = F.when(F.col("kind") == "imported_by", F.col("item"))
    at = F.row_number().over(Window.partitionBy("path", "kind").orderBy(by_item, "line", "item"))
    return rows.withColumn("at", at).where(F.col("at") <= most)


def edges_of(resolved: DataFrame, each: int) -> DataFrame:
    """path, to, at of both directions: what a file imports by (line, specifier), then what imports it by (path, line).

    Of each direction the first `each` of a file count, unresolved imports included. The cut is made within tasks before rows
    are shuffled, so a file that a large share of all files import is no task of its own.
    """
    out = resolved.withColumn("at", F.row_number().over(Window.partitionBy("path").orderBy("line", "specifier"))).where((F.col("at") <= each) & F.col("resolved_path").isNotNull()).select("path", F.col("resolved_path").alias("to"), "at")
    back = resolved.where("resolved_path IS NOT NULL").select(F.col("resolved_path").alias("path"), F.col("path").alias("to"), "line")
    into = back.withColumn("at", F.row_number().over(Window.partitionBy("path").orderBy("to", "line"))).where(F.col("at") <= each).select("path", "to", F.col("at") + each)
    return out.unionByName(into.toDF("path", "to", "at"))


def walk(resolved: DataFrame, seeds: DataFrame, depth: int, most: int, each: int = 16) -> DataFrame:
    """path, depth, via, position: files reached from seeds (path, order) within `depth` steps, `most` in all."""
    return walks(resolved, seeds.withColumn("query_id", F.lit(0)), depth, most, each).drop("query_id")


def walks(resolved: DataFrame, seeds: DataFrame, depth: int, most: int, each: int = 16) -> DataFrame:
    """query_id, path, depth, via, position: files reached from each query's seeds (query_id, path, order), stored.

    Level by level, all queries at once: a level's files are ordered by role, then by the place of the file that led there and
    of the edge; a file keeps the first way to it, and no more than `most` files of a query go on, seeds included. A level is
    one join of at most `most` files a query with the edges, of which a file has `each` a direction. Unknown seeds stay,
    without neighbours.
    """
    if depth < 0 or most < 0 or each <= 0:
        raise ValueError("depth and most must not be negative, each must be positive")
    edges = stored(edges_of(resolved, each).withColumnRenamed("path", "via"), "edges")
    role = T.role_priority(T.classify_path(F.col("path")))
    within = lambda *by: F.row_number().over(Window.partitionBy("query_id").orderBy(*by))
    first = seeds.groupBy("query_id", "path").agg(F.min("order").alias("order")).withColumn("role", role)
    level = first.withColumn("position", within("role", "order", "path")).where(F.col("position") <= most)
    seen = level = stored(level.select("query_id", "path", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via"), "position"), "level")
    for d in range(1, depth + 1):
        step = level.select("query_id", F.col("path").alias("via"), F.col("position").alias("from")).join(edges, "via")
        ways = step.groupBy("query_id", F.col("to").alias("path")).agg(F.min_by(F.struct("via", "from", "at"), F.struct("from", "at")).alias("way"))
        fresh = ways.join(seen.select("query_id", "path"), ["query_id", "path"], "left_anti").withColumn("role", role)
        done = seen.groupBy("query_id").agg(F.count(F.lit(1)).alias("done"))
        placed = fresh.withColumn("i", within("role", "way.from", "way.at", "path")).where(F.col("i") <= most).join(done, "query_id")
        level = placed.select("query_id", "path", F.lit(d).alias("depth"), F.col("way.via").alias("via"), (F.col("i") + F.col("done")).cast("int").alias("position")).where(F.col("position") <= most)
        level = stored(level, "level")
        seen = seen.unionByName(level)
    out = stored(seen, "walks")
    discard(edges, seen)
    return out
