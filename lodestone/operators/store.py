"""An index on disk whose later runs rewrite only what changed.

Every table of the index (files, and any other rows by path: chunks, symbols, dependencies, postings, vectors) is kept in
buckets by the hash of the path. A version is a small list that names, for each table and bucket, the folder that holds it. A
run compares hashes of files, and touches the buckets with a new, modified or missing file alone: of these, rows of unchanged
files are carried over and those of changed ones are made anew; all other buckets stay where they are. Folders of a run have
names of their own, and its version is written last, in one piece and only if no other run was first. So a run that fails
leaves the version before it readable, and readers never see half a run. Folders that no version names any more are deleted
by `vacuum`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import discard, key_bitmap, stored, with_hit

BUCKETS = 64
FILES = "files"
_HIT = "__store_hit"


class Run(NamedTuple):
    version: int
    states: dict[str, int]  #: files by state: new, modified, missing, kept
    touched: int  #: buckets that were rewritten
    carried: int  #: files of these whose rows were carried over


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def latest(spark: SparkSession, path: str) -> dict | None:
    """The newest version's list, or None where there is no index."""
    done = [int(n.removesuffix(".json")) for n in _names(spark, f"{path}/versions") if n.endswith(".json") and not n.startswith((".", "_"))]
    if not done:
        return None
    return json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}/versions/{max(done)}.json").collect()))


def read(spark: SparkSession, path: str, table: str, version: dict | None = None) -> DataFrame:
    """A table of an index, with its column `bucket`; a filter on that reads only such folders."""
    version = version or latest(spark, path)
    if version is None or table not in version["tables"]:
        raise ValueError(f"no table {table} in an index at {path}")
    entry = version["tables"][table]
    schema = T.StructType.fromJson(entry["schema"])
    folders = [f"{path}/{table}/run={run}/bucket={b}" for b, run in entry["buckets"].items()]
    if not folders:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())]))
    whole = T.StructType([*schema.fields, T.StructField("run", T.StringType()), T.StructField("bucket", T.IntegerType())])
    return spark.read.schema(whole).option("basePath", f"{path}/{table}").parquet(*folders).drop("run")


def _commit(spark: SparkSession, path: str, version: dict) -> None:
    """Write a version under a name of its own, then give it its number: only one run can."""
    fs, draft = _fs(spark, f"{path}/versions/.draft-{uuid.uuid4().hex}")
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{version['version']}.json")
    out = fs.create(draft, False)
    out.write(json.dumps(version).encode())
    out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise RuntimeError(f"another run wrote version {version['version']} of {path} first")


def update(path: str, scanned: DataFrame, makers: dict[str, Callable[[DataFrame], DataFrame]], buckets: int = BUCKETS) -> Run:
    """Bring the index at `path` to the files scanned (path, hash and what makers read), each path once.

    A maker gets rows of changed files and gives rows with a column `path`. The number of buckets is that of the first run.
    Files are shuffled once, in the order of their buckets, and what makers give of them is written as it comes, so a narrow
    maker's rows are not shuffled. Nor are rows that are carried over: a bitmap of bounded size tells most of them from those of
    modified and missing files, and only what it leaves in doubt is joined.
    """
    spark = scanned.sparkSession
    before = latest(spark, path)
    buckets = before["bucket_count"] if before else buckets
    bucket = F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int").alias("bucket")
    held = read(spark, path, FILES, before).select("path", F.col("hash").alias("old")) if before else spark.createDataFrame([], "path string, old string")
    state = F.when(F.col("old").isNull(), "new").when(F.col("hash").isNull(), "missing").when(F.col("old") == F.col("hash"), "kept").otherwise("modified")
    states = stored(held.join(scanned.select("path", "hash"), "path", "full_outer").select("path", bucket, state.alias("state")), "file-states")
    counts = {r["state"]: r["count"] for r in states.groupBy("state").count().collect()}
    counts = {s: counts.get(s, 0) for s in ("new", "modified", "missing", "kept")}
    touched = sorted(r["bucket"] for r in states.where("state <> 'kept'").select("bucket").distinct().collect())  # a number a bucket
    makers = {FILES: lambda f: f.select("path", "hash"), **makers}
    if before and not touched and set(makers) == set(before["tables"]):
        return Run(before["version"], counts, 0, 0)
    kept = states.where((F.col("state") == "kept") & F.col("bucket").isin(touched)).select("path")
    gone = stored(states.where("state IN ('modified', 'missing')").select("path"), "gone-files")
    bits = key_bitmap(gone, "path", "gone-bits")
    ordered = lambda files: stored(files.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket").drop("bucket"), "changed-files")
    changed = ordered(scanned.join(states.where("state IN ('new', 'modified')").select("path"), "path", "left_semi"))
    whole = None
    run = uuid.uuid4().hex[:12]
    version = {"version": before["version"] + 1 if before else 1, "bucket_count": buckets, "tables": {}}
    for name, make in makers.items():
        if before and name in before["tables"]:
            fresh, entry = make(changed), before["tables"][name]
            old = read(spark, path, name, before).where(F.col("bucket").isin(touched)).drop("bucket")
            marked = with_hit(old, bits, "path", _HIT)
            maybe = marked.where(_HIT).select(*old.columns).join(kept, "path", "left_semi").repartition(bucket)  # rows of changed files, and few others
            rows = marked.where(~F.col(_HIT)).select(*old.columns).unionByName(maybe.select(*old.columns)).unionByName(fresh.select(*old.columns))
            places = {b: r for b, r in entry["buckets"].items() if int(b) not in touched}
        else:  # a table that is new to the index is made of all files
            whole = whole or (ordered(scanned) if before else changed)
            rows, places = make(whole), {}
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
        rows.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(f"{path}/{name}/run={run}")
        for folder in _names(spark, f"{path}/{name}/run={run}"):
            if folder.startswith("bucket="):
                places[folder.removeprefix("bucket=")] = run
        version["tables"][name] = {"schema": schema.jsonValue(), "buckets": places}
    _commit(spark, path, version)
    carried = kept.count()
    discard(states, gone, bits.words, changed, *([whole] if whole is not None and whole is not changed else []))
    return Run(version["version"], counts, len(touched), carried)


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete folders that the newest version does not name, of runs that failed or were replaced; gives their number."""
    now = latest(spark, path)
    gone = 0
    for name, entry in (now["tables"] if now else {}).items():
        named = {(run, b) for b, run in entry["buckets"].items()}
        for folder in _names(spark, f"{path}/{name}"):
            run = folder.removeprefix("run=")
            if folder.startswith("run="):
                own = [f for f in _names(spark, f"{path}/{name}/{folder}") if f.startswith("bucket=")]
                old = [f for f in own if (run, f.removeprefix("bucket=")) not in named]
                for f in old if len(old) < len(own) else [""]:
                    discard(f"{path}/{name}/{folder}/{f}".rstrip("/"))
                    gone += 1
    return gone
