"""Exact deduplication as a stateful stream, with Spark's own operators only.

Rows of a call land in a content table in the store's folder: stable id, length, digest of the normalised text, and the
normalised text itself. A stream over that table is grouped by digest; the state keeps, for each digest ever seen, how
many rows had it, which row stays, and where its content is (file and row of the content table). The state is
disk-backed (RocksDB) and nothing expires, and the store's folder keeps its checkpoint, so that a later call, in
another session too, goes on with the same state.

Rows whose digest the state has seen more than once are hits. Their full bytes are compared with those that the locator
points at; texts of equal digests but unequal bytes, should there ever be any, are then grouped by their bytes.

Equal texts: identical after deleting U+0020 and U+0009 to U+000D. The row with the most code points,
then the smallest doc_id, stays.

Defined results: null text counts as empty, and all empty texts are one group; a null doc_id loses
against any other; ids may be of any type that has an order; repeated (doc_id, text) rows are rows of their own in group_size and each come out;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import key_bitmap, scratch, stored, with_hit

SPACES = " \t\n\u000b\f\r"
#: The state is on disk; its many small stores don't set space aside before they need it.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def records(docs: DataFrame) -> DataFrame:
    """doc_id, n_points, sha, norm (the normalised text) of a batch or a stream."""
    norm = docs.select("doc_id", points(F.col("text")).alias("n_points"), normalised(F.col("text")).alias("norm"))
    return norm.select("doc_id", "n_points", digest(F.col("norm")).alias("sha"), "norm")


def digest(norm: Column) -> Column:
    return F.sha2(norm, 256)


def points(text: Column) -> Column:
    return F.char_length(F.coalesce(text.cast("string"), F.lit(""))).cast("long")


def keep_state(stream: DataFrame, folder: str) -> DataFrame:
    """Run what is new of a stream through the keyed state to its end; all digests so far: sha, rows, head.

    `stream` has doc_id, n_points, sha, locator. Each trigger appends the keys it changed; a key's last change is its state.
    """
    spark = stream.sparkSession
    had = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        state = stream.groupBy("sha").agg(F.count(F.lit(1)).alias("rows"), F.min_by(F.struct("doc_id", "locator"), best()).alias("head"))

        def append(batch: DataFrame, number: int) -> None:  # a trigger that runs again writes the same folder again
            batch.write.mode("overwrite").parquet(f"{folder}/state/trigger={number}")

        query = state.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/progress").foreachBatch(append).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in had.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    log = spark.read.schema(state.schema.add("trigger", "long")).parquet(f"{folder}/state")
    return log.groupBy("sha").agg(F.max("rows").alias("rows"), F.max_by("head", "rows").alias("head"))


def best() -> Column:
    """The order of copies, the one that stays first: most code points, then an id before none, then the smallest id of any type."""
    return F.struct(-F.col("n_points"), F.col("doc_id").isNull(), F.col("doc_id"))


def groups(docs: DataFrame, folder: str | None = None, name: str = "dedup", files_a_trigger: int | None = None, batch: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of a batch of documents.

    With `folder` the batch joins the texts of all earlier calls with that folder, and is judged against them too. A call that
    is repeated, after a failure or not, has the `batch` name of the first: its rows, which have landed under that name, count
    once. Without a name each call is a batch of its own.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, name)
    batch = batch or uuid.uuid4().hex[:12]
    if not re.fullmatch(r"[\w\-]+", batch):
        raise ValueError("a batch name has letters, digits, _ and - only")
    own = records(docs)
    landed = land(own, folder, batch)
    if not landed.inputFiles() or landed.isEmpty():
        return landed.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    heads = stored(keep_state(located(spark.readStream, own.schema, folder, files_a_trigger), folder), f"{name}-heads")
    odd = stored(unequal(landed, heads, located(spark.read, own.schema, folder), name), f"{name}-unequal")
    out = landed.join(heads, "sha").select("sha", "norm", "doc_id", F.col("head.doc_id").alias("keep_id"), F.col("rows").alias("group_size"))
    if not odd.isEmpty():  # these digests stand for several texts: grouped by the bytes of all their rows
        every = located(spark.read, own.schema, folder).join(odd, "sha", "left_semi").groupBy("sha", "norm").agg(F.count(F.lit(1)).alias("group_size"), F.min_by("doc_id", best()).alias("keep_id"))
        theirs = landed.join(every, ["sha", "norm"]).select("sha", "norm", "doc_id", "keep_id", "group_size")
        out = out.join(odd, "sha", "left_anti").unionByName(theirs)
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def land(own: DataFrame, folder: str, batch: str) -> DataFrame:
    """The rows of a batch in the content table: written beside it and moved in whole, unless they are there already."""
    spark = own.sparkSession
    path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    call, beside = f"{folder}/content/call={batch}", f"{folder}/landing/call={batch}"
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(call)):
        own.write.mode("overwrite").option("compression", "zstd").parquet(beside)
        fs.mkdirs(path(f"{folder}/content"))
        if not fs.rename(path(beside), path(call)):
            raise OSError(f"{beside} cannot be moved to {call}")
    return spark.read.schema(own.schema).parquet(call)


def located(reader, schema, folder: str, files_a_trigger: int | None = None) -> DataFrame:
    """The content table, or the stream of it, with each row's locator."""
    reader = reader.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_a_trigger) if files_a_trigger else reader
    return reader.parquet(f"{folder}/content/call=*").withColumn("locator", F.concat_ws(":", F.col("_metadata.file_name"), F.col("_metadata.row_index")))


def unequal(landed: DataFrame, heads: DataFrame, content: DataFrame, name: str) -> DataFrame:
    """The digests of hits in `landed` whose full bytes are not those at the state's locator.

    Copies first meet within each task, and only the located rows of the content table move.
    """
    several = heads.where("rows > 1")
    found = with_hit(landed, key_bitmap(several, "sha", f"{name}-hits"), "sha").where("hit").select("sha", "norm").distinct()
    spots = stored(several.select("sha", F.col("head.locator").alias("locator")), f"{name}-spots")
    first = with_hit(content, key_bitmap(spots, "locator", f"{name}-spot-bits"), "locator").where("hit").join(spots, ["sha", "locator"]).select("sha", F.col("norm").alias("first"))
    return found.join(first, "sha").where("norm <> first").select("sha").distinct()
