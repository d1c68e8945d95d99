"""Maintain the index: what changed, what stays, what is missing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 0.001  # seconds by which modification times may differ


def freshness(indexed: DataFrame, scanned: DataFrame) -> DataFrame:
    """path, state (new, missing, modified, metadata_changed, fresh) from path, size, mtime (seconds), hash of both sides."""
    i = indexed.select("path", F.col("size").alias("i_size"), F.col("mtime").alias("i_mtime"), F.col("hash").alias("i_hash"))
    both = i.join(scanned, "path", "full_outer")
    touched = (F.col("size") != F.col("i_size")) | (F.abs(F.col("mtime") - F.col("i_mtime")) > TOLERANCE)
    state = F.when(F.col("i_hash").isNull(), "new").when(F.col("hash").isNull(), "missing").when(touched & (F.col("hash") != F.col("i_hash")), "modified").when(touched, "metadata_changed").otherwise("fresh")
    return both.select("path", state.alias("state"))


def freshness_counts(states: DataFrame) -> DataFrame:
    """One row: the number of files in each state, and whether the index is fresh or stale."""
    counts = [F.count_if(F.col("state") == s).alias(s) for s in ("new", "missing", "modified", "metadata_changed", "fresh")]
    return states.agg(*counts).withColumn("status", F.when(F.col("new") + F.col("missing") + F.col("modified") > 0, "stale").otherwise("fresh"))


def stale_delete(rows: DataFrame, active: DataFrame) -> DataFrame:
    """Rows whose path is still there."""
    return rows.join(active.select("path").distinct(), "path", "left_semi")


def reindex(chunks: DataFrame, indexed: DataFrame, scanned: DataFrame, rechunk: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The next version of a chunk table: unchanged files keep their rows, changed and new ones are cut anew, others go.

    `rechunk` only gets the files that changed.
    """
    kept = indexed.select("path", "hash").join(scanned.select("path", "hash"), ["path", "hash"], "left_semi").select("path")
    changed = scanned.join(kept, "path", "left_anti")
    return chunks.join(kept, "path", "left_semi").unionByName(rechunk(changed))


def upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """path, id, hash, change (inserted, updated, kept) of a file table after rows of path, hash came in.

    A path that is there keeps its id; a new one gets an id that its path alone decides, so that a second run gives the same.
    """
    new = incoming.select("path", F.col("hash").alias("new_hash"))
    both = existing.select("path", "id", "hash").join(new, "path", "full_outer")
    change = F.when(F.col("id").isNull(), "inserted").when(F.col("new_hash") != F.col("hash"), "updated").otherwise("kept")
    return both.select("path", F.coalesce("id", stable_id(F.col("path"))).alias("id"), F.coalesce("new_hash", "hash").alias("hash"), change.alias("change"))


def stable_id(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 16)


def repaired(rows: DataFrame, indexed: DataFrame, scanned: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The next version of any table of rows by path (postings, symbols, dependencies, vectors).

    Rows of files whose hash is unchanged stay, those of changed and new files are made anew, those of files that are gone
    go; and so do rows whose file the index does not know, while files of the index that have no rows are made anew.
    """
    same = indexed.select("path", "hash").join(scanned.select("path", "hash"), ["path", "hash"], "left_semi").select("path")
    good = same.join(rows.select("path").distinct(), "path", "left_semi")
    return rows.join(good, "path", "left_semi").unionByName(make(scanned.join(good, "path", "left_anti")))


def next_actions(status: DataFrame) -> DataFrame:
    """position, action: what an index needs next, of one row of counts.

    The row has files, chunks, posting_chunks (chunks with postings), symbols, dependencies, embeddings (of the wanted
    size) and status (fresh or stale). Without a row there is no index. An index that needs nothing is ready.
    """
    few = F.col("embeddings") < F.col("chunks")
    none = F.col("embeddings") == 0
    rules = [
        (F.col("status") == "stale", "refresh changed files"),
        ((F.col("files") == 0) | (F.col("chunks") == 0), "index files and chunks"),
        (F.col("posting_chunks") < F.col("chunks"), "repair missing postings"),
        ((F.col("symbols") == 0) & (F.col("files") > 0), "extract symbols"),
        ((F.col("dependencies") == 0) & (F.col("files") > 1), "extract dependencies"),
        (none, "embed chunks"),
        (few & ~none, "embed missing chunks"),
    ]
    found = F.filter(F.array(*[F.when(when, what) for when, what in rules]), lambda a: a.isNotNull())
    listed = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("ready")))
    all_ = F.max(listed)  # no group: a row even where there is no index
    actions = status.agg(all_.alias("a")).select(F.coalesce("a", F.array(F.lit("create the index"), F.lit("embed chunks"))).alias("a"))
    return actions.select(F.posexplode("a").alias("at", "action")).select((F.col("at") + 1).cast("long").alias("position"), "action")


def latest_records(held: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """A table of records after others came in: those of the same key replace what was held, the last of them by `at`."""
    new = first_of_key(incoming.withColumn("_back", -F.col("at")), key, ["_back"]).drop("_back")
    return held.join(new.select(*key), key, "left_anti").unionByName(new.select(*held.columns))


def first_of_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: a partial aggregate before the shuffle, no window."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, *[F.col("r")[c].alias(c) for c in rest])


def pending(chunks: DataFrame, embedded: DataFrame, most: int | None = None) -> DataFrame:
    """Chunks without an embedding, in the order of path and first line."""
    rows = chunks.join(embedded.select("chunk_id").distinct(), "chunk_id", "left_anti").orderBy("path", "start_line", "chunk_id")
    return rows.limit(most) if most else rows


def embed(chunks: DataFrame, provider: Callable[[list[str]], list[list[float]]], size: int, batch: int = 16) -> DataFrame:
    """chunk_id, vector of each chunk; texts go to the provider `batch` at a time, one by one where a batch is refused."""
    if size <= 0 or batch <= 0:
        raise ValueError("size and batch must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts, vectors = rows["text"].to_pylist(), []
            for i in range(0, len(texts), batch):
                some = texts[i : i + batch]
                try:
                    got = provider(some)
                except NotImplementedError:
                    got = [provider([t])[0] for t in some]
                if any(len(v) != size for v in got):
                    raise ValueError(f"the provider's vectors do not have {size} elements")
                vectors += got
            yield pa.RecordBatch.from_arrays([rows["chunk_id"], pa.array(vectors, pa.list_(pa.float32()))], names=["chunk_id", "vector"])

    src = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), "text")
    return src.mapInArrow(run, "chunk_id string, vector array<float>")


def length_provider(size: int = 8) -> Callable[[list[str]], list[list[float]]]:
    """A provider without a network: every element is the last digit of the text's length, in tenths."""
    return lambda texts: [[len(t) % 10 / 10] * size for t in texts]


def coverage(sets: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Rows of sets (set_id, ...) with their number of embeddings, 0 where there is none."""
    return sets.join(embeddings.groupBy("set_id").agg(F.count("chunk_id").alias("n")), "set_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
