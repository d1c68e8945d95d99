"""Keep a chunk table up to date from a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.chunking import Limits, chunk_files


def ingest(files: DataFrame, table: str, checkpoint: str, limits: Limits = Limits()):
    """Start a query that cuts each trigger's files (path, text) into chunks, one folder of `table` a trigger.

    A trigger that runs again writes its folder again. `current` reads the newest chunks of each path.
    """

    def write(batch: DataFrame, number: int) -> None:
        chunk_files(batch, limits).write.mode("overwrite").parquet(f"{table}/trigger={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, table: str) -> DataFrame:
    """The chunks of each path's last trigger."""
    rows = spark.read.parquet(table)
    last = rows.groupBy("path").agg(F.max("trigger").alias("trigger"))
    return rows.join(last, ["path", "trigger"], "left_semi").drop("trigger")
