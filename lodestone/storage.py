"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent on a local master (tests, a laptop) a temporary folder is made: on a cluster each
    executor would write to a disk of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.lodestone.scratch", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^-]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share on {master or 'this master'}")
        base = tempfile.mkdtemp(prefix="spark-lodestone-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.lodestone.scratch", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame | str) -> None:
    """Delete tables made by stored(), or folders, once nothing reads them any more."""
    for t in tables:
        spark = SparkSession.getActiveSession()
        with contextlib.suppress(Exception):
            paths = [t] if isinstance(t, str) else {f.rsplit("/", 1)[0] for f in t.inputFiles()}
            for p in paths:
                path = spark._jvm.org.apache.hadoop.fs.Path(p)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(spark: SparkSession) -> None:
    """Between rounds of many short jobs: have the driver's heap collected, so that Spark's cleaner drops the shuffles and broadcasts
    of tables that are gone, and the heap does not grow over what these left."""
    spark.sparkContext._jvm.System.gc()


# --- a filter for keys that some rows have ---

#: Bits of a bitmap: 16 for each key, between these bounds. The upper one makes 2**20 rows of 64 bits; beyond some 16
#: million keys ever more rows count as hits, until beyond 100 million a join behind it is a plain shuffle join.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26
_SPOT, _WORD, _BITS = "__bitmap_spot", "__bitmap_word", "__bitmap_bits"


class Bitmap(NamedTuple):
    words: DataFrame
    bits: int


def key_bitmap(keys: DataFrame, key: str, name: str) -> Bitmap:
    """The hashes of the keys of a stored table as a stored bitmap of bounded size."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * keys.count()).bit_length()))
    spot = keys.select(F.pmod(F.xxhash64(key), F.lit(bits)).alias(_SPOT))
    words = spot.groupBy((F.col(_SPOT) / 64).cast("int").alias(_WORD)).agg(F.expr(f"bit_or(shiftleft(1L, CAST({_SPOT} % 64 AS INT)))").alias(_BITS))
    return Bitmap(stored(words, name), bits)


def with_hit(rows: DataFrame, bitmap: Bitmap, key: str, hit: str = "hit") -> DataFrame:
    """Adds `hit`: whether a row's key may be one of the bitmap's. The bitmap's bound holds for the broadcast."""
    marked = rows.withColumn(_SPOT, F.pmod(F.xxhash64(key), F.lit(bitmap.bits))).withColumn(_WORD, (F.col(_SPOT) / 64).cast("int"))
    return marked.join(F.broadcast(bitmap.words), _WORD, "left").withColumn(hit, F.expr(f"coalesce(getbit({_BITS}, CAST({_SPOT} % 64 AS INT)), 0) = 1")).drop(_SPOT, _WORD, _BITS)
