"""Tables of the data folder, and what queries of one application build once and then share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_KEPT: dict[tuple, tuple] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(spark: SparkSession, sf_dir: str, name: str, make: Callable):
    """What `make` gives, a stored table or an index with a `path`; made once for a data folder and application, and anew
    where its files are gone."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key in _KEPT:
        value, where = _KEPT[key]
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return value
    value = make()
    where = value.inputFiles()[0].rsplit("/", 1)[0] if isinstance(value, DataFrame) else value.path
    _KEPT[key] = value, where
    return value
