"""The corpus pipeline: each stage filters or encodes what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import pipeline as _stages
from lodestone.llm.common import stored

STAGES = _stages.STAGES
ORACLE_SQL = None  # a trained classifier's decisions cannot be expressed in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
