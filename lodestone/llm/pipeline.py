"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and, but for the last, returns rows of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import key_bitmap, stored, table, with_hit


KEY, HIT = "__pipeline_key", "__pipeline_hit"


def without(docs: DataFrame, drop: DataFrame) -> DataFrame:
    """The rows of docs whose KEY is not in `drop`, KEY included; a null key is never dropped. Only texts that may go are shuffled."""
    drop = stored(drop.select(KEY).distinct(), "dropped")
    marked = with_hit(docs, key_bitmap(drop, KEY, "dropped-bits"), KEY, HIT)
    return marked.where(f"NOT {HIT}").drop(HIT).unionByName(marked.where(HIT).drop(HIT).join(drop, KEY, "left_anti").select(*docs.columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on these documents' labels, does not call toxic at the threshold of their language.

    Null and empty texts are scored too; repeated rows share one score; rows without doc_id are scored and never learnt
    from; any other columns, whatever their names, come out as they went in; no labels or no rows: nothing is dropped.
    """
    from . import toxicity as t

    model = t.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return t.scored(docs, model).where("NOT flagged").select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the longest original, then the smallest doc_id.

    Null text is empty text, and all empty texts are one group; null doc_ids lose against others; of rows that repeat
    doc_id and normalised text one stays. A doc_id on rows with different texts is judged row by row.
    """
    from . import stream_dedup as d

    def key(doc_id, sha):
        return F.concat_ws("/", F.coalesce(doc_id.cast("string"), F.lit("-")), sha)

    judged = stored(d.groups(docs, name="stage-dedup").select(key(F.col("doc_id"), F.col("text_sha256")).alias(KEY), "kept"), "stage-dedup-judged")
    left = without(docs.withColumn(KEY, key(F.col("doc_id"), F.sha2(d.normalised(F.col("text")), 256))), judged.where("NOT kept"))
    again = stored(judged.where("kept").groupBy(KEY).count().where("count > 1").select(KEY), "stage-dedup-repeats")
    marked = with_hit(left, key_bitmap(again, KEY, "stage-dedup-bits"), KEY, HIT)
    length = F.struct(F.char_length("text"), "text")
    one = marked.where(HIT).groupBy(KEY).agg(F.max_by(F.struct(*docs.columns), length).alias("row")).select("row.*")
    return marked.where(f"NOT {HIT}").select(*docs.columns).unionByName(one)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near copies.

    Rows without words or doc_id link with nothing and stay; rows that repeat a doc_id are one document and stay or go
    together; other columns are not looked at.
    """
    from . import jaccard_join

    drop = jaccard_join.near_duplicates(docs).where("doc_id <> component_id").select(F.col("doc_id").alias(KEY))
    return without(docs.withColumn(KEY, F.col("doc_id").cast("long")), drop).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark's windows do not cover enough to count as contaminated.

    Texts without words, null ones included, stay; repeated rows are judged alike; other columns are not looked at.
    """
    from . import decontaminate as d

    return d.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and digests of every document that is left: a row for each, null text as empty text."""
    import public_tokenizers

    from . import pieces

    return pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("ngram_jaccard_join", near_dedup), ("decontamination", decontaminate), ("sentencepiece", encode)]
