"""A training corpus in five stages: each takes (spark, docs, sf_dir) and returns a DataFrame.

Every stage but the last returns the columns of ``documents``; the last adds the copy number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import decontaminate, mixing, near_dup, pii, toxicity
from veilspark.llm.common import Stages, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.3, whole texts read.

    Null texts stay, as do empty ones, whose score is that of a text without evidence; repeated rows
    stay or go alike; without usable labels, and of an empty table, nothing goes; columns of any name are kept.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.keep_ordinary(spark, docs, labels)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id (a null id only where there is no other).

    Null, empty and blank texts are no copies and stay; of repeated rows with one id, one stays; an empty
    table stays empty; columns of any name are kept.
    """
    return near_dup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window, whole texts read.

    Null, empty and wordless texts hold no window and stay; repeated rows stay or go alike; an empty
    table or benchmark drops nothing; columns of any name are kept.
    """
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced, at any length; n_chars follows the text.

    Null texts keep their n_chars; empty texts and repeated rows are treated like any other; an empty table
    stays empty; other columns are kept as they are.
    """
    return pii.redact(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Poisson copies of documents so that all sources have the same share of characters.

    A null source is the source ``''``; sources without any character are left out; rows of one id are
    drawn alike; an empty table stays empty; columns of any name are kept but for mix_copy, which is added.
    """
    return mixing.mix(docs).drop("mix_key")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("pii", redact_pii),
    ("mix_sources", mix_sources),
]

#: trained models and the dedup closure have no SQL form; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written as Parquet and read again."""
    stages = Stages(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stages.write(stage(spark, docs, sf_dir), name)
    return docs
