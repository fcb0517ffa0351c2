"""A corpus pipeline over ``documents``, stage by stage.

Quality rules (rejected documents go), near-duplicate join (one document of each class
stays), removal of repeated passages, masking of secrets, packing into sequences. Each
stage reads what the one before has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstie.llm import ngram_join, packing, quality, secret_scan, suffix_dedup
from crosstie.llm.common import importable
from crosstie.session import stored


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` after the text has changed."""
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return quality.kept_documents(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return ngram_join.one_of_each(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return _measured(suffix_dedup.without_repeats(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(secret_scan.masked(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", keep_good),
    ("n-gram join", keep_one_of_each),
    ("suffix dedup", drop_repeats),
    ("secret scan", mask_secrets),
    ("packing", pack),
]

# Classes by similarity, byte-wise repeats and token ids are beyond SQL; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
