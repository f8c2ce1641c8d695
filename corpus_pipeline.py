"""The corpus pipeline: five stages over documents, each written and read again.

Every stage takes null ids, languages and sources, empty and very long texts,
extra columns and an empty table (and gives one). A repeated row is treated as
any other until near-duplicate removal, which leaves one of it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.llm import lang_id, near_dup, packing, quality, secrets
from quaymark.llm.common import shared_dir, small_batches, table

#: A text whose best profile is hardly nearer than none has no language.
LEAST_SCORE = 0.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a language, null and empty ones among them; lang becomes the predicted one. Nearest profiles tie by name."""
    small_batches(spark)
    profiles = lang_id.learn_profiles(docs.where(~lang_id.held_out("doc_id")))
    found = lang_id.identify(docs, profiles)
    known = found.where((F.col("lang_pred") != lang_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return known.withColumn("lang", F.col("lang_pred")).select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that fail the base rule (null and short ones do) or are robust outliers of their language and source; a null language or source counts as one."""
    small_batches(spark)
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the least doc_id of each near-duplicate group; of repeats of it one row stays."""
    small_batches(spark)
    return near_dup.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; n_chars follows. No row goes."""
    small_batches(spark)
    return secrets.redact_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the texts into bins: one row for each piece of a document, of 0 tokens for a text without words."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express none of the stages' methods; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
