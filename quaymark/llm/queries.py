"""The queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, conversation_trie, html_text, lang_id, near_dup, packing, pii, quality, secrets, sentencepiece_backend, spelling, substrings, warc
from .common import small_batches, table

#: The tokenizer model to encode with; its path is a parameter, the file is no part of this repository.
MODEL_PATH = os.environ.get("QUAYMARK_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op1_anisotropic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op4_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.language_of_documents(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_sentencepiece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentencepiece_backend.read_model(spark, MODEL_PATH)
    return sentencepiece_backend.encode_report(table(spark, sf_dir, "documents"), model)


def op9_consensus_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op11_recompressed_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents"))


def op12_anagram_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_nodes(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


Query = Callable[[SparkSession, str], DataFrame]


def _batched(query: Query) -> Query:
    """The query under ``small_batches``: some texts are very long."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {
    f.__name__: _batched(f)
    for f in (
        op1_anisotropic_neighbours,
        op2_warc_round_trip,
        op3_quality_mcd,
        op4_rank_order_language,
        op5_best_fit_packing,
        op6_pii_disclosure,
        op7_near_duplicates,
        op8_sentencepiece_encoding,
        op9_consensus_main_text,
        op10_secret_scan,
        op11_recompressed_substrings,
        op12_anagram_variants,
        op13_conversation_trie,
        pipeline,
    )
}

#: None of the operators can be written in SQL; their tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {}
