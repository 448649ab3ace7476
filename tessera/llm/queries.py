"""The queries of this subpackage and their SQL: ``QUERIES`` and ``ORACLE_SQL``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import byte_bpe, divergence, embed_dedup, hard_negatives, html_extract, line_dedup, media_audio, mixing, quality, simhash, token_store, toxicity, warc_store
from tessera.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def op3_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_audio.stored(table(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.linked(table(spark, sf_dir, "embeddings"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), *byte_bpe.public_ranks())


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_store.archived(table(spark, sf_dir, "pages"))


def op7_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.slots(table(spark, sf_dir, "documents"))


def op8_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored(table(spark, sf_dir, "documents"), token_store.public_tokenizer())


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"), ratio=0.1, min_pages=3, counts=True).select("doc_id", "source", "text", "n_lines", "n_dropped")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_html_main_text": op2_html_main_text,
    "op3_mpeg_audio": op3_mpeg_audio,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_warc_archive": op6_warc_archive,
    "op7_pfair_mixing": op7_pfair_mixing,
    "op8_wavelet_tokens": op8_wavelet_tokens,
    "op9_line_dedup": op9_line_dedup,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_source_divergence": op12_source_divergence,
    "op13_quality_classifier": op13_quality_classifier,
}

#: Queries without an entry are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op6_warc_archive": warc_store.SQL,
    "op7_pfair_mixing": mixing.SQL,
    "op9_line_dedup": line_dedup.SQL,
    "op11_hard_negatives": hard_negatives.SQL,
    "op12_source_divergence": divergence.SQL,
}
