"""A training corpus from ``documents``: toxicity, line dedup, near-duplicates, mixing, tokens.

In every stage: null texts count as empty ones and null sources as the source with the empty name; null and repeated doc_ids
are told apart by their texts; equal rows are separate documents until near-duplicates are removed; very long texts are
handled whole, in memory by their length; columns beyond those used are carried along unchanged, whatever their names, and
an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, line_dedup, mixing, shingle_dedup, simhash, toxicity
from tessera.llm.common import delete, new_path, scratch, table, written, written_at


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; labels come from ``sf_dir``. A score of exactly 0.5 is a rejection; empty texts
    and equal rows have equal scores. Without labels of both kinds no document is rejected unless all labels are toxic."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def remove_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of their source. So that clean documents stay: a line must be on
    three pages at least, equal pages of a source count once, and a document that would lose all its lines keeps them."""
    return line_dedup.drop_boilerplate(docs, min_pages=3, distinct_pages=True, keep_emptied=True)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles of Jaccard similarity 0.8 or more, that with the least doc_id: null
    ids last; of several texts with that id, the one with the least hash; of equal rows, one. Texts of equal words, those
    without any included, are copies of each other."""
    return simhash.least_of_groups(docs, shingle_dedup.grouped(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which they are to be read so that sources meet their exact target weights. Rows of
    one block come in the order of a digest of id and text, equal rows side by side."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes for each document, and its place: (slot, position) is the order of
    mixing, computed again as rows of several files have none. Equal rows are told apart by number."""
    order = Window.partitionBy("doc_id", "text_sha256")
    placed = mixing.placed(docs).withColumn("copy", F.row_number().over(order.orderBy("slot", "position")))
    placed = written(placed, "places")  # so that no join runs beside the encoders, which need the executors' memory
    tokens = written(byte_bpe.digests(docs, *byte_bpe.public_ranks()).withColumnsRenamed({"doc_id": "id"}), "tokens")
    tokens = tokens.withColumn("number", F.row_number().over(Window.partitionBy("id", "decoded_sha256").orderBy("n_tokens")))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("decoded_sha256") == F.col("text_sha256")) & (F.col("number") == F.col("copy"))
    return tokens.join(placed, same, "left").select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256", "decoded_equal", "source", "block", "slot", "position")


STAGES = [
    ("toxicity", remove_toxic),
    ("line dedup", remove_boilerplate),
    ("near duplicates", remove_near_duplicates),
    ("mixing", mix_sources),
    ("byte-level BPE", tokenize),
]

#: Trees, fingerprints and merges aren't SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each but the last written and read again. What a stage wrote for itself
    goes when its output is written, and so does the output before; the last stage, which is lazy, keeps its own tables."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            docs = written_at(stage(spark, docs, sf_dir), path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
