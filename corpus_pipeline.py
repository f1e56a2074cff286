"""The corpus pipeline: language filter, line dedup, near-dedup, packing. Each stage works on all its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gramwise.llm import langid, linedup, packing, simhash
from gramwise.session import scratch_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with enough confidence; those without letters go as well."""
    model = langid.learn(docs, ~langid.held_out())
    return docs.where(langid.accepts(model)(F.col("text").cast("string")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that a smaller doc_id holds as well; n_chars follows."""
    kept = linedup.drop_repeated_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near-duplicates; a row without doc_id belongs to no group."""
    firsts = simhash.simhash_groups(docs).where("kept").select("doc_id").distinct()
    return docs.join(firsts, "doc_id", "left_semi").select(docs.columns).unionByName(docs.where("doc_id is null"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_near_dedup", simhash_near_dedup), ("best_fit_packing", best_fit_packing)]

ORACLE_SQL = None
"""Learnt filters, XXH64 votes and BPE ids are beyond SQL; the tests compare with a brute-force version."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; every result is a table in the shared folder, which the next stage reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
