"""From raw documents to encoded training text: five stages, each on all that the one before it kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a table that is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from apexframe.llm import chunk_bpe, exact_dedup, host_rules, mixing, simhash
from apexframe.llm.queries import tokenizer_file
from apexframe.operators.ordered import settle


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule go, and those of hosts whose documents mostly fail."""
    return host_rules.passing(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts stays, the one with the smallest id."""
    return exact_dedup.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of linked fingerprints stays, the one with the smallest id."""
    return simhash.one_per_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row per time that the mix takes a document, the last one of a source cut at its budget."""
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens`` and the digests of ids and decoded text of every row of the mix."""
    return chunk_bpe.digests(chunk_bpe.chunk_encoding(docs, tokenizer_file()))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: SQL has neither the fingerprints' hash nor the encoding; the tests compare with a version by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
