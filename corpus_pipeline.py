"""A training corpus from raw documents: five stages, each one operator of ``lodestone.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept; ``run``
writes each result as Parquet to the shared folder and reads it again.  All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import automaton, language, mixing, passages, simhash
from lodestone.llm.common import materialise
from lodestone.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; the others go."""
    return language.keep_known(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id."""
    return simhash.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has are cut out."""
    return passages.remove_passages(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the tempered weights of their sources say, twice at most."""
    return mixing.realise(docs, repetition_limit=2.0)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document."""
    return automaton.encode_decode(docs, tokenizer_path("word_bpe_49k.json"), carry=["doc_id", "lang", "source"])


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("bpe_round_trip", bpe_round_trip),
]

#: Compression, fingerprints, alignment and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = materialise(stage(spark, out, sf_dir), name)
    return out
