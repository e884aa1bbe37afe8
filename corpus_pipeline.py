"""The training-data pipeline: every stage works on all that the one before it kept.

Each stage is written as Parquet and read again before the next one starts, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from framewright.llm import decontaminate, near_dup, packing, personal_data, quality_rules
from framewright.llm.queries import BYTE_BPE, TOKENS
from framewright.llm.shared import ready, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rule and the certified cutoffs of their language."""
    ready(spark)
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (shingles of five words, similarity 0.8)."""
    ready(spark)
    return near_dup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without those that hold a benchmark item, also with exchanged numbers or names."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with fixed and learned identifiers replaced by their kind."""
    ready(spark)
    return personal_data.masked(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their place in sequences of 1024 tokens."""
    ready(spark)
    return packing.pack(docs, public_tokenizers.path(BYTE_BPE), TOKENS)


STAGES = [("quality", quality), ("near_duplicates", deduplicate), ("decontamination", decontaminated), ("personal_data", mask),
          ("packing", pack)]
#: Tokenizers, learned patterns and confirmed MinHash links have no SQL form; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
