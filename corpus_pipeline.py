"""A corpus pipeline: quality, exact and near duplicates, mixing, packing.  Every stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import exact_dedup, mixing, near_dedup, packing, quality, tokens
from textloom.llm.common import prepare, table, tidied, written


@tidied
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier accepts; null and empty texts are as good as the average.  An empty table stays empty."""
    return quality.accepted(docs)


@tidied
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each text, the one with the smallest identifier; null and empty texts are equal, null identifiers stay only without others."""
    return exact_dedup.dedup(docs)


@tidied
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each group of near duplicates, the one with the smallest identifier, and all texts without words."""
    return near_dedup.dedup(docs)


@tidied
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, twice at most; a null source is one of its own, texts without words get whole copies only."""
    return mixing.Mix(docs).repeated(docs)


@tidied
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids: one row per piece; rows that repeat are packed each for itself, null and empty texts are their end id."""
    return packing.pack(docs, tokens.public("byte_bpe_50k.json"), False, 0)


STAGES = [("quality", keep_quality), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mix", mix_sources), ("pack", pack_sequences)]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


@tidied
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from the documents table, each written in the shared folder and read again."""
    docs = table(prepare(spark), sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
