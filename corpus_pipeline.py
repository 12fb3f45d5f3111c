"""A corpus pipeline: each stage works on what its predecessor kept and returns the columns of documents, the last one
packed pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm import minhash, mixing, packing, quality, suffix_dedup
from loomspark.llm.common import Workspace
from loomspark.llm.queries import tokenizer_path

#: Near copies in the pipeline: word shingles of five, similar by 0.8.
NEAR = minhash.NearDup(k=5, percent=80, bands=32)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines and rejected documents go."""
    return quality.keep_clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return minhash.one_of_each(docs, NEAR)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that occur earlier go from the texts."""
    return suffix_dedup.without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 4096."""
    return packing.pack(packing.token_pieces(docs, tokenizer_path("word_bpe_49k.json")))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("repeated passages", repeated_passages),
    ("source mix", source_mix),
    ("packing", pack_sequences),
]

#: SQL can't express near-duplicate groups, cuts of bytes and best-fit packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            work.drop(f"stage{i - 1}")
    return docs
