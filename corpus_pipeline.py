"""From raw documents to token files: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import decontamination, mixing, near_duplicates, quality, token_files
from ledgerlens.llm.common import DOCUMENT_COLUMNS, table
from ledgerlens.llm.queries import vocabulary
from ledgerlens.settings import settle


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tail probability of a good grade is high enough."""
    rated = quality.rate(docs, table(spark, sf_dir, "labels"))
    return rated.where("kept").select(*DOCUMENT_COLUMNS)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more."""
    return near_duplicates.keep_one(docs, 80).select(*DOCUMENT_COLUMNS)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every pass over a document as a row of its own."""
    return mixing.mixed_texts(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in id order, and one row per text read back from them."""
    return token_files.store_and_digest(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", select_quality),
    ("near-duplicates", remove_near_duplicates),
    ("benchmark decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("token ids", write_token_ids),
]

#: A trained classifier and a tokenizer are not expressible in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
