"""Corpus pipeline: language, exact copies, near copies, mixture, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as
Parquet and read again as the next stage's documents.  All but the last keep
the columns of ``documents``, extra ones as well.  An empty table gives an empty
table in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact, jaccard, langid, mixing, packing
from tidemark.llm.common import settle, table
from tidemark.llm.queries import target_weights, tokenizer_path

#: SQL can express neither the language model nor the tokenizer; tests hold each stage against a plain version.
ORACLE_SQL = None

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a clear margin; null texts and texts without a letter go. Repeated rows and null ids are treated as any row."""
    return langid.keep_identified(docs, langid.learn(docs))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the smallest id; null text counts as empty, a null id sorts last."""
    return exact.keep_distinct(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the smallest id; empty texts, null ids and all rows of the id that stays are kept."""
    return jaccard.keep_first(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of target weights takes them, at most four times; null lang and source are leaves of their own."""
    return mixing.mix(docs, target_weights(spark)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens: where each piece lies, and the checksum of its ids; null text is the end id alone."""
    return packing.pack_documents(docs, tokenizer_path(), with_ids=False)


STAGES: list[tuple[str, Stage]] = [
    ("language", identified),
    ("exact dedup", distinct),
    ("near dedup", dissimilar),
    ("mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
