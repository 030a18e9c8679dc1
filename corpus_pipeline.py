"""The corpus pipeline: documents in, packed training sequences out.

Every stage works on all that the one before it has kept, read back from Parquet. Stages decide by row,
not by id, so rows without an id or with a shared one stay or go by their own text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeledger.llm import fertility, language, minhash, packing
from codeledger.llm.common import stored
from codeledger.llm.queries import BYTE_BPE, PIECES, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without a letter or of too little evidence for any language go."""
    return language.told(docs.select(*COLUMNS), language.fit(docs))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return fertility.good(docs.select(*COLUMNS), PIECES)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8 or more), one row, that of the smallest id."""
    return minhash.one_of_each(docs.select(*COLUMNS), minhash.Likeness(words=5, percent=80))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.pack(docs, BYTE_BPE, window=1024, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("packing", packed),
]

# Tokenizers, kernels and packing have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
