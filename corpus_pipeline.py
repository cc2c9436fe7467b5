"""The training-data pipeline: documents through five operators of ``ledgerlens.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet under the session's checkpoint folder and reads it back for the next
one.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import jaccard, langid, mixing, packing, passages
from ledgerlens.llm.queries import byte_bpe
from ledgerlens.llm.tables import read
from ledgerlens.session import materialize

#: A flow, rounds of connected components and a tokenizer are beyond SQL.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go."""
    return langid.keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    return jaccard.keep_first(docs, percent=80)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out."""
    return passages.clean(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 3, 1, 2; a document the mix takes twice appears twice."""
    return mixing.repeat_documents(docs, F.array("source"), weights=(3, 1, 2), share=1.5, most=2)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their ids, in sequences of at most 2048 ids."""
    return packing.pack(docs, byte_bpe(), capacity=2048, end_id=1, with_ids=True)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard", near_copies),
    ("substring_dedup", substrings),
    ("mixing", mixture),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
