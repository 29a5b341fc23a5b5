"""The corpus pipeline over `documents`: toxic documents go, of equal texts one stays, of near duplicates one stays,
sources are mixed to their target weights, and the mix is packed into sequences.

Every stage works on all rows that its predecessor kept. All but the last return the columns of `documents`; the
mix repeats the row of a document that it takes more than once, and packing packs each repetition.

Nulls, empty and very long texts, repeated rows, empty tables and further columns have the results that the
operators' docstrings state: a null or empty text is not toxic by itself, all of them are one exact class, and
the one that stays is packed as the separator alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from tidemark.llm.common import forget, scratch, stored, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on `labels`, does not call toxic."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the most code points, then the smallest id."""
    return exact_dedup.keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the one with the smallest id."""
    return near_dedup.first_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Toxicity scores, dart signatures and tokens have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each result written as Parquet and read again as the next one's input; what a stage has written and read itself goes then."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before = docs
        with scratch() as work:
            docs = work.keep(stored(stage(spark, before, sf_dir)))
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
