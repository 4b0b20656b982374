"""The training-data pipeline: reject, deduplicate, decontaminate, pack.

Every stage takes the documents that its predecessor kept and returns whole rows
of ``documents``; the last returns the pieces of all that is left with their
places in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, near_dup, packing, quality
from tidemark.llm.common import staged, table
from tidemark.llm.queries import fold
from tidemark.queries.catalog import Entry


def reject(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep documents that the quality classifier scores 0.3 or more."""
    return quality.kept_rows(docs, table(spark, folder, "labels"), fold(5) != 0)


def deduplicate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep one document of each group that links of similarity 0.8 on five-word shingles connect."""
    return near_dup.without_near_duplicates(docs, shingle=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop documents that hold ten consecutive words of a benchmark item, or a shorter item."""
    return decontaminate.uncontaminated(docs, table(spark, folder, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Place every document in sequences of 4096 tokens."""
    # earlier stages leave the executors little memory, so fewer chunks are remembered
    return packing.pack_documents(docs, kept=100_000)


STAGES = [
    ("quality classifier", reject),
    ("MinHash near-dedup", deduplicate),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", pack),
]

# Classifier, signatures and tokenizer have no SQL form; tests compare run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, folder), "pipeline-" + name.replace(" ", "-"))
    return docs


ENTRY = Entry(run, ORACLE_SQL)
