"""Corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark passages, packing.

Each stage takes the documents that the one before it kept and returns documents with the same columns; the last returns
packed pieces. Rows with missing texts, repeated rows and empty tables are treated as the stages' operators define it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import decontaminate, near_duplicates, packing, suffix_dedup, toxicity
from lacuna.llm.queries import vocabulary
from lacuna.llm.rows import table
from lacuna.session import staged, tune


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier rejects go; it learns from all labelled documents."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.reject(docs, model)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return near_duplicates.distinct_documents(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document holds are cut out."""
    return suffix_dedup.remove_repeats(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near),
    ("suffix_dedup", repeats),
    ("decontamination", benchmark),
    ("packing", packed),
]

#: Learned, sketched and byte-wise stages are beyond SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tune(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
