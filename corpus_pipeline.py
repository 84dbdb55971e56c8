"""A training corpus from raw documents in five stages, each one of the operators.

toxic documents go; one document of each near-duplicate group stays; long repeated
passages go; sources are mixed to their weights; token sequences are packed.  Each
stage reads what the one before has written; all but the last give the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verilens.llm.lsh_forest import one_per_group
from verilens.llm.mixing import mixed_documents
from verilens.llm.packing import pack
from verilens.llm.shared import table, write_table
from verilens.llm.suffix_merge import cleaned_documents
from verilens.llm.weak_toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not predict toxic."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return one_per_group(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings that occur elsewhere too."""
    return cleaned_documents(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their place in a training sequence."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("source mix", source_mix),
    ("packing", packed_sequences),
]

#: Classifier, forest, merged transforms and tokenizer have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        if number:
            docs = write_table(docs, "pipeline")
        docs = stage(spark, docs, sf_dir)
    return docs
