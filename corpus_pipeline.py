"""A training-text pipeline: every stage is one operator over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foldline.llm.common import stage, table
from foldline.llm.decontaminate import clean
from foldline.llm.packing import pack
from foldline.llm.phrases import without_phrases
from foldline.llm.queries import categories
from foldline.llm.simhash import simhash_dedup
from foldline.llm.toxicity import keep_clean, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the label table, does not take for toxic."""
    return keep_clean(docs, train(docs, table(spark, sf_dir, "labels"), categories()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash fingerprints of four-word shingles that differ in 4 bits or fewer."""
    return simhash_dedup(docs, words=4, radius=4)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that occur more than once."""
    return without_phrases(docs, window=50)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within 5 % edits."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Fitted models and fingerprints are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None
