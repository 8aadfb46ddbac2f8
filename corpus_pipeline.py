"""From documents to packed token rows in five stages, each written and read again.

Counted as part of the training-data subpackage; only __spark_entry__.py imports it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import decontaminate, jaccard_join, language_id, mixing, packing
from tideline.llm.common import documents, remove_staged, stage_table, staged_so_far

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay."""
    return language_id.identified_documents(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8."""
    return jaccard_join.one_of_each_group(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken to their target weights, a row for each round a text is taken in."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids."""
    return packing.pack_tokens(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify),
    ("ngram_jaccard", deduplicate),
    ("decontamination", clean_of_benchmark),
    ("source_mixing", mix),
    ("token_packing", pack),
]

#: Trained machines, hash trees and a tokenizer can't be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's own tables, and its predecessor's rows, are removed once its rows are written."""
    docs, begun = documents(spark, sf_dir), staged_so_far()
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        remove_staged(spark, begun, but_last=1)
    return STAGES[-1][1](spark, docs, sf_dir)
