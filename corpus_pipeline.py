"""A corpus pipeline of five operators; see STAGES."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crossload.llm import decontaminate, ngram_join, packing, suffix_dedup, toxicity
from crossload.llm.common import settle, table

STAGES = [
    ("toxicity", toxicity.stage_toxicity),
    ("near_copies", ngram_join.stage_near_copies),
    ("repeats", suffix_dedup.stage_repeats),
    ("decontaminate", decontaminate.stage_decontaminate),
    ("packing", packing.stage_packing),
]

# SQL can't express the learned, iterative and tokenising stages; tests/llm checks them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
