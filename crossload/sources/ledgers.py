"""Append-only ledgers of errors and warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LONGEST = 4000
SCHEMA = "source_id string, entity string, code string, message string, run_id string"


def append(rows: DataFrame, folder: str, run_id: str) -> None:
    """Add a run's rows (source_id, entity, code, message; messages up to LONGEST characters) to a ledger. A run is
    a partition, replaced as a whole: one that is written again after a failure stands there once."""
    cut = rows.select("source_id", "entity", "code", F.substring("message", 1, LONGEST).alias("message"), F.lit(run_id).alias("run_id"))
    cut.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(folder)
