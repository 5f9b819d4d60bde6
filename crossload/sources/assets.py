"""Binary assets of a folder, with what proves that they are whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import integrity_level


def scan(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, name, size, hash (SHA-256) of the files below folder whose names fit glob. A file is read whole by one
    task, and is at most 2 GB."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("hash"))


def verified(sent: DataFrame, found: DataFrame, by: str) -> DataFrame:
    """What was sent (by, hash, size) against what was found: level as integrity_level, or MISSING, and
    UNEXPECTED for files that nobody sent."""
    a = sent.select(by, F.col("hash").alias("sent_hash"), F.col("size").alias("sent_size"), F.lit(True).alias("sent"))
    b = found.select(by, F.col("hash").alias("stored_hash"), F.col("size").alias("stored_size"), F.lit(True).alias("there"))
    level = (
        F.when(F.col("there").isNull(), "MISSING").when(F.col("sent").isNull(), "UNEXPECTED")
        .otherwise(integrity_level(F.col("sent_hash"), F.col("stored_hash"), F.col("sent_size"), F.col("stored_size"))))
    return a.join(b, by, "full").select(by, "stored_size", level.alias("level"))
