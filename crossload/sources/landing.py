"""Raw payloads, landed as they came and kept for a time.

Payloads are JSON text in Parquet, partitioned by entity and by the day by which they expire (the last of a
month, so that there are few). Purging takes the payloads of expired partitions away and keeps their rows: only those
partitions are read and rewritten, each replaced as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "source_id string, payload string, landed_at timestamp, entity string, expires_on date"
DAYS = 90


def land(records: DataFrame, entity: str, id: Column, folder: str, landed_at: Column, days: int = DAYS) -> None:
    """Append the payloads (all columns) of records."""
    rows = records.select(
        id.alias("source_id"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("payload"), landed_at.alias("landed_at"), F.lit(entity).alias("entity"))
    rows = rows.withColumn("expires_on", F.last_day(F.date_add(F.to_date("landed_at"), days)))
    # each partition is written by few tasks; a large one is dealt over several
    rows.repartition("entity", "expires_on", F.pmod(F.xxhash64("source_id"), F.lit(4))).write.mode("append").partitionBy("entity", "expires_on").parquet(folder)


def landed(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(folder)


def purge(spark: SparkSession, folder: str, as_of: Column) -> None:
    """Take away the payloads of partitions that have expired before a date. Run again, it changes nothing more."""
    old = landed(spark, folder).where(F.col("expires_on") < as_of)
    due = old.where("payload is not null").select("entity", "expires_on").distinct()
    # partitions purged before are left alone; there are few, whatever they hold
    rows = old.join(F.broadcast(due), ["entity", "expires_on"], "left_semi").withColumn("payload", F.lit(None).cast("string"))
    rows.select("source_id", "payload", "landed_at", "entity", "expires_on").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("entity", "expires_on").parquet(folder)
