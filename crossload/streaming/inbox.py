"""Events as a stream, each stored once, and upserts of micro-batches.

Which keys were seen is state of the stream, kept in a state store on disk and changed by what a
micro-batch brings: a batch costs what it holds, however long the history is. The rows go to a file sink that
commits each batch once. Upserts go to the bucketed table of operators/sink.py, which rewrites the buckets that
change and remembers the last batch, so that a batch that runs again is not applied twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import sink

STORE = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """State beyond an executor's memory, where the session names no store of its own."""
    own = spark.conf.get(STORE, None)
    chosen = own is not None and "HDFSBacked" not in own
    if not chosen:
        spark.conf.set(STORE, ON_DISK)
    try:
        yield
    finally:
        if not chosen:
            spark.conf.unset(STORE) if own is None else spark.conf.set(STORE, own)


def first_string(payload: Column, paths: list[str]) -> Column:
    """The first of several JSON paths that holds a string that isn't empty; numbers and other kinds don't count."""
    held = F.try_parse_json(payload)
    found = []
    for p in paths:
        at = F.try_variant_get(held, p, "variant")
        found.append(F.when(F.schema_of_variant(at) == "STRING", F.nullif(F.try_variant_get(held, p, "string"), F.lit(""))))
    return F.coalesce(*found)


# Where senders put an event's own id.
EVENT_ID = ["$.event_id", "$.id", "$.eventId"]


def event_keys(events: DataFrame, header: str | None = None, paths: list[str] = EVENT_ID) -> DataFrame:
    """events with their key: the sender's id in the payload, else in a header's column, else a hash of the payload."""
    given = [first_string(F.col("payload"), paths), *([F.nullif(F.col(header), F.lit(""))] if header else [])]
    return events.withColumn("key", F.coalesce(*given, F.sha2(F.coalesce("payload", F.lit("")), 256)))


def once(stream: DataFrame, keys: list[str], time: str | None = None, within: str | None = None) -> DataFrame:
    """The stream without rows whose keys came before. State grows by a key each; with time and within
    (such as '30 days') only repeats within that span are met, and older keys are forgotten."""
    if within is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def store_once(stream: DataFrame, folder: str, checkpoint: str, keys: list[str], time: str | None = None, within: str | None = None) -> None:
    """Append the stream's rows to folder, one of each key; ends when all that is there is read."""
    with state_on_disk(stream.sparkSession):
        query = once(stream, keys, time, within).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
        query.trigger(availableNow=True).start().awaitTermination()


def stored(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The rows of all batches that were committed."""
    return spark.read.schema(schema).parquet(folder)


def upsert_stream(stream: DataFrame, folder: str, checkpoint: str, key: str, order: list[str], buckets: int = sink.BUCKETS) -> None:
    """Keep the latest row of each key (by order) in the table at folder; ends when all that is there is read."""
    spark = stream.sparkSession
    if not sink.names(spark, f"{folder}/versions"):
        sink.create(spark, folder, stream.schema, [key], buckets)

    def add(batch: DataFrame, number: int) -> None:
        sink.upsert(batch.sparkSession, folder, latest(batch, key, order), newer=order, batch=(checkpoint, number))

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    last = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("__n", last).where("__n = 1").drop("__n")
