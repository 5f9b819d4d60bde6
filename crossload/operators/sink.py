"""A table of Parquet files that takes upserts.

Rows are dealt by the hash of their key to a fixed number of buckets, each a folder of files. A
version is a small JSON file that names the folder of every bucket. An upsert reads the buckets that its
rows fall in, writes those in which something changes to new folders, and then puts the file of the next
version in place by a rename that fails if somebody else was first. So what a failed job has written
is never read, a second writer gets ConcurrentWrite and nothing of the first is lost, and rows that are sent
again unchanged write nothing. Readers of a version are not disturbed; expire() deletes what no kept
version names. The driver holds a bucket's name and path each, and no rows.

As on conflict at the destination: the columns in keep, and created_in, stay those of the first version;
the others are replaced, and updated_in is the version that replaced them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..sources.folders import get_text, names, put_once, remove

BUCKETS = 64
AUDIT = ["created_in", "updated_in"]


class ConcurrentWrite(RuntimeError):
    """Another writer put the next version in place first."""


def create(spark: SparkSession, folder: str, schema: StructType, key: list[str], buckets: int = BUCKETS) -> None:
    """An empty table (version 0). Buckets should hold about one file's worth of rows at the size the table will reach."""
    first = {"version": 0, "key": key, "buckets": buckets, "schema": schema.jsonValue(), "at": {}, "batches": {}}
    if not put_once(spark, f"{folder}/versions/{0:012d}.json", json.dumps(first)):
        raise ConcurrentWrite(folder)


def state(spark: SparkSession, folder: str, version: int | None = None) -> dict:
    """What a version, else the last one, consists of."""
    known = [n for n in names(spark, f"{folder}/versions") if n.endswith(".json")]
    name = known[-1] if version is None else f"{version:012d}.json"
    return json.loads(get_text(spark, f"{folder}/versions/{name}"))


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    return rows(spark, folder, state(spark, folder, version))


def rows(spark: SparkSession, folder: str, known: dict, buckets: list[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(known["schema"])
    for c in AUDIT:
        schema = schema.add(c, LongType())
    paths = [f"{folder}/{p}" for b, p in known["at"].items() if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def merged(current: DataFrame, incoming: DataFrame, key: list[str], version: int, keep: list[str], newer: list[str]) -> DataFrame:
    """All rows of both with their fate: CREATED, UPDATED, or null where nothing changes. Incoming keys are distinct.
    With newer, an incoming row counts only if it is later than the current one in these columns."""
    c, n = current.alias("c"), incoming.alias("n")
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"c.{k}").eqNullSafe(F.col(f"n.{k}"))
    here, sent = F.col("c.created_in").isNotNull(), F.col("n.__sent").isNotNull()
    own = [x for x in incoming.columns if x != "__sent"]
    differ = F.lit(False)
    for x in own:
        if x not in (*key, *keep):
            differ = differ | ~F.col(f"c.{x}").eqNullSafe(F.col(f"n.{x}"))
    if newer:
        differ = differ & (F.struct(*[F.col(f"n.{x}") for x in newer]) > F.struct(*[F.col(f"c.{x}") for x in newer]))
    fate = F.when(~here, "CREATED").when(sent & differ, "UPDATED")
    put = fate.isNotNull()
    pick = [
        (F.when(here, F.col(f"c.{x}")).otherwise(F.col(f"n.{x}")) if x in (*key, *keep) else F.when(put, F.col(f"n.{x}")).otherwise(F.col(f"c.{x}"))).alias(x) for x in own
    ]
    now = F.lit(version).cast("long")
    return c.join(n, same, "full").select(
        *pick, F.coalesce("c.created_in", now).alias("created_in"), F.when(put, now).otherwise(F.col("c.updated_in")).alias("updated_in"), fate.alias("__fate"))


def upsert(
    spark: SparkSession, folder: str, incoming: DataFrame, keep: list[str] | None = None, order: list[str] | None = None, newer: list[str] | None = None,
    batch: tuple[str, int] | None = None,
) -> dict:
    """Insert or update incoming rows; of several with one key the first by order counts (by all columns where it is not
    given). Returns version, created and updated. batch names a numbered batch of a stream, which counts once."""
    known = state(spark, folder)
    if batch and known["batches"].get(batch[0], -1) >= batch[1]:
        return {"version": known["version"], "created": 0, "updated": 0}
    key, version = known["key"], known["version"] + 1
    columns = StructType.fromJson(known["schema"]).names
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*(order or columns)))
    sent = incoming.select(*columns).withColumn("__sent", rank).where("__sent = 1").withColumn("__bucket", bucket(key, known["buckets"]))
    touched = [r[0] for r in sent.select("__bucket").distinct().collect()]  # no more than there are buckets
    current = rows(spark, folder, known, touched)
    both = merged(current, sent.drop("__bucket"), key, version, keep or [], newer or []).withColumn("__bucket", bucket(key, known["buckets"]))
    changes = both.groupBy("__bucket").agg(F.count_if(F.col("__fate") == "CREATED").alias("created"), F.count_if(F.col("__fate") == "UPDATED").alias("updated"))
    changed = changes.where("created + updated > 0").collect()
    if not changed and not batch:
        return {"version": known["version"], "created": 0, "updated": 0}
    at, place = dict(known["at"]), f"data/v{version}-{uuid.uuid4().hex}"
    if changed:
        some = both.where(F.col("__bucket").isin([r["__bucket"] for r in changed])).drop("__fate")
        some.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{folder}/{place}")
        at |= {str(r["__bucket"]): f"{place}/__bucket={r['__bucket']}" for r in changed}
    batches = known["batches"] | ({batch[0]: batch[1]} if batch else {})
    if not put_once(spark, f"{folder}/versions/{version:012d}.json", json.dumps(known | {"version": version, "at": at, "batches": batches})):
        raise ConcurrentWrite(f"{folder}, version {version}")
    return {"version": version, "created": sum(r["created"] for r in changed), "updated": sum(r["updated"] for r in changed)}


def expire(spark: SparkSession, folder: str, keep_versions: int = 1) -> None:
    """Delete all but the last versions, and the folders that none of those names (also those of failed jobs).
    No writer may be at work."""
    known = [n for n in names(spark, f"{folder}/versions") if n.endswith(".json")]
    held = [json.loads(get_text(spark, f"{folder}/versions/{n}")) for n in known[-keep_versions:]]
    used = {p for s in held for p in s["at"].values()}
    for n in known[:-keep_versions]:
        remove(spark, f"{folder}/versions/{n}")
    for v in names(spark, f"{folder}/data"):
        for b in names(spark, f"{folder}/data/{v}"):
            if f"data/{v}/{b}" not in used:
                remove(spark, f"{folder}/data/{v}/{b}")
