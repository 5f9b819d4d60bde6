"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where it is unset, a session
    on this machine alone (tests) gets a temporary one; a cluster must name its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """From now on Spark hands rows to Python in Arrow batches of about `size`, in place of 10,000 rows: these are large
    where rows hold whole texts, and are in memory several times, in the executor and in each of its Python workers.
    What the session was started with stays. Set for the session, as Spark reads it when a plan runs."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(name) is None:
        spark.conf.set(name, size)


def free(df: DataFrame, name: str) -> str:
    """A column name that df does not have, made of name."""
    taken, name = {c.lower() for c in df.columns}, f"__{name}"
    while name.lower() in taken:
        name += "_"
    return name


def settle(df: DataFrame, packed: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and no later step redoes the work.
    packed: with more compression, for tables that hold texts."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd" if packed else None)
    made = spark.read.schema(df.schema).parquet(path)
    made._settled = path
    return made


def drop(*settled: DataFrame, shuffles: bool = True) -> None:
    """Delete tables made by settle that nothing reads any more. Shuffle files go with the plans
    that the driver has forgotten, so it is asked to collect its garbage, unless they are small."""
    for df in settled:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._settled)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if not shuffles:
        return
    gc.collect()
    settled[0].sparkSession._jvm.System.gc()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) long edges to (id, component): the smallest id reachable, for every id in an edge.

    Alternating large-star and small-star rounds; each round is two aggregations
    over the edge table, which never grows past its first size.
    """
    pairs = settle(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )

    def state(p: DataFrame) -> tuple:
        row = p.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    before = state(pairs)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        ends = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")
        both = pairs.select(ends).select("e.*")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        # an edge of each id to its least neighbour, and of its other neighbours to that one
        each = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        nxt = large.join(low2, "u").select(each).select("e.*").where("u <> v").distinct()
        last, pairs = pairs, settle(nxt)
        drop(last, shuffles=False)
        now = state(pairs)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not converge")
    out = pairs.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return out.unionByName(out.select(F.col("component").alias("id"), "component").distinct())
