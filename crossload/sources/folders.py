"""Folders that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; a temporary one where that is unset and all runs on this machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to a new folder and read from it: what several steps read is made once."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def path_of(spark: SparkSession, path: str):
    """A path and its file system, whatever store it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, none if there is no folder."""
    at, fs = path_of(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def get_text(spark: SparkSession, path: str) -> str:
    at, fs = path_of(spark, path)
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that nobody has written yet: whole or not at all, and false if somebody was first."""
    at, fs = path_of(spark, path)
    draft, _ = path_of(spark, f"{path}.{uuid.uuid4().hex}.draft")
    stream = fs.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    no_option = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(draft, at, no_option)  # fails where the name is taken
        return True
    except Exception:
        fs.delete(draft, False)
        if fs.exists(at):
            return False
        raise


def remove(spark: SparkSession, path: str) -> None:
    at, fs = path_of(spark, path)
    fs.delete(at, True)
