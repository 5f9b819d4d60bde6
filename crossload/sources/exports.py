"""Sources of records: what a migration reads an entity from.

A source gives the records of an entity under the schema that the entity has, and what could not be read
beside it, so that nothing is lost silently. A file export (JSON lines, CSV or Parquet, a folder an entity) is the
one built here; a vendor's API joins as a Spark data source whose partitions are ranges of its pages.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType, TimestampType

from ..functions import normalize as n

CORRUPT = "_corrupt_record"


class Source(Protocol):
    def scan(self, entity: str, since: Column | None = None) -> DataFrame:
        """The readable records of an entity; with since, those changed after it."""

    def rejects(self, entity: str) -> DataFrame:
        """entity, file, record (its text) of what could not be read."""


@dataclass
class FileExport:
    """Folders <folder>/<entity> of files in one form. A record that doesn't fit its entity's schema (fields that are no
    numbers, cut lines, too few or too many cells) is rejected whole, with its text.

    changed: for each entity the columns of a record's last change and of its creation. A record without a date of
    change counts by that of its creation; one with an unreadable date of change doesn't count as changed. Dates in
    timestamp columns are compared as they are, so that Parquet files skip row groups; dates in text are read first."""

    spark: SparkSession
    folder: str
    form: str
    schemas: dict[str, StructType]
    changed: dict[str, list[str]] = field(default_factory=dict)
    header: bool = True  # of CSV files

    def raw(self, entity: str) -> DataFrame:
        schema, reader = self.schemas[entity], self.spark.read
        if self.form == "parquet":
            return reader.schema(schema).parquet(f"{self.folder}/{entity}")
        reader = reader.schema(StructType([*schema.fields]).add(CORRUPT, StringType())).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        if self.form == "csv":
            # all cells of a line are read, as a line with too many or too few of them is bad
            reader = reader.option("header", self.header).option("enforceSchema", False).option("columnPruning", False)
        return reader.format(self.form).load(f"{self.folder}/{entity}")

    def scan(self, entity: str, since: Column | None = None) -> DataFrame:
        rows = self.raw(entity)
        good = rows if self.form == "parquet" else rows.where(self.bad(entity) == "").drop(CORRUPT)
        return good if since is None else good.where(self.changed_at(entity) > since)

    def changed_at(self, entity: str) -> Column:
        columns, schema = self.changed[entity], self.schemas[entity]
        if all(isinstance(schema[c].dataType, TimestampType) for c in columns):
            return F.coalesce(*columns) if len(columns) > 1 else F.col(columns[0])
        return n.timestamp(F.coalesce(*[F.col(c).cast("string") for c in columns]))

    def rejects(self, entity: str) -> DataFrame:
        if self.form == "parquet":
            return self.spark.createDataFrame([], "entity string, file string, record string")
        return self.raw(entity).where(self.bad(entity) != "").select(F.lit(entity).alias("entity"), F.col("_metadata.file_path").alias("file"), self.bad(entity).alias("record"))

    def bad(self, entity: str) -> Column:
        """A record's text if it was rejected, else nothing. Of the first field, no letters are added: Spark asks that a
        query reads some field besides the text."""
        return F.concat_ws("", CORRUPT, F.substring(F.col(self.schemas[entity].names[0]).cast("string"), 1, 0))


def scanned(source: Source, entities: list[str]) -> DataFrame:
    """entity, records, rejected: how many records of each entity were readable and how many not."""
    out = None
    for e in entities:
        good = source.scan(e).select(F.lit(e).alias("entity"), F.lit(1).alias("good"))
        both = good.unionByName(source.rejects(e).select("entity", F.lit(0).alias("good")))
        out = both if out is None else out.unionByName(both)
    return out.groupBy("entity").agg(F.sum("good").cast("long").alias("records"), F.sum(1 - F.col("good")).cast("long").alias("rejected"))
