"""References of records to their parents, resolved for all entities in one join.

Which column of which entity points to what is a table (REFERENCES); each reference of a record is exploded
to a row, so that a new reference is a new line here and no new join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..sources.folders import written

# Entity, the column with the source id (or ids), and the entity it points to. Where that is in a
# column of the record itself, its name stands in braces.
REFERENCES = [
    ("contact", "assigned_user_source_id", "user"),
    ("contact", "company_source_id", "company"),
    ("job", "contact_source_id", "contact"),
    ("job", "opportunity_source_id", "opportunity"),
    ("job", "stage_source_id", "pipeline_stage"),
    ("job", "assigned_user_source_ids", "user"),
    ("opportunity", "contact_source_id", "contact"),
    ("opportunity", "pipeline_source_id", "pipeline"),
    ("opportunity", "stage_source_id", "pipeline_stage"),
    ("opportunity", "assigned_user_source_id", "user"),
    ("pipeline_stage", "pipeline_source_id", "pipeline"),
]
REFERENCES += [
    (entity, column, target)
    for entity in ("note", "activity", "task", "appointment")
    for column, target in (("parent_source_id", "{parent_entity_type}"), ("author_user_source_id", "user"), ("user_source_id", "user"), ("assigned_user_source_id", "user"))
]


def references(records: DataFrame, entity: str) -> DataFrame:
    """entity, id, column, place, target, source_id: a row for each reference that a record of an entity holds. Columns that
    records lacks are no references; null and empty ids neither."""
    parts = []
    for of, column, target in REFERENCES:
        if of == entity and column in records.columns:
            ids = F.col(column) if isinstance(records.schema[column].dataType, ArrayType) else F.array(column)
            to = F.col(target[1:-1]) if target.startswith("{") else F.lit(target)
            parts.append(F.struct(F.lit(column).alias("column"), to.alias("target"), ids.alias("ids")))
    if not parts:
        parts = [F.struct(F.lit("").alias("column"), F.lit("").alias("target"), F.array().cast("array<string>").alias("ids"))]
    each = records.select("id", F.explode(F.array(*parts)).alias("r")).select("id", "r.column", "r.target", F.posexplode("r.ids").alias("place", "source_id"))
    return each.where("source_id <> '' and target is not null").select(F.lit(entity).alias("entity"), "id", "column", "place", "target", "source_id")


def resolved(held: DataFrame, known: DataFrame) -> DataFrame:
    """References (of any number of entities) with destination_id, by known (entity, source_id, destination_id). The ids that
    are referred to are looked up first: they are far fewer than the references, which then need no shuffle if those
    found fit a broadcast."""
    at = ["target", "source_id"]
    asked = held.select(*at).distinct()
    found = written(asked.join(known.select(F.col("entity").alias("target"), "source_id", "destination_id"), at), "known")
    return held.join(found, at, "left")


def parents(found: DataFrame) -> DataFrame:
    """entity, id, parents (a map of column to the destination ids, in order; those that aren't known are left out)
    and warnings (PARENT_UNRESOLVED: column, target and source id of each)."""
    lost = F.when(F.col("destination_id").isNull(), F.struct("target", "source_id")).alias("lost")
    narrow = found.select("entity", "id", "column", F.col("place").cast("int").alias("place"), "destination_id", lost)
    per = narrow.groupBy("entity", "id").agg(F.array_sort(F.collect_list(F.struct("column", "place", "destination_id", "lost"))).alias("all"))
    named = F.array_distinct(F.transform("all", lambda x: x["column"]))
    ids = lambda c: F.transform(F.filter("all", lambda x: (x["column"] == c) & x["destination_id"].isNotNull()), lambda x: x["destination_id"])
    warnings = F.transform(F.filter("all", lambda x: x["lost"].isNotNull()), lambda x: F.struct(
        F.lit("PARENT_UNRESOLVED").alias("code"), x["column"].alias("column"), x["lost"]["target"].alias("target"), x["lost"]["source_id"].alias("source_id")))
    return per.select("entity", "id", F.map_from_entries(F.transform(named, lambda c: F.struct(c, ids(c)))).alias("parents"), F.array_sort(warnings).alias("warnings"))
