"""Mapping tables applied: fields with checked expressions, and tags."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# what an expression may call, and the words of SQL that it may hold
FUNCTIONS = {"upper", "lower", "trim", "concat", "coalesce", "substring", "replace", "round", "abs", "cast", "length", "nullif", "date_format", "to_date", "split_part"}
WORDS = {"case", "when", "then", "else", "end", "and", "or", "not", "is", "null", "in", "like", "between", "as", "string", "bigint", "int", "double", "date", "boolean", "true", "false"}
TOKEN = re.compile(r"\s*(?:(?P<name>[A-Za-z_]\w*)|(?P<number>\d+(?:\.\d+)?)|(?P<text>'(?:[^'\\]|'')*')|(?P<sign><=>|<>|<=|>=|!=|\|\||[-+*/%<>=(),]))")
ACTIONS = ["auto", "suggested", "manual", "ignore", "create_custom_field"]


class ForbiddenExpression(ValueError):
    """An expression that names a column, function or sign that isn't allowed."""


def checked(text: str, columns: list[str]) -> Column:
    """An expression as a Column, if it consists of allowed columns, functions, literals and signs alone; anything
    else (other functions, subqueries, comments, quoted names, several statements) raises ForbiddenExpression."""
    at, allowed, end = 0, {c.lower() for c in columns}, len(text.rstrip())
    while at < end:
        found = TOKEN.match(text, at)
        if not found:
            raise ForbiddenExpression(f"{text!r} at {at}")
        at = found.end()
        if name := found["name"]:
            called = text[at:].lstrip().startswith("(") and name.lower() not in WORDS
            if name.lower() not in (FUNCTIONS if called else allowed | WORDS):
                raise ForbiddenExpression(f"{name!r} in {text!r}")
        if found["sign"] in ("-", "/") and text[at : at + 1] in ("-", "*"):
            raise ForbiddenExpression(f"a comment in {text!r}")
    if not end:
        raise ForbiddenExpression("an empty expression")
    return F.expr(text)


def map_fields(records: DataFrame, mappings: list[dict], custom: str = "custom_fields") -> DataFrame:
    """records under their field mappings (source_field, destination_field, mapping_action, transform_expression).

    A field without a mapping keeps its name; ignore drops it; create_custom_field puts it into the map custom, under its
    destination name, unless null; the others rename it. An expression replaces its value, and may name any column of records."""
    by, out, more, seen = {m["source_field"]: m for m in mappings}, [], [], []
    for name in records.columns:
        m = by.get(name, {})
        action, to = m.get("mapping_action") or "auto", m.get("destination_field") or name
        if action not in ACTIONS:
            raise ValueError(f"{action!r} is none of {ACTIONS}")
        value = checked(m["transform_expression"], records.columns) if m.get("transform_expression") else F.col(name)
        if action == "create_custom_field":
            more += [F.lit(to), value.cast("string")]
        elif action != "ignore":
            if to.lower() in seen:
                raise ValueError(f"two fields are mapped to {to!r}")
            seen.append(to.lower())
            out.append(value.alias(to))
    if more:
        out.append(F.map_filter(F.create_map(*more), lambda _, v: v.isNotNull()).alias(custom))
    return records.select(*out)


def map_tags(records: DataFrame, id: str, tags: str, mappings: DataFrame) -> DataFrame:
    """id, tags (array) of records under tag mappings (source_tag, destination_tag, mapping_action): ignore drops a tag,
    the others take the destination's; a tag without a mapping, or with one that names none, stays. Order is kept; of tags
    that become equal, but for case, the first stays. Tags are compared without case."""
    each = records.select(id, F.posexplode(tags).alias("at", "tag"))
    known = mappings.select(F.lower("source_tag").alias("low"), "destination_tag", "mapping_action")
    mapped = each.withColumn("low", F.lower("tag")).join(known, "low", "left").where("mapping_action is null or mapping_action <> 'ignore'")
    first = mapped.withColumn("tag", F.coalesce("destination_tag", "tag")).groupBy(id, F.lower("tag").alias("low")).agg(F.min(F.struct("at", "tag")).alias("t"))
    found = first.groupBy(id).agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["tag"]).alias(tags))
    return records.select(id).join(found, id, "left").withColumn(tags, F.coalesce(tags, F.array().cast("array<string>")))
