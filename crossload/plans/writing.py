"""Queries of reading exports, landing, mapping, hashing, resolving and writing to the versioned table."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from ..functions import normalize as n
from ..functions.redaction import redact_json as without_secrets
from ..operators import idempotency as i
from ..operators import mapping, parents, sink
from ..sources import assets, exports, landing
from ..sources.folders import new_folder
from ..sources.inputs import read
from .queries import C, query

# Writing

UPSERTED = ("SELECT coalesce(m.source_id, c.id) AS id, coalesce(m.destination_id, 'D-' || c.id) AS destination_id, CASE WHEN c.id IS NULL THEN 'old' ELSE c.email END AS email, "
            "CASE WHEN m.source_id IS NULL THEN 2 ELSE 1 END AS created_in, CASE WHEN c.id IS NULL THEN 1 ELSE 2 END AS updated_in FROM known_contact m FULL JOIN (SELECT id, email FROM raw_contact WHERE id <> '') c ON m.source_id = c.id")


@query(UPSERTED)
def upsert_sink(spark, d):
    """All contacts written to a versioned table that holds others, then sent again: the second time nothing changes."""
    folder = new_folder(spark, "sink")
    old = read(spark, d, "known_contact").select(C("source_id").alias("id"), "destination_id", F.lit("old").alias("email"))
    new = read(spark, d, "raw_contact").where("id <> ''").select("id", F.concat(F.lit("D-"), "id").alias("destination_id"), "email")
    sink.create(spark, folder, old.schema, ["id"], 16)
    sink.upsert(spark, folder, old)
    for _ in range(2):
        sink.upsert(spark, folder, new, keep=["destination_id"])
    return sink.read(spark, folder)


QUOTED = "CASE WHEN {0} IS NULL THEN 'null' ELSE '\"' || {0} || '\"' END"
NESTED = ("'{\"contact\":{\"email\":' || " + QUOTED.format("email") + " || ',\"name\":{\"first\":' || " + QUOTED.format("first_name") + " || ',\"last\":' || " + QUOTED.format("last_name")
          + " || '}},\"custom\":{\"a\":' || " + QUOTED.format("zip") + " || ',\"owner\":' || " + QUOTED.format("user_id") + " || '},\"id\":\"' || id || '\",\"tags\":[{\"label\":' || " + QUOTED.format("state") + " || ',\"n\":' || k || '}]}'")


@query(f"SELECT k, sha256({NESTED}) AS hash, true AS stable FROM raw_contact")
def content_hash_nested(spark, d):
    """The hash of nested records, and whether it stays when fields and keys come in another order and what doesn't count changes."""
    rows = read(spark, d, "raw_contact")
    text = lambda c: C(c).cast("string")
    one = rows.select(
        "k", F.struct(
            C("id"), F.struct(F.struct(C("first_name").alias("first"), C("last_name").alias("last")).alias("name"), C("email"), F.lit("w1").alias("warnings")).alias("contact"),
            F.create_map(F.lit("owner"), text("user_id"), F.lit("a"), text("zip"), F.lit("migration_id"), F.lit("m1")).alias("custom"),
            F.array(F.struct(C("k").alias("n"), C("state").alias("label"), F.lit(1).alias("source_created_at"))).alias("tags"), F.lit("m1").alias("migration_id")).alias("r"))
    two = rows.select(
        "k", F.struct(
            F.lit("m2").alias("migration_id"), F.array(F.struct(F.lit(2).alias("source_created_at"), C("state").alias("label"), C("k").alias("n"))).alias("tags"),
            F.create_map(F.lit("migration_id"), F.lit("m2"), F.lit("a"), text("zip"), F.lit("owner"), text("user_id")).alias("custom"),
            F.struct(F.array(F.lit("w2")).alias("warnings"), C("email"), F.struct(C("last_name").alias("last"), C("first_name").alias("first")).alias("name")).alias("contact"), C("id")).alias("r"))
    hashed = lambda df: df.select("k", "r.*").select("k", i.content_hash(df.select("r.*")).alias("hash"))
    return hashed(one).join(hashed(two).withColumnRenamed("hash", "other"), "k").select("k", "hash", (C("hash") == C("other")).alias("stable"))


# References

HELD = ("SELECT 'contact' AS entity, id, 'assigned_user_source_id' AS col, 0 AS place, 'user' AS target, user_id AS sid FROM raw_contact "
        "UNION ALL SELECT 'job', id, 'contact_source_id', 0, 'contact', contact_id FROM raw_job "
        "UNION ALL SELECT 'job', id, 'assigned_user_source_ids', unnest(range(len(string_split(user_ids, ',')))), 'user', unnest(string_split(user_ids, ',')) FROM raw_job "
        "UNION ALL SELECT 'opportunity', id, 'contact_source_id', 0, 'contact', contact_id FROM raw_opportunity UNION ALL SELECT 'opportunity', id, 'pipeline_source_id', 0, 'pipeline', pipeline_id FROM raw_opportunity "
        "UNION ALL SELECT 'opportunity', id, 'stage_source_id', 0, 'pipeline_stage', stage_id FROM raw_opportunity UNION ALL SELECT 'pipeline_stage', id, 'pipeline_source_id', 0, 'pipeline', pipeline_id FROM raw_stage "
        "UNION ALL SELECT 'note', id, 'parent_source_id', 0, parent_type, parent_id FROM raw_note")
KNOWN = ("SELECT 'contact' AS entity, source_id, destination_id FROM object_map UNION ALL SELECT 'user', id, 'D-' || id FROM raw_user UNION ALL SELECT 'job', id, 'D-' || id FROM raw_job "
         "UNION ALL SELECT 'pipeline_stage', id, 'D-' || id FROM raw_stage UNION ALL SELECT 'pipeline', CAST(r_regionkey AS STRING), 'D-P' || r_regionkey FROM region")
LINKED = f"SELECT r.*, o.destination_id AS dest FROM ({HELD}) r LEFT JOIN ({KNOWN}) o ON o.entity = r.target AND o.source_id = r.sid WHERE sid <> ''"


def references(spark, d):
    contacts = read(spark, d, "raw_contact").select("id", C("user_id").alias("assigned_user_source_id"))
    jobs = read(spark, d, "raw_job").select("id", C("contact_id").alias("contact_source_id"), F.split("user_ids", ",").alias("assigned_user_source_ids"))
    deals = read(spark, d, "raw_opportunity").select("id", C("contact_id").alias("contact_source_id"), C("pipeline_id").alias("pipeline_source_id"), C("stage_id").alias("stage_source_id"))
    stages = read(spark, d, "raw_stage").select("id", C("pipeline_id").alias("pipeline_source_id"))
    notes = read(spark, d, "raw_note").select("id", C("parent_type").alias("parent_entity_type"), C("parent_id").alias("parent_source_id"))
    out = None
    for entity, df in (("contact", contacts), ("job", jobs), ("opportunity", deals), ("pipeline_stage", stages), ("note", notes)):
        held = parents.references(df, entity)
        out = held if out is None else out.unionByName(held)
    named = lambda name, entity, id="id": read(spark, d, name).select(F.lit(entity).alias("entity"), C(id).cast("string").alias("source_id"), F.concat(F.lit("D-"), id).alias("destination_id"))
    pipelines = read(spark, d, "region").select(F.lit("pipeline").alias("entity"), C("r_regionkey").cast("string").alias("source_id"), F.concat(F.lit("D-P"), "r_regionkey").alias("destination_id"))
    known = read(spark, d, "object_map").select(F.lit("contact").alias("entity"), "source_id", "destination_id").unionByName(named("raw_user", "user")).unionByName(
        named("raw_job", "job")).unionByName(named("raw_stage", "pipeline_stage")).unionByName(pipelines)
    return parents.resolved(out, known)


@query("SELECT entity, id, string_agg(col || '=' || ids, ';' ORDER BY col) AS parents, CAST(sum(lost) AS BIGINT) AS lost FROM (SELECT entity, id, col, coalesce(string_agg(dest, ',' ORDER BY place, dest), '') AS ids, "
       f"count(*) FILTER (dest IS NULL) AS lost FROM ({LINKED}) x GROUP BY entity, id, col) y GROUP BY entity, id")
def resolve_parents(spark, d):
    """The references of five entities, resolved in one join."""
    each = F.array_sort(F.transform(F.map_entries("parents"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))))
    return parents.parents(references(spark, d)).select("entity", "id", F.array_join(each, ";").alias("parents"), F.size("warnings").cast("long").alias("lost"))


@query(f"SELECT entity, id, 'PARENT_UNRESOLVED' AS code, col AS field, target, sid AS source_id FROM ({LINKED}) x WHERE dest IS NULL")
def parent_warnings(spark, d):
    found = parents.parents(references(spark, d)).select("entity", "id", F.explode("warnings").alias("w"))
    return found.select("entity", "id", "w.code", C("w.column").alias("field"), "w.target", "w.source_id")


# Reading exports

PEOPLE = StructType().add("k", LongType()).add("id", StringType()).add("full_name", StringType()).add("created", StringType()).add("modified", StringType())
JOBS = StructType().add("k", LongType()).add("id", StringType()).add("status", StringType()).add("created", "timestamp").add("modified", "timestamp")


def people(spark, d):
    """An export of contacts as JSON lines, of which some are cut and some hold text for a number."""
    rows = read(spark, d, "raw_contact").select("k", "id", "full_name", "created", F.when(C("k") % 3 == 0, "2023-07-01 00:00:00").when(C("k") % 3 == 1, "unreadable").alias("modified"))
    line = F.to_json(F.struct("*"))
    bad = F.when(C("k") % 97 == 5, F.substring(line, 1, 20)).when(C("k") % 89 == 7, F.regexp_replace(line, r'"k":\d+', '"k":"many"')).otherwise(line)
    folder = new_folder(spark, "export")
    rows.select(bad.alias("value")).write.text(f"{folder}/contact")
    return exports.FileExport(spark, folder, "json", {"contact": PEOPLE}, {"contact": ["modified", "created"]})


READABLE = "raw_contact WHERE k % 97 <> 5 AND k % 89 <> 7"


@query(f"SELECT k, id, full_name FROM {READABLE}")
def scan_contacts(spark, d):
    return people(spark, d).scan("contact").select("k", "id", "full_name")


@query(f"SELECT 'contact' AS entity, count(*) FILTER (k % 97 <> 5 AND k % 89 <> 7) AS records, count(*) FILTER (k % 97 = 5 OR k % 89 = 7) AS rejected FROM raw_contact")
def scan_report(spark, d):
    return exports.scanned(people(spark, d), ["contact"])


@query(f"SELECT k FROM {READABLE} AND (k % 3 = 0 OR (k % 3 = 2 AND k % 8 IN (3, 4)))")
def scan_since(spark, d):
    """Contacts changed after a time: an unreadable date of change doesn't count, a missing one gives way to that of creation."""
    return people(spark, d).scan("contact", F.lit("2023-06-01").cast("timestamp")).select("k")


@query(f"SELECT CASE WHEN k % 3 = 1 OR (k % 3 = 2 AND k % 8 IN (5, 6)) THEN 'unreadable' WHEN k % 3 = 2 AND k % 8 = 7 THEN 'undated' WHEN k % 3 = 0 OR k % 8 IN (3, 4) THEN 'changed' ELSE 'unchanged' END AS what, count(*) AS n FROM {READABLE} GROUP BY 1")
def since_report(spark, d):
    """How many records a scan since a time takes, and how many it leaves for what reason: dates that can't be read are told, not lost."""
    source = people(spark, d)
    at, text = source.changed_at("contact"), F.coalesce("modified", "created")
    what = F.when(text.isNull(), "undated").when(at.isNull(), "unreadable").when(at > F.lit("2023-06-01").cast("timestamp"), "changed").otherwise("unchanged")
    return source.scan("contact").select(what.alias("what")).groupBy("what").agg(F.count("*").alias("n"))


def job_export(spark, d, form):
    rows = read(spark, d, "raw_job").select("k", "id", "status", C("created").cast("timestamp").alias("created"), F.when(C("k") % 2 == 0, C("created") + F.make_dt_interval(C("k").cast("int") % 90)).cast("timestamp").alias("modified"))
    folder = new_folder(spark, "export")
    if form == "csv":
        time = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
        line = F.concat_ws(",", "k", "id", "status", time("created"), time("modified"))
        bad = F.when(C("k") % 71 == 3, F.concat(line, F.lit(",more,cells"))).when(C("k") % 71 == 4, F.concat(F.lit("x"), line)).otherwise(line)
        rows.select(bad.alias("value")).write.text(f"{folder}/job")
    else:
        rows.write.parquet(f"{folder}/job")
    return exports.FileExport(spark, folder, form, {"job": JOBS}, {"job": ["modified", "created"]}, header=False)


@query("SELECT k, id, status FROM raw_job WHERE k % 71 NOT IN (3, 4)")
def scan_export_csv(spark, d):
    return job_export(spark, d, "csv").scan("job").select("k", "id", "status")


@query("SELECT k FROM raw_job WHERE CASE WHEN k % 2 = 0 THEN created + INTERVAL '1' DAY * (k % 90) ELSE created END > TIMESTAMP '1996-01-01 00:00:00'")
def scan_export(spark, d):
    """Jobs of a Parquet export changed after a time, filtered in the scan."""
    return job_export(spark, d, "parquet").scan("job", F.lit("1996-01-01 00:00:00").cast("timestamp")).select("k")


# Landing

ORDER_JSON = "'{\"o_orderkey\":' || o_orderkey || ',\"o_custkey\":' || o_custkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}'"


def land_orders(spark, d):
    folder = new_folder(spark, "landed")
    some = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    landing.land(some, "job", C("o_orderkey").cast("string"), folder, F.timestamp_seconds(F.lit(800_000_000) + C("o_orderkey") % 400 * 86_400))
    return folder


LANDED = (f"SELECT CAST(o_orderkey AS STRING) AS source_id, 'job' AS entity, {ORDER_JSON} AS payload, "
          "last_day(CAST(make_timestamp(1000000 * (800000000 + o_orderkey % 400 * 86400)) AS DATE) + 90) AS expires_on FROM orders")


@query(LANDED)
def land_payload(spark, d):
    return landing.landed(spark, land_orders(spark, d)).select("source_id", "entity", "payload", "expires_on")


@query(f"SELECT source_id, entity, CASE WHEN expires_on >= DATE '1996-02-01' THEN payload END AS payload FROM ({LANDED}) t")
def purge_payload(spark, d):
    folder = land_orders(spark, d)
    for _ in range(2):  # the second time finds nothing to do
        landing.purge(spark, folder, F.lit("1996-02-01").cast("date"))
    return landing.landed(spark, folder).select("source_id", "entity", "payload")


# Redaction, mappings, assets

@query("SELECT k, clean FROM raw_payload")
def redact_json(spark, d):
    return read(spark, d, "raw_payload").select("k", without_secrets(C("payload")).alias("clean"))


FIELDS = [
    {"source_field": "id", "destination_field": "external_id", "mapping_action": "manual"},
    {"source_field": "first_name", "destination_field": "given_name", "mapping_action": "suggested", "transform_expression": "upper(coalesce(first_name, split_part(full_name, ', ', 2)))"},
    {"source_field": "last_name", "mapping_action": "ignore"},
    {"source_field": "zip", "destination_field": "zip5", "mapping_action": "create_custom_field", "transform_expression": "substring(zip, 1, 5)"},
    {"source_field": "user_id", "destination_field": "owner", "mapping_action": "create_custom_field"},
]


@query("SELECT id AS external_id, upper(coalesce(first_name, split_part(full_name, ', ', 2))) AS given_name, full_name, substr(zip, 1, 5) AS zip5, user_id AS owner, CASE WHEN user_id IS NULL THEN 1 ELSE 2 END AS fields FROM raw_contact")
def map_fields(spark, d):
    rows = read(spark, d, "raw_contact").select("id", "first_name", "last_name", "full_name", "zip", "user_id")
    mapped = mapping.map_fields(rows, FIELDS)
    custom = C("custom_fields")
    return mapped.select("external_id", "given_name", "full_name", custom["zip5"].alias("zip5"), custom["owner"].alias("owner"), F.size(custom).alias("fields"))


@query("SELECT k, string_agg(tag, ';' ORDER BY pos) AS tags FROM (SELECT k, min_by(tag, pos) AS tag, min(pos) AS pos FROM (SELECT k, pos, CASE WHEN lower(t) = 'vip' THEN 'Key account' WHEN lower(t) = 'machinery' THEN 'Furniture' ELSE t END AS tag FROM "
       "(SELECT k, trim(unnest(regexp_split_to_array(tags, '[;,|]'))) AS t, unnest(range(len(regexp_split_to_array(tags, '[;,|]')))) AS pos FROM raw_contact) x WHERE lower(t) <> 'new') y GROUP BY k, lower(tag)) z GROUP BY k")
def map_tags(spark, d):
    rows = read(spark, d, "raw_contact").select("k", n.tags(C("tags")).alias("tags"))
    table = spark.createDataFrame(
        [("VIP", "Key account", "use_existing"), ("new", None, "ignore"), ("machinery", "Furniture", "merge_into"), ("furniture", None, "create_new")],
        "source_tag string, destination_tag string, mapping_action string")
    return mapping.map_tags(rows, "k", "tags", table).select("k", F.array_join("tags", ";").alias("tags"))


@query("SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'size_verified' WHEN 2 THEN 'MISSING' ELSE 'hash_verified' END AS level, CASE WHEN item_id % 5 <> 2 THEN octet_length(encode(text)) + 1 END AS stored_size FROM benchmark "
       "UNION ALL SELECT -1, 'UNEXPECTED', 5")
def asset_scan(spark, d):
    """Texts stored as files, scanned and held against what was sent: some hashes are wrong, some not known, some files missing."""
    folder = new_folder(spark, "assets")
    items = read(spark, d, "benchmark").select("item_id", "text")
    items.where("item_id % 5 <> 2").repartition("item_id").write.partitionBy("item_id").text(folder)
    spark.createDataFrame([(-1, "more")], "item_id long, text string").write.mode("append").partitionBy("item_id").text(folder)
    whole = F.concat("text", F.lit("\n"))
    found = assets.scan(spark, folder, "part-*").select(F.regexp_extract("path", r"item_id=(-?\d+)", 1).cast("long").alias("item_id"), F.when(F.regexp_extract("path", r"item_id=(-?\d+)", 1).cast("long") % 5 != 1, C("hash")).alias("hash"), "size")
    sent = items.select("item_id", F.when(C("item_id") % 5 == 0, "bad").otherwise(F.sha2(whole, 256)).alias("hash"), F.octet_length(whole).cast("long").alias("size"))
    return assets.verified(sent, found, "item_id").select("item_id", "level", "stored_size")


# Capabilities

@query("SELECT s.migration_id, s.entity, coalesce(c.level, 'false') AS level, coalesce(c.level, 'false') <> 'false' AS supported, coalesce(c.level, 'false') = 'conditional' AS conditional FROM selection s "
       "JOIN migration m ON s.migration_id = m.migration_id LEFT JOIN capability c ON c.entity = s.entity AND c.platform = CAST(m.migration_id % 5 AS STRING)")
def capability_check(spark, d):
    """What each migration's source can do for the entities chosen: an entity that its matrix lacks isn't supported."""
    runs = read(spark, d, "migration").select("migration_id", (C("migration_id") % 5).cast("string").alias("platform"))
    level = F.coalesce("level", F.lit("false"))
    found = read(spark, d, "selection").join(runs, "migration_id").join(F.broadcast(read(spark, d, "capability")), ["platform", "entity"], "left")  # platforms times entities
    return found.select("migration_id", "entity", level.alias("level"), (level != "false").alias("supported"), (level == "conditional").alias("conditional"))
