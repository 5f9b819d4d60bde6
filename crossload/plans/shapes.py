"""Queries of canonical and destination forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as n
from ..operators import forms
from ..operators import records as r
from ..sources.inputs import read
from .migration import PARENT, parents
from .queries import CENTS, DATE_OF, EMAIL, NAME, PHONE, POSTAL, STATE, STREET, C, query

NONE = "CAST(NULL AS STRING)"


def q(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN 'null' ELSE '\"' || {column} || '\"' END"


def text(column: str) -> str:
    return rf"nullif(trim(regexp_replace({column}, '\s+', ' ', 'g')), '')"


def address(line: str, city: str, state: str, code: str, country: str) -> str:
    parts = {"line1": q(line), "line2": "'null'", "city": q(city), "state": q(state), "postal_code": q(code), "country": q(country)}
    return f"CASE WHEN coalesce({line}, {city}, {code}) IS NULL THEN 'null' ELSE '{{' || " + " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in parts.items()) + " || '}' END"


def resolved(df, column: str, known, out: str):
    """df with the destination id (prefix D-) of a source id that known (id) holds."""
    return r.resolve(df, column, known.select(C("id").alias("source_id"), F.concat(F.lit("D-"), "id").alias("destination_id")), out)


LAND = "CASE WHEN lower(country) IN ('us', 'usa', 'united states', 'united states of america', 'u.s.', 'u.s.a.') THEN 'US' WHEN lower(country) IN ('ca', 'canada') THEN 'CA' WHEN length(country) = 2 THEN upper(country) ELSE country END"
FIRST = "coalesce(first_name, CASE WHEN full_name LIKE '%,%' THEN trim(split_part(full_name, ',', 2)) ELSE split_part(full_name, ' ', 1) END)"
LAST = "coalesce(last_name, CASE WHEN full_name LIKE '%,%' THEN split_part(full_name, ',', 1) ELSE split_part(full_name, ' ', 2) END)"
TAGS = ("(SELECT string_agg(tag, ';' ORDER BY pos) FROM (SELECT min_by(trim(t), pos) AS tag, min(pos) AS pos FROM (SELECT unnest(regexp_split_to_array(tags, '[;,|]')) AS t, "
        "unnest(range(len(regexp_split_to_array(tags, '[;,|]')))) AS pos) x WHERE trim(t) <> '' GROUP BY lower(trim(t))) y)")


@query(f"SELECT id, {FIRST} AS first_name, {LAST} AS last_name, {NONE} AS company_name, {NONE} AS company_id, {EMAIL} AS email, {PHONE} AS phone, CASE WHEN k % 4 = 0 THEN '[\"' || lower(trim(secondary_email)) || '\"]' ELSE '[]' END AS secondary_emails, "
       f"'[]' AS secondary_phones, {address('trim(street)', 'city', STATE, POSTAL, LAND)} AS address_json, {text('lead_source')} AS lead_source, CASE WHEN EXISTS (SELECT 1 FROM raw_user u WHERE u.id = user_id) THEN 'D-' || user_id END AS assigned_user_id, "
       f"'[\"' || replace({TAGS}, ';', '\",\"') || '\"]' AS tags, '{{' || CASE WHEN user_id IS NOT NULL THEN '\"owner\":\"' || user_id || '\",' ELSE '' END || '\"zip\":\"' || zip || '\"}}' AS custom_fields, '{{}}' AS communication_prefs, {EMAIL} AS normalized_email, "
       f"{PHONE} AS normalized_phone, {NAME.format(f'({FIRST} || chr(32) || {LAST})')} AS normalized_name_key, {STREET} AS address_key, {DATE_OF.format('created')} AS source_created_at, {DATE_OF.format('modified')} AS source_updated_at FROM full_contact")
def form_contact(spark, d):
    raw = read(spark, d, "full_contact").withColumn("custom", F.create_map(F.lit("owner"), C("user_id"), F.lit("none"), F.lit(""), F.lit("zip"), C("zip")))
    canonical = resolved(forms.canonical_contact(raw), "assigned_user_source_id", read(spark, d, "raw_user"), "assigned_user_destination_id")
    return forms.project(canonical.withColumnRenamed("source_object_id", "id"), "contact", "id")


@query(f"SELECT id, job_number, {text('name')} AS name, CASE WHEN EXISTS (SELECT 1 FROM raw_contact c WHERE c.id = contact_id) THEN 'D-' || contact_id END AS contact_id, {NONE} AS opportunity_id, "
       f"{address('street', 'city', chr(39) + 'OH' + chr(39), 'zip', chr(39) + 'US' + chr(39))} AS address_json, job_type, status, {NONE} AS stage_id, {CENTS} AS value_cents, 'USD' AS currency, {NONE} AS lead_source, {DATE_OF.format('start_text')} AS start_date, "
       f"{DATE_OF.format('done_text')} AS completion_date, '[' || coalesce((SELECT string_agg('\"D-' || u.id || '\"', ',' ORDER BY x.pos) FROM (SELECT unnest(string_split(user_ids, ',')) AS u, unnest(range(len(string_split(user_ids, ',')))) AS pos) x JOIN raw_user u ON u.id = x.u), '') || ']' AS assigned_user_ids, "
       "'[\"A\",\"b\"]' AS tags, '{}' AS custom_fields, created AS source_created_at, CAST(NULL AS TIMESTAMP) AS source_updated_at FROM full_job")
def form_job(spark, d):
    raw = read(spark, d, "full_job").select(
        "id", "job_number", "name", "contact_id", "street", "city", C("region").alias("state"), "zip", "job_type", "status", "value", F.split("user_ids", ",").alias("user_ids"), C("start_text").alias("start"),
        C("done_text").alias("completed"), F.lit(None).cast("string").alias("lead_source"), "tags", F.date_format("created", "yyyy-MM-dd HH:mm:ss").alias("created"), F.lit(None).cast("string").alias("modified"))
    jobs = forms.canonical_job(raw)
    users = read(spark, d, "raw_user").select(C("id").alias("source_id"), F.concat(F.lit("D-"), "id").alias("destination_id"))
    contacts = read(spark, d, "raw_contact").select("id").where("id <> ''").distinct()
    found = r.resolve_lists(jobs, "assigned_user_source_ids", users, "assigned_user_destination_ids")
    whole = resolved(found, "contact_source_id", contacts, "contact_destination_id")
    return forms.project(whole.withColumnRenamed("source_object_id", "id"), "job", "id")


USER_EMAIL = "CASE WHEN k % 20 <> 0 THEN 'u' || k || '@mail.example' END"
USER_PHONE = "'+1555' || lpad(CAST(2000000 + k % 7000000 AS STRING), 7, '0')"


@query(f"SELECT id, first_name, last_name, {USER_EMAIL} AS email, {USER_PHONE} AS phone, CASE WHEN k % 3 = 0 THEN 'Sales Rep' END AS role, CASE WHEN k % 3 = 0 THEN 'Sales Rep' END AS source_role, {NONE} AS team, active AS is_active, NOT active AS is_historical FROM raw_user")
def form_user(spark, d):
    raw = read(spark, d, "raw_user").select(
        "id", "first_name", "last_name", F.element_at(F.split("emails", ";"), 1).alias("email"), F.element_at(F.split("phones", "/"), 1).alias("phone"), F.when(C("k") % 3 == 0, " Sales  Rep ").alias("role"), "active")
    return forms.project(forms.canonical_user(raw).withColumnRenamed("source_object_id", "id"), "user", "id")


@query("SELECT id, name, 'D-P' || pipeline_id AS pipeline_id, k AS position, regexp_matches(lower(name), 'won|complete') AS is_won, lower(name) LIKE '%lost%' AS is_lost FROM raw_stage")
def form_pipeline_stage(spark, d):
    pipelines = read(spark, d, "region").select(C("r_regionkey").cast("string").alias("source_id"), F.concat(F.lit("D-P"), "r_regionkey").alias("destination_id"))
    stages = r.resolve(forms.canonical_stage(read(spark, d, "raw_stage").withColumn("position", C("k"))), "pipeline_source_id", pipelines, "pipeline_destination_id")
    return forms.project(stages.withColumnRenamed("source_object_id", "id"), "pipeline_stage", "id")


@query(f"SELECT a.id, a.parent_type AS parent_entity_type, t.parent AS parent_id, {text('a.body')} AS body, CASE WHEN regexp_matches(a.body, '(?is)<[a-z].*>') THEN 'html' ELSE 'text' END AS body_format, a.created AS authored_at, "
       f"{NONE} AS author_user_id, a.author AS author_source_name FROM raw_note a JOIN ({PARENT.format('raw_note')}) t ON a.id = t.id")
def form_note(spark, d):
    raw = read(spark, d, "raw_note").select("id", "parent_type", "parent_id", "body", F.date_format("created", "yyyy-MM-dd HH:mm:ss").alias("created"), F.lit(None).cast("string").alias("author_user_id"), C("author").alias("author_name"))
    known = parents(spark, d, "raw_note").select(C("id").alias("source_object_id"), C("parent").alias("parent_destination_id"))
    return forms.project(forms.canonical_note(raw).join(known, "source_object_id").withColumnRenamed("source_object_id", "id"), "note", "id")


@query(f"SELECT k, 'Deal ' || k AS name, 'D-' || contact_id AS contact_id, CASE WHEN pipeline_id IS NOT NULL THEN 'D-P' || pipeline_id END AS pipeline_id, stage_id, 'open' AS status, k * 7 AS value_cents, CASE WHEN k % 3 = 0 THEN 'CAD' ELSE 'USD' END AS currency, "
       f"{NONE} AS assigned_user_id, {NONE} AS lead_source, {NONE} AS lost_reason, CAST(NULL AS TIMESTAMP) AS closed_at, CAST(NULL AS TIMESTAMP) AS source_created_at, CAST(NULL AS TIMESTAMP) AS source_updated_at, '{{}}' AS custom_fields FROM raw_opportunity")
def form_opportunity(spark, d):
    deals = read(spark, d, "raw_opportunity").select(
        "k", F.concat(F.lit("Deal "), "k").alias("name"), F.concat(F.lit("D-"), "contact_id").alias("contact_destination_id"), F.concat(F.lit("D-P"), "pipeline_id").alias("pipeline_destination_id"), C("stage_id").alias("stage_destination_id"),
        F.lit("open").alias("status"), F.struct((C("k") * 7).alias("amount_cents"), F.when(C("k") % 3 == 0, "CAD").when(C("k") % 3 == 1, "").alias("currency")).alias("value"), F.lit("").alias("lost_reason"))
    return forms.project(deals, "opportunity", "k")


@query(f"SELECT event_id, 'contact' AS parent_entity_type, 'D-' || user_id AS parent_id, CASE WHEN event_id % 4 = 0 THEN 'other' ELSE event_type END AS activity_type, {NONE} AS subject, {NONE} AS body, CASE WHEN event_id % 2 = 0 THEN 'inbound' END AS direction, ts AS occurred_at, "
       f"{NONE} AS user_id, {NONE} AS author_source_name, CASE WHEN event_id % 5 = 0 THEN '{{}}' ELSE '{{\"k\":\"' || regexp_extract(props, '[0-9]+') || '\"}}' END AS metadata FROM events")
def form_activity(spark, d):
    rows = read(spark, d, "events").select(
        "event_id", F.lit("contact").alias("parent_entity_type"), F.concat(F.lit("D-"), "user_id").alias("parent_destination_id"), F.when(C("event_id") % 4 != 0, C("event_type")).otherwise("").alias("activity_type"),
        F.when(C("event_id") % 2 == 0, "inbound").alias("direction"), C("ts").cast("timestamp").alias("occurred_at"), F.when(C("event_id") % 5 != 0, F.from_json("props", "map<string,string>")).alias("metadata"))
    return forms.project(rows, "activity", "event_id")


ACCOUNT = "CASE WHEN c_custkey % 10 = 3 THEN {0} ELSE c_name END"


@query(f"SELECT c_custkey, {ACCOUNT.format(repr('Unnamed Account'))} AS name, c_mktsegment AS legal_name, {NONE} AS phone, {NONE} AS email, {NONE} AS website, 'null' AS address_json FROM customer")
def form_account(spark, d):
    rows = read(spark, d, "customer").select("c_custkey", F.when(C("c_custkey") % 10 != 3, C("c_name")).otherwise("").alias("name"), C("c_mktsegment").alias("legal_name"))
    return forms.project(rows, "account", "c_custkey")


@query(f"SELECT c_custkey, {ACCOUNT.format(repr('Unnamed Company'))} AS name, {NONE} AS phone, {NONE} AS email, 'https://c' || c_custkey || '.example' AS website, '{{\"line1\":\"1 Oak St\",\"line2\":null,\"city\":null,\"state\":null,\"postal_code\":null,\"country\":null}}' AS address_json, {NONE} AS assigned_user_id FROM customer")
def form_company(spark, d):
    none = F.lit(None).cast("string")
    rows = read(spark, d, "customer").select(
        "c_custkey", F.when(C("c_custkey") % 10 != 3, C("c_name")).alias("name"), F.concat(F.lit("https://c"), "c_custkey", F.lit(".example")).alias("website"), n.address(F.lit("1  Oak St"), none, none, none, none, none).alias("address"))
    return forms.project(rows, "company", "c_custkey")


@query("SELECT o_orderkey, 'job' AS parent_entity_type, 'D-J' || o_orderkey AS parent_id, 'Order ' || o_orderkey AS title, CAST(NULL AS STRING) AS description, o_orderstatus AS status, o_orderdate AS due_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS completed_at, CAST(NULL AS STRING) AS assigned_user_id FROM orders")
def form_task(spark, d):
    rows = read(spark, d, "orders").select(
        "o_orderkey", F.lit("job").alias("parent_entity_type"), F.concat(F.lit("D-J"), "o_orderkey").alias("parent_destination_id"), F.concat(F.lit("Order "), "o_orderkey").alias("title"), F.lit("").alias("description"),
        C("o_orderstatus").alias("status"), C("o_orderdate").alias("due_at"), F.when(C("o_orderstatus") == "F", C("o_orderdate")).alias("completed_at"))
    return forms.project(rows, "task", "o_orderkey")


@query("SELECT o_orderkey, 'job' AS parent_entity_type, 'D-J' || o_orderkey AS parent_id, o_orderpriority AS title, CAST(NULL AS STRING) AS location, o_orderdate AS starts_at, o_orderdate + INTERVAL '1' HOUR AS ends_at, CAST(NULL AS STRING) AS assigned_user_id, o_orderstatus AS status FROM orders")
def form_appointment(spark, d):
    rows = read(spark, d, "orders").select(
        "o_orderkey", F.lit("job").alias("parent_entity_type"), F.concat(F.lit("D-J"), "o_orderkey").alias("parent_destination_id"), C("o_orderpriority").alias("title"), C("o_orderdate").alias("starts_at"),
        (C("o_orderdate") + F.expr("interval 1 hour")).alias("ends_at"), C("o_orderstatus").alias("status"))
    return forms.project(rows, "appointment", "o_orderkey")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'Unnamed Location' ELSE n_name END AS name, 'B' || n_nationkey AS branch_code, CAST(NULL AS STRING) AS phone, 'null' AS address_json, n_nationkey % 3 <> 1 AS is_active FROM nation")
def form_location(spark, d):
    active = F.when(C("n_nationkey") % 3 == 0, True).when(C("n_nationkey") % 3 == 1, False)
    rows = read(spark, d, "nation").select("n_nationkey", F.when(C("n_nationkey") % 4 != 0, C("n_name")).alias("name"), F.concat(F.lit("B"), "n_nationkey").alias("branch_code"), active.alias("is_active"))
    return forms.project(rows, "location", "n_nationkey")


@query("SELECT id, coalesce(name, id) AS name, CAST(NULL AS STRING) AS color FROM (SELECT DISTINCT 'T-' || p_brand AS id, CASE WHEN p_brand LIKE '%3' THEN NULL ELSE p_brand END AS name FROM part) t")
def form_tag(spark, d):
    raw = read(spark, d, "part").select(F.concat(F.lit("T-"), "p_brand").alias("id"), F.when(~C("p_brand").endswith("3"), F.concat(C("p_brand"), F.lit("  "))).otherwise(" ").alias("name")).distinct()
    return forms.project(forms.canonical_named(raw).withColumnRenamed("source_object_id", "id"), "tag", "id")


@query("SELECT CAST(r_regionkey AS STRING) AS id, r_name AS name, true AS is_active FROM region")
def form_pipeline(spark, d):
    raw = read(spark, d, "region").select(C("r_regionkey").cast("string").alias("id"), C("r_name").alias("name"))
    return forms.project(forms.canonical_named(raw).withColumnRenamed("source_object_id", "id"), "pipeline", "id")


@query("SELECT DISTINCT 'contact' AS entity_type, lower(p_type) AS key, replace(lower(p_type), '_', ' ') AS label, 'text' AS field_type, '[]' AS options FROM (SELECT replace(p_type, ' ', '_') AS p_type FROM part) t")
def form_custom_field(spark, d):
    raw = read(spark, d, "part").select(F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))).alias("key")).distinct()
    return forms.project(forms.canonical_custom_field(raw), "custom_field")


@query("SELECT id AS source_object_id, CASE WHEN starts_with(kind, 'image/') THEN 'image' ELSE 'document' END AS source_object_type, name AS file_name, kind AS mime_type, size AS size_bytes, url AS source_url, parent_type AS parent_entity_type, parent_id AS parent_source_id, "
       "CASE WHEN starts_with(kind, 'image/') THEN 'strip' END AS exif_retention FROM asset")
def canonical_asset(spark, d):
    raw = read(spark, d, "asset").withColumn("mime", C("kind"))
    return forms.canonical_file(raw).select("source_object_id", "source_object_type", "file_name", "mime_type", "size_bytes", "source_url", "parent_entity_type", "parent_source_id", "exif_retention")


ISSUES = "CASE WHEN id = '' THEN 'source_object_id;' ELSE '' END || CASE WHEN {0} IS NULL AND {1} IS NULL THEN 'contact_method;' ELSE '' END || CASE WHEN {2} IS NULL THEN 'source_created_at;' ELSE '' END".format(EMAIL, PHONE, DATE_OF.format("created"))


@query(f"SELECT k, {ISSUES} AS issues FROM raw_contact")
def validation_split(spark, d):
    """Contacts that meet all rules (no issues), and those that don't, from two tables that hold each contact once."""
    raw = read(spark, d, "full_contact").withColumn("custom", F.create_map().cast("map<string,string>"))
    canonical = forms.canonical_contact(raw.withColumn("id", F.concat_ws("|", "k", "id")))
    split = canonical.withColumn("k", F.split_part("source_object_id", F.lit("|"), F.lit(1)).cast("long")).withColumn("source_object_id", F.split_part("source_object_id", F.lit("|"), F.lit(2)))
    good, bad = forms.validated(split, {"source_object_id": C("source_object_id") != "", "contact_method": C("email").isNotNull() | C("phone").isNotNull(), "source_created_at": C("source_created_at").isNotNull()})
    return good.select("k", F.lit("").alias("issues")).unionByName(bad.select("k", F.concat(F.array_join("issues", ";"), F.lit(";")).alias("issues")))
