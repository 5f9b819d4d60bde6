"""Canonical forms of source records and destination forms of canonical ones, as projections over whole tables.

A destination form is a list of columns, each with its kind and the canonical field that it comes from;
project() turns it into one select. A field that the table lacks counts as null. Kinds:
text (empty is null), name (a text with a default), yes (true unless false), no (false unless true), number,
time, json (with a default where null), cents and currency of a money struct, ids made of other fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as n

# The columns of each destination form with kind, canonical field and default.
FORMS = {
    "account": [
        ("name", "name", "name", "Unnamed Account"), ("legal_name", "text", "legal_name", None), ("phone", "text", "phone", None), ("email", "text", "email", None),
        ("website", "text", "website", None), ("address_json", "json", "address", "null")],
    "location": [
        ("name", "name", "name", "Unnamed Location"), ("branch_code", "text", "branch_code", None), ("phone", "text", "phone", None), ("address_json", "json", "address", "null"),
        ("is_active", "yes", "is_active", None)],
    "user": [
        ("first_name", "text", "first_name", None), ("last_name", "text", "last_name", None), ("email", "text", "email", None), ("phone", "text", "phone", None), ("role", "text", "role", None),
        ("source_role", "text", "source_role", None), ("team", "text", "team", None), ("is_active", "yes", "is_active", None), ("is_historical", "no", "is_historical", None)],
    "tag": [("name", "name", "name", "untitled"), ("color", "text", "color", None)],
    "custom_field": [
        ("entity_type", "name", "entity_type", "contact"), ("key", "name", "key", "unknown"), ("label", "text", "label", None), ("field_type", "name", "field_type", "text"),
        ("options", "json", "options", "[]")],
    "pipeline": [("name", "name", "name", "Pipeline"), ("is_active", "yes", "is_active", None)],
    "pipeline_stage": [
        ("name", "name", "name", "Stage"), ("pipeline_id", "text", "pipeline_destination_id", None), ("position", "number", "position", 0), ("is_won", "no", "is_won", None),
        ("is_lost", "no", "is_lost", None)],
    "company": [
        ("name", "name", "name", "Unnamed Company"), ("phone", "text", "phone", None), ("email", "text", "email", None), ("website", "text", "website", None), ("address_json", "json", "address", "null"),
        ("assigned_user_id", "text", "assigned_user_destination_id", None)],
    "contact": [
        ("first_name", "text", "first_name", None), ("last_name", "text", "last_name", None), ("company_name", "text", "company_name", None), ("company_id", "text", "company_destination_id", None),
        ("email", "text", "email", None), ("phone", "text", "phone", None), ("secondary_emails", "json", "secondary_emails", "[]"), ("secondary_phones", "json", "secondary_phones", "[]"),
        ("address_json", "json", "address", "null"), ("lead_source", "text", "lead_source", None), ("assigned_user_id", "text", "assigned_user_destination_id", None), ("tags", "json", "tags", "[]"),
        ("custom_fields", "json", "custom_fields", "{}"), ("communication_prefs", "json", "communication_prefs", "{}"), ("normalized_email", "text", "normalized_email", None),
        ("normalized_phone", "text", "normalized_phone", None), ("normalized_name_key", "name_key", "", None), ("address_key", "address_key", "address", None),
        ("source_created_at", "time", "source_created_at", None), ("source_updated_at", "time", "source_updated_at", None)],
    "opportunity": [
        ("name", "text", "name", None), ("contact_id", "text", "contact_destination_id", None), ("pipeline_id", "text", "pipeline_destination_id", None), ("stage_id", "text", "stage_destination_id", None),
        ("status", "text", "status", None), ("value_cents", "cents", "value", None), ("currency", "currency", "value", "USD"), ("assigned_user_id", "text", "assigned_user_destination_id", None),
        ("lead_source", "text", "lead_source", None), ("lost_reason", "text", "lost_reason", None), ("closed_at", "time", "closed_at", None), ("source_created_at", "time", "source_created_at", None),
        ("source_updated_at", "time", "source_updated_at", None), ("custom_fields", "json", "custom_fields", "{}")],
    "job": [
        ("job_number", "text", "job_number", None), ("name", "text", "name", None), ("contact_id", "text", "contact_destination_id", None), ("opportunity_id", "text", "opportunity_destination_id", None),
        ("address_json", "json", "address", "null"), ("job_type", "text", "job_type", None), ("status", "text", "status", None), ("stage_id", "text", "stage_destination_id", None),
        ("value_cents", "cents", "value", None), ("currency", "currency", "value", "USD"), ("lead_source", "text", "lead_source", None), ("start_date", "time", "start_date", None),
        ("completion_date", "time", "completion_date", None), ("assigned_user_ids", "json", "assigned_user_destination_ids", "[]"), ("tags", "json", "tags", "[]"),
        ("custom_fields", "json", "custom_fields", "{}"), ("source_created_at", "time", "source_created_at", None), ("source_updated_at", "time", "source_updated_at", None)],
    "note": [
        ("parent_entity_type", "text", "parent_entity_type", None), ("parent_id", "text", "parent_destination_id", None), ("body", "text", "body", None), ("body_format", "name", "body_format", "text"),
        ("authored_at", "time", "authored_at", None), ("author_user_id", "text", "author_user_destination_id", None), ("author_source_name", "text", "author_source_name", None)],
    "activity": [
        ("parent_entity_type", "text", "parent_entity_type", None), ("parent_id", "text", "parent_destination_id", None), ("activity_type", "name", "activity_type", "other"), ("subject", "text", "subject", None),
        ("body", "text", "body", None), ("direction", "text", "direction", None), ("occurred_at", "time", "occurred_at", None), ("user_id", "text", "user_destination_id", None),
        ("author_source_name", "text", "author_source_name", None), ("metadata", "json", "metadata", "{}")],
    "task": [
        ("parent_entity_type", "text", "parent_entity_type", None), ("parent_id", "text", "parent_destination_id", None), ("title", "text", "title", None), ("description", "text", "description", None),
        ("status", "text", "status", None), ("due_at", "time", "due_at", None), ("completed_at", "time", "completed_at", None), ("assigned_user_id", "text", "assigned_user_destination_id", None)],
    "appointment": [
        ("parent_entity_type", "text", "parent_entity_type", None), ("parent_id", "text", "parent_destination_id", None), ("title", "text", "title", None), ("location", "text", "location", None),
        ("starts_at", "time", "starts_at", None), ("ends_at", "time", "ends_at", None), ("assigned_user_id", "text", "assigned_user_destination_id", None), ("status", "text", "status", None)],
}
TYPES = {"text": "string", "name": "string", "yes": "boolean", "no": "boolean", "number": "long", "time": "timestamp", "json": "string", "cents": "struct<amount_cents:bigint,currency:string>",
         "currency": "struct<amount_cents:bigint,currency:string>"}
ADDRESS = "struct<line1:string,line2:string,city:string,state:string,postal_code:string,country:string>"


def project(records: DataFrame, entity: str, *keep: str) -> DataFrame:
    """The destination form of canonical records of an entity, behind the columns in keep."""
    have = {c.lower() for c in records.columns}

    def get(name: str, kind: str) -> Column:
        return F.col(name) if name.lower() in have else F.lit(None).cast(TYPES.get(kind, "string"))

    out = []
    for column, kind, source, default in FORMS[entity]:
        value = get(source, kind)
        made = {
            "text": lambda: n.blank_null(value), "name": lambda: F.coalesce(n.blank_null(value), F.lit(default)), "yes": lambda: F.coalesce(value, F.lit(True)), "no": lambda: F.coalesce(value, F.lit(False)),
            "number": lambda: F.coalesce(value.cast("long"), F.lit(default)), "time": lambda: value.cast("timestamp"), "cents": lambda: value["amount_cents"],
            "json": lambda: F.coalesce(F.to_json(value, {"ignoreNullFields": "false"}) if source.lower() in have else F.lit(None).cast("string"), F.lit(default)),
            "currency": lambda: F.coalesce(n.blank_null(value["currency"]), F.lit(default)),
            "name_key": lambda: n.name_key(F.concat_ws(" ", n.blank_null(get("first_name", "text")), n.blank_null(get("last_name", "text")))),
            "address_key": lambda: n.address_key(value["line1"], value["postal_code"]) if source.lower() in have else F.lit(None).cast("string"),
        }[kind]()
        out.append(made.alias(column))
    return records.select(*keep, *out)


# Canonical forms: what each entity's raw record comes to. All take raw tables with the columns named in them.

def canonical_user(raw: DataFrame) -> DataFrame:
    """An inactive user stays, as a historical one."""
    active = F.col("active")
    return raw.select(
        F.col("id").alias("source_object_id"), n.text(F.col("first_name")).alias("first_name"), n.text(F.col("last_name")).alias("last_name"), n.email(F.col("email")).alias("email"),
        n.phone(F.col("phone")).alias("phone"), n.text(F.col("role")).alias("role"), n.text(F.col("role")).alias("source_role"), active.alias("is_active"), (~active).alias("is_historical"))


def canonical_named(raw: DataFrame) -> DataFrame:
    """Tags and pipelines: a record without a name is called by its id."""
    return raw.select(F.col("id").alias("source_object_id"), F.coalesce(n.text(F.col("name")), "id").alias("name"), F.lit(True).alias("is_active"))


def canonical_stage(raw: DataFrame) -> DataFrame:
    name = F.col("name")
    return raw.select(
        F.col("id").alias("source_object_id"), F.coalesce(n.text(name), "id").alias("name"), F.col("pipeline_id").alias("pipeline_source_id"), F.col("position").cast("long").alias("position"),
        F.coalesce(name.rlike("(?i)won|complete"), F.lit(False)).alias("is_won"), F.coalesce(name.rlike("(?i)lost"), F.lit(False)).alias("is_lost"))


def canonical_custom_field(raw: DataFrame) -> DataFrame:
    key = F.col("key")
    return raw.select(
        key.alias("source_object_id"), F.lit("contact").alias("entity_type"), key.alias("key"), F.replace(key, F.lit("_"), F.lit(" ")).alias("label"), F.lit("text").alias("field_type"),
        F.array().cast("array<string>").alias("options"))


def canonical_contact(raw: DataFrame) -> DataFrame:
    """First and last name come from the whole name where they lack; custom fields without a value go."""
    first, last = n.split_name(F.col("full_name"))
    email, phone = n.email(F.col("email")), n.phone(F.col("phone"))
    created = n.timestamp(F.col("created"))
    second = n.email(F.col("secondary_email"))
    warnings = F.array_compact(F.array(
        F.when(F.col("created").isNotNull() & created.isNull(), F.lit("INVALID_DATE")), F.when(email.isNull() & phone.isNull(), F.lit("NO_CONTACT_METHOD"))))
    return raw.select(
        F.col("id").alias("source_object_id"), F.coalesce(n.text(F.col("first_name")), first).alias("first_name"), F.coalesce(n.text(F.col("last_name")), last).alias("last_name"),
        email.alias("email"), phone.alias("phone"), F.array_compact(F.array(second)).alias("secondary_emails"), F.array().cast("array<string>").alias("secondary_phones"),
        n.address(F.col("street"), F.lit(None).cast("string"), F.col("city"), F.col("state"), F.col("zip"), F.col("country")).alias("address"), n.text(F.col("lead_source")).alias("lead_source"),
        n.tags(F.col("tags")).alias("tags"), F.col("user_id").alias("assigned_user_source_id"), n.clean_map(F.col("custom")).alias("custom_fields"), F.create_map().cast("map<string,string>").alias("communication_prefs"),
        email.alias("normalized_email"), phone.alias("normalized_phone"), created.alias("source_created_at"), n.timestamp(F.col("modified")).alias("source_updated_at"), warnings.alias("warnings"))


def canonical_job(raw: DataFrame) -> DataFrame:
    money = F.struct(n.cents(F.col("value")).alias("amount_cents"), F.lit("USD").alias("currency"))
    return raw.select(
        F.col("id").alias("source_object_id"), n.text(F.col("job_number")).alias("job_number"), n.text(F.col("name")).alias("name"), F.col("contact_id").alias("contact_source_id"),
        n.address(F.col("street"), F.lit(None).cast("string"), F.col("city"), F.col("state"), F.col("zip"), F.lit("USA")).alias("address"), n.text(F.col("job_type")).alias("job_type"),
        n.text(F.col("status")).alias("status"), money.alias("value"), F.col("user_ids").alias("assigned_user_source_ids"), n.timestamp(F.col("start")).alias("start_date"),
        n.timestamp(F.col("completed")).alias("completion_date"), n.text(F.col("lead_source")).alias("lead_source"), n.tags(F.col("tags")).alias("tags"),
        n.timestamp(F.col("created")).alias("source_created_at"), n.timestamp(F.col("modified")).alias("source_updated_at"),
        F.array_compact(F.array(F.when(n.blank_null(F.col("contact_id")).isNull(), F.lit("JOB_WITHOUT_CONTACT")))).alias("warnings"))


def canonical_note(raw: DataFrame) -> DataFrame:
    made = n.timestamp(F.col("created"))
    return raw.select(
        F.col("id").alias("source_object_id"), F.col("parent_type").alias("parent_entity_type"), F.col("parent_id").alias("parent_source_id"), n.text(F.col("body"), 65_535).alias("body"),
        n.body_format(F.col("body")).alias("body_format"), made.alias("authored_at"), F.col("author_user_id").alias("author_user_source_id"), n.text(F.col("author_name")).alias("author_source_name"),
        made.alias("source_created_at"), made.alias("source_updated_at"))


def canonical_file(raw: DataFrame) -> DataFrame:
    """Documents and images; an image has a size of its own and loses what its camera wrote."""
    image = F.col("mime").startswith("image/")
    return raw.select(
        F.col("id").alias("source_object_id"), F.when(image, "image").otherwise("document").alias("source_object_type"), F.col("name").alias("file_name"), F.col("name").alias("original_name"),
        F.col("mime").alias("mime_type"), F.col("size").cast("long").alias("size_bytes"), F.col("url").alias("source_url"), F.col("parent_type").alias("parent_entity_type"),
        F.col("parent_id").alias("parent_source_id"), F.col("kind").alias("kind"), F.when(image, "strip").alias("exif_retention"))


CANONICAL = {
    "user": canonical_user, "tag": canonical_named, "pipeline": canonical_named, "pipeline_stage": canonical_stage, "custom_field": canonical_custom_field, "contact": canonical_contact,
    "job": canonical_job, "note": canonical_note, "document": canonical_file, "image": canonical_file,
}


def validated(records: DataFrame, required: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Canonical records that meet all rules, and those that don't with their issues (an array of the rules' names). A
    rule that can't be decided is not met; one bad record spoils no other."""
    issues = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in required.items()]))
    marked = records.withColumn("issues", issues)
    return marked.where(F.size("issues") == 0).drop("issues"), marked.where(F.size("issues") > 0)
