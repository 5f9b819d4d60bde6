"""Queries of a whole move: normalising, projecting, matching, writing once, checking, planning."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import normalize as n
from ..operators import forms
from ..operators import idempotency as i
from ..operators import matching as m
from ..operators import records as r
from ..operators import sink
from ..sources import ledgers
from ..sources.folders import new_folder, written
from ..sources.inputs import read
from ..streaming import inbox
from .queries import CENTS, DATE_OF, EMAIL, FLIGHT, KEYED, NAME, PHONE, POSTAL, STATE, STREET, C, column, query

AS_OF = "2024-02-01 00:00:00"
DONE = "('CREATED', 'UPDATED', 'MERGED', 'SKIPPED', 'FAILED', 'UNSUPPORTED')"


def lit_time(text: str = AS_OF):
    return F.lit(text).cast("timestamp")


# Normalising

def packed(column, signs, rule, good):
    """SQL of a packed cell: its parts by a rule over x, those that are good, each once in the order of the first."""
    parts = f"SELECT unnest(regexp_split_to_array({column}, '{signs}')) AS x, unnest(range(len(regexp_split_to_array({column}, '{signs}')))) AS pos"
    return f"(SELECT string_agg(v, ';' ORDER BY pos) FROM (SELECT v, min(pos) AS pos FROM (SELECT {rule} AS v, pos FROM ({parts}) a) b WHERE {good} GROUP BY v) c)"


ONE_PHONE = PHONE.replace("phone", "x")
column("norm_emails", "raw_user", lambda: F.array_join(n.emails(C("emails")), ";"),
       packed("emails", "[;,|]", "regexp_replace(lower(trim(x)), '^mailto:', '')", r"regexp_matches(v, '^[^\s@,;]+@[^\s@,;]+\.[^\s@,;]+$')"))
column("norm_phones", "raw_user", lambda: F.array_join(n.phones(C("phones")), ";"),
       packed("phones", "[;,|/]", f"CASE WHEN NOT regexp_matches(regexp_replace(x, '\\D', '', 'g'), '^0*$') AND length(regexp_replace(x, '\\D', '', 'g')) BETWEEN 7 AND 15 THEN {ONE_PHONE} END", "v IS NOT NULL"))
column("norm_boolean", "raw_user", lambda: n.boolean(C("active_text")),
       "CASE WHEN lower(active_text) IN ('true', 't', 'yes', 'y', '1', 'on', 'active', 'enabled') THEN true "
       "WHEN lower(active_text) IN ('false', 'f', 'no', 'n', '0', 'off', 'inactive', 'disabled') THEN false END")
column("body_format", "raw_note", lambda: n.body_format(C("body")), "CASE WHEN regexp_matches(body, '(?is)<[a-z].*>') THEN 'html' WHEN body IS NOT NULL THEN 'text' END")
column("path_segment", "raw_file", lambda: n.segment(F.when(C("k") % 5 != 0, C("name"))),
       "CASE WHEN k % 5 = 0 THEN 'unknown' ELSE substr(regexp_replace(name, '[^A-Za-z0-9._-]', '_', 'g'), 1, 128) END")
column("asset_kind_reject", "asset", lambda: r.rejection(C("name"), C("size"), C("kind")),
       "CASE WHEN name LIKE '%.exe' THEN 'blocked_extension' WHEN kind <> '' AND NOT regexp_matches(kind, '^(image|video|audio|text|application)/') THEN 'blocked_kind' WHEN size = 0 THEN 'empty' END")
column("asset_integrity", "asset", lambda: r.integrity_level(C("sent_hash"), C("stored_hash"), C("size"), C("stored_size")),
       "CASE WHEN stored_hash = sent_hash THEN 'hash_verified' WHEN stored_hash IS NOT NULL THEN 'FAILED' WHEN stored_size IS NULL THEN 'unverified' WHEN stored_size = size THEN 'size_verified' ELSE 'FAILED' END")


@query("SELECT id, regexp_matches(lower(name), 'won|complete') AS won, lower(name) LIKE '%lost%' AS lost FROM raw_stage")
def stage_flags(spark, d):
    return read(spark, d, "raw_stage").select("id", C("name").rlike("(?i)won|complete").alias("won"), C("name").rlike("(?i)lost").alias("lost"))


@query("SELECT k, CASE WHEN token IS NULL THEN NULL ELSE '[REDACTED]' END AS token, CASE WHEN header LIKE 'Bearer %' THEN '[REDACTED]' ELSE header END AS header, author AS note FROM raw_note")
def redact_fields(spark, d):
    fields = n.redact(F.create_map(*[x for c in ("token", "header") for x in (F.lit(c), C(c))], F.lit("note"), C("author")))
    return read(spark, d, "raw_note").select("k", fields.alias("f")).select("k", *[C("f")[c].alias(c) for c in ("token", "header", "note")])


@query("SELECT k, CASE WHEN email IS NOT NULL AND trim(email) <> '' THEN 1 ELSE 0 END + CASE WHEN user_id IS NOT NULL THEN 1 ELSE 0 END AS fields FROM raw_contact")
def clean_custom(spark, d):
    custom = n.clean_map(F.create_map(F.lit("email"), C("email"), F.lit("owner"), C("user_id"), F.lit("none"), F.lit("")))
    return read(spark, d, "raw_contact").select("k", F.size(custom).alias("fields"))


@query("SELECT batch_id, upper(substr(entity, 1, 1)) || substr(entity, 2) || ' Batch ' || CASE WHEN number < 1000 THEN lpad(CAST(number AS STRING), 3, '0') ELSE CAST(number AS STRING) END AS label "
       "FROM (SELECT DISTINCT batch_id, entity, CAST(split_part(batch_id, '-', 2) AS BIGINT) AS number FROM ledger) t")
def batch_label(spark, d):
    number = F.split_part("batch_id", F.lit("-"), F.lit(2)).cast("long")
    return read(spark, d, "ledger").select("batch_id", "entity").distinct().select("batch_id", n.batch_label(C("entity"), number).alias("label"))


ADDRESS = "trim(street)"


@query(f"SELECT k, {ADDRESS} AS line1, {STATE} AS state, {POSTAL} AS postal_code FROM raw_contact")
def norm_address(spark, d):
    none = F.lit(None).cast("string")
    whole = n.address(C("street"), none, none, C("state"), C("zip"), C("country"))
    return read(spark, d, "raw_contact").select("k", whole.alias("a")).select("k", "a.line1", "a.state", "a.postal_code")


# Canonical and destination forms

CONTACT = f"SELECT id AS source_object_id, first_name, last_name, {EMAIL} AS email, {PHONE} AS phone, user_id AS owner, street AS line1, substr(zip, 1, 5) AS zip5 FROM raw_contact"


@query(CONTACT)
def canonical_contact(spark, d):
    return read(spark, d, "raw_contact").select(
        C("id").alias("source_object_id"), n.text(C("first_name")).alias("first_name"), n.text(C("last_name")).alias("last_name"), n.email(C("email")).alias("email"),
        n.phone(C("phone")).alias("phone"), C("user_id").alias("owner"), n.text(C("street")).alias("line1"), F.substring(n.postal(C("zip")), 1, 5).alias("zip5"))


JOB = f"SELECT id AS source_object_id, contact_id, status, {CENTS} AS amount_cents, 'USD' AS currency, created AS source_created_at FROM raw_job"


@query(JOB)
def canonical_job(spark, d):
    return read(spark, d, "raw_job").select(
        C("id").alias("source_object_id"), "contact_id", "status", n.cents(C("value")).alias("amount_cents"), F.lit("USD").alias("currency"), C("created").alias("source_created_at"))


@query("SELECT id AS source_object_id, parent_type, parent_id, body, author, CASE WHEN regexp_matches(body, '(?is)<[a-z].*>') THEN 'html' WHEN body IS NOT NULL THEN 'text' END AS body_format FROM raw_note")
def canonical_note(spark, d):
    return read(spark, d, "raw_note").select(C("id").alias("source_object_id"), "parent_type", "parent_id", "body", "author", n.body_format(C("body")).alias("body_format"))


@query("SELECT id AS source_object_id, first_name || ' ' || last_name AS name, CASE WHEN emails IS NOT NULL THEN concat('u', CAST(k AS STRING), '@mail.example') END AS email, active FROM raw_user")
def canonical_user(spark, d):
    return read(spark, d, "raw_user").select(
        C("id").alias("source_object_id"), F.concat_ws(" ", "first_name", "last_name").alias("name"), F.try_element_at(n.emails(C("emails")), F.lit(1)).alias("email"), "active")


@query("SELECT id AS source_object_id, regexp_replace(name, '[^A-Za-z0-9._-]', '_', 'g') AS name, lower(kind) AS mime, size, parent_type, parent_id FROM asset")
def canonical_file(spark, d):
    return read(spark, d, "asset").select(C("id").alias("source_object_id"), n.safe_name(C("name")).alias("name"), F.lower("kind").alias("mime"), "size", "parent_type", "parent_id")


@query(f"SELECT source_object_id, coalesce(first_name, 'Unnamed') AS first_name, coalesce(last_name, 'Contact') AS last_name, email, phone, "
       f"CASE WHEN owner IS NOT NULL THEN true ELSE false END AS has_owner FROM ({CONTACT}) t")
def to_dest_contact(spark, d):
    return canonical_contact(spark, d).select(
        "source_object_id", F.coalesce("first_name", F.lit("Unnamed")).alias("first_name"), F.coalesce("last_name", F.lit("Contact")).alias("last_name"), "email", "phone", C("owner").isNotNull().alias("has_owner"))


@query(f"SELECT source_object_id, contact_id, coalesce(status, 'UNKNOWN') AS status, coalesce(amount_cents, 0) AS value_cents, currency FROM ({JOB}) t")
def to_dest_job(spark, d):
    return canonical_job(spark, d).select("source_object_id", "contact_id", F.coalesce("status", F.lit("UNKNOWN")).alias("status"), F.coalesce("amount_cents", F.lit(0)).alias("value_cents"), "currency")


@query("SELECT id, CASE WHEN body LIKE '[2021-03-14 · Ana] %' OR created IS NULL THEN body ELSE '[' || strftime(created, '%Y-%m-%d') || coalesce(' · ' || author, '') || '] ' || body END AS body FROM raw_note")
def stamp_history(spark, d):
    return read(spark, d, "raw_note").select("id", i.stamp(C("body"), C("author"), C("created")).alias("body"))


to_dest_note = stamp_history


@query("SELECT id, CASE WHEN created IS NULL THEN NULL WHEN turn0 THEN 'own' ELSE strftime(created, '%Y-%m-%d') END AS original FROM (SELECT id, created, k % 10 = 0 AS turn0 FROM raw_note) t")
def mirror_date(spark, d):
    own = F.when(C("k") % 10 == 0, F.create_map(F.lit("migrated_original_date"), F.when(C("created").isNotNull(), "own"))).otherwise(F.create_map().cast("map<string,string>"))
    return read(spark, d, "raw_note").select("id", i.mirrored(own, C("created"))["migrated_original_date"].alias("original"))


@query("SELECT id, (CASE WHEN id = '' THEN 'id: required;' ELSE '' END) || (CASE WHEN email IS NULL AND phone IS NULL THEN 'contact: no method;' ELSE '' END) AS issues FROM raw_contact WHERE id = '' OR (email IS NULL AND phone IS NULL)")
def validate_contact(spark, d):
    issue = lambda cond, text: F.when(cond, F.lit(text)).otherwise("")
    issues = F.concat(issue(C("id") == "", "id: required;"), issue(n.email(C("email")).isNull() & n.phone(C("phone")).isNull(), "contact: no method;"))
    return read(spark, d, "raw_contact").select("id", issues.alias("issues")).where("issues <> ''")


@query("SELECT id, 'INVALID_DATE' AS code FROM raw_contact WHERE created IS NOT NULL AND " + DATE_OF.format("created") + " IS NULL UNION ALL SELECT id, 'NO_CONTACT_METHOD' FROM raw_contact WHERE email IS NULL AND phone IS NULL "
       "UNION ALL SELECT id, 'JOB_WITHOUT_CONTACT' FROM raw_job WHERE contact_id IS NULL")
def dq_warnings(spark, d):
    people = read(spark, d, "raw_contact").select("id", F.explode(F.array_compact(F.array(
        F.when(C("created").isNotNull() & n.timestamp(C("created")).isNull(), "INVALID_DATE"),
        F.when(n.email(C("email")).isNull() & n.phone(C("phone")).isNull(), "NO_CONTACT_METHOD")))).alias("code"))
    return people.unionByName(read(spark, d, "raw_job").where("contact_id is null").select("id", F.lit("JOB_WITHOUT_CONTACT").alias("code")))


@query("SELECT id, 'HISTORY_UNDATED' AS code FROM raw_note WHERE created IS NULL AND body NOT LIKE '[2021-03-14%' UNION ALL SELECT id, 'INVALID_DATE' FROM raw_contact WHERE created IS NOT NULL AND " + DATE_OF.format("created") + " IS NULL "
       "UNION ALL SELECT id, 'NO_CONTACT_METHOD' FROM raw_contact WHERE email IS NULL AND phone IS NULL UNION ALL SELECT id, 'JOB_WITHOUT_CONTACT' FROM raw_job WHERE contact_id IS NULL")
def all_warnings(spark, d):
    undated = read(spark, d, "raw_note").where(C("created").isNull() & ~C("body").rlike(i.STAMP)).select("id", F.lit("HISTORY_UNDATED").alias("code"))
    return undated.unionByName(dq_warnings(spark, d))


@query("SELECT code, count(*) AS n FROM (SELECT 'INVALID_DATE' AS code FROM raw_contact WHERE created IS NOT NULL AND " + DATE_OF.format("created") + " IS NULL UNION ALL SELECT 'NO_CONTACT_METHOD' FROM raw_contact WHERE email IS NULL AND phone IS NULL "
       "UNION ALL SELECT 'JOB_WITHOUT_CONTACT' FROM raw_job WHERE contact_id IS NULL UNION ALL SELECT 'HISTORY_UNDATED' FROM raw_note WHERE created IS NULL AND body NOT LIKE '[2021-03-14%') t GROUP BY code")
def warning_summary(spark, d):
    return all_warnings(spark, d).groupBy("code").agg(F.count("*").alias("n"))


STATUS = "CASE k % 9 WHEN 0 THEN 401 WHEN 1 THEN 403 WHEN 2 THEN 404 WHEN 3 THEN 409 WHEN 4 THEN 422 WHEN 5 THEN 429 WHEN 6 THEN 503 END"


CODE = ("CASE WHEN status = 401 THEN 'AUTHENTICATION_ERROR' WHEN status = 403 THEN 'PERMISSION_ERROR' WHEN status = 404 THEN 'SOURCE_NOT_FOUND' WHEN status = 409 THEN 'DUPLICATE_CONFLICT' "
        "WHEN status = 422 THEN 'VALIDATION_ERROR' WHEN status = 429 THEN 'RATE_LIMIT' WHEN status >= 500 THEN 'DESTINATION_API_ERROR' "
        "WHEN errno IN ('ETIMEDOUT', 'ECONNRESET', 'ECONNREFUSED', 'ENOTFOUND', 'EAI_AGAIN', 'UND_ERR_CONNECT_TIMEOUT') THEN 'SOURCE_TIMEOUT' ELSE 'UNKNOWN_ERROR' END")
RETRY = ", ".join(f"'{c}'" for c, again, _ in i.PROFILES if again)


@query(f"SELECT source_id, entity, code, code IN ({RETRY}) AS retryable FROM (SELECT source_id, entity, {CODE} AS code FROM (SELECT *, {STATUS} AS status, CASE WHEN k % 9 = 7 THEN 'ECONNRESET' ELSE 'EODD' END AS errno FROM ledger WHERE state = 'FAILED') a) b")
def classify_errors(spark, d):
    errno = F.when(C("k") % 9 == 7, "ECONNRESET").otherwise("EODD")
    code = i.classify(F.expr(STATUS), errno)
    return read(spark, d, "ledger").where("state = 'FAILED'").select("source_id", "entity", code.alias("code"), code.isin(i.RETRYABLE).alias("retryable"))


PROFILE_SQL = ", ".join(f"('{code}', {str(again).lower()}, {str(customer).lower()})" for code, again, customer in i.PROFILES)


@query(f"SELECT l.error_code, l.entity, count(*) AS n, coalesce(p.retryable, false) AS retryable, coalesce(p.customer, false) AS needs_customer FROM ledger l LEFT JOIN (SELECT * FROM (VALUES {PROFILE_SQL}) AS v(code, retryable, customer)) p "
       "ON l.error_code = p.code WHERE l.state = 'FAILED' GROUP BY ALL")
def error_profiles(spark, d):
    """Errors with what follows from their kind: whether to try again, and whether the customer must act."""
    table = F.broadcast(spark.createDataFrame(i.PROFILES, "error_code string, retryable boolean, customer boolean"))
    found = read(spark, d, "ledger").where("state = 'FAILED'").groupBy("error_code", "entity").agg(F.count("*").alias("n"))
    return found.join(table, "error_code", "left").select("error_code", "entity", "n", F.coalesce("retryable", F.lit(False)).alias("retryable"), F.coalesce("customer", F.lit(False)).alias("needs_customer"))


WRITERS = ", ".join(f"'{e}'" for e in forms.FORMS)


@query(f"SELECT migration_id, entity, CASE WHEN entity IN ({WRITERS}) THEN 'DISCOVERED' ELSE 'UNSUPPORTED' END AS state FROM selection")
def unsupported_entities(spark, d):
    """Records of entities that the destination has no form for are unsupported, all of them."""
    writers = F.broadcast(spark.createDataFrame([(e, True) for e in forms.FORMS], "entity string, writes boolean"))
    return read(spark, d, "selection").join(writers, "entity", "left").select("migration_id", "entity", F.when(C("writes"), "DISCOVERED").otherwise("UNSUPPORTED").alias("state"))


@query(f"SELECT l.source_id, l.entity, CASE WHEN l.entity IN ({WRITERS}) THEN l.state ELSE 'UNSUPPORTED' END AS state FROM ledger l")
def unsupported(spark, d):
    writers = F.broadcast(spark.createDataFrame([(e, True) for e in forms.FORMS], "entity string, writes boolean"))
    return read(spark, d, "ledger").join(writers, "entity", "left").select("source_id", "entity", F.when(C("writes"), C("state")).otherwise("UNSUPPORTED").alias("state"))


@query("SELECT source_id, entity, substr('error in ' || coalesce(error_code, '-') || repeat('.', 5000), 1, 4000) AS message FROM ledger WHERE state = 'FAILED'")
def error_ledger(spark, d):
    message = F.substring(F.concat(F.lit("error in "), F.coalesce("error_code", F.lit("-")), F.repeat(F.lit("."), F.lit(5000))), 1, 4000)
    return read(spark, d, "ledger").where("state = 'FAILED'").select("source_id", "entity", message.alias("message"))


@query("SELECT source_id, entity, error_code AS code, substr('error in ' || coalesce(error_code, '-') || repeat('.', 5000), 1, 4000) AS message, run_id FROM ledger, (VALUES ('first'), ('second')) v(run_id) WHERE state = 'FAILED' AND (run_id = 'first' OR open)")
def error_log(spark, d):
    """Errors of two runs in one ledger; the second run is written twice, as after a failure, and stands there once."""
    folder = new_folder(spark, "errors")
    message = F.concat(F.lit("error in "), F.coalesce("error_code", F.lit("-")), F.repeat(F.lit("."), F.lit(5000)))
    failed = read(spark, d, "ledger").where("state = 'FAILED'").select("source_id", "entity", C("error_code").alias("code"), message.alias("message"), "open")
    ledgers.append(failed, folder, "first")
    for _ in range(2):
        ledgers.append(failed.where("open"), folder, "second")
    return ledgers.read(spark, folder)


# Reading and landing

@query("SELECT id, 'contact' AS entity, sha256(coalesce(full_name, '')) AS digest, TIMESTAMP '2024-05-01 00:00:00' AS expires FROM raw_contact")
def land_raw(spark, d):
    return read(spark, d, "raw_contact").select(
        "id", F.lit("contact").alias("entity"), F.sha2(F.coalesce("full_name", F.lit("")), 256).alias("digest"), (lit_time() + F.expr("interval 90 days")).alias("expires"))


@query("SELECT source_id, entity, CASE WHEN expires < TIMESTAMP '2024-02-01 00:00:00' THEN NULL ELSE state END AS payload FROM ledger")
def purge_raw(spark, d):
    return read(spark, d, "ledger").select("source_id", "entity", F.when(~F.coalesce(C("expires") < lit_time(), F.lit(False)), C("state")).alias("payload"))


SINCE = "TIMESTAMP '1996-01-01 00:00:00'"


@query(f"SELECT id FROM (SELECT id, created, CASE WHEN k % 5 < 2 THEN created + INTERVAL '1' DAY * (k % 90) END AS modified, k % 5 = 1 AS bad FROM raw_job) t "
       f"WHERE (modified IS NOT NULL AND NOT bad AND modified > {SINCE}) OR (modified IS NULL AND created > {SINCE})")
def delta_scan_modified(spark, d):
    """A present but unreadable modification date does not fall back to the creation date."""
    changed = F.when(C("k") % 5 == 0, F.date_format(C("created") + F.make_dt_interval(C("k").cast("int") % 90), "yyyy-MM-dd HH:mm:ss")).when(C("k") % 5 == 1, "soon")
    seen = n.timestamp(F.coalesce(changed, F.date_format("created", "yyyy-MM-dd HH:mm:ss")))
    return read(spark, d, "raw_job").where(seen > lit_time("1996-01-01 00:00:00")).select("id")


@query("SELECT entity, count(*) AS n, entity <> 'note' AS supported FROM (SELECT 'contact' AS entity FROM raw_contact UNION ALL SELECT 'job' FROM raw_job UNION ALL SELECT 'note' FROM raw_note) t GROUP BY entity")
def discovery_counts(spark, d):
    scans = [read(spark, d, f"raw_{e}").select(F.lit(e).alias("entity")) for e in ("contact", "job", "note")]
    known = spark.createDataFrame([("contact", True), ("job", True)], "entity string, supported boolean")
    found = scans[0].unionByName(scans[1]).unionByName(scans[2]).groupBy("entity").agg(F.count("*").alias("n"))
    return found.join(F.broadcast(known), "entity", "left").select("entity", "n", F.coalesce("supported", F.lit(False)).alias("supported"))


# Joins

@query("SELECT o.id, c.destination_id AS contact, s.name AS stage FROM raw_opportunity o LEFT JOIN object_map c ON o.contact_id = c.source_id LEFT JOIN raw_stage s ON o.stage_id = s.id")
def resolve_opportunity(spark, d):
    out = r.resolve(read(spark, d, "raw_opportunity"), "contact_id", read(spark, d, "object_map"), "contact")
    return r.resolve(out, "stage_id", read(spark, d, "raw_stage"), "stage", "id", "name").select("id", "contact", "stage")


@query("SELECT o.id, string_agg(u.id || '!', ';' ORDER BY o.pos, u.id) AS users FROM (SELECT id, unnest(string_split(user_ids, ',')) AS u, unnest(range(len(string_split(user_ids, ',')))) AS pos FROM raw_opportunity) o "
       "LEFT JOIN raw_user u ON o.u = u.id GROUP BY o.id")
def resolve_assignees(spark, d):
    """Each list of ids is looked up once, and of users that share an id only their number is carried to the end."""
    deals = read(spark, d, "raw_opportunity").select("id", "user_ids")
    users = read(spark, d, "raw_user").groupBy(C("id").alias("u")).agg(F.count("*").cast("int").alias("n"))
    each = deals.select("user_ids").distinct().select("user_ids", F.posexplode(F.split("user_ids", ",")).alias("pos", "u")).join(users, "u")
    lists = written(each.groupBy("user_ids").agg(F.collect_list(F.struct("pos", "u", "n")).alias("some")), "lists")
    found = deals.join(lists, "user_ids", "left").groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("some"))).alias("all"))
    text = F.array_join(F.transform("all", lambda x: F.repeat(F.concat(F.lit(";"), x["u"], F.lit("!")), x["n"])), "")
    return found.select("id", F.when(F.size("all") > 0, F.substring(text, 2, 2**31 - 1)).alias("users"))


PARENT = "SELECT n.id, coalesce(j.id, c.destination_id) AS parent FROM {0} n LEFT JOIN raw_job j ON n.parent_type = 'job' AND n.parent_id = j.id LEFT JOIN object_map c ON n.parent_type = 'contact' AND n.parent_id = c.source_id"


def parents(spark, d, name):
    """(parent_type, parent_id) to the destination's id, over one table of both types."""
    known = read(spark, d, "raw_job").select(F.lit("job").alias("parent_type"), C("id").alias("parent_id"), C("id").alias("parent")).unionByName(
        read(spark, d, "object_map").select(F.lit("contact").alias("parent_type"), C("source_id").alias("parent_id"), C("destination_id").alias("parent")))
    return read(spark, d, name).join(known, ["parent_type", "parent_id"], "left")


@query(PARENT.format("raw_note"))
def resolve_note_parent(spark, d):
    return parents(spark, d, "raw_note").select("id", "parent")


@query(f"SELECT a.id, CASE WHEN t.parent IS NULL THEN 'FAILED' ELSE a.state END AS state, CASE WHEN t.parent IS NULL THEN 'DEPENDENCY_MISSING' END AS error_code FROM asset a JOIN ({PARENT.format('asset')}) t ON a.id = t.id")
def file_parent_check(spark, d):
    lost = C("parent").isNull()
    return parents(spark, d, "asset").select("id", F.when(lost, "FAILED").otherwise(C("state")).alias("state"), F.when(lost, "DEPENDENCY_MISSING").alias("error_code"))


@query("SELECT c.id FROM raw_contact c WHERE user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM raw_user u WHERE u.id = c.user_id)")
def missing_users(spark, d):
    users = read(spark, d, "raw_user").select(C("id").alias("user_id"))
    return read(spark, d, "raw_contact").where("user_id is not null").join(users, "user_id", "left_anti").select("id")


@query("SELECT l.source_id, l.entity, coalesce(o.state, l.state) AS state, coalesce(o.destination_id, l.destination_id) AS destination_id, l.attempt + CASE WHEN o.state IS NULL THEN 0 ELSE 1 END AS attempt "
       "FROM ledger l LEFT JOIN (SELECT * FROM outcome WHERE n = 0) o ON l.source_id = o.source_id AND l.entity = o.entity")
def apply_outcomes(spark, d):
    return i.apply_outcomes(read(spark, d, "ledger"), read(spark, d, "outcome"))


@query("SELECT m.migration_id, m.status, l.source_id, l.entity, l.state FROM ledger l JOIN (SELECT 'M' || CAST(migration_id AS STRING) AS migration_id, status FROM migration) m ON l.migration_id = m.migration_id "
       "WHERE l.source_id = 'J000007' OR l.destination_id = 'D-C000004' ORDER BY l.created DESC, l.source_id LIMIT 100")
def trace_record(spark, d):
    runs = read(spark, d, "migration").select(F.concat(F.lit("M"), "migration_id").alias("migration_id"), "status")
    found = read(spark, d, "ledger").where("source_id = 'J000007' or destination_id = 'D-C000004'")
    return found.join(runs, "migration_id").orderBy(C("created").desc(), "source_id").limit(100).select("migration_id", "status", "source_id", "entity", "state")


DISCOVERY = ("SELECT migration_id, entity, discovered, ledger, discovered - ledger AS variance, NOT selected OR discovered <= ledger AS passed, CASE WHEN selected THEN 'reconciled' ELSE 'not_selected' END AS status FROM "
             "(SELECT d.migration_id, d.entity, d.n AS discovered, coalesce(l.n, 0) AS ledger, NOT EXISTS (SELECT 1 FROM chosen c WHERE c.migration_id = d.migration_id) OR "
             "EXISTS (SELECT 1 FROM chosen c WHERE c.migration_id = d.migration_id AND c.entity = d.entity) AS selected FROM discovery d LEFT JOIN "
             "(SELECT migration_id, entity, count(*) AS n FROM ledger GROUP BY 1, 2) l ON d.migration_id = l.migration_id AND d.entity = l.entity WHERE d.n > 0 AND d.supported) t")


@query(DISCOVERY)
def discovery_recon(spark, d):
    """Supported entities only. What was not selected passes, whatever was left; a migration without a selection takes all."""
    keys = ["migration_id", "entity"]
    counts = read(spark, d, "ledger").groupBy(*keys).agg(F.count("*").alias("ledger"))
    chosen = read(spark, d, "chosen").select(*keys).distinct()
    some = chosen.select("migration_id").distinct().withColumn("some", F.lit(True))
    both = read(spark, d, "discovery").where("n > 0 and supported").join(counts, keys, "left").join(chosen.withColumn("own", F.lit(True)), keys, "left").join(some, "migration_id", "left")
    selected, ledger = C("some").isNull() | C("own").isNotNull(), F.coalesce("ledger", F.lit(0))
    return both.select(*keys, C("n").alias("discovered"), ledger.alias("ledger"), (C("n") - ledger).alias("variance"), (~selected | (C("n") <= ledger)).alias("passed"),
                       F.when(selected, "reconciled").otherwise("not_selected").alias("status"))


@query("SELECT vendor, event_key, k, again FROM (SELECT *, row_number() OVER (PARTITION BY vendor, event_key ORDER BY ts, k, again) AS n FROM raw_event WHERE event_key IS NOT NULL) t WHERE n = 1")
def dedupe_identity(spark, d):
    return r.collapse(read(spark, d, "raw_event").where("event_key is not null"), ["vendor", "event_key"], ["ts", "k", "again"]).select("vendor", "event_key", "k", "again")


@query("SELECT DISTINCT contact_id FROM raw_job j WHERE EXISTS (SELECT 1 FROM dest_contact c WHERE c.source_id = j.contact_id)")
def resolve_ids(spark, d):
    there = read(spark, d, "dest_contact").select(C("source_id").alias("contact_id"))
    return read(spark, d, "raw_job").join(there, "contact_id", "left_semi").select("contact_id").distinct()


@query(f"SELECT id, attempt FROM asset WHERE state IN ('DISCOVERED', 'QUEUED', 'FAILED') AND attempt < 5 AND (retry_at IS NULL OR retry_at <= TIMESTAMP '{AS_OF}')")
def files_pending(spark, d):
    due = C("retry_at").isNull() | (C("retry_at") <= lit_time())
    return read(spark, d, "asset").where(C("state").isin("DISCOVERED", "QUEUED", "FAILED") & (C("attempt") < 5) & due).select("id", "attempt")


@query(f"SELECT id, TIMESTAMP '{AS_OF}' + INTERVAL '30' SECOND * CASE least(attempt, 4) WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 ELSE 16 END AS retry_at FROM asset WHERE state = 'FAILED' AND attempt < 5")
def file_retry_at(spark, d):
    wait = F.make_dt_interval(secs=(F.lit(30) * F.pow(F.lit(2), F.least("attempt", F.lit(4)))))
    return read(spark, d, "asset").where("state = 'FAILED' and attempt < 5").select("id", (lit_time() + wait).alias("retry_at"))


# Matching

DEST = f"SELECT id, {EMAIL} AS e, {PHONE.replace(' ext', ' ext')} AS p, {NAME.format('full_name')} AS nk, {STREET} AS ak FROM dest_contact"
NEW = KEYED
TWO = (f"SELECT id, other, matched_on, 0.99 AS confidence FROM (SELECT x.id, y.id AS other, CASE WHEN x.e = y.e THEN 'email' ELSE 'phone' END AS matched_on, "
       f"row_number() OVER (PARTITION BY x.id ORDER BY CASE WHEN x.e = y.e THEN 0 ELSE 1 END, y.id) AS n FROM ({NEW}) x JOIN ({DEST}) y ON x.e = y.e OR x.p = y.p) t WHERE n = 1")
THREE = ("SELECT id, other, confidence FROM (SELECT x.id, y.id AS other, CASE WHEN x.ak = y.ak THEN 0.9 ELSE 0.85 END AS confidence, row_number() OVER (PARTITION BY x.id ORDER BY "
         f"CASE WHEN x.ak = y.ak THEN 0 ELSE 1 END, y.id) AS n FROM ({NEW}) x JOIN ({DEST}) y ON x.nk = y.nk AND length(x.nk) >= 3 AND (x.ak = y.ak OR right(x.p, 7) = right(y.p, 7)) "
         f"WHERE x.id NOT IN (SELECT id FROM ({TWO}) z)) t WHERE n = 1")


def keyed(df):
    return df.select("id", n.email(C("email")).alias("e"), n.phone(C("phone")).alias("p"), n.name_key(C("full_name")).alias("nk"), n.address_key(C("street"), C("zip")).alias("ak"))


def sides(spark, d):
    """All identified contacts and those at the destination, with their keys, written once: many steps read them. A small
    file of customers is one task, so that its rows are spread before their keys are made."""
    spread = lambda df: df.select("id", "email", "phone", "full_name", "street", "zip").repartition("id")
    return written(keyed(spread(read(spark, d, "raw_contact").where("id <> ''"))), "new-keys"), written(keyed(spread(read(spark, d, "dest_contact"))), "old-keys")


@query(TWO.replace("0.99", "CAST(0.99 AS DOUBLE)"))
def match_tier2(spark, d):
    return m.exact(*sides(spark, d))


@query(THREE.replace("THEN 0.9 ELSE 0.85", "THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.85 AS DOUBLE)"))
def match_tier3(spark, d):
    new, old = sides(spark, d)
    return m.combined(new.join(m.exact(new, old), "id", "left_anti"), old)


@query(None)
def match_tier4(spark, d):
    new, old = sides(spark, d)
    rest = new.join(m.exact(new, old), "id", "left_anti")
    return m.fuzzy(written(rest.join(m.combined(rest, old), "id", "left_anti"), "left"), old)


@query(None)
def match_actions(spark, d):
    return m.actions(*sides(spark, d))


@query(f"SELECT c.id, coalesce(CASE d.decision WHEN 'SKIP' THEN 'SKIPPED' ELSE d.decision END, CASE WHEN t.id IS NULL THEN 'CREATE_NEW' ELSE 'UPDATE_EXISTING' END) AS action, "
       f"CASE WHEN d.decision = 'MERGE' THEN d.target WHEN d.decision IS NULL THEN t.other END AS other FROM ({NEW}) c LEFT JOIN ({TWO}) t ON c.id = t.id LEFT JOIN (SELECT * FROM decision WHERE status = 'REVIEWED') d ON c.id = d.source_id")
def apply_decisions(spark, d):
    new, old = sides(spark, d)
    found = new.select("id").join(m.exact(new, old), "id", "left").withColumn("action", F.when(C("other").isNull(), "CREATE_NEW").otherwise("UPDATE_EXISTING"))
    return m.decide(found, read(spark, d, "decision"))


@query(None)
def decide_all(spark, d):
    """Reviewed decisions over all tiers, one row a contact."""
    return m.decide(m.actions(*sides(spark, d)).select("id", "action", "other"), read(spark, d, "decision"))


@query(None)
def review_queue(spark, d):
    queue = read(spark, d, "decision").where("status = 'OPEN'").select(C("source_id").alias("id"))
    return m.review_queue(m.actions(*sides(spark, d)), queue)


@query(f"SELECT block, count(*) AS n, count(*) > 1000 AS oversize FROM (SELECT id, 'e:' || e AS block FROM ({KEYED}) a UNION ALL SELECT id, 'p:' || p FROM ({KEYED}) a UNION ALL SELECT id, '7:' || right(p, 7) FROM ({KEYED}) a "
       f"UNION ALL SELECT id, 'n:' || nk || '|' || ak FROM ({KEYED}) a UNION ALL SELECT id, 'a:' || ak FROM ({KEYED}) a) t WHERE block IS NOT NULL GROUP BY block HAVING count(*) > 1")
def block_stats(spark, d):
    """Sizes of all blocks but those by sound, which the other engine has no function for."""
    return m.block_sizes(keyed(read(spark, d, "raw_contact").where("id <> ''"))).where(~C("block").startswith("s:"))


@query(f"SELECT source_id, confidence FROM (SELECT id AS source_id, confidence FROM ({TWO}) t) u ORDER BY confidence DESC, source_id LIMIT 500")
def top_candidates(spark, d):
    return m.exact(*sides(spark, d)).select(C("id").alias("source_id"), "confidence").orderBy(C("confidence").desc(), "source_id").limit(500)


# Writing once

HASHED = "sha256('{\"created\":' || CASE WHEN created IS NULL THEN 'null' ELSE '\"' || created || '\"' END || ',\"id\":\"' || id || '\"}')"


@query(f"SELECT id, {HASHED} AS hash FROM raw_contact")
def content_hash(spark, d):
    some = read(spark, d, "raw_contact").select("id", "created", F.lit("x").alias("migration_id"))
    return some.select("id", i.content_hash(some).alias("hash"))


def incoming(spark, d):
    some = read(spark, d, "raw_contact").where("id <> ''").select("id", "created")
    return some.select("id", F.concat(F.lit("mig_1:export:contact:"), "id").alias("key"), i.content_hash(some).alias("hash"))


def log(spark, d):
    now = incoming(spark, d).select("key", C("hash").alias("same"))
    return read(spark, d, "write_log").join(now, "key").select("key", C("destination_id").alias("old_id"), F.when(C("current"), C("same")).otherwise("old").alias("old_hash"))


# a contact of write_log was written by this migration; one of known_contact by another, under the same source identity;
# every eleventh sends the key of its neighbour
WRITES = ("SELECT c.k, c.id, 'mig_1:export:contact:' || CASE WHEN o.id IS NOT NULL THEN o.id ELSE c.id END AS key, o.id IS NOT NULL AS borrowed FROM (SELECT k, id FROM raw_contact WHERE id <> '') c "
          "LEFT JOIN (SELECT k, id FROM raw_contact WHERE id <> '' AND k % 4 = 0) o ON c.k % 11 = 5 AND o.k = c.k - 1")
OUTCOMES = ("SELECT x.k AS n, x.key, x.id AS source_id, CASE WHEN x.borrowed THEN m.destination_id WHEN w.key IS NULL THEN coalesce(m.destination_id, 'new-' || x.id) WHEN w.current THEN w.destination_id "
            "ELSE coalesce(m.destination_id, w.destination_id) END AS destination_id, CASE WHEN x.borrowed THEN CASE WHEN m.source_id IS NULL THEN 'FAILED' ELSE 'UPDATED' END WHEN w.current THEN 'CREATED' "
            "WHEN w.key IS NOT NULL OR m.source_id IS NOT NULL THEN 'UPDATED' ELSE 'CREATED' END AS status, NOT x.borrowed AND coalesce(w.current, false) AS replayed, "
            f"NOT (NOT x.borrowed AND coalesce(w.current, false)) AND NOT (x.borrowed AND m.source_id IS NULL) AS writes FROM ({WRITES}) x LEFT JOIN write_log w ON w.key = x.key LEFT JOIN known_contact m ON m.source_id = x.id")


def outcomes(spark, d):
    """What comes of writing all identified contacts, some under the key of their neighbour."""
    contacts = read(spark, d, "raw_contact").where("id <> ''")
    own = contacts.select("k", "id", "created")
    lender = contacts.where("k % 4 = 0").select((C("k") + 1).alias("k"), C("id").alias("lender"))
    hashed = own.select("k", "id", i.content_hash(own.select("id", "created")).alias("hash"))
    sent = hashed.join(lender, "k", "left").withColumn("lender", F.when(C("k") % 11 == 5, C("lender"))).select(
        C("k").alias("n"), F.concat(F.lit("mig_1:export:contact:"), F.coalesce("lender", "id")).alias("key"), F.lit("T1").alias("tenant"), F.lit("export").alias("platform"), C("id").alias("source_id"),
        "hash", F.concat(F.lit("new-"), "id").alias("new_id"))
    same = hashed.select(C("id").alias("source_id"), "hash")
    stored = read(spark, d, "write_log").join(same, "source_id")
    known = stored.select("key", "destination_id", F.lit("CREATED").alias("status"), F.when(C("current"), C("hash")).otherwise("old").alias("hash"))
    place = lambda df: df.select(F.lit("T1").alias("tenant"), F.lit("export").alias("platform"), "source_id", "destination_id")
    others = read(spark, d, "known_contact")
    written_here = read(spark, d, "write_log").join(others.select("source_id"), "source_id", "left_anti")
    return i.identity_upsert(sent, known, place(others).unionByName(place(written_here)))


@query(OUTCOMES)
def upsert_status(spark, d):
    return outcomes(spark, d)


@query(f"SELECT key, source_id, destination_id, status FROM ({OUTCOMES}) t WHERE replayed")
def idem_replay(spark, d):
    """What was written before, unchanged: its stored outcome."""
    return outcomes(spark, d).where("replayed").select("key", "source_id", "destination_id", "status")


@query(f"SELECT key, source_id, destination_id FROM ({OUTCOMES}) t WHERE status = 'UPDATED' AND NOT replayed")
def idem_delta(spark, d):
    return outcomes(spark, d).where("status = 'UPDATED' and not replayed").select("key", "source_id", "destination_id")


@query("SELECT c.id, CASE WHEN w.current THEN 'SKIPPED' ELSE 'WRITE' END AS state FROM raw_contact c LEFT JOIN write_log w ON w.source_id = c.id WHERE c.id <> ''")
def skip_unchanged(spark, d):
    both = incoming(spark, d).join(log(spark, d), "key", "left")
    return both.select("id", F.when((C("hash") == C("old_hash")) & C("old_id").isNotNull(), "SKIPPED").otherwise("WRITE").alias("state"))


@query("SELECT coalesce(m.source_id, o.source_id) AS source_id, coalesce(o.destination_id, m.destination_id) AS destination_id FROM object_map m FULL JOIN (SELECT source_id, destination_id FROM outcome WHERE n = 0) o ON m.source_id = o.source_id")
def object_map_upsert(spark, d):
    new = read(spark, d, "outcome").where("n = 0").select("source_id", C("destination_id").alias("new"))
    return read(spark, d, "object_map").join(new, "source_id", "full").select("source_id", F.coalesce("new", "destination_id").alias("destination_id"))


@query("SELECT id, CASE WHEN tenant <> 'T1' THEN 'FAILED' ELSE 'READY' END AS state FROM dest_contact")
def tenant_check(spark, d):
    return read(spark, d, "dest_contact").select("id", F.when(C("tenant") != "T1", "FAILED").otherwise("READY").alias("state"))


@query("SELECT source_id, 'missing' AS problem FROM ledger l WHERE state IN ('QUEUED', 'PROCESSING') AND NOT EXISTS (SELECT 1 FROM outcome o WHERE o.source_id = l.source_id) "
       "UNION ALL SELECT source_id, 'unexpected' FROM outcome o WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.source_id = o.source_id AND l.state IN ('QUEUED', 'PROCESSING'))")
def batch_completeness(spark, d):
    return i.completeness(read(spark, d, "ledger").where("state in ('QUEUED', 'PROCESSING')"), read(spark, d, "outcome"), "source_id")


@query("SELECT a.id, CASE WHEN a.k % 2 = 0 THEN 'old' ELSE a.state END AS state FROM asset a")
def register_files(spark, d):
    """Insert or ignore: what is registered already keeps its state."""
    all_files = read(spark, d, "asset")
    old = all_files.where("k % 2 = 0").select("id", F.lit("old").alias("was"))
    return all_files.join(old, "id", "left").select("id", F.coalesce("was", "state").alias("state"))


@query("SELECT 'bl_contact_' || substr(sha256('T1|export|contact|' || id), 1, 32) AS destination_id, id FROM raw_contact WHERE id <> ''")
def deterministic_id(spark, d):
    return read(spark, d, "raw_contact").where("id <> ''").select(i.destination_id("bl_contact", F.lit("T1"), F.lit("export"), F.lit("contact"), C("id")).alias("destination_id"), "id")


OWNED = ("SELECT coalesce(m.source_id, c.id) AS source_id, coalesce(m.destination_id, c.new_id) AS destination_id, CASE WHEN c.id IS NULL THEN 'old' ELSE c.email END AS email, CASE WHEN m.source_id IS NULL THEN 'M' || CAST(c.k % 9 AS STRING) ELSE 'M0' END AS created_by, "
         "CASE WHEN m.source_id IS NOT NULL AND c.id IS NOT NULL THEN 'M' || CAST(c.k % 9 AS STRING) END AS updated_by FROM known_contact m FULL JOIN (SELECT k, id, email, 'bl_contact_' || substr(sha256('T1|export|contact|' || id), 1, 32) AS new_id FROM raw_contact WHERE id <> '') c ON m.source_id = c.id")


@query(OWNED)
def upsert_owned(spark, d):
    """On a conflict the id and who created the record stay; the rest is replaced, with who did it."""
    current = read(spark, d, "known_contact").select("source_id", "destination_id", F.lit("old").alias("email"), F.lit("M0").alias("created_by"), F.lit(None).cast("string").alias("updated_by"))
    new = read(spark, d, "raw_contact").where("id <> ''").select(
        C("id").alias("source_id"), i.destination_id("bl_contact", F.lit("T1"), F.lit("export"), F.lit("contact"), C("id")).alias("destination_id"), "email", F.concat(F.lit("M"), C("k") % 9).alias("by"))
    return r.upsert_by(current, new, "source_id", ["destination_id"], "by")


@query(f"SELECT actor, CAST(sum(made) AS BIGINT) AS created, CAST(sum(1 - made) AS BIGINT) AS updated FROM (SELECT created_by AS actor, 1 AS made FROM ({OWNED}) a UNION ALL SELECT updated_by, 0 FROM ({OWNED}) b WHERE updated_by IS NOT NULL) t GROUP BY actor")
def dest_counts_by_migration(spark, d):
    """How many records of the destination's table each migration created, and how many it updated."""
    acts = F.array(F.struct(C("created_by").alias("actor"), F.lit(1).alias("made")), F.struct(C("updated_by").alias("actor"), F.lit(0).alias("made")))
    each = upsert_owned(spark, d).select(F.explode(acts).alias("a")).select("a.*").where("actor is not null")
    return each.groupBy("actor").agg(F.sum("made").alias("created"), F.sum(1 - C("made")).alias("updated"))


# Counting and checking

LEVEL = "CASE WHEN stored_hash = sent_hash THEN 'hash_verified' WHEN stored_hash IS NOT NULL THEN 'FAILED' WHEN stored_size IS NULL THEN 'unverified' WHEN stored_size = size THEN 'size_verified' ELSE 'FAILED' END"
FILES = ("count(*) AS discovered, count(*) FILTER (state = 'CREATED') AS uploaded, count(*) FILTER (state = 'FAILED') AS failed, count(*) FILTER (state = 'UNSUPPORTED') AS unsupported, "
         f"count(*) FILTER (state IN ('DISCOVERED', 'QUEUED', 'PROCESSING')) AS pending, count(*) FILTER ({LEVEL} = 'hash_verified') AS hash_verified, "
         f"count(*) FILTER ({LEVEL} = 'size_verified') AS size_verified, count(*) FILTER (state = 'CREATED' AND {LEVEL} = 'unverified') AS unverified")


def file_numbers(files):
    """Counts of (grouped) files by state, and by what their copies prove; unverified ones count once they are there."""
    level = r.integrity_level(C("sent_hash"), C("stored_hash"), C("size"), C("stored_size"))
    of = lambda cond, name: F.count_if(cond).alias(name)
    return files.agg(
        F.count("*").alias("discovered"), of(C("state") == "CREATED", "uploaded"), of(C("state") == "FAILED", "failed"), of(C("state") == "UNSUPPORTED", "unsupported"),
        of(C("state").isin(r.IN_FLIGHT), "pending"), of(level == "hash_verified", "hash_verified"), of(level == "size_verified", "size_verified"),
        of((C("state") == "CREATED") & (level == "unverified"), "unverified"))


@query(f"SELECT {FILES} FROM asset")
def file_counts(spark, d):
    return file_numbers(read(spark, d, "asset").groupBy())


@query(f"SELECT migration_id, {FILES} FROM asset GROUP BY migration_id")
def file_counts_by_migration(spark, d):
    return file_numbers(read(spark, d, "asset").groupBy("migration_id"))


@query("SELECT error_code, entity, count(*) AS n, bool_or(coalesce(error_code, '') IN ('RATE_LIMIT', 'SOURCE_TIMEOUT')) AS retryable FROM ledger WHERE state = 'FAILED' AND open GROUP BY error_code, entity")
def open_errors(spark, d):
    return read(spark, d, "ledger").where("state = 'FAILED' and open").groupBy("error_code", "entity").agg(
        F.count("*").alias("n"), F.bool_or(F.coalesce(C("error_code").isin(i.RETRYABLE), F.lit(False))).alias("retryable"))


@query("SELECT count(DISTINCT id) AS n FROM raw_job WHERE contact_id IS NULL")
def contactless_at_source(spark, d):
    return read(spark, d, "raw_job").where("contact_id is null").agg(F.count_distinct("id").alias("n"))


@query("SELECT entity, migration_id, count(*) FILTER (state = 'CREATED') AS created, count(*) FILTER (state = 'UPDATED') AS updated FROM ledger GROUP BY entity, migration_id")
def dest_counts(spark, d):
    return read(spark, d, "ledger").groupBy("entity", "migration_id").agg(F.count_if(C("state") == "CREATED").alias("created"), F.count_if(C("state") == "UPDATED").alias("updated"))


@query("SELECT batch_id, count(*) AS n, count(*) FILTER (state = 'FAILED') AS failed, CASE WHEN count(*) FILTER (state = 'FAILED') > 0 THEN 'COMPLETED_WITH_ERRORS' ELSE 'COMPLETED' END AS status FROM ledger GROUP BY batch_id")
def batch_stats(spark, d):
    failed = F.count_if(C("state") == "FAILED")
    return read(spark, d, "ledger").groupBy("batch_id").agg(
        F.count("*").alias("n"), failed.alias("failed"), F.when(failed > 0, "COMPLETED_WITH_ERRORS").otherwise("COMPLETED").alias("status"))


# Bounds of the duration buckets, in milliseconds.
BUCKETS = [50, 250, 1_000, 5_000, 30_000, 120_000, 600_000, 3_600_000]
RUNS = "SELECT event_type, epoch_ms(max(ts)) - epoch_ms(min(ts)) AS ms FROM events GROUP BY event_type, user_id, date_trunc('hour', ts)"


@query(f"SELECT event_type, {', '.join(f'count(*) FILTER (ms <= {b}) AS le_{b}' for b in BUCKETS)}, count(*) AS n FROM ({RUNS}) t GROUP BY event_type")
def duration_histogram(spark, d):
    """A user's events of one kind within an hour are a run, from its first to its last."""
    ms = F.unix_millis(F.max("ts").cast("timestamp")) - F.unix_millis(F.min("ts").cast("timestamp"))
    runs = read(spark, d, "events").groupBy("event_type", "user_id", F.date_trunc("hour", "ts").alias("hour")).agg(ms.alias("ms"))
    return runs.groupBy("event_type").agg(*[F.count_if(C("ms") <= b).alias(f"le_{b}") for b in BUCKETS], F.count("*").alias("n"))


@query(f"SELECT migration_id, CAST(floor(count(*) FILTER (state IN {DONE}) * 100.0 / count(*) + 0.5) AS BIGINT) AS percent FROM ledger GROUP BY migration_id")
def progress(spark, d):
    share = F.count_if(C("state").isin(r.ACCOUNTED)) * 100.0 / F.count("*")
    return read(spark, d, "ledger").groupBy("migration_id").agg(F.floor(share + 0.5).cast("long").alias("percent"))


TOTAL = ("SELECT migration_id, count(*) AS discovered, " + ", ".join(f"count(*) FILTER (state = '{s}') AS {s.lower()}" for s in r.ACCOUNTED) + f", {FLIGHT} FROM ledger GROUP BY migration_id")


@query(f"SELECT coalesce(migration_id, 'all') AS migration_id, CAST(sum(discovered) AS BIGINT) AS discovered, {', '.join(f'CAST(sum({s.lower()}) AS BIGINT) AS {s.lower()}' for s in r.ACCOUNTED)} FROM ({TOTAL}) t GROUP BY ROLLUP (migration_id)")
def grand_totals(spark, d):
    names = ["discovered", *map(str.lower, r.ACCOUNTED)]
    rolled = r.state_counts(read(spark, d, "ledger"), "migration_id").rollup("migration_id").agg(*[F.sum(c).alias(c) for c in names])
    return rolled.withColumn("migration_id", F.coalesce("migration_id", F.lit("all")))


@query(f"SELECT pending, discovered - uploaded - failed - unsupported AS variance, pending = 0 AND discovered = uploaded + failed + unsupported AS passed FROM (SELECT {FILES} FROM asset) t")
def recon_files(spark, d):
    variance = C("discovered") - C("uploaded") - C("failed") - C("unsupported")
    return file_counts(spark, d).select("pending", variance.alias("variance"), ((variance == 0) & (C("pending") == 0)).alias("passed"))


LOST_JOB = "SELECT j.k FROM raw_job j WHERE NOT EXISTS (SELECT 1 FROM raw_contact c WHERE c.id = j.contact_id)"
IDLE = "SELECT c.k FROM raw_contact c WHERE NOT EXISTS (SELECT 1 FROM raw_job j WHERE j.contact_id = c.id)"
NO_USER = "SELECT c.k FROM raw_contact c WHERE user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM raw_user u WHERE u.id = c.user_id)"
LOST_FILE = f"SELECT a.k FROM asset a JOIN ({PARENT.format('asset')}) t ON a.id = t.id WHERE t.parent IS NULL"
CHECKS = {
    "jobs_without_contact": LOST_JOB, "opportunities_without_pipeline": "SELECT k FROM raw_opportunity WHERE pipeline_id IS NULL", "jobs_without_user": "SELECT k FROM raw_job WHERE user_ids = ''",
    "files_without_parent": LOST_FILE, "idle_contacts": IDLE, "missing_users": NO_USER, "contactless": "SELECT k FROM raw_job WHERE contact_id IS NULL"}
FOUND = " UNION ALL ".join(f"SELECT '{name}' AS what, 'M' || CAST(k % 9 AS STRING) AS migration_id FROM ({sql}) x{n}" for n, (name, sql) in enumerate(CHECKS.items()))
PER_CHECK = ", ".join(f"count(*) FILTER (what = '{name}') AS {name}" for name in CHECKS)
INTEGRITY = f"SELECT {PER_CHECK} FROM ({FOUND}) f"


def broken(spark, d):
    """what, migration_id of every record that a check of relationships finds."""
    jobs, contacts = read(spark, d, "raw_job"), read(spark, d, "raw_contact")
    users = read(spark, d, "raw_user").select(C("id").alias("user_id"))
    found = {
        "jobs_without_contact": jobs.join(contacts.select(C("id").alias("contact_id")), "contact_id", "left_anti"),
        "opportunities_without_pipeline": read(spark, d, "raw_opportunity").where("pipeline_id is null"),
        "jobs_without_user": jobs.where("user_ids = ''"),
        "files_without_parent": parents(spark, d, "asset").where("parent is null"),
        "idle_contacts": contacts.join(jobs.select(C("contact_id").alias("id")), "id", "left_anti"),
        "missing_users": contacts.where("user_id is not null").join(users, "user_id", "left_anti"),
        "contactless": jobs.where("contact_id is null"),
    }
    out = None
    for name, df in found.items():
        rows = df.select(F.lit(name).alias("what"), F.concat(F.lit("M"), C("k") % 9).alias("migration_id"))
        out = rows if out is None else out.unionByName(rows)
    return out


def per_check(found):
    return found.agg(*[F.count_if(C("what") == name).alias(name) for name in CHECKS])


def integrity_row(spark, d):
    return per_check(broken(spark, d).groupBy())


@query(INTEGRITY)
def relationship_integrity(spark, d):
    return integrity_row(spark, d)


@query(f"SELECT migration_id, {PER_CHECK} FROM ({FOUND}) f GROUP BY migration_id")
def integrity_by_migration(spark, d):
    return per_check(broken(spark, d).groupBy("migration_id"))


ORPHANS = f"SELECT greatest(0, jobs_without_contact - contactless) AS orphaned, jobs_without_contact <= contactless AND files_without_parent = 0 AND missing_users = 0 AS passed FROM ({INTEGRITY}) t"


@query(ORPHANS)
def orphans_by_migration(spark, d):
    lost = F.greatest(F.lit(0), C("jobs_without_contact") - C("contactless"))
    return integrity_row(spark, d).select(lost.alias("orphaned"), ((lost == 0) & (C("files_without_parent") == 0) & (C("missing_users") == 0)).alias("passed"))


LEFT = f"SELECT migration_id, {FLIGHT}, count(*) FILTER (state = 'FAILED' AND open) AS open_errors FROM ledger GROUP BY migration_id"


def left_over(spark, d):
    return read(spark, d, "ledger").groupBy("migration_id").agg(
        F.count_if(C("state").isin(r.IN_FLIGHT)).alias("in_flight"), F.count_if((C("state") == "FAILED") & C("open")).alias("open_errors"))


COUNTED = f"SELECT migration_id, entity, count(*) AS discovered, count(*) FILTER (state IN {DONE}) AS accounted, {FLIGHT} FROM ledger GROUP BY migration_id, entity"
PER_FILES = f"SELECT migration_id, {FILES} FROM asset GROUP BY migration_id"
PER_LINKS = f"SELECT *, greatest(0, jobs_without_contact - contactless) AS orphaned FROM (SELECT migration_id, {PER_CHECK} FROM ({FOUND}) f GROUP BY migration_id) t"
REASONS = (f"SELECT migration_id, 'counts' AS step, entity || ': ' || discovered || ' discovered, ' || accounted || ' accounted for, ' || in_flight || ' in flight' AS reason FROM ({COUNTED}) t WHERE discovered <> accounted "
           f"UNION ALL SELECT migration_id, 'discovery', entity || ': discovery found ' || discovered || ', extracted ' || ledger FROM ({DISCOVERY}) t WHERE NOT passed "
           f"UNION ALL SELECT migration_id, 'files', discovered || ' files, ' || uploaded || ' uploaded, ' || failed || ' failed, ' || unsupported || ' unsupported, ' || pending || ' pending' FROM ({PER_FILES}) t "
           "WHERE pending > 0 OR discovered <> uploaded + failed + unsupported "
           f"UNION ALL SELECT migration_id, 'relationships', orphaned || ' jobs lost their contact, ' || files_without_parent || ' files without parent, ' || missing_users || ' contacts of missing users' FROM ({PER_LINKS}) t "
           "WHERE orphaned > 0 OR files_without_parent > 0 OR missing_users > 0")


@query(REASONS)
def blocking_reasons(spark, d):
    """What keeps a migration from completing: of counts, discovery, files and relationships."""
    text = lambda *parts: F.concat(*[C(p[1:]) if p.startswith("=") else F.lit(p) for p in parts])
    row = lambda df, step, reason: df.select("migration_id", F.lit(step).alias("step"), reason.alias("reason"))
    counts, files, links = counted(spark, d), file_counts_by_migration(spark, d), linked(spark, d)
    return (
        row(counts.where("discovered <> accounted"), "counts", text("=entity", ": ", "=discovered", " discovered, ", "=accounted", " accounted for, ", "=in_flight", " in flight"))
        .unionByName(row(discovery_recon(spark, d).where("not passed"), "discovery", text("=entity", ": discovery found ", "=discovered", ", extracted ", "=ledger")))
        .unionByName(row(files.where("pending > 0 or discovered <> uploaded + failed + unsupported"), "files", text(
            "=discovered", " files, ", "=uploaded", " uploaded, ", "=failed", " failed, ", "=unsupported", " unsupported, ", "=pending", " pending")))
        .unionByName(row(links.where("orphaned > 0 or files_without_parent > 0 or missing_users > 0"), "relationships", text(
            "=orphaned", " jobs lost their contact, ", "=files_without_parent", " files without parent, ", "=missing_users", " contacts of missing users"))))


def counted(spark, d):
    of = lambda states, name: F.count_if(C("state").isin(states)).alias(name)
    return read(spark, d, "ledger").groupBy("migration_id", "entity").agg(F.count("*").alias("discovered"), of(r.ACCOUNTED, "accounted"), of(r.IN_FLIGHT, "in_flight"))


def linked(spark, d):
    return integrity_by_migration(spark, d).withColumn("orphaned", F.greatest(F.lit(0), C("jobs_without_contact") - C("contactless")))


STEPS = (f"SELECT migration_id, 'object_count_reconciliation' AS step, entity, discovered = accounted AS passed FROM ({COUNTED}) t "
         f"UNION ALL SELECT migration_id, 'discovery_reconciliation', entity, passed FROM ({DISCOVERY}) t "
         f"UNION ALL SELECT migration_id, 'file_reconciliation', NULL, pending = 0 AND discovered = uploaded + failed + unsupported FROM ({PER_FILES}) t "
         f"UNION ALL SELECT migration_id, 'relationship_reconciliation', NULL, orphaned = 0 AND files_without_parent = 0 AND missing_users = 0 FROM ({PER_LINKS}) t "
         "UNION ALL SELECT DISTINCT migration_id, 'duplicate_detection', NULL, true FROM ledger "
         f"UNION ALL SELECT migration_id, 'error_review', NULL, open_errors = 0 FROM ({LEFT}) t")


@query(STEPS)
def validation_results(spark, d):
    """The six steps of a migration's validation; duplicates are reported and never fail."""
    none = F.lit(None).cast("string")
    row = lambda df, step, entity, passed: df.select("migration_id", F.lit(step).alias("step"), entity.alias("entity"), passed.alias("passed"))
    runs = read(spark, d, "ledger").select("migration_id").distinct()
    return (
        row(counted(spark, d), "object_count_reconciliation", C("entity"), C("discovered") == C("accounted"))
        .unionByName(row(discovery_recon(spark, d), "discovery_reconciliation", C("entity"), C("passed")))
        .unionByName(row(file_counts_by_migration(spark, d), "file_reconciliation", none, F.expr("pending = 0 and discovered = uploaded + failed + unsupported")))
        .unionByName(row(linked(spark, d), "relationship_reconciliation", none, F.expr("orphaned = 0 and files_without_parent = 0 and missing_users = 0")))
        .unionByName(row(runs, "duplicate_detection", none, F.lit(True))).unionByName(row(left_over(spark, d), "error_review", none, C("open_errors") == 0)))


@query(f"SELECT l.migration_id, CASE WHEN EXISTS (SELECT 1 FROM ({REASONS}) x WHERE x.migration_id = l.migration_id) THEN 'WAITING_FOR_REVIEW' WHEN l.open_errors = 0 AND "
       f"NOT EXISTS (SELECT 1 FROM decision q WHERE q.status = 'OPEN' AND q.migration_id = l.migration_id) THEN 'COMPLETED' ELSE 'COMPLETED_WITH_WARNINGS' END AS state FROM ({LEFT}) l")
def completion_state(spark, d):
    """Completed without blocking reasons: with warnings where errors are open or duplicates wait for a decision."""
    blocked = blocking_reasons(spark, d).select("migration_id").distinct().withColumn("blocked", F.lit(True))
    waiting = read(spark, d, "decision").where("status = 'OPEN'").select("migration_id").distinct().withColumn("waiting", F.lit(True))
    both = left_over(spark, d).join(blocked, "migration_id", "left").join(waiting, "migration_id", "left")
    clean = (C("open_errors") == 0) & C("waiting").isNull()
    return both.select("migration_id", F.when(C("blocked").isNotNull(), "WAITING_FOR_REVIEW").when(clean, "COMPLETED").otherwise("COMPLETED_WITH_WARNINGS").alias("state"))


@query("SELECT 'CREATED_DATE_IS_MIGRATION_DATE' AS code, count(*) AS affected FROM ledger WHERE state IN ('CREATED', 'UPDATED', 'MERGED', 'SKIPPED') HAVING count(*) > 0 UNION ALL SELECT 'HISTORY_UNDATED', count(*) FROM raw_note "
       "WHERE created IS NULL AND body NOT LIKE '[2021-03-14%' HAVING count(*) > 0 UNION ALL SELECT 'FILE_INTEGRITY_PARTIAL', size_verified + unverified FROM (" + f"SELECT {FILES} FROM asset) t WHERE size_verified + unverified > 0")
def disclosures(spark, d):
    count = lambda df, code: df.agg(F.lit(code).alias("code"), F.count("*").alias("affected"))
    found = count(read(spark, d, "ledger").where(C("state").isin("CREATED", "UPDATED", "MERGED", "SKIPPED")), "CREATED_DATE_IS_MIGRATION_DATE").unionByName(
        count(read(spark, d, "raw_note").where(C("created").isNull() & ~C("body").rlike(i.STAMP)), "HISTORY_UNDATED")).unionByName(
        file_counts(spark, d).select(F.lit("FILE_INTEGRITY_PARTIAL").alias("code"), (C("size_verified") + C("unverified")).alias("affected")))
    return found.where("affected > 0")


@query(None)
def manifest(spark, d):
    """One row of nested results for the report."""
    rows = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
    return rows(grand_totals(spark, d), "totals").join(rows(disclosures(spark, d), "disclosures")).join(rows(file_counts(spark, d), "files"))


WAITING = "SELECT migration_id, count(*) AS n FROM decision WHERE status = 'OPEN' GROUP BY migration_id"
OUTSTANDING = (f"SELECT migration_id, step || ': ' || reason AS action FROM ({REASONS}) a UNION ALL SELECT migration_id, n || ' possible duplicates are held for review' FROM ({WAITING}) b "
               f"UNION ALL SELECT migration_id, failed || ' records failed and can be retried' FROM ({TOTAL}) c WHERE failed > 0 UNION ALL SELECT migration_id, failed || ' files failed and can be retried' FROM ({PER_FILES}) d WHERE failed > 0")


@query(OUTSTANDING)
def outstanding_actions(spark, d):
    """What is left to do for each migration."""
    row = lambda df, *text: df.select("migration_id", F.concat(*[C(t[1:]) if t.startswith("=") else F.lit(t) for t in text]).alias("action"))
    waiting = read(spark, d, "decision").where("status = 'OPEN'").groupBy("migration_id").agg(F.count("*").alias("n"))
    failed = r.state_counts(read(spark, d, "ledger"), "migration_id").where("failed > 0")
    return (
        row(blocking_reasons(spark, d), "=step", ": ", "=reason").unionByName(row(waiting, "=n", " possible duplicates are held for review"))
        .unionByName(row(failed, "=failed", " records failed and can be retried"))
        .unionByName(row(file_counts_by_migration(spark, d).where("failed > 0"), "=failed", " files failed and can be retried")))


@query(f"SELECT t.migration_id, t.discovered, t.created + t.updated + t.merged + t.skipped AS in_destination, e.entities, coalesce(f.uploaded, 0) AS files_uploaded, coalesce(f.size_verified + f.unverified, 0) AS files_partly_verified, coalesce(o.actions, 0) AS actions, "
       f"NOT EXISTS (SELECT 1 FROM ({REASONS}) x WHERE x.migration_id = t.migration_id) AS passed FROM ({TOTAL}) t JOIN (SELECT migration_id, string_agg(entity || '=' || n, ',' ORDER BY entity) AS entities FROM "
       f"(SELECT migration_id, entity, count(*) AS n FROM ledger GROUP BY 1, 2) y GROUP BY 1) e ON e.migration_id = t.migration_id LEFT JOIN ({PER_FILES}) f ON f.migration_id = t.migration_id LEFT JOIN (SELECT migration_id, count(*) AS actions FROM ({OUTSTANDING}) z GROUP BY 1) o ON o.migration_id = t.migration_id")
def manifests(spark, d):
    """A row for each migration: totals, entities (of which there are few), files, actions left, and whether it passed."""
    totals = r.state_counts(read(spark, d, "ledger"), "migration_id")
    lines = read(spark, d, "ledger").groupBy("migration_id", "entity").agg(F.count("*").alias("n")).groupBy("migration_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat("entity", F.lit("="), "n"))), ",").alias("entities"))
    files = file_counts_by_migration(spark, d).select("migration_id", C("uploaded").alias("files_uploaded"), (C("size_verified") + C("unverified")).alias("files_partly_verified"))
    left = outstanding_actions(spark, d).groupBy("migration_id").agg(F.count("*").alias("actions"))
    blocked = blocking_reasons(spark, d).select("migration_id").distinct().withColumn("blocked", F.lit(True))
    whole = totals.join(lines, "migration_id").join(files, "migration_id", "left").join(left, "migration_id", "left").join(blocked, "migration_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return whole.select(
        "migration_id", "discovered", (C("created") + C("updated") + C("merged") + C("skipped")).alias("in_destination"), "entities", zero("files_uploaded"), zero("files_partly_verified"), zero("actions"), C("blocked").isNull().alias("passed"))


@query(f"SELECT t.migration_id, t.discovered, t.in_flight, l.open_errors FROM ({TOTAL}) t JOIN ({LEFT}) l ON t.migration_id = l.migration_id")
def status_panel(spark, d):
    return r.state_counts(read(spark, d, "ledger"), "migration_id").select("migration_id", "discovered").join(left_over(spark, d), "migration_id").select("migration_id", "discovered", "in_flight", "open_errors")


@query(f"SELECT t.migration_id, t.discovered, t.in_flight, l.open_errors, f.pending AS files_pending, f.failed AS files_failed, coalesce(w.n, 0) AS to_review, "
       f"CASE WHEN t.discovered = 0 THEN 0 ELSE CAST(floor((t.discovered - t.in_flight) * 100.0 / t.discovered + 0.5) AS BIGINT) END AS percent FROM ({TOTAL}) t JOIN ({LEFT}) l ON t.migration_id = l.migration_id "
       f"LEFT JOIN ({PER_FILES}) f ON f.migration_id = t.migration_id LEFT JOIN ({WAITING}) w ON w.migration_id = t.migration_id")
def status_panels(spark, d):
    """What a migration's panel shows: records, files, errors, reviews, progress."""
    counts = r.state_counts(read(spark, d, "ledger"), "migration_id").select("migration_id", "discovered", "in_flight")
    files = file_counts_by_migration(spark, d).select("migration_id", C("pending").alias("files_pending"), C("failed").alias("files_failed"))
    waiting = read(spark, d, "decision").where("status = 'OPEN'").groupBy("migration_id").agg(F.count("*").alias("to_review"))
    percent = F.when(C("discovered") > 0, F.floor((C("discovered") - C("in_flight")) * 100.0 / C("discovered") + 0.5)).otherwise(0).cast("long")
    whole = counts.join(left_over(spark, d).select("migration_id", "open_errors"), "migration_id").join(files, "migration_id", "left").join(waiting, "migration_id", "left")
    return whole.select("migration_id", "discovered", "in_flight", "open_errors", "files_pending", "files_failed", F.coalesce("to_review", F.lit(0)).alias("to_review"), percent.alias("percent"))


# Planning

SUPPORTED = "(SELECT s.migration_id, s.entity FROM selection s JOIN capability c ON c.entity = s.entity AND c.platform = CAST(s.migration_id % 5 AS STRING) AND c.level <> 'false')"


def supported(spark, d):
    """The entities chosen for each migration that its source can give, at least on conditions."""
    can = read(spark, d, "capability").where("level <> 'false'").select("platform", "entity")
    return read(spark, d, "selection").withColumn("platform", (C("migration_id") % 5).cast("string")).join(F.broadcast(can), ["platform", "entity"], "left_semi").select("migration_id", "entity")


@query(f"SELECT s.migration_id, s.entity, CAST(row_number() OVER (PARTITION BY s.migration_id ORDER BY p.ord) AS BIGINT) AS place FROM {SUPPORTED} s JOIN (SELECT DISTINCT entity, ord FROM entity_plan) p ON s.entity = p.entity")
def entity_sequence(spark, d):
    order = F.broadcast(read(spark, d, "entity_plan").select("entity", "ord").distinct())
    place = F.row_number().over(Window.partitionBy("migration_id").orderBy("ord")).cast("long")
    return supported(spark, d).join(order, "entity").select("migration_id", "entity", place.alias("place"))


GAPS = ("SELECT s.migration_id, s.entity, p.kind, p.dep FROM selection s JOIN entity_plan p ON s.entity = p.entity AND p.dep IS NOT NULL WHERE NOT EXISTS (SELECT 1 FROM selection w WHERE w.migration_id = s.migration_id AND w.entity = p.dep)")


@query(f"{GAPS} AND p.kind <> 'any' UNION ALL SELECT s.migration_id, s.entity, 'any', p.dep FROM selection s JOIN entity_plan p ON s.entity = p.entity AND p.kind = 'any' "
       "LEFT JOIN (SELECT DISTINCT w.migration_id, q.entity FROM selection w JOIN entity_plan q ON w.entity = q.dep AND q.kind = 'any') h ON h.migration_id = s.migration_id AND h.entity = s.entity WHERE h.entity IS NULL")
def missing_dependencies(spark, d):
    chosen = read(spark, d, "selection")
    needs = chosen.join(F.broadcast(read(spark, d, "entity_plan").where("dep is not null")), "entity").select("migration_id", "entity", "kind", "dep")
    has = chosen.select("migration_id", C("entity").alias("dep"), F.lit(True).alias("has"))
    known = needs.join(has, ["migration_id", "dep"], "left").withColumn("some", F.bool_or(F.coalesce("has", F.lit(False))).over(Window.partitionBy("migration_id", "entity", "kind")))
    lacks = F.when(C("kind") == "any", ~C("some")).otherwise(C("has").isNull())
    return known.where(lacks).select("migration_id", "entity", "kind", "dep")


@query("SELECT entity, string_agg(DISTINCT dep, ',' ORDER BY dep) AS deps, count(*) AS n FROM (SELECT DISTINCT s.migration_id, p.entity, p.dep FROM selection s JOIN entity_plan p ON s.entity = p.entity WHERE dep IS NOT NULL) t GROUP BY entity")
def depends_on(spark, d):
    deps = read(spark, d, "selection").join(F.broadcast(read(spark, d, "entity_plan").where("dep is not null")), "entity").select("migration_id", "entity", "dep").distinct()
    return deps.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_set("dep")), ",").alias("deps"), F.count("*").alias("n"))


@query(f"SELECT migration_id, entity FROM {SUPPORTED} s")
def selected_supported(spark, d):
    return supported(spark, d)


@query("SELECT migration_id, max(watermark_at) FILTER (status = 'COMPLETED') AS since, coalesce(max(number), 0) + 1 AS number, CASE WHEN count(*) FILTER (status = 'COMPLETED') = 0 THEN 'HISTORICAL' ELSE 'DELTA' END AS kind FROM migration_pass GROUP BY migration_id")
def next_pass(spark, d):
    done = C("status") == "COMPLETED"
    return read(spark, d, "migration_pass").groupBy("migration_id").agg(
        F.max(F.when(done, C("watermark_at"))).alias("since"), (F.coalesce(F.max("number"), F.lit(0)) + 1).alias("number"), F.when(F.count_if(done) == 0, "HISTORICAL").otherwise("DELTA").alias("kind"))


@query("SELECT migration_id, CAST(sum(discovered) AS BIGINT) AS discovered, CAST(sum(written) AS BIGINT) AS written, max(watermark_at) AS watermark FROM migration_pass WHERE status = 'COMPLETED' GROUP BY migration_id")
def pass_totals(spark, d):
    return read(spark, d, "migration_pass").where("status = 'COMPLETED'").groupBy("migration_id").agg(
        F.sum("discovered").alias("discovered"), F.sum("written").alias("written"), F.max("watermark_at").alias("watermark"))


ASKED = "SELECT migration_id, CASE migration_id % 3 WHEN 0 THEN 'HISTORICAL' WHEN 1 THEN 'DELTA' ELSE 'FINAL_DELTA' END AS kind, started_at AS at FROM migration"


@query(f"SELECT a.migration_id, a.kind, CASE WHEN a.kind = 'HISTORICAL' OR p.last IS NOT NULL THEN coalesce(p.last, 0) + 1 END AS number, CASE WHEN a.kind <> 'HISTORICAL' THEN p.mark END AS since, "
       f"CASE WHEN a.kind = 'HISTORICAL' OR p.last IS NOT NULL THEN a.at END AS watermark_at, CASE WHEN a.kind <> 'HISTORICAL' AND p.last IS NULL THEN 'VALIDATION_ERROR' END AS error_code FROM ({ASKED}) a LEFT JOIN "
       "(SELECT migration_id, max(number) AS last, arg_max(watermark_at, (number, k)) FILTER (status = 'COMPLETED') AS mark FROM migration_pass GROUP BY migration_id) p ON a.migration_id = p.migration_id")
def begin_pass(spark, d):
    """New passes: a delta reads from the watermark of the last pass that was completed, and can't come before the first
    pass. The new watermark is taken before anything is read."""
    kind = F.element_at(F.array(*map(F.lit, ["HISTORICAL", "DELTA", "FINAL_DELTA"])), (C("migration_id") % 3 + 1).cast("int"))
    asked = read(spark, d, "migration").select("migration_id", kind.alias("kind"), C("started_at").alias("at"))
    done = F.when(C("status") == "COMPLETED", F.struct("number", "k"))
    known = read(spark, d, "migration_pass").groupBy("migration_id").agg(F.max("number").alias("last"), F.max_by("watermark_at", done).alias("mark"))
    ok = (C("kind") == "HISTORICAL") | C("last").isNotNull()
    return asked.join(known, "migration_id", "left").select(
        "migration_id", "kind", F.when(ok, F.coalesce("last", F.lit(0)) + 1).alias("number"), F.when(C("kind") != "HISTORICAL", C("mark")).alias("since"),
        F.when(ok, C("at")).alias("watermark_at"), F.when(~ok, "VALIDATION_ERROR").alias("error_code"))


TALLY = ", ".join(f"count(*) FILTER (state = '{s}') AS {s.lower()}" for s in ("CREATED", "UPDATED", "SKIPPED", "FAILED"))


@query("SELECT p.migration_id, p.number, p.kind, p.watermark_at AS delta_watermark, CASE p.kind WHEN 'HISTORICAL' THEN 'historical_pass_complete' WHEN 'FINAL_DELTA' THEN 'final_delta_complete' END AS closes_task, "
       "coalesce(t.created, 0) AS created, coalesce(t.updated, 0) AS updated, coalesce(t.skipped, 0) AS skipped, coalesce(t.failed, 0) AS failed FROM "
       "(SELECT *, row_number() OVER (PARTITION BY migration_id ORDER BY number, k) AS n FROM migration_pass WHERE status = 'RUNNING') p LEFT JOIN "
       f"(SELECT migration_id, {TALLY} FROM ledger GROUP BY migration_id) t ON t.migration_id = 'M' || CAST(p.migration_id % 9 AS STRING) WHERE p.n = 1")
def complete_pass(spark, d):
    """The open pass of each migration, closed: its totals, the watermark the next delta reads from, and the task of the
    checklist that is done with it."""
    first = r.collapse(read(spark, d, "migration_pass").where("status = 'RUNNING'"), ["migration_id"], ["number", "k"])
    states = ["CREATED", "UPDATED", "SKIPPED", "FAILED"]
    tally = read(spark, d, "ledger").groupBy(C("migration_id").alias("run")).agg(*[F.count_if(C("state") == x).alias(x.lower()) for x in states])
    task = F.when(C("kind") == "HISTORICAL", "historical_pass_complete").when(C("kind") == "FINAL_DELTA", "final_delta_complete")
    return first.withColumn("run", F.concat(F.lit("M"), C("migration_id") % 9)).join(tally, "run", "left").select(
        "migration_id", "number", "kind", C("watermark_at").alias("delta_watermark"), task.alias("closes_task"), *[F.coalesce(x.lower(), F.lit(0)).alias(x.lower()) for x in states])


READY = ("SELECT m.migration_id, count(c.task_id) > 0 AND count(*) FILTER (c.blocks AND c.status NOT IN ('DONE', 'NOT_APPLICABLE')) = 0 AS ready, count(c.task_id) > 0 AS started, count(*) FILTER (c.blocks AND c.status NOT IN ('DONE', 'NOT_APPLICABLE')) AS blockers, "
         "CASE WHEN count(*) FILTER (c.status <> 'NOT_APPLICABLE') = 0 THEN 0 ELSE CAST(floor(count(*) FILTER (c.status = 'DONE') * 100.0 / count(*) FILTER (c.status <> 'NOT_APPLICABLE') + 0.5) AS BIGINT) END AS percent "
         "FROM migration m LEFT JOIN checklist c ON m.migration_id = c.migration_id GROUP BY m.migration_id")


def ready(spark, d):
    tasks = read(spark, d, "checklist").groupBy("migration_id").agg(
        F.count_if(C("blocks") & ~C("status").isin("DONE", "NOT_APPLICABLE")).alias("blockers"), F.count_if(C("status") == "DONE").alias("done"), F.count_if(C("status") != "NOT_APPLICABLE").alias("total"))
    both = read(spark, d, "migration").join(tasks, "migration_id", "left")
    percent = F.when(C("total") > 0, F.floor(C("done") * 100.0 / C("total") + 0.5)).otherwise(0).cast("long")
    return both.select("migration_id", (C("blockers").isNotNull() & (C("blockers") == 0)).alias("ready"), C("blockers").isNotNull().alias("started"),
                       F.coalesce("blockers", F.lit(0)).alias("blockers"), percent.alias("percent"), "started_at", "sla_days")


@query(READY)
def readiness(spark, d):
    return ready(spark, d).drop("started_at", "sla_days").withColumn("ready", F.coalesce("ready", F.lit(False)))


DUE = "started_at + INTERVAL '1' DAY * sla_days"


@query(f"SELECT m.migration_id, {DUE} AS due_at, CAST(ceil(epoch({DUE} - TIMESTAMP '{AS_OF}') / 86400.0) AS BIGINT) AS days_remaining, TIMESTAMP '{AS_OF}' > {DUE} AND NOT r.ready AS breached "
       f"FROM migration m JOIN ({READY}) r ON m.migration_id = r.migration_id")
def sla(spark, d):
    due = F.expr(DUE)
    left = (F.unix_micros(due) - F.unix_micros(lit_time())) / 86_400_000_000
    return ready(spark, d).select("migration_id", due.alias("due_at"), F.ceil(left).cast("long").alias("days_remaining"), ((lit_time() > due) & ~F.coalesce("ready", F.lit(False))).alias("breached"))


@query("SELECT source_id, entity, 'DISCOVERED' AS state FROM ledger WHERE state = 'FAILED'")
def retry_failed(spark, d):
    """Every failed record starts again, whatever it failed of."""
    return read(spark, d, "ledger").where("state = 'FAILED'").select("source_id", "entity", F.lit("DISCOVERED").alias("state"))


@query("SELECT id, CASE WHEN state = 'FAILED' THEN 'DISCOVERED' ELSE state END AS state, CASE WHEN state = 'FAILED' THEN 0 ELSE attempt END AS attempt, CASE WHEN state <> 'FAILED' THEN retry_at END AS retry_at FROM asset")
def retry_files(spark, d):
    failed = C("state") == "FAILED"
    return read(spark, d, "asset").select("id", F.when(failed, "DISCOVERED").otherwise(C("state")).alias("state"), F.when(failed, 0).otherwise(C("attempt")).alias("attempt"), F.when(~failed, C("retry_at")).alias("retry_at"))


@query("SELECT m.migration_id, 'selection' AS what, count(s.entity) > 0 AS passed FROM migration m LEFT JOIN selection s ON m.migration_id = s.migration_id GROUP BY m.migration_id "
       f"UNION ALL SELECT m.migration_id, 'dependencies', count(g.dep) = 0 FROM migration m LEFT JOIN ({GAPS} AND p.kind = 'requires') g ON m.migration_id = g.migration_id GROUP BY m.migration_id")
def preflight(spark, d):
    runs = read(spark, d, "migration").select("migration_id")
    some = read(spark, d, "selection").select("migration_id").distinct().withColumn("hit", F.lit(True))
    gaps = missing_dependencies(spark, d).where("kind = 'requires'").select("migration_id").distinct().withColumn("hit", F.lit(True))
    part = lambda side, what, ok: runs.join(side, "migration_id", "left").select("migration_id", F.lit(what).alias("what"), ok.alias("passed"))
    return part(some, "selection", C("hit").isNotNull()).unionByName(part(gaps, "dependencies", C("hit").isNull()))


@query("SELECT entity, count(*) AS migrations, entity IN ('contact', 'job', 'note') AS supported FROM selection GROUP BY entity")
def capabilities(spark, d):
    return read(spark, d, "selection").groupBy("entity").agg(F.count("*").alias("migrations")).withColumn("supported", C("entity").isin("contact", "job", "note"))


ANY_GAPS = ("SELECT s.migration_id, p.dep FROM selection s JOIN entity_plan p ON s.entity = p.entity AND p.kind = 'any' LEFT JOIN (SELECT DISTINCT w.migration_id, q.entity FROM selection w JOIN entity_plan q ON w.entity = q.dep AND q.kind = 'any') h "
            "ON h.migration_id = s.migration_id AND h.entity = s.entity WHERE h.entity IS NULL")
CHECKED = (f"SELECT m.migration_id, 'selection' AS what, true AS blocks, CASE WHEN count(s.entity) = 0 THEN 1 ELSE 0 END AS found FROM migration m LEFT JOIN selection s ON m.migration_id = s.migration_id GROUP BY m.migration_id "
           f"UNION ALL SELECT m.migration_id, 'requires', true, count(g.dep) FROM migration m LEFT JOIN ({GAPS} AND p.kind = 'requires') g ON m.migration_id = g.migration_id GROUP BY m.migration_id "
           f"UNION ALL SELECT m.migration_id, 'any', true, count(g.dep) FROM migration m LEFT JOIN ({ANY_GAPS}) g ON m.migration_id = g.migration_id GROUP BY m.migration_id "
           f"UNION ALL SELECT m.migration_id, 'enriched', false, count(g.dep) FROM migration m LEFT JOIN ({GAPS} AND p.kind = 'enriched') g ON m.migration_id = g.migration_id GROUP BY m.migration_id "
           f"UNION ALL SELECT m.migration_id, 'unavailable', true, count(g.entity) FROM migration m LEFT JOIN (SELECT x.migration_id, x.entity FROM selection x WHERE NOT EXISTS (SELECT 1 FROM {SUPPORTED} y WHERE y.migration_id = x.migration_id AND y.entity = x.entity)) g "
           "ON m.migration_id = g.migration_id GROUP BY m.migration_id "
           "UNION ALL SELECT m.migration_id, 'discovery', true, CASE WHEN EXISTS (SELECT 1 FROM discovery d WHERE d.migration_id = 'M' || CAST(m.migration_id % 9 AS STRING)) THEN 0 ELSE 1 END FROM migration m")


@query(f"SELECT migration_id, what, blocks, found, NOT blocks OR found = 0 AS passed FROM ({CHECKED}) t")
def preflight_checks(spark, d):
    """What each check finds before a migration starts: nothing selected, entities that lack one they require or any of those they
    need, entities that the source can't give, no discovery; what others would only be enriched by is advice."""
    runs = read(spark, d, "migration").select("migration_id")
    chosen = read(spark, d, "selection").select("migration_id", "entity")
    gaps = missing_dependencies(spark, d)
    lost = chosen.join(supported(spark, d), ["migration_id", "entity"], "left_anti")

    def row(found, what, blocks, empty_is_bad=False):
        counts = found.groupBy("migration_id").agg(F.count("*").alias("n"))
        number = F.when(C("n").isNull(), 1).otherwise(0) if empty_is_bad else F.coalesce("n", F.lit(0))
        return runs.join(counts, "migration_id", "left").select("migration_id", F.lit(what).alias("what"), F.lit(blocks).alias("blocks"), number.cast("long").alias("found"))

    known = read(spark, d, "discovery").select("migration_id").distinct()
    discovered = runs.withColumn("run", F.concat(F.lit("M"), C("migration_id") % 9)).join(known.withColumnRenamed("migration_id", "run"), "run", "left_semi")
    out = row(chosen, "selection", True, True)
    for found, what, blocks in ((gaps.where("kind = 'requires'"), "requires", True), (gaps.where("kind = 'any'"), "any", True), (gaps.where("kind = 'enriched'"), "enriched", False), (lost, "unavailable", True)):
        out = out.unionByName(row(found, what, blocks))
    return out.unionByName(row(discovered, "discovery", True, True)).withColumn("passed", ~C("blocks") | (C("found") == 0))


@query("SELECT o.id, coalesce(CASE WHEN s.name LIKE '%Won%' THEN 'Sold' END, s.name, o.stage_id) AS stage FROM raw_opportunity o LEFT JOIN raw_stage s ON o.stage_id = s.id")
def map_stages(spark, d):
    mapped = read(spark, d, "raw_stage").select(C("id").alias("stage_id"), "name", F.when(C("name").contains("Won"), "Sold").alias("to"))
    return read(spark, d, "raw_opportunity").join(mapped, "stage_id", "left").select("id", F.coalesce("to", "name", "stage_id").alias("stage"))


@query("SELECT j.id, CASE j.status WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' ELSE j.status END AS status FROM raw_job j")
def map_statuses(spark, d):
    table = spark.createDataFrame([("F", "Finished"), ("O", "Open")], "status string, to string")
    return read(spark, d, "raw_job").join(F.broadcast(table), "status", "left").select("id", F.coalesce("to", "status").alias("status"))


@query("SELECT c.id, CASE WHEN u.active THEN u.id ELSE 'U0001' END AS user_id FROM raw_contact c LEFT JOIN raw_user u ON c.user_id = u.id")
def map_users(spark, d):
    """Contacts of inactive or unknown users go to a default one."""
    users = read(spark, d, "raw_user").where("active").select(C("id").alias("user_id"), C("id").alias("to"))
    return read(spark, d, "raw_contact").join(users, "user_id", "left").select("id", F.coalesce("to", F.lit("U0001")).alias("user_id"))


# Lists

@query("SELECT source_id, created FROM ledger WHERE state = 'FAILED' AND entity = 'job' AND open AND error_code = 'RATE_LIMIT' ORDER BY created DESC, source_id LIMIT 50 OFFSET 10")
def list_errors_filtered(spark, d):
    return errors(read(spark, d, "ledger"), entity="job", error_code="RATE_LIMIT", open=True, limit=50, offset=10)


def errors(ledger, migration_id=None, entity=None, error_code=None, open=None, state="FAILED", limit=200, offset=0):
    """A page of the error list by the filters that are given, the latest first."""
    given = {"migration_id": migration_id, "entity": entity, "error_code": error_code, "open": open, "state": state}
    for c, v in given.items():
        ledger = ledger if v is None else ledger.where(C(c) == v)
    return ledger.orderBy(C("created").desc(), "source_id").offset(offset).limit(limit).select("source_id", "created")


@query("SELECT migration_id, arg_max(batch_id, (n, batch_id)) AS batch_id, max(n) AS n FROM (SELECT migration_id, batch_id, count(*) AS n FROM ledger GROUP BY 1, 2) t GROUP BY migration_id")
def last_checkpoint(spark, d):
    counts = read(spark, d, "ledger").groupBy("migration_id", "batch_id").agg(F.count("*").alias("n"))
    return counts.groupBy("migration_id").agg(F.max_by("batch_id", F.struct("n", "batch_id")).alias("batch_id"), F.max("n").alias("n"))


@query("SELECT id, 'contact' AS kind FROM raw_contact WHERE lower(full_name) LIKE '%smith%' UNION ALL SELECT id, 'job' FROM raw_job WHERE id = 'J000007' UNION ALL SELECT id, 'file' FROM raw_file WHERE name ILIKE '%1.PDF'")
def support_search(spark, d):
    hit = lambda df, cond, kind: df.where(cond).select("id", F.lit(kind).alias("kind"))
    return hit(read(spark, d, "raw_contact"), C("full_name").ilike("%smith%"), "contact").unionByName(
        hit(read(spark, d, "raw_job"), C("id") == "J000007", "job")).unionByName(hit(read(spark, d, "raw_file"), C("name").ilike("%1.PDF"), "file"))


def search(spark, d, source_id=None, destination_id=None, email=None, phone=None, job_number=None, filename=None):
    """kind, id of what support finds by whatever is given; e-mail and phone are compared as cleaned."""
    hit = lambda df, cond, kind, id="id": df.where(cond).select(F.lit(kind).alias("kind"), C(id).alias("id"))
    found, people = [], read(spark, d, "dest_contact")
    if source_id or destination_id:
        found.append(hit(read(spark, d, "ledger"), (C("source_id") == F.lit(source_id)) | (C("destination_id") == F.lit(destination_id)), "record", "source_id"))
    if email or phone:
        found.append(hit(people, (n.email(C("email")) == n.email(F.lit(email))) | (n.phone(C("phone")) == n.phone(F.lit(phone))), "contact"))
    if job_number:
        found.append(hit(read(spark, d, "raw_job"), C("id") == job_number, "job"))
    if filename:
        found.append(hit(read(spark, d, "asset"), C("name").ilike(f"%{filename}%"), "file"))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


@query(f"SELECT 'record' AS kind, source_id AS id FROM ledger WHERE source_id = 'J000007' OR destination_id = 'D-C000004' UNION ALL SELECT 'contact', id FROM dest_contact WHERE {EMAIL} = 'user3@mail.example' OR {PHONE} = '+15552000222' "
       "UNION ALL SELECT 'job', id FROM raw_job WHERE id = 'J000009' UNION ALL SELECT 'file', id FROM asset WHERE name ILIKE '%11.PDF%'")
def support_search_all(spark, d):
    return search(spark, d, "J000007", "D-C000004", " User3@mail.example", "(555) 200-0222", "J000009", "11.PDF")


@query("SELECT source_id, destination_id FROM object_map ORDER BY source_id LIMIT 100 OFFSET 5")
def object_map_page(spark, d):
    return read(spark, d, "object_map").orderBy("source_id").offset(5).limit(100)


@query("SELECT account, count(*) AS n FROM migration WHERE status IN ('RUNNING', 'PAUSED', 'QUEUED') GROUP BY account HAVING count(*) > 1")
def active_migrations(spark, d):
    return read(spark, d, "migration").where(C("status").isin("RUNNING", "PAUSED", "QUEUED")).groupBy("account").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT k, vendor FROM raw_event e WHERE again = 0 AND NOT EXISTS (SELECT 1 FROM raw_event x WHERE x.vendor = e.vendor AND x.event_key = e.event_key AND x.k % 10 <> 3) AND event_key IS NOT NULL")
def missed_events(spark, d):
    """Events of the snapshot that the inbox never applied."""
    applied = read(spark, d, "raw_event").where("k % 10 <> 3").select("vendor", "event_key")
    return read(spark, d, "raw_event").where("again = 0 and event_key is not null").join(applied, ["vendor", "event_key"], "left_anti").select("k", "vendor")


# Streams

def event_stream(spark, d):
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/events.parquet*")
    return inbox.event_keys(rows.select(C("event_type").alias("vendor"), F.expr(PAYLOAD).alias("payload"), F.when(C("event_id") % 4 == 3, C("event_id").cast("string")).alias("header"), "ts", "event_id"), "header")


# senders put an event's id in one place or another; a number is no id, and some send none
PAYLOAD = ("CASE event_id % 4 WHEN 1 THEN to_json(named_struct('event_id', string(event_id), 'id', 'other', 'data', props)) "
           "WHEN 2 THEN to_json(named_struct('event_id', '', 'id', event_id, 'eventId', string(event_id))) WHEN 3 THEN to_json(named_struct('id', event_id)) ELSE props END")


@query("SELECT DISTINCT event_type AS vendor, CASE WHEN event_id % 4 <> 0 THEN CAST(event_id AS STRING) ELSE sha256(coalesce(props, '')) END AS key FROM events")
def stream_inbox(spark, d):
    folder = new_folder(spark, "inbox")
    rows = event_stream(spark, d)
    inbox.store_once(rows, f"{folder}/rows", f"{folder}/progress", ["vendor", "key"])
    return inbox.stored(spark, f"{folder}/rows", rows.schema).select("vendor", "key")


@query("SELECT vendor, max(event_id) AS event_id FROM (SELECT event_type AS vendor, event_id, ts, max(ts) OVER (PARTITION BY event_type) AS last FROM events) t WHERE ts = last GROUP BY vendor")
def stream_upsert(spark, d):
    """The latest event of each vendor, kept by a stream."""
    folder = new_folder(spark, "upsert")
    rows = event_stream(spark, d).select("vendor", "ts", "event_id")
    inbox.upsert_stream(rows, f"{folder}/rows", f"{folder}/progress", "vendor", ["ts", "event_id"])
    return sink.read(spark, f"{folder}/rows").select("vendor", "event_id")


@query("SELECT DISTINCT event_type AS vendor, CASE WHEN event_id % 4 <> 0 THEN CAST(event_id AS STRING) ELSE sha256(coalesce(props, '')) END AS key FROM events")
def resume_equals_full(spark, d):
    """A stream that is started again finds nothing new, and its table stays as it was."""
    folder = new_folder(spark, "resume")
    rows = event_stream(spark, d)
    for _ in range(2):
        inbox.store_once(rows, f"{folder}/rows", f"{folder}/progress", ["vendor", "key"])
    return inbox.stored(spark, f"{folder}/rows", rows.schema).select("vendor", "key")
