"""The registered queries, each with the SQL that it is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as n
from ..operators import records as r
from ..sources.inputs import oracle, read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = oracle(sql)
        return f

    return add


def column(name: str, table: str, expr, sql: str) -> None:
    """A query of one cleaned column, k and out."""
    QUERIES[name] = lambda spark, d: read(spark, d, table).select("k", expr().alias("out"))
    SQL[name] = oracle(f"SELECT k, {sql} AS out FROM {table}")


PHONE = (
    "CASE WHEN phone IS NULL THEN NULL WHEN length({d}) = 10 AND NOT starts_with(trim(phone), '+') THEN '+1' || {d} ELSE '+' || {d} END"
).replace("{d}", r"regexp_replace(regexp_replace(trim(phone), '(?i)\s*(?:ext|x|extension)\.?\s*\d+\s*$', ''), '\D', '', 'g')")
EMAIL = "lower(trim(email))"
NAME = "trim(regexp_replace(lower(strip_accents({})), '[^a-z0-9 ]', '', 'g'))"
STREET = rf"regexp_replace(regexp_replace(lower(street), '\b(street|st|avenue|ave|road|rd|drive|dr|lane|ln|boulevard|blvd|court|ct|circle|cir|place|pl|suite|ste|apartment|apt|unit)\b', '', 'g'), '[^a-z0-9]', '', 'g') || '|' || substr(zip, 1, 5)"
CENTS = (
    "CASE WHEN trim(value) = '' THEN NULL ELSE CAST(floor(CAST(regexp_replace(value, '[^0-9.]', '', 'g') AS DOUBLE) * 100 + 0.5) AS BIGINT) "
    "* CASE WHEN value LIKE '(%' OR value LIKE '-%' THEN -1 ELSE 1 END END"
)
NUMBER = r"CASE WHEN regexp_matches(trim({0}), '^-?\d+(\.\d+)?$') THEN TRY_CAST(trim({0}) AS DOUBLE) END"
US_DATE = r"regexp_extract(trim({0}), '^(\d{{1,2}})[/-](\d{{1,2}})[/-](\d{{4}})$', {1})"
FOUND_DATE = (
    "CASE WHEN trim({0}) = '' OR trim({0}) = '0' OR starts_with(trim({0}), '0000-00-00') THEN NULL "
    f"WHEN {NUMBER} IS NOT NULL THEN make_timestamp(CAST(1000000 * (CASE WHEN {NUMBER} > 0 AND {NUMBER} < 60000 THEN ({NUMBER} - 25569) * 86400 WHEN abs({NUMBER}) < 1e11 THEN {NUMBER} ELSE {NUMBER} / 1000 END) AS BIGINT)) "
    f"WHEN {US_DATE.replace('{1}', '3')} <> '' THEN CAST(make_date(CAST({US_DATE.replace('{1}', '3')} AS BIGINT), 1, 1) + to_months(CAST({US_DATE.replace('{1}', '1')} AS INTEGER) - 1) + to_days(CAST({US_DATE.replace('{1}', '2')} AS INTEGER) - 1) AS TIMESTAMP) "
    r"WHEN regexp_matches(trim({0}), '^\d{{4}}-\d{{2}}-\d{{2}}') THEN TRY_CAST(trim({0}) AS TIMESTAMP) END"
)
DATE_OF = "CASE WHEN year({x}) BETWEEN 1970 AND 2100 THEN {x} END".replace("{x}", f"({FOUND_DATE})")
CREATED = DATE_OF.format("created")
STATE = (f"CASE WHEN upper(trim(state)) IN ({', '.join(repr(v) for v in n.STATES.values())}) THEN upper(trim(state)) "
         + " ".join(f"WHEN lower(trim(state)) = '{k}' THEN '{v}'" for k, v in n.STATES.items()) + " ELSE trim(state) END")
BARE_ZIP = r"regexp_replace(zip, '\s', '', 'g')"
POSTAL = (rf"CASE WHEN regexp_matches({BARE_ZIP}, '^\d{{5}}-?\d{{4}}$') THEN substr({BARE_ZIP}, 1, 5) || '-' || right({BARE_ZIP}, 4) "
          rf"WHEN regexp_matches({BARE_ZIP}, '^\d{{5}}$') THEN {BARE_ZIP} ELSE upper(trim(zip)) END")
C = F.col
column("norm_email", "raw_contact", lambda: n.email(C("email")), EMAIL)
column("norm_phone", "raw_contact", lambda: n.phone(C("phone")), PHONE)
column("norm_name_key", "raw_contact", lambda: n.name_key(C("full_name")), NAME.format("full_name"))
column("norm_state", "raw_contact", lambda: n.state(C("state")), STATE)
column("norm_postal", "raw_contact", lambda: n.postal(C("zip")), POSTAL)
column("norm_country", "raw_contact", lambda: n.country(C("country")),
       "CASE WHEN lower(country) IN ('usa', 'united states') THEN 'US' WHEN lower(country) IN ('ca', 'canada') THEN 'CA' WHEN country = 'fr' THEN 'FR' ELSE country END")
column("address_key", "raw_contact", lambda: n.address_key(C("street"), C("zip")), STREET)
column("norm_date", "raw_contact", lambda: n.timestamp(C("created")), CREATED)
column("norm_money", "raw_job", lambda: n.cents(C("value")), CENTS)
column("norm_tags", "raw_contact", lambda: F.array_join(n.tags(C("tags")), ";"),
       "(SELECT string_agg(tag, ';' ORDER BY pos) FROM (SELECT min_by(trim(t), pos) AS tag, min(pos) AS pos FROM (SELECT unnest(regexp_split_to_array(tags, '[;,|]')) AS t, "
       "unnest(range(len(regexp_split_to_array(tags, '[;,|]')))) AS pos) x WHERE trim(t) <> '' GROUP BY lower(trim(t))) y)")
column("norm_text", "raw_file", lambda: n.text(F.concat(F.lit(" \t"), "text", F.lit("  x\n"))), r"trim(regexp_replace(text || ' x', '[\s\x{A0}\x{FEFF}]+', ' ', 'g'))")
column("safe_name", "raw_file", lambda: n.safe_name(C("name")), "replace(name, ' ', '_')")
column("mask_value", "raw_contact", lambda: n.mask(C("street")),
       "CASE WHEN length(street) <= 8 THEN repeat('*', length(street)) ELSE left(street, 3) || repeat('*', CAST(least(length(street) - 6, 12) AS INTEGER)) || right(street, 3) END")
column("null_if_empty", "raw_job", lambda: n.null_if_empty(C("value")), "CASE WHEN trim(value) <> '' THEN value END")
TRUE, FALSE = (", ".join(f"'{x}'" for x in some) for some in (n.TRUE, n.FALSE))
column("norm_bool", "raw_user", lambda: n.boolean(C("active_text")), f"CASE WHEN lower(trim(active_text)) IN ({TRUE}) THEN true WHEN lower(trim(active_text)) IN ({FALSE}) THEN false END")
column("dispositions", "raw_job", lambda: r.disposition(C("state")),
       "CASE WHEN state = 'CREATED' THEN 'MIGRATED' WHEN state NOT IN ('DISCOVERED', 'QUEUED', 'PROCESSING') THEN state END")
column("idem_key", "raw_contact", lambda: F.concat_ws(":", F.lit("mig_1"), F.lit("export"), F.lit("contact"), "id"), "'mig_1:export:contact:' || id")
column("fallback_id", "raw_contact", lambda: F.coalesce(n.blank_null(C("id")), F.concat(F.lit("__unidentified:contact:k"), "k")),
       "CASE WHEN id = '' THEN '__unidentified:contact:k' || k ELSE id END")
column("asset_hash", "raw_file", lambda: F.sha2("text", 256), "sha256(text)")
ENDS = ", ".join(f"'{x}'" for x in r.BLOCKED)
column("file_reject", "raw_file", lambda: r.rejection(C("name"), C("size")),
       f"CASE WHEN lower(regexp_extract(name, '(\\.[A-Za-z0-9]+)$', 1)) IN ({ENDS}) THEN 'blocked_extension' WHEN size > {r.LARGEST} THEN 'too_large' WHEN size = 0 THEN 'empty' END")
column("file_integrity", "raw_file", lambda: r.integrity(C("size"), C("stored_size")), "CASE WHEN size = stored_size THEN 'size_verified' ELSE 'failed' END")


@query(r"SELECT k, CASE WHEN k % 10 = 1 THEN split_part(full_name, ', ', 2) ELSE split_part(full_name, ' ', 1) END AS first_name, "
       r"CASE WHEN k % 10 = 1 THEN split_part(full_name, ', ', 1) ELSE split_part(full_name, ' ', 2) END AS last_name FROM raw_contact")
def split_name(spark, d):
    first, last = n.split_name(C("full_name"))
    return read(spark, d, "raw_contact").select("k", first.alias("first_name"), last.alias("last_name"))


@query("SELECT c.id, m.destination_id FROM raw_contact c LEFT JOIN object_map m ON c.id = m.source_id")
def object_map_lookup(spark, d):
    return r.resolve(read(spark, d, "raw_contact"), "id", read(spark, d, "object_map"), "destination_id").select("id", "destination_id")


@query("SELECT j.id, m.destination_id AS contact FROM raw_job j LEFT JOIN object_map m ON j.contact_id = m.source_id")
def resolve_job_contact(spark, d):
    return r.resolve(read(spark, d, "raw_job"), "contact_id", read(spark, d, "object_map"), "contact").select("id", "contact")


@query("SELECT j.id FROM raw_job j WHERE NOT EXISTS (SELECT 1 FROM raw_contact c WHERE c.id = j.contact_id)")
def orphan_jobs(spark, d):
    side = read(spark, d, "raw_contact").select(C("id").alias("contact_id"))
    return read(spark, d, "raw_job").join(side, "contact_id", "left_anti").select("id")


@query("SELECT c.id FROM raw_contact c WHERE NOT EXISTS (SELECT 1 FROM raw_job j WHERE j.contact_id = c.id)")
def idle_contacts(spark, d):
    side = read(spark, d, "raw_job").select(C("contact_id").alias("id"))
    return read(spark, d, "raw_contact").join(side, "id", "left_anti").select("id")


KEYED = f"SELECT id, {EMAIL} AS e, {PHONE} AS p, {NAME.format('full_name')} AS nk, {STREET} AS ak FROM raw_contact WHERE id <> ''"


def keyed(spark, d):
    return read(spark, d, "raw_contact").where("id <> ''").select(
        "id", n.email(C("email")).alias("e"), n.phone(C("phone")).alias("p"), n.name_key(C("full_name")).alias("nk"), n.address_key(C("street"), C("zip")).alias("ak"))


@query(f"SELECT x.id, y.id AS other FROM ({KEYED}) x JOIN ({KEYED}) y ON x.id <> y.id AND (x.e = y.e OR x.p = y.p OR (x.nk = y.nk AND x.ak = y.ak))")
def dup_candidates(spark, d):
    k = keyed(spark, d)
    return r.candidates(k, k, [["e"], ["p"], ["nk", "ak"]])


COUNTS = ", ".join(f"count(*) FILTER (state = '{s}') AS {s.lower()}" for s in r.ACCOUNTED)
FLIGHT = "count(*) FILTER (state IN ('DISCOVERED', 'QUEUED', 'PROCESSING')) AS in_flight"


@query(f"SELECT entity, count(*) AS discovered, {COUNTS}, {FLIGHT} FROM raw_job GROUP BY entity")
def counts_by_entity(spark, d):
    return r.state_counts(read(spark, d, "raw_job"), "entity")


@query("SELECT entity, count(*) AS n FROM raw_job GROUP BY ROLLUP (entity)")
def count_totals(spark, d):
    return read(spark, d, "raw_job").rollup("entity").agg(F.count("*").alias("n"))


@query("SELECT entity, count(*) FILTER (state IN ('DISCOVERED', 'QUEUED', 'PROCESSING')) AS variance, "
       "count(*) FILTER (state IN ('DISCOVERED', 'QUEUED', 'PROCESSING')) = 0 AS passed FROM raw_job GROUP BY entity")
def recon_counts(spark, d):
    done = sum((C(s.lower()) for s in r.ACCOUNTED), F.lit(0))
    counts = r.state_counts(read(spark, d, "raw_job"), "entity").withColumn("variance", C("discovered") - done)
    return counts.select("entity", "variance", (C("variance") == 0).alias("passed"))


@query("SELECT DISTINCT vendor, coalesce(event_key, sha256(coalesce(payload, ''))) AS key FROM raw_event")
def inbox_dedupe(spark, d):
    events = read(spark, d, "raw_event").withColumn("key", F.coalesce("event_key", F.sha2(F.coalesce("payload", F.lit("")), 256)))
    return r.collapse(events, ["vendor", "key"], ["ts", "k", "again"]).select("vendor", "key")


@query(f"SELECT id FROM (SELECT id, {CREATED} AS made FROM raw_contact) t WHERE made > TIMESTAMP '2023-06-01'")
def delta_scan(spark, d):
    return read(spark, d, "raw_contact").where(n.timestamp(C("created")) > F.lit("2023-06-01").cast("timestamp")).select("id")


@query("SELECT id, count(*) AS copies FROM raw_contact GROUP BY id HAVING count(*) > 1")
def identity_dupes(spark, d):
    return read(spark, d, "raw_contact").groupBy("id").agg(F.count("*").alias("copies")).where("copies > 1")


@query("SELECT id, min(k) AS k FROM raw_contact GROUP BY id")
def collapse_repeats(spark, d):
    return r.collapse(read(spark, d, "raw_contact"), ["id"], ["k"]).select("id", "k")


@query("SELECT coalesce(m.source_id, c.id) AS id, coalesce(m.destination_id, 'D-' || c.id) AS destination_id, coalesce(c.email, CASE WHEN c.id IS NULL THEN 'old' END) AS email "
       "FROM object_map m FULL JOIN (SELECT id, email FROM raw_contact WHERE id <> '') c ON m.source_id = c.id")
def upsert_contacts(spark, d):
    current = read(spark, d, "object_map").select(C("source_id").alias("id"), "destination_id", F.lit("old").alias("email"))
    new = read(spark, d, "raw_contact").where("id <> ''").select("id", F.concat(F.lit("D-"), "id").alias("destination_id"), "email")
    return r.upsert(current, new, "id", ["destination_id"])


@query("SELECT coalesce(m.source_id, c.id) AS id, coalesce(m.destination_id, 'D-' || c.id) AS destination_id, CASE WHEN c.id IS NULL THEN 'old' ELSE c.email END AS email "
       "FROM known_contact m FULL JOIN (SELECT id, email FROM raw_contact WHERE id <> '') c ON m.source_id = c.id")
def upsert_all_contacts(spark, d):
    """All identified contacts; known_contact also has entries (G...) that the export no longer holds."""
    current = read(spark, d, "known_contact").select(C("source_id").alias("id"), "destination_id", F.lit("old").alias("email"))
    new = read(spark, d, "raw_contact").where("id <> ''").select("id", F.concat(F.lit("D-"), "id").alias("destination_id"), "email")
    return r.upsert(current, new, "id", ["destination_id"])


@query("SELECT state, entity, count(*) AS n FROM raw_job WHERE state IN ('FAILED', 'UNSUPPORTED') GROUP BY state, entity")
def error_summary(spark, d):
    return read(spark, d, "raw_job").where(C("state").isin("FAILED", "UNSUPPORTED")).groupBy("state", "entity").agg(F.count("*").alias("n"))


@query("SELECT id, created FROM raw_job WHERE state = 'FAILED' ORDER BY created DESC, id LIMIT 200")
def list_errors(spark, d):
    return read(spark, d, "raw_job").where("state = 'FAILED'").orderBy(C("created").desc(), "id").limit(200).select("id", "created")
