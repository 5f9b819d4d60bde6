"""Dirty exports of a system of record, derived from the given tables.

Each is one SQL text that both engines read the same, so that an oracle starts from equal rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def pick(key: str, values: list[str]) -> str:
    cases = " ".join(f"WHEN {n} THEN '{v}'" for n, v in enumerate(values))
    return f"CASE {key} % {len(values)} {cases} END"


FIRST = pick("b", ["Ana", "Ben", "José", "Renée", "Eva", "Finn", "Gus", "Hana", "Ivo", "Jill"])
LAST = pick("b", ["Smith", "Müller", "Jones", "Lopez", "Brown", "Ito", "Novak", "Reyes"])
DIGITS = "lpad(CAST(2000000 + b * 37 % 7000000 AS STRING), 7, '0')"
TABLES = {
    "raw_contact": (["customer"], f"""
SELECT k, CASE WHEN k % 500 = 499 THEN '' ELSE concat('C', lpad(CAST(k AS STRING), 6, '0')) END AS id,
  CASE WHEN k % 10 <> 1 THEN {FIRST} END AS first_name, CASE WHEN k % 10 <> 1 THEN {LAST} END AS last_name,
  CASE WHEN k % 10 = 1 THEN concat({LAST}, ', ', {FIRST}) ELSE concat({FIRST}, ' ', {LAST}) END AS full_name,
  CASE WHEN k % 33 <> 0 THEN CASE WHEN k % 50 = 49 THEN concat('USER', CAST(b AS STRING), '@MAIL.EXAMPLE')
    ELSE concat(' user', CAST(b AS STRING), '@mail.example') END END AS email,
  CASE WHEN k % 33 <> 0 THEN CASE k % 5 WHEN 0 THEN concat('555', {DIGITS}) WHEN 1 THEN concat('(555) ', {DIGITS})
    WHEN 2 THEN concat('+1 555-', {DIGITS}) WHEN 3 THEN concat('1555', {DIGITS}) ELSE concat('555.', {DIGITS}, ' ext. 12') END END AS phone,
  concat(CAST(100 + b % 9800 AS STRING), ' Oak ', {pick("b", ["St", "Street", "Ave", "Avenue", "Rd"])}) AS street,
  CASE WHEN k % 2 = 0 THEN 'Ohio' ELSE 'oh' END AS state,
  CASE k % 3 WHEN 0 THEN lpad(CAST(10000 + b % 900 AS STRING), 5, '0') WHEN 1 THEN concat(CAST(10000 + b % 900 AS STRING), '1234')
    ELSE concat(CAST(10000 + b % 900 AS STRING), '-1234') END AS zip,
  {pick("k", ["usa", "United States", "ca", "Canada", "fr", "Norway"])} AS country,
  concat(c_mktsegment, ';', lower(c_mktsegment), ', vip |', CASE WHEN k % 2 = 0 THEN 'VIP' ELSE 'new' END) AS tags,
  CASE WHEN k % 17 <> 0 THEN concat('U', lpad(CAST(c_nationkey AS STRING), 4, '0')) END AS user_id,
  CASE k % 8 WHEN 0 THEN '2023-04-05 06:07:08' WHEN 1 THEN '3/15/2023' WHEN 2 THEN '45000' WHEN 3 THEN '1700000000'
    WHEN 4 THEN '1700000000000' WHEN 5 THEN '0000-00-00' WHEN 6 THEN 'soon' END AS created
FROM (SELECT c_custkey AS k, c_custkey - CASE WHEN c_custkey % 50 = 49 THEN 1 ELSE 0 END AS b, c_nationkey, c_mktsegment FROM customer) t"""),
    "raw_job": (["orders"], """
SELECT o_orderkey AS k, concat('J', lpad(CAST(o_orderkey AS STRING), 6, '0')) AS id,
  CASE WHEN o_orderkey % 50 <> 0 THEN concat('C', lpad(CAST(o_custkey AS STRING), 6, '0')) END AS contact_id,
  CASE o_orderkey % 6 WHEN 0 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) WHEN 1 THEN '$1,234.56' WHEN 2 THEN '(500.00)'
    WHEN 3 THEN '-250' WHEN 4 THEN ' ' END AS value,
  o_orderstatus AS status, o_orderdate AS created,
  CASE o_orderkey % 11 WHEN 0 THEN 'DISCOVERED' WHEN 1 THEN 'QUEUED' WHEN 2 THEN 'PROCESSING' WHEN 3 THEN 'CREATED' WHEN 4 THEN 'UPDATED'
    WHEN 5 THEN 'MERGED' WHEN 6 THEN 'SKIPPED' WHEN 7 THEN 'FAILED' WHEN 8 THEN 'UNSUPPORTED' ELSE 'CREATED' END AS state,
  CASE WHEN o_orderkey % 2 = 0 THEN 'job' ELSE 'contact' END AS entity,
  CASE WHEN o_orderkey % 20 = 0 THEN '' WHEN o_orderkey % 40 = 7 THEN 'U99999'
    ELSE concat('U', lpad(CAST(o_orderkey % 10 AS STRING), 4, '0'), ',U', lpad(CAST(o_orderkey % 13 AS STRING), 4, '0')) END AS user_ids
FROM orders"""),
    "raw_event": (["events"], """
SELECT event_id AS k, event_type AS vendor, CASE WHEN event_id % 4 <> 0 THEN CAST(event_id AS STRING) END AS event_key,
  props AS payload, ts, 0 AS again FROM events
UNION ALL SELECT event_id, event_type, CASE WHEN event_id % 4 <> 0 THEN CAST(event_id AS STRING) END, props, ts, 1 FROM events WHERE event_id % 20 = 0"""),
    "raw_file": (["documents"], f"""
SELECT doc_id AS k, concat('F', CAST(doc_id AS STRING)) AS id,
  concat('file ', CAST(doc_id AS STRING), {pick("doc_id", [".pdf", ".jpg", ".exe", ".docx", ".png"])}) AS name,
  n_chars AS size, CASE WHEN doc_id % 4 = 3 THEN n_chars + 1 ELSE n_chars END AS stored_size, text FROM documents"""),
    "object_map": (["customer"], """
SELECT concat('C', lpad(CAST(c_custkey AS STRING), 6, '0')) AS source_id, concat('D', CAST(c_custkey AS STRING)) AS destination_id
FROM customer WHERE c_custkey % 3 = 0"""),
    "known_contact": (["customer"], """
SELECT CASE WHEN c_custkey % 21 = 0 THEN concat('G', lpad(CAST(c_custkey AS STRING), 6, '0')) ELSE concat('C', lpad(CAST(c_custkey AS STRING), 6, '0')) END AS source_id,
  concat('D', CAST(c_custkey AS STRING)) AS destination_id
FROM customer WHERE c_custkey % 3 = 0"""),
}


# Tables made of other derived ones: {name} stands for the table.
TABLES |= {
    "raw_user": (["supplier"], f"""
SELECT s_suppkey AS k, concat('U', lpad(CAST(s_suppkey AS STRING), 4, '0')) AS id, {FIRST.replace("b %", "s_suppkey %")} AS first_name,
  {LAST.replace("b %", "s_suppkey %")} AS last_name,
  CASE WHEN s_suppkey % 20 <> 0 THEN concat('u', CAST(s_suppkey AS STRING), '@mail.example;', 'U', CAST(s_suppkey AS STRING), '@Mail.example, second', CAST(s_suppkey AS STRING), '@mail.example') END AS emails,
  concat('555', lpad(CAST(2000000 + s_suppkey % 7000000 AS STRING), 7, '0'), ' / 0000000000 | (555) ', lpad(CAST(3000000 + s_suppkey % 6000000 AS STRING), 7, '0')) AS phones,
  {pick("s_suppkey", ["Yes", "off", "maybe", "1", "N", "Enabled", ""])} AS active_text, s_suppkey % 5 <> 0 AS active
FROM {{supplier}}"""),
    "raw_note": (["conversations"], """
SELECT conv_id * 1000 + turn AS k, concat('N', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS id,
  CASE WHEN conv_id % 2 = 0 THEN 'job' ELSE 'contact' END AS parent_type,
  CASE WHEN conv_id % 25 = 0 THEN 'gone' WHEN conv_id % 2 = 0 THEN concat('J', lpad(CAST(conv_id AS STRING), 6, '0'))
    ELSE concat('C', lpad(CAST(conv_id AS STRING), 6, '0')) END AS parent_id,
  CASE WHEN conv_id % 30 = 1 THEN concat('[2021-03-14 · Ana] ', text) WHEN turn % 10 = 3 THEN concat('<p>', text, '</p>') ELSE text END AS body,
  CASE WHEN turn % 3 <> 0 THEN role END AS author, CASE WHEN conv_id % 12 <> 0 THEN TIMESTAMP '2023-01-10 09:30:00' + INTERVAL '1' DAY * (conv_id % 300) END AS created,
  concat('t', CAST(conv_id AS STRING)) AS token, CASE WHEN turn % 2 = 0 THEN 'Bearer abc' ELSE 'plain' END AS header
FROM {conversations}"""),
    "raw_stage": (["nation"], f"""
SELECT n_nationkey AS k, concat('S', CAST(n_nationkey AS STRING)) AS id, CAST(n_regionkey AS STRING) AS pipeline_id,
  {pick("n_nationkey", ["Lead", "Closed Won", "Job Complete", "Lost deal", "WON!", "Quoted", "In review"])} AS name FROM {{nation}}"""),
    "asset": (["raw_file"], """
SELECT k, id, name, size, text, md5(text) AS sent_hash,
  CASE k % 4 WHEN 0 THEN md5(text) WHEN 1 THEN CASE WHEN k % 12 = 1 THEN 'bad' END END AS stored_hash,
  CASE WHEN k % 4 < 3 THEN CASE WHEN k % 20 = 2 THEN size + 1 ELSE size END END AS stored_size,
  CASE k % 7 WHEN 0 THEN 'image/png' WHEN 1 THEN 'Application/pdf' WHEN 2 THEN 'chemical/x-pdb' WHEN 3 THEN 'text/plain' END AS kind,
  CASE WHEN k % 15 <> 0 THEN concat('https://files.example/', CAST(k AS STRING)) END AS url,
  CASE WHEN k % 3 = 0 THEN 'job' ELSE 'contact' END AS parent_type,
  concat(CASE WHEN k % 3 = 0 THEN 'J' ELSE 'C' END, lpad(CAST(k AS STRING), 6, '0')) AS parent_id,
  CASE k % 8 WHEN 0 THEN 'CREATED' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'DISCOVERED' WHEN 3 THEN 'UNSUPPORTED' WHEN 4 THEN 'QUEUED' WHEN 5 THEN 'PROCESSING' ELSE 'CREATED' END AS state,
  k % 7 AS attempt, CASE WHEN k % 3 <> 0 THEN TIMESTAMP '2024-01-20 00:00:00' + INTERVAL '1' MINUTE * (k % 40000) END AS retry_at,
  concat('M', CAST(k % 9 AS STRING)) AS migration_id
FROM {raw_file}"""),
    "ledger": (["raw_job", "raw_contact"], """
SELECT k, concat('M', CAST(k % 9 AS STRING)) AS migration_id, 'job' AS entity, id AS source_id, state, k % 5 AS attempt,
  CASE WHEN state IN ('CREATED', 'UPDATED', 'MERGED', 'SKIPPED') THEN concat('D-', id) END AS destination_id,
  CASE WHEN state = 'FAILED' THEN CASE k % 5 WHEN 0 THEN 'RATE_LIMIT' WHEN 1 THEN 'VALIDATION_ERROR' WHEN 2 THEN 'SOURCE_TIMEOUT' WHEN 3 THEN 'MAPPING_ERROR' ELSE 'ODD' END END AS error_code,
  k % 3 <> 0 AS open, concat(CASE WHEN k % 2 = 0 THEN 'Job' ELSE 'Late' END, '-', CAST(k DIV 200 AS STRING)) AS batch_id, created,
  CASE WHEN k % 4 <> 0 THEN created + INTERVAL '90' DAY END AS expires, contact_id
FROM {raw_job}
UNION ALL SELECT k, concat('M', CAST(k % 9 AS STRING)), 'contact', id,
  CASE k % 9 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'UPDATED' ELSE 'CREATED' END, k % 5,
  CASE WHEN k % 9 > 1 THEN concat('D-', id) END, CASE WHEN k % 9 = 1 THEN 'PERMISSION_ERROR' END, k % 3 <> 0,
  concat('Contact-', CAST(k DIV 200 AS STRING)), TIMESTAMP '2023-02-01 00:00:00', CASE WHEN k % 4 <> 0 THEN TIMESTAMP '2024-05-01 00:00:00' END, CAST(NULL AS STRING)
FROM {raw_contact} WHERE id <> ''"""),
    "outcome": (["ledger"], """
SELECT source_id, entity, CASE WHEN k % 4 = 0 THEN 'FAILED' ELSE 'CREATED' END AS state, CASE WHEN k % 4 <> 0 THEN concat('N-', source_id) END AS destination_id, 0 AS n
FROM {ledger} WHERE state IN ('DISCOVERED', 'QUEUED', 'PROCESSING')
UNION ALL SELECT source_id, entity, 'UPDATED', concat('X-', source_id), 1 FROM {ledger} WHERE state = 'QUEUED'"""),
    "dest_contact": (["raw_contact"], """
SELECT concat('D', CAST(k AS STRING)) AS id, id AS source_id, CASE WHEN (k DIV 150) % 4 = 3 THEN concat(full_name, 'n') ELSE full_name END AS full_name,
  CASE WHEN (k DIV 150) % 4 = 0 THEN email ELSE concat('other', CAST(k AS STRING), '@mail.example') END AS email,
  CASE (k DIV 150) % 4 WHEN 0 THEN phone WHEN 2 THEN concat('+44 20 555 ', lpad(CAST(2000000 + k * 37 % 7000000 AS STRING), 7, '0')) END AS phone,
  CASE WHEN (k DIV 150) % 4 = 2 THEN concat('9 Elm ', CAST(k AS STRING)) ELSE street END AS street, zip,
  CASE WHEN k % 2 = 0 THEN 'T1' ELSE 'T2' END AS tenant
FROM {raw_contact} WHERE k % 3 = 0 AND id <> ''"""),
    "write_log": (["raw_contact"], """
SELECT concat('mig_1:export:contact:', id) AS key, id AS source_id, concat('W', CAST(k AS STRING)) AS destination_id, k % 8 = 0 AS current
FROM {raw_contact} WHERE k % 4 = 0 AND id <> ''"""),
    "decision": (["raw_contact"], """
SELECT id AS source_id, CASE k % 3 WHEN 0 THEN 'SKIP' WHEN 1 THEN 'MERGE' ELSE 'CREATE_NEW' END AS decision,
  CASE WHEN k % 3 = 1 THEN concat('D', CAST(k - 1 AS STRING)) END AS target, CASE WHEN k % 10 < 8 THEN 'REVIEWED' ELSE 'OPEN' END AS status,
  concat('M', CAST(k % 9 AS STRING)) AS migration_id
FROM {raw_contact} WHERE k % 7 = 0 AND id <> ''"""),
    "checklist": (["orders"], """
SELECT o_custkey AS migration_id, o_orderkey AS task_id, o_orderkey % 9 = 0 AS blocks,
  CASE o_orderkey % 5 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'IN_PROGRESS' WHEN 2 THEN 'DONE' WHEN 3 THEN 'DONE' ELSE 'NOT_APPLICABLE' END AS status FROM {orders}"""),
    "migration": (["customer"], """
SELECT c_custkey AS migration_id, TIMESTAMP '2023-12-01 12:00:00' + INTERVAL '1' HOUR * (c_custkey % 1800) AS started_at, 20 + c_custkey % 40 AS sla_days,
  CASE c_custkey % 5 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'PAUSED' WHEN 2 THEN 'COMPLETED' WHEN 3 THEN 'QUEUED' ELSE 'FAILED' END AS status,
  concat('A', CAST(c_nationkey AS STRING)) AS account FROM {customer}"""),
    "migration_pass": (["orders"], """
SELECT o_custkey AS migration_id, o_orderkey AS k, o_orderdate AS watermark_at,
  CASE WHEN o_orderkey % 3 = 0 THEN 'RUNNING' ELSE 'COMPLETED' END AS status, 1 + o_orderkey % 50 AS number,
  CASE o_orderkey % 4 WHEN 0 THEN 'HISTORICAL' WHEN 1 THEN 'FINAL_DELTA' ELSE 'DELTA' END AS kind, o_orderkey % 100 AS discovered, o_orderkey % 40 AS written FROM {orders}"""),
    "selection": (["customer", "entity_plan"], """
SELECT c_custkey AS migration_id, entity FROM {customer} CROSS JOIN (SELECT DISTINCT entity, ord FROM {entity_plan}) e WHERE (c_custkey * 7 + ord * ord) % 5 < 3"""),
    "discovery": (["ledger"], """
SELECT migration_id, entity, count(*) + CASE WHEN entity = 'job' AND migration_id = 'M3' THEN 2 WHEN entity = 'contact' AND migration_id = 'M2' THEN 5 ELSE 0 END AS n,
  migration_id <> 'M5' AS supported FROM {ledger} GROUP BY migration_id, entity"""),
    "chosen": (["ledger"], """
SELECT DISTINCT migration_id, entity FROM {ledger} WHERE migration_id <> 'M4' AND NOT (migration_id = 'M2' AND entity = 'contact')"""),
    "capability": (["region", "entity_plan"], """
SELECT CAST(r_regionkey AS STRING) AS platform, entity, CASE (r_regionkey * 5 + ord) % 4 WHEN 0 THEN 'false' WHEN 1 THEN 'conditional' ELSE 'true' END AS level
FROM {region} CROSS JOIN (SELECT DISTINCT entity, ord FROM {entity_plan}) e WHERE (r_regionkey + ord) % 9 <> 0"""),
    "full_contact": (["raw_contact"], """
SELECT *, CASE WHEN k % 4 = 0 THEN concat(' Second', CAST(k AS STRING), '@Mail.example ') WHEN k % 4 = 1 THEN 'no address' END AS secondary_email,
  CASE WHEN k % 7 <> 0 THEN concat('Town ', CAST(k % 5 AS STRING)) END AS city, CASE WHEN k % 6 = 0 THEN ' ' ELSE ' Web  form' END AS lead_source,
  CASE WHEN k % 3 = 0 THEN '2023-07-01 10:00:00' WHEN k % 3 = 1 THEN 'never' END AS modified FROM {raw_contact}"""),
    "full_job": (["raw_job"], """
SELECT *, concat('N-', CAST(k AS STRING)) AS job_number, CASE WHEN k % 5 <> 0 THEN concat(' Roof  ', CAST(k AS STRING)) ELSE '' END AS name, CASE WHEN k % 9 <> 0 THEN concat(CAST(k AS STRING), ' Elm Rd') END AS street,
  CAST(NULL AS STRING) AS city, 'ohio' AS region, CASE WHEN k % 2 = 0 THEN '12345' END AS zip, 'Repair' AS job_type, CASE WHEN k % 4 = 0 THEN '1/31/2023' END AS start_text, CASE WHEN k % 8 = 0 THEN '45000' END AS done_text,
  'A;b, a' AS tags FROM {raw_job}"""),
    "raw_payload": (["raw_note"], """
SELECT k, replace(replace(concat('< "id" : ', CAST(k AS STRING), ', "token":"', token, '","note": <"Header": "', header, '", "list":[ <"api_key": [1, <"x":2>], "amount": 1.50>, "Basic dXNlcg==", "plain ',
    CAST(k % 10 AS STRING), '", null],"deep":<"a":<"b":<"sessionId":<"v":true>,"ok":"é">>>>>'), '<', chr(123)), '>', chr(125)) AS payload,
  replace(replace(concat('< "id" : ', CAST(k AS STRING), ', "token":"[REDACTED]","note": <"Header": "', CASE WHEN header LIKE 'Bearer %' THEN '[REDACTED]' ELSE header END,
    '", "list":[ <"api_key": "[REDACTED]", "amount": 1.50>, "[REDACTED]", "plain ', CAST(k % 10 AS STRING), '", null],"deep":<"a":<"b":<"sessionId":"[REDACTED]","ok":"é">>>>>'), '<', chr(123)), '>', chr(125)) AS clean
FROM {raw_note}"""),
    "raw_opportunity": (["lineitem"], """
SELECT l_orderkey * 10 + l_linenumber AS k, concat('O', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS id,
  concat('C', lpad(CAST(l_suppkey AS STRING), 6, '0')) AS contact_id, concat('S', CAST(l_partkey % 30 AS STRING)) AS stage_id,
  concat(concat('U', lpad(CAST(l_suppkey AS STRING), 4, '0')), CASE WHEN l_linenumber % 2 = 0 THEN concat(',U', lpad(CAST(l_linenumber AS STRING), 4, '0')) ELSE ',U99999' END) AS user_ids,
  CASE WHEN l_partkey % 6 <> 0 THEN CAST(l_partkey % 7 AS STRING) END AS pipeline_id
FROM {lineitem}"""),
}
# Entities in the order they move, and what each requires, needs any of, and is enriched by.
ENTITIES = [
    ("account", [], [], []),
    ("location", [], [], ["account"]),
    ("user", [], [], ["account"]),
    ("team", ["user"], [], ["account"]),
    ("custom_field", [], [], ["account"]),
    ("tag", [], [], ["account"]),
    ("pipeline", [], [], ["account"]),
    ("pipeline_stage", ["pipeline"], [], []),
    ("status_definition", [], [], ["account"]),
    ("contact", [], [], ["user", "tag", "custom_field"]),
    ("company", [], [], ["user"]),
    ("lead", ["contact"], [], []),
    ("opportunity", ["contact"], [], ["pipeline", "pipeline_stage", "user"]),
    ("job", ["contact"], [], ["user", "status_definition", "tag"]),
    ("job_assignment", ["job", "user"], [], []),
    ("contact_job_relationship", ["job", "contact"], [], []),
    ("task", [], ["contact", "job"], ["user"]),
    ("appointment", [], ["contact", "job"], ["user"]),
    ("note", [], ["contact", "job"], ["user"]),
    ("activity", [], ["contact", "job"], ["user"]),
    ("document", [], ["job", "contact"], []),
    ("image", [], ["job", "contact"], []),
    ("attachment", [], ["job", "contact", "note"], []),
]


def plan_rows() -> list[str]:
    out = []
    for n, (entity, *deps) in enumerate(ENTITIES, 1):
        rows = [(kind, d) for kind, some in zip(("requires", "any", "enriched"), deps) for d in some]
        out += [f"('{entity}', {n}, '{kind}', '{d}')" for kind, d in rows] or [f"('{entity}', {n}, NULL, NULL)"]
    return out


TABLES = {"entity_plan": ([], f"SELECT * FROM (VALUES {', '.join(plan_rows())}) AS t(entity, ord, kind, dep)")} | TABLES


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, or a given one."""
    if name not in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    base, sql = TABLES[name]
    if not base:
        return spark.sql(sql)
    if f"{{{base[0]}}}" not in sql:
        sql = sql.replace(f"FROM {base[0]}", f"FROM {{{base[0]}}}")
    return spark.sql(sql, **{b: read(spark, sf_dir, b) for b in base})


def oracle(sql: str) -> str:
    """SQL over derived tables as SQL over the given ones."""
    need = {n for n in TABLES if n in sql}
    while more := {b for n in need for b in TABLES[n][0] if b in TABLES} - need:
        need |= more
    used = []
    while len(used) < len(need):  # a table after those that it is made of
        used += [n for n in TABLES if n in need and n not in used and all(b in used or b not in need for b in TABLES[n][0])]
    plain = lambda n: re.sub(r"\b(\w+) DIV (\d+)", r"(\1 // \2)", re.sub(r"\{(%s)\}" % "|".join(TABLES[n][0] or ["-"]), r"\1", TABLES[n][1]))
    return f"WITH {', '.join(f'{n} AS ({plain(n)})' for n in used)} {sql}" if used else sql
