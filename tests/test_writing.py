import json
import random

import pytest
from pyspark.sql import functions as F

from crossload.functions.redaction import redacted
from crossload.operators import idempotency as idem
from crossload.operators import mapping, parents, sink
from crossload.plans import writing
from crossload.sources import exports, folders, landing
from crossload.streaming import inbox

ROW = "id string, name string, at long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(spark, folder):
    """Paths of data files with their times, to see which were written anew."""
    at, fs = folders.path_of(spark, f"{folder}/data")
    found, it = {}, fs.listFiles(at, True)
    while it.hasNext():
        s = it.next()
        if s.getPath().getName().endswith(".parquet"):
            found[s.getPath().toString()] = s.getModificationTime()
    return found


@pytest.fixture
def table(spark):
    folder = folders.new_folder(spark, "test-sink")
    sink.create(spark, folder, spark.createDataFrame([], ROW).schema, ["id"], 8)
    first = spark.createDataFrame([(f"r{k}", "one", 1) for k in range(100)], ROW)
    assert sink.upsert(spark, folder, first) == {"version": 1, "created": 100, "updated": 0}
    return folder


def test_sink_rewrites_touched_buckets_only(spark, table):
    before = files(spark, table)
    assert sink.upsert(spark, table, spark.createDataFrame([("r3", "two", 2)], ROW)) == {"version": 2, "created": 0, "updated": 1}
    new = set(files(spark, table)) - set(before)
    assert len(new) == 1 and len(before) == 8
    got = {r.id: (r.name, r.created_in, r.updated_in) for r in sink.read(spark, table).collect()}
    assert len(got) == 100 and got["r3"] == ("two", 1, 2) and got["r4"] == ("one", 1, 1)
    assert {r.name for r in sink.read(spark, table, 1).collect()} == {"one"}  # an earlier version stays as it was


def test_sink_replay_writes_nothing(spark, table):
    again = spark.createDataFrame([(f"r{k}", "one", 1) for k in range(100)], ROW)
    before = files(spark, table)
    assert sink.upsert(spark, table, again) == {"version": 1, "created": 0, "updated": 0}
    assert files(spark, table) == before


def test_torn_write_is_invisible(spark, table, monkeypatch):
    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(sink, "put_once", dies)
        with pytest.raises(KeyboardInterrupt):
            sink.upsert(spark, table, spark.createDataFrame([("r1", "torn", 2), ("new", "torn", 2)], ROW))
    assert {r.name for r in sink.read(spark, table).collect()} == {"one"} and sink.read(spark, table).count() == 100
    torn = set(files(spark, table))
    sink.upsert(spark, table, spark.createDataFrame([("r1", "whole", 2)], ROW))
    sink.expire(spark, table)
    assert len(files(spark, table)) == 8 < len(torn) and sink.read(spark, table).where("name = 'whole'").count() == 1


def test_second_writer_is_told(spark, table, monkeypatch):
    real = sink.put_once

    def late(session, path, text):
        monkeypatch.setattr(sink, "put_once", real)  # somebody else commits first
        sink.upsert(spark, table, spark.createDataFrame([("r5", "first", 2)], ROW))
        return real(session, path, text)

    monkeypatch.setattr(sink, "put_once", late)
    with pytest.raises(sink.ConcurrentWrite):
        sink.upsert(spark, table, spark.createDataFrame([("r6", "second", 2)], ROW))
    got = {r.id: r.name for r in sink.read(spark, table).collect()}
    assert got["r5"] == "first" and got["r6"] == "one"


def test_sink_keeps_repeats_nulls_and_order(spark, table):
    sent = spark.createDataFrame([(None, "a", 1), (None, "b", 2), ("r7", "late", 9), ("r7", "early", 3), ("r8", None, None)], ROW)
    sink.upsert(spark, table, sent, order=["at"])
    got = {r.id: r.name for r in sink.read(spark, table).collect()}
    assert len(got) == 101 and got[None] == "a" and got["r7"] == "early" and got["r8"] is None
    sink.upsert(spark, table, spark.createDataFrame([("r7", "older", 1), ("r9", "newer", 5)], ROW), newer=["at"])
    got = {r.id: r.name for r in sink.read(spark, table).collect()}
    assert got["r7"] == "early" and got["r9"] == "newer"
    assert sink.upsert(spark, table, spark.createDataFrame([], ROW)) == {"version": 3, "created": 0, "updated": 0}


# Streams

EVENT = "vendor string, payload string, header string, ts timestamp, event_id long"


def event_files(spark, folder, parts):
    for part in parts:
        spark.createDataFrame(part, "vendor string, payload string, header string, event_id long").withColumn("ts", F.timestamp_seconds(F.col("event_id"))).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    schema = spark.createDataFrame([], "vendor string, payload string, header string, event_id long, ts timestamp").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_inbox_drops_repeats_across_batches(spark):
    folder = folders.new_folder(spark, "test-inbox")
    paths = [
        '{"event_id":"A","id":"B"}', '{"event_id":"","id":7,"eventId":"C"}', '{"id":7}', "no json", None, '{"event_id":{"x":"A"},"id":"D"}',
    ]
    part = [("v", p, "h" if k == 2 else None, k) for k, p in enumerate(paths)]
    event_files(spark, f"{folder}/in", [part, part, [("v", '{"id":"A"}', None, 50), ("w", '{"id":"A"}', None, 51)], [*part, ("v", "new", None, 60)]])
    events = inbox.event_keys(stream(spark, f"{folder}/in"), "header")
    inbox.store_once(events, f"{folder}/out", f"{folder}/progress", ["vendor", "key"])
    got = inbox.stored(spark, f"{folder}/out", events.schema)
    keys = rows(got.select("vendor", "key"))
    assert len(keys) == len(set(keys)) == 8
    assert {k for v, k in keys if v == "v"} >= {"A", "C", "h", "D"} and ("w", "A") in keys
    # what comes later costs a batch of its own and no more: the state answers, the table isn't read
    event_files(spark, f"{folder}/in", [[("v", '{"id":"A"}', None, 70), ("v", '{"id":"E"}', None, 71)]])
    inbox.store_once(events, f"{folder}/out", f"{folder}/progress", ["vendor", "key"])
    assert sorted(rows(inbox.stored(spark, f"{folder}/out", events.schema).select("vendor", "key"))) == sorted([*keys, ("v", "E")])


def test_inbox_within_a_span(spark):
    folder = folders.new_folder(spark, "test-inbox")
    event_files(spark, f"{folder}/in", [[("v", '{"id":"A"}', None, 0)], [("v", '{"id":"A"}', None, 30)], [("v", '{"id":"B"}', None, 31)]])
    events = inbox.event_keys(stream(spark, f"{folder}/in"))
    inbox.store_once(events, f"{folder}/out", f"{folder}/progress", ["vendor", "key"], "ts", "1 hour")
    assert rows(inbox.stored(spark, f"{folder}/out", events.schema).select("key")) == [("A",), ("B",)]


def test_failed_batch_counts_once(spark, monkeypatch):
    folder = folders.new_folder(spark, "test-upsert")
    event_files(spark, f"{folder}/in", [[("v", None, None, 1), ("w", None, None, 2)], [("v", None, None, 5)], [("v", None, None, 3), ("x", None, None, 9)]])
    events = stream(spark, f"{folder}/in").select("vendor", "ts", "event_id")
    real, seen = sink.upsert, []

    def dies_after_second(*args, **kw):
        done = real(*args, **kw)
        seen.append(kw["batch"][1])
        if len(seen) == 2:
            raise RuntimeError("lost after the commit")
        return done

    monkeypatch.setattr(sink, "upsert", dies_after_second)
    run = lambda: inbox.upsert_stream(events, f"{folder}/out", f"{folder}/progress", "vendor", ["ts", "event_id"], 4)
    with pytest.raises(Exception, match="lost after the commit"):
        run()
    run()
    assert seen == [0, 1, 1, 2]
    assert sorted((r.vendor, r.event_id) for r in sink.read(spark, f"{folder}/out").collect()) == [("v", 5), ("w", 2), ("x", 9)]
    assert sink.state(spark, f"{folder}/out")["version"] == 3


# Hashes and identities

def digest(spark, text):
    df = spark.sql(f"SELECT {text}")
    return df.select(idem.content_hash(df).alias("h")).first().h


def test_content_hash(spark):
    same = [
        ("1 AS a, 2 AS b", "2 AS b, 1 AS a"),
        ("'A' AS name, 'x' AS migration_id, 'r1' AS raw_source_reference, array() AS warnings", "'A' AS name, 'y' AS migration_id, 'r2' AS raw_source_reference, array('w') AS warnings"),
        ("named_struct('x', 1, 'y', named_struct('p', 1, 'warnings', 'a', 'q', 2)) AS s", "named_struct('y', named_struct('q', 2, 'p', 1), 'x', 1) AS s"),
        ("map('b', 1, 'a', 2) AS m", "map('a', 2, 'b', 1) AS m"),
        ("array(map('b', named_struct('u', 1, 'v', 2), 'warnings', null)) AS l", "array(map('b', named_struct('v', 2, 'u', 1))) AS l"),
    ]
    for a, b in same:
        assert digest(spark, a) == digest(spark, b), (a, b)
    other = [("'A' AS name", "'B' AS name"), ("array(1, 2) AS l", "array(2, 1) AS l"), ("CAST(NULL AS STRING) AS a", "'null' AS a"), ("named_struct('a', 1) AS s", "CAST(NULL AS STRUCT<a: INT>) AS s"),
             ("TIMESTAMP '2024-01-01 00:00:00' AS t", "TIMESTAMP '2024-01-01 00:00:00.5' AS t")]
    for a, b in other:
        assert digest(spark, a) != digest(spark, b), (a, b)


def one_by_one(sent, log, objects):
    """The same by a loop over the rows, as the destination takes them."""
    log, objects = dict(log), dict(objects)
    owner = {v: k for k, v in objects.items()}
    out = []
    for n, key, who, hash, new in sent:
        if key in log and log[key][2] == hash:
            out.append((n, log[key][0], log[key][1], True))
        elif key in log:
            id = log[key][0]
            if who in objects:
                id = objects[who]
            elif owner.get(id, who) != who:
                out.append((n, None, "FAILED", False))
                continue
            else:
                objects[who] = id
                owner[id] = who
            out.append((n, id, "UPDATED", False))
            if owner[log[key][0]] == who:
                log[key] = (log[key][0], "UPDATED", hash)
        else:
            status = "UPDATED" if who in objects else "CREATED"
            id = objects.setdefault(who, new)
            owner[id] = who
            log[key] = (id, status, hash)
            out.append((n, id, status, False))
    return out


def test_identity_upsert_equals_a_loop(spark):
    rng, sent, log, objects, want = random.Random(4), [], {}, {}, []
    for g in range(250):  # groups of keys and records that don't touch each other
        who, keys = [f"s{g}-{k}" for k in range(2)], [f"k{g}-{k}" for k in range(2)]
        here = {w: f"d-{w}" for w in who if rng.random() < 0.4}
        known = {}
        for k, w in zip(keys, who):
            if w in here and rng.random() < 0.5:
                known[k] = (here[w], rng.choice(["CREATED", "UPDATED"]), rng.choice("xy"))
        batch = [(g * 10 + n, rng.choice(keys), rng.choice(who) if rng.random() < 0.3 else None, rng.choice("xy"), f"new-{g}-{n}") for n in range(rng.randrange(1, 4))]
        batch = [(n, k, w or who[keys.index(k)], h, new) for n, k, w, h, new in batch]
        want += one_by_one(batch, known, here)
        sent += batch
        log |= known
        objects |= here
    df = spark.createDataFrame([(n, k, "T", "P", w, h, new) for n, k, w, h, new in sent], "n long, key string, tenant string, platform string, source_id string, hash string, new_id string")
    logged = spark.createDataFrame([(k, *v) for k, v in log.items()], "key string, destination_id string, status string, hash string")
    there = spark.createDataFrame([("T", "P", w, i) for w, i in objects.items()], "tenant string, platform string, source_id string, destination_id string")
    got = {r.n: (r.destination_id, r.status, r.replayed, r.writes) for r in idem.identity_upsert(df, logged, there).collect()}
    assert len(got) == len(sent)
    wrong = [(n, got[n], (i, s, r)) for n, i, s, r in want if got[n] != (i, s, r, not r and s != "FAILED")]
    assert not wrong, (len(wrong), wrong[:3])


def test_status_query_has_all_outcomes(spark):
    from crossload.plans import migration

    kinds = {(r.status, r.replayed) for r in migration.upsert_status(spark, "/root/testdata/sf0.001").collect()}
    assert kinds == {("CREATED", False), ("UPDATED", False), ("CREATED", True), ("FAILED", False)}


# References, exports, landing, redaction, mappings

def test_references(spark):
    notes = spark.createDataFrame([("n1", "job", "j1", "u1"), ("n2", "contact", "gone", ""), ("n3", None, "j1", None)], "id string, parent_entity_type string, parent_source_id string, user_source_id string")
    jobs = spark.createDataFrame([("j1", "c1", ["u2", "zz", "u1", None])], "id string, contact_source_id string, assigned_user_source_ids array<string>")
    known = spark.createDataFrame([("job", "j1", "J"), ("user", "u1", "U1"), ("user", "u2", "U2"), ("contact", "j1", "wrong type")], "entity string, source_id string, destination_id string")
    held = parents.references(notes, "note").unionByName(parents.references(jobs, "job"))
    got = {r.id: (r.parents, [tuple(w) for w in r.warnings]) for r in parents.parents(parents.resolved(held, known)).collect()}
    assert got == {
        "n1": ({"parent_source_id": ["J"], "user_source_id": ["U1"]}, []),
        "n2": ({"parent_source_id": []}, [("PARENT_UNRESOLVED", "parent_source_id", "contact", "gone")]),
        "j1": ({"contact_source_id": [], "assigned_user_source_ids": ["U2", "U1"]}, [
            ("PARENT_UNRESOLVED", "assigned_user_source_ids", "user", "zz"), ("PARENT_UNRESOLVED", "contact_source_id", "contact", "c1")]),
    }
    assert parents.references(notes, "tag").count() == 0


def test_export_filters_in_the_scan(spark):
    plan = writing.job_export(spark, "/root/testdata/sf0.001", "parquet")
    plan.changed = {"job": ["created"]}
    text = plan.scan("job", F.lit("1996-01-01").cast("timestamp"))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(created), GreaterThan(created" in text


def test_export_of_nothing(spark, tmp_path):
    (tmp_path / "contact").mkdir()
    (tmp_path / "contact" / "empty.json").write_text("")
    source = exports.FileExport(spark, str(tmp_path), "json", {"contact": writing.PEOPLE})
    assert source.scan("contact").count() == 0 and source.rejects("contact").count() == 0
    assert rows(exports.scanned(source, ["contact"])) == []


def test_purge_rewrites_expired_partitions_only(spark):
    folder = writing.land_orders(spark, "/root/testdata/sf0.001")

    def parts():
        at, fs = folders.path_of(spark, folder)
        found, it = {}, fs.listFiles(at, True)
        while it.hasNext():
            s = it.next()
            if s.getPath().getName().endswith(".parquet"):
                found.setdefault(s.getPath().getParent().getName(), set()).add(s.getPath().getName())
        return found

    before = parts()
    landing.purge(spark, folder, F.lit("1996-02-01").cast("date"))
    after = parts()
    changed = {k for k in before if before[k] != after[k]}
    assert set(before) == set(after) and changed == {k for k in before if k < "expires_on=1996-02-01"} and 0 < len(changed) < len(before)
    landing.purge(spark, folder, F.lit("1996-02-01").cast("date"))
    assert parts() == after


def plain(value):
    if isinstance(value, dict):
        return {k: "[REDACTED]" if any(s in k.lower() for s in ("password", "token", "secret", "cookie")) else plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [plain(v) for v in value]
    return "[REDACTED]" if isinstance(value, str) and value.lower().startswith(("bearer x", "basic x")) else value


def test_redaction_at_any_depth():
    rng = random.Random(2)

    def made(depth):
        kind = rng.randrange(8) if depth else 7
        if kind < 3:
            return {rng.choice(["a", "Password", "my_token", 'q"uote', "é", "secret\\", "setCookie"]): made(depth - 1) for _ in range(3)}
        if kind < 5:
            return [made(depth - 1) for _ in range(3)]
        return rng.choice([1, 2.5, None, True, "Bearer x1", "basic x", "bearer", "plain \" text", "token", "\\", "{\"password\": 1}"])

    for _ in range(400):
        value = made(5)
        text = json.dumps(value, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        assert json.loads(redacted(text)) == plain(value)
    kept = ' { "a" :1.50 , "b":[ 1e5,"\\u00e9" ] } '
    assert redacted(kept) == kept and redacted(None) is None and redacted("password: x") == "[REDACTED]" and redacted("[" * 100_000) == "[REDACTED]"


def test_forbidden_expressions(spark):
    df = spark.createDataFrame([("a", 1)], "name string, n int")
    ok = ["upper(name)", "CASE WHEN n > 0 AND name IS NOT NULL THEN concat(name, 'it''s') ELSE '-' END", "cast(n AS string)", "n * 2 - 1", "name"]
    for text in ok:
        df.select(mapping.checked(text, df.columns)).collect()
    bad = ["secret", "java_method('java.lang.System', 'exit')", "(SELECT 1)", "name; DROP", "`name`", "name -- x", "name /* x */", "reflect(name)", "n.name", "upper (other)", "current_user()", "", "  ", "'open", "name # x", "@x", "input_file_name()", "date (name) + evil(n)"]
    for text in bad:
        with pytest.raises(mapping.ForbiddenExpression):
            mapping.checked(text, df.columns)
    with pytest.raises(mapping.ForbiddenExpression):
        mapping.map_fields(df, [{"source_field": "name", "transform_expression": "sha2(name, 256)"}])
    with pytest.raises(ValueError):
        mapping.map_fields(df, [{"source_field": "name", "destination_field": "N"}])
