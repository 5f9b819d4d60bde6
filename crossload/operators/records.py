"""Set-based forms of the record operators: resolving, matching, upserting, counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Record states, the lists that block a file, and the size limit in bytes.
ACCOUNTED = ["CREATED", "UPDATED", "MERGED", "SKIPPED", "FAILED", "UNSUPPORTED"]
IN_FLIGHT = ["DISCOVERED", "QUEUED", "PROCESSING"]
BLOCKED = [".exe", ".dll", ".scr", ".bat", ".cmd", ".com", ".msi", ".jar", ".sh", ".ps1", ".vbs", ".js", ".app", ".deb", ".rpm"]
KINDS = ["image/", "video/", "audio/", "text/", "application/"]
LARGEST = 512 * 1024 * 1024
BLOCK_ROWS = 1000  # of a crowded key that are joined in one cell


def collapse(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by a total order."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", first).where("__n = 1").drop("__n")


def resolve(df: DataFrame, ref: str, known: DataFrame, out: str, id: str = "source_id", to: str = "destination_id") -> DataFrame:
    """df with the destination id of a source reference, null where unknown."""
    side = known.select(F.col(id).alias(ref), F.col(to).alias(out))
    return df.join(side, ref, "left")


def resolve_lists(df: DataFrame, refs: str, known: DataFrame, out: str, id: str = "source_id", to: str = "destination_id") -> DataFrame:
    """df with the destination ids of a list of source references, in order, without the unknown ones; null where none is
    known. Equal lists are resolved once, so that neither repeated ids nor repeated lists make more of them."""
    lists = df.select(refs).distinct()
    each = lists.select(refs, F.posexplode(refs).alias("__at", "__ref")).join(known.select(F.col(id).alias("__ref"), F.col(to).alias("__to")), "__ref")
    found = each.groupBy(refs).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__to"))), lambda x: x["__to"]).alias(out))
    return df.join(found, refs, "left")


def disposition(state: Column) -> Column:
    return F.when(state == "CREATED", "MIGRATED").when(~state.isin(IN_FLIGHT), state)


def split_join(left: DataFrame, right: DataFrame, on: list[str], id: str, other: str, at_once: int = BLOCK_ROWS) -> DataFrame:
    """left and right joined on equal columns, with the pairs of a crowded key dealt over many tasks: its rows go to
    parts of at_once rows by the hash of their id, and each part of one side meets each of the other in a cell
    of its own. Every pair is made once, whatever the sizes; keys that fit one part are joined as they are."""
    sizes = left.groupBy(*on).agg(F.count("*").alias("__l")).join(right.groupBy(*on).agg(F.count("*").alias("__r")), on)
    parts = lambda c: F.ceil(F.col(c) / at_once).cast("int")
    crowded = sizes.where((F.col("__l") > at_once) | (F.col("__r") > at_once)).select(*on, parts("__l").alias("__l"), parts("__r").alias("__r"))

    def dealt(side: DataFrame, key: str, own: str, far: str) -> DataFrame:
        known = side.join(crowded, on, "left")
        mine = F.pmod(F.xxhash64(key), F.coalesce(own, F.lit(1))).cast("int").alias(f"__at{own}")
        return known.withColumn(f"__at{far}", F.explode(F.sequence(F.lit(0), F.coalesce(far, F.lit(1)) - 1))).select(*side.columns, mine, f"__at{far}")

    cells = ["__at__l", "__at__r"]
    return dealt(left, id, "__l", "__r").join(dealt(right, other, "__r", "__l"), [*on, *cells]).drop(*cells)


def candidates(incoming: DataFrame, existing: DataFrame, signals: list[list[str]], at_once: int = BLOCK_ROWS) -> DataFrame:
    """Pairs (id, other) equal in all columns of at least one signal: one equi-join over exploded
    (signal, key) rows, crowded keys in parts. For a table with itself, each pair is joined once and then turned around."""
    keys = lambda df, id: df.select(
        F.col("id").alias(id), F.explode(F.array(*[
            F.struct(F.lit(n).alias("signal"), F.when(F.forall(F.array(*s), lambda c: c.isNotNull()), F.to_json(F.array(*s))).alias("key"))
            for n, s in enumerate(signals)])).alias("x")).select(id, "x.*").where("key is not null")
    alone = incoming is existing
    pairs = split_join(keys(incoming, "id"), keys(existing, "other"), ["signal", "key"], "id", "other", at_once)
    pairs = pairs.where("id < other" if alone else "id <> other").select("id", "other").distinct()
    return pairs.unionByName(pairs.select(F.col("other").alias("id"), F.col("id").alias("other"))) if alone else pairs


def upsert(current: DataFrame, incoming: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Incoming rows replace current ones of the same key, but for the columns in keep; the rest stay."""
    a, b = current.alias("a"), incoming.alias("b")
    known = F.col(f"b.{key}").isNotNull()
    pick = [
        (F.coalesce(f"a.{c}", f"b.{c}") if c in [key, *keep] else F.when(known, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))).alias(c)
        for c in current.columns
    ]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(*pick)


def upsert_by(current: DataFrame, incoming: DataFrame, key: str, keep: list[str], by: str) -> DataFrame:
    """upsert() of a table with created_by and updated_by: a new record was created by the one that incoming names in
    by, one that was there keeps its creator and is updated by it."""
    a, b = current.alias("a"), incoming.alias("b")
    here, sent = F.col(f"a.{key}").isNotNull(), F.col(f"b.{key}").isNotNull()
    own = [c for c in current.columns if c not in ("created_by", "updated_by")]
    pick = [(F.coalesce(f"a.{c}", f"b.{c}") if c in [key, *keep] else F.when(sent, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))).alias(c) for c in own]
    created = F.when(here, F.col("a.created_by")).otherwise(F.col(f"b.{by}")).alias("created_by")
    updated = F.when(here & sent, F.col(f"b.{by}")).otherwise(F.col("a.updated_by")).alias("updated_by")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(*pick, created, updated)


def state_counts(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(
        F.count("*").alias("discovered"), *[F.count_if(F.col("state") == s).alias(s.lower()) for s in ACCOUNTED],
        F.count_if(F.col("state").isin(IN_FLIGHT)).alias("in_flight"),
    )


def integrity(sent: Column, stored: Column) -> Column:
    return F.when(sent == stored, "size_verified").otherwise("failed")


def integrity_level(sent_hash: Column, stored_hash: Column, sent_size: Column, stored_size: Column) -> Column:
    """What a stored copy proves: its hash, else its size, else nothing; any mismatch fails."""
    return (
        F.when(stored_hash.isNotNull(), F.when(sent_hash == stored_hash, "hash_verified").otherwise("FAILED"))
        .when(stored_size.isNotNull(), F.when(sent_size == stored_size, "size_verified").otherwise("FAILED")).otherwise("unverified")
    )


def rejection(name: Column, size: Column, kind: Column | None = None) -> Column:
    end = F.lower(F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1))
    found = F.when(end.isin(BLOCKED), "blocked_extension").when(size > LARGEST, "too_large").when(size == 0, "empty")
    if kind is None:
        return found
    allowed = F.exists(F.array(*map(F.lit, KINDS)), lambda p: kind.startswith(p))  # as written: kinds are lower case
    return F.when(end.isin(BLOCKED), "blocked_extension").when((kind != "") & ~allowed, "blocked_kind").otherwise(found)
