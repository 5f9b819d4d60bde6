"""Chat formatting: tool calls linked to their results, ordered, checked and serialised.

Native: DataFrame functions only. Calls and results join by identifier; repeated calls or results
of one identifier collapse to the smallest by position. A call may name the call it follows; its
depth comes from pointer doubling, so chains of n calls take log2(n) joins, and calls in a cycle
get depth null and status ``cycle``. Arguments are parsed as they are; the fields' types are held
against their tool's schema without conversion, and fields in sorted order make the canonical JSON.
Status: ok, unknown_tool, invalid (no JSON object, a field that the schema lacks, a required field
missing or null, or one of another type), no_result, cycle, or no_call (a result whose call is not
there). Null identifiers are dropped: nothing can link
to them. A parent that does not exist counts as none. Very long arguments are one row's memory. After
max_rounds doublings (chains of 2^64 calls) depths would stay null. Empty tables give empty results;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table

# Tool to fields: name to (Spark type, required).
KINDS = {"string": "STRING", "bigint": "BIGINT", "double": r"DOUBLE|BIGINT|DECIMAL\(.*\)", "boolean": "BOOLEAN"}  # patterns of a JSON value's types
SCHEMAS = {
    "answer": {"question": ("string", True), "turn": ("bigint", True)},
    "reply": {"question": ("string", True), "turn": ("bigint", True), "style": ("string", False)},
}


def depths(calls: DataFrame, max_rounds: int = 64) -> DataFrame:
    """call_id, depth (from 0; null in a cycle) of calls (call_id, after)."""
    known = calls.select(F.col("call_id").alias("after"))
    state = settle(
        calls.select("call_id", "after").join(known.withColumn("real", F.lit(True)), "after", "left")
        .select("call_id", F.when(F.col("real"), F.col("after")).alias("up"))
        .withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long"))
    )
    size, k = state.count(), 0
    while k < max_rounds and 2**k <= 2 * size and state.where("up is not null").limit(1).count():
        other = state.select(F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        state = settle(
            state.join(other, "up", "left").select("call_id", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        )
        k += 1
    return state.select("call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict | None = None) -> DataFrame:
    """calls (call_id, conv_id, position, tool, arguments, after) and results (call_id, position,
    content) to one row per call_id: conv_id, call_id, tool, depth, status, message."""
    schemas = SCHEMAS if schemas is None else schemas
    one = lambda df, *cols: df.where("call_id is not null").groupBy("call_id").agg(
        F.min_by(F.struct(*cols), F.struct("position", *cols)).alias("x")).select("call_id", "x.*")
    calls = settle(one(calls, "conv_id", "position", "tool", "arguments", "after"))
    results = one(results.withColumn("found", F.lit(True)), "content", "found").withColumnRenamed("found", "has_result")
    read, valid = F.try_parse_json("arguments"), F.lit(False)
    for tool, fields in schemas.items():
        ok = F.size(F.array_except(F.coalesce(F.json_object_keys("arguments"), F.array(F.lit(""))), F.array(*map(F.lit, fields)))) == 0
        for k, (kind, required) in fields.items():
            given = F.coalesce(F.schema_of_variant(F.try_variant_get(read, f"$.{k}", "variant")), F.lit("VOID"))
            ok = ok & given.rlike(f"^(?:{KINDS[kind]}{'' if required else '|VOID'})$")
        valid = F.when(F.col("tool") == tool, ok).otherwise(valid)
    linked = (
        calls.join(depths(calls).hint("shuffle_hash"), "call_id").withColumn("called", F.lit(True)).join(results, "call_id", "full")
        .withColumns({"canonical": F.to_json(read), "valid": F.coalesce(valid, F.lit(False))})
    )
    status = (
        F.when(F.col("called").isNull(), "no_call").when(F.col("tool").isNull() | ~F.col("tool").isin(*schemas), "unknown_tool").when(~F.col("valid"), "invalid")
        .when(F.col("depth").isNull(), "cycle").when(F.col("has_result").isNull(), "no_result").otherwise("ok")
    )
    message = F.to_json(F.struct(F.col("canonical").alias("arguments"), F.col("call_id").alias("id"), F.col("content").alias("result"), F.col("tool").alias("tool")))
    return linked.withColumn("status", status).select("conv_id", "call_id", "tool", "depth", "status", F.when(F.col("status") == "ok", message).alias("message"))


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn is a call (of the tool named by its turn), the next assistant turn its result."""
    talk = table(spark, sf_dir, "conversations")
    ident = lambda turn: F.concat_ws("-", F.col("conv_id"), turn)
    tool = F.when(F.col("turn") % 4 == 0, "answer").otherwise("reply")
    calls = talk.where("role = 'user'").select(
        ident(F.col("turn")).alias("call_id"), "conv_id", F.col("turn").alias("position"), tool.alias("tool"),
        F.to_json(F.struct("turn", F.col("text").alias("question"))).alias("arguments"), ident(F.col("turn") - 2).alias("after"),
    )
    results = talk.where("role = 'assistant'").select(ident(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("position"), F.col("text").alias("content"))
    return link_calls(calls, results)
