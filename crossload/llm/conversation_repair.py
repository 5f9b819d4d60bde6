"""Conversation structure repair over a suffix-shared automaton of role and fault signatures.

Each row of a conversation is one symbol: its role's initial (s, u, a or another), whether it is cut
short, or only that it must go. A conversation's symbols in order are its signature, and a node of the
automaton is a different rest of a signature, whoever has it: signatures are made distinct, turned
round, dealt by range and sorted, so that those with a common end are neighbours. A task walks its
range depth first and keeps the nodes of the present path; a node that the next signature shares is
not computed again. For each grammar state a node holds the cost to go and its best edit with the
edit's successor, which is the best audit suffix as a list that shares its tail with the nodes behind.
Only the path at the border of two ranges is met twice.

The grammar `(s?(ua)+)?` has four states, and in each of them an edit has one successor. So the
cheapest edits with the smallest letter at every step spell the smallest audit of that cost.

A conversation's order and its SHA-256 are sequential by nature: its rows pass through one task as a
sorted stream, without being held together; its signature and audit are one byte a row. Copies of a
signature are one node path; the join that gives each conversation its audit can be split.

Null roles and texts are one space, null ids and turns too in the key that damage() hashes; a null conv_id
is a conversation of its own. Rows of one turn stand in the order of role and text, equal rows side by
side. A role outside of s, u and a can't be kept, only given another role or deleted. Very long texts
are read whole, in one row's memory. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, settle, table

SPACE = r"\x20\x09-\x0D"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1  # costs: keep, another role, delete, insert, a row that stays cut short
START, AFTER_S, AFTER_U, AFTER_A = range(4)
FORCED = {START: "u", AFTER_S: "u", AFTER_U: "a", AFTER_A: "u"}  # what an edit that chooses a role must choose
STEP = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
ROLES = {"u": "user", "a": "assistant"}
MUST_GO = "x"
EMPTY = hashlib.sha256(b"").hexdigest()

# of a node and state: cost to go, and the best edits as (letter, rest) or None
Best = tuple[int, tuple | None]


def step(state: int) -> int:
    return STEP[state, FORCED[state]]


def with_inserts(best: list[Best]) -> list[Best]:
    """The states of a node, where an inserted row may come first. Of the two states that inserts lead to and fro
    between, at most one gains by it, so both look at the other without; the others come after them."""

    def least(s: int, then: list[Best]) -> Best:
        cost, edits = then[step(s)]
        return min(best[s], (INSERT + cost, ("I", edits)), key=lambda b: (b[0], b[1][0] if b[1] else ""))

    loop = [*best[:2], *(least(s, best) for s in (AFTER_U, AFTER_A))]
    return [*(least(s, loop) for s in (START, AFTER_S)), *loop[2:]]


END: list[Best] = with_inserts([(0, None), (10**9, None), (10**9, None), (0, None)])


def node(symbol: str, behind: list[Best]) -> list[Best]:
    """Cost to go and best edits of a node for each state, from those of the node behind it. A symbol is
    MUST_GO, or an initial, in upper case if the row is cut short."""
    out: list[Best] = []
    for s in range(4):
        tries = [(DELETE + behind[s][0], "D", behind[s][1])]
        if symbol != MUST_GO:
            late = CUT if symbol.isupper() else 0
            role = symbol.lower()
            if (s, role) in STEP:
                cost, edits = behind[STEP[s, role]]
                tries.append((KEEP + late + cost, "K", edits))
            cost, edits = behind[step(s)]
            tries.append((REROLE + late + cost, "R", edits))
        cost, letter, edits = min(tries, key=lambda t: t[:2])
        out.append((cost, (letter, edits)))
    return with_inserts(out)


def spelled(edits: tuple | None) -> str:
    letters = []
    while edits:
        letter, edits = edits
        letters.append(letter)
    return "".join(letters)


class Walk:
    """Cost and audit of one signature after the other. They come turned round and sorted, so that the nodes that
    one shares with the next are its common beginning; only the others are computed."""

    def __init__(self) -> None:
        self.last, self.path = "", [END]

    def __call__(self, turned: str) -> tuple[int, str]:
        same, most = 0, min(len(self.last), len(turned))
        while same < most and self.last[same] == turned[same]:
            same += 1
        del self.path[same + 1 :]
        for symbol in turned[same:]:
            self.path.append(node(symbol, self.path[-1]))
        self.last = turned
        cost, edits = self.path[-1][START]
        return cost, spelled(edits)


def audits(signatures: DataFrame) -> DataFrame:
    """signature (distinct) to signature, cost, audit."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Walk()
        for p in parts:
            turned = p.column(0).to_pylist()
            got = [walk(t) for t in turned]
            yield pa.RecordBatch.from_arrays(
                [pa.array([t[::-1] for t in turned], "string"), pa.array([g[0] for g in got], "int64"), pa.array([g[1] for g in got], "string")],
                ["signature", "cost", "audit"])

    dealt = signatures.select(F.reverse("signature").alias("turned")).repartitionByRange("turned").sortWithinPartitions("turned")
    return dealt.mapInArrow(run, "signature string, cost long, audit string")


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with one row in four damaged by the hash of its key: 0 drops it, 1 empties its text,
    2 takes its closing marks, 3 repeats it, 4 makes it the user's."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    own = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    changed = own.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"))
    return changed.drop("copy")


def flagged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, at (place in the conversation), fault (null, blank, duplicate or truncated), symbol,
    clash (whether its role can't follow the one before), fresh (whether its turn is new)."""
    dealt = turns.repartition("conv_id")  # the two windows below need no other deal
    again = Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text", "nth")
    first = F.substring("role", 1, 1)
    fault: Column = (
        F.when(~F.col("text").rlike(f"[^{SPACE}]"), "blank").when(F.col("nth") > 1, "duplicate")
        .when(~F.col("text").rlike(rf"[.!?][{SPACE}]*\z"), "truncated"))
    initial = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    symbol = (
        F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", F.upper(initial)).otherwise(initial))
    return (
        dealt.withColumn("nth", F.row_number().over(again))
        .withColumn("fault", fault).withColumn("symbol", symbol)
        .withColumn("at", F.row_number().over(order))
        .withColumn("clash", (F.col("at") > 1) & ~F.concat(F.lag(first).over(order), first).isin("su", "ua", "au"))
        .withColumn("fresh", F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(order)))
        .select("conv_id", "turn", "role", "text", "at", "fault", "symbol", "clash", "fresh"))


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of turns."""
    rows = settle(flagged(turns))
    count = lambda c: F.count(F.when(c, 1))
    found = settle(
        rows.groupBy("conv_id").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - count(F.col("fresh")), F.lit(0)).cast("long").alias("gaps"),
            *(count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")), count(F.col("clash")).alias("illegal"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "symbol"))), lambda x: x["symbol"]), "").alias("signature")))
    best = settle(audits(found.select("signature").distinct()))
    fixed = found.join(best, "signature").drop("signature")

    # a conversation's head, with its audit, comes before its rows
    null = lambda kind: F.lit(None).cast(kind)
    heads = fixed.select("conv_id", F.lit(0).alias("at"), "audit", null("string").alias("role"), null("string").alias("text"),
                         F.struct("gaps", "blank", "duplicate", "truncated", "illegal", "cost").alias("numbers"))
    numbers = heads.schema["numbers"].dataType
    body = rows.select("conv_id", "at", null("string").alias("audit"), "role", "text", F.lit(None).cast(numbers).alias("numbers"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "numbers", "audit", "repaired_sha256"]
        head, made, place, state, empty = None, None, 0, START, True

        def put(role: str, text: str) -> None:
            nonlocal empty
            made.update((f"{role}:{text}" if empty else f"\n{role}:{text}").encode())
            empty = False

        def inserted() -> None:
            nonlocal place, state
            while head[2][place : place + 1] == "I":
                put(ROLES[FORCED[state]], "")
                state, place = step(state), place + 1

        for p in parts:
            out = []
            for conv, audit, role, text, numbers in zip(*(p.column(k).to_pylist() for k in (0, 2, 3, 4, 5))):
                if audit is not None:
                    if head:
                        out.append((*head, made.hexdigest()))
                    head, made, place, state, empty = (conv, numbers, audit), hashlib.sha256(), 0, START, True
                else:
                    edit = head[2][place]
                    place += 1
                    if edit == "K":
                        put(role, text)
                        state = STEP[state, role[0]]
                    elif edit == "R":
                        put(ROLES[FORCED[state]], text)
                        state = step(state)
                inserted()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (p.schema.types[0], p.schema.types[5], "string", "string"))], names)
            kinds = p.schema.types
        if head:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*head, made.hexdigest()), (kinds[0], kinds[5], "string", "string"))], names)

    kind = turns.schema["conv_id"].dataType.simpleString()
    done = settle(
        heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "at")
        .mapInArrow(run, f"conv_id {kind}, numbers {numbers.simpleString()}, audit string, repaired_sha256 string")
        .select("conv_id", "numbers.*", "audit", "repaired_sha256"))
    drop(rows, found, best)
    return done


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of which no row is left after the damage have zeros, an empty audit and the hash of nothing."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = repair(damage(turns))
    ids = turns.select(F.col("conv_id").alias("id")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return ids.join(done, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("id").alias("conv_id"), *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256"))
