"""Finding the destination record that an incoming contact already is, in tiers of certainty.

All signals of certainty are one equi-join on exploded keys, the blocks of the uncertain tier others. Of the records
at the destination that a contact can't tell apart only the first by id can win, so each stands for its likes: a join
grows with what differs, not with how often it is there. Crowded blocks are joined in parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.folders import written
from .records import split_join

FUZZY_LEAST = 0.72
BLOCK_WARNING = 1000


def phone7(c: str) -> Column:
    return F.when(F.length(c) >= 7, F.right(F.col(c), F.lit(7)))


def signals(df: DataFrame) -> DataFrame:
    """id, tier, place, key: what makes two contacts the same for sure (tier 2), or most likely (3), the better first."""
    named = F.when(F.length("nk") >= 3, F.col("nk"))
    each = [(2, 0, F.col("e")), (2, 1, F.col("p")), (3, 0, F.concat(named, F.lit("|"), "ak")), (3, 1, F.concat(named, F.lit("|"), phone7("p")))]
    parts = F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(n).alias("place"), F.when(k != "", k).alias("key")) for t, n, k in each])
    return df.select("id", F.explode(parts).alias("s")).select("id", "s.*").where("key is not null")


def sure(incoming: DataFrame, existing: DataFrame, tiers: tuple[int, ...] = (2, 3)) -> DataFrame:
    """id, other, tier, matched_on, confidence of the incoming contacts that another one equals in e-mail, else
    phone (tier 2), else in name with address, else in name with the last seven digits (3): one join for all signals."""
    of = lambda df: signals(df).where(F.col("tier").isin(*tiers))
    side = of(existing).groupBy("tier", "place", "key").agg(F.min("id").alias("other"))
    pairs = of(incoming).join(side, ["tier", "place", "key"])
    found = pairs.groupBy("id").agg(F.min(F.struct("tier", "place", "other")).alias("m")).select("id", "m.*")
    on = F.when(F.col("tier") == 2, F.when(F.col("place") == 0, "email").otherwise("phone")).otherwise(F.when(F.col("place") == 0, "name and address").otherwise("name and digits"))
    confidence = F.when(F.col("tier") == 2, 0.99).otherwise(F.when(F.col("place") == 0, 0.9).otherwise(0.85))
    return found.select("id", "other", "tier", on.alias("matched_on"), confidence.alias("confidence"))


def exact(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Tier 2: id, other, matched_on, confidence."""
    return sure(incoming, existing, (2,)).drop("tier")


def combined(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Tier 3: id, other, confidence."""
    return sure(incoming, existing, (3,)).select("id", "other", "confidence")


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, and a tenth of what lacks for each of up to four first letters in common, at any score."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    gap = "\0"  # stands for letters of b that are taken
    while gap in a:
        gap = chr(ord(gap) + 1)
    reach, rest, hits, taken = max(0, max(len(a), len(b)) // 2 - 1), b, [], []
    for i, c in enumerate(a):
        at = rest.find(c, max(0, i - reach), i + reach + 1)
        if at >= 0:
            rest = rest[:at] + gap + rest[at + 1:]
            hits.append(c)
            taken.append(at)
    if not hits:
        return 0.0
    m, other = len(hits), [b[k] for k in sorted(taken)]
    jaro = (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(hits, other)) / 2) / m) / 3
    prefix = next((k for k in range(4) if k >= min(len(a), len(b)) or a[k] != b[k]), 4)
    return jaro + prefix * 0.1 * (1 - jaro)


def similarity(a: str, b: str) -> Column:
    @F.pandas_udf("double")
    def measure(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for some, others in pairs:
            known: dict = {}  # names and addresses repeat within a batch
            out = []
            for pair in zip(some, others):
                if pair not in known:
                    known[pair] = None if pair[0] is None or pair[1] is None else jaro_winkler(*pair)
                out.append(known[pair])
            yield pd.Series(out, dtype="float64")

    return measure(a, b)


def at_most(a: str, b: str) -> Column:
    """A bound that no Jaro-Winkler similarity of two columns passes: at most so many letters agree as each has in
    common with the other."""
    x, y = F.col(a), F.col(b)
    shared = lambda p, q: F.length(p) - F.length(F.call_function("translate", p, q, F.lit("")))
    hits = F.least(shared(x, y), shared(y, x))
    jaro = F.when((x == "") | (y == ""), F.when(x == y, 1.0).otherwise(0.0)).otherwise((hits / F.length(x) + hits / F.length(y) + 1) / 3)
    jaro = F.when(hits == 0, 0.0).otherwise(jaro)
    head = lambda n: (F.substring(x, 1, n) == F.substring(y, 1, n)) & (F.length(x) >= n) & (F.length(y) >= n)
    prefix = F.when(head(4), 4).when(head(3), 3).when(head(2), 2).when(head(1), 1).otherwise(0)
    return F.when(x == y, 1.0).otherwise(jaro + prefix * 0.1 * (1 - jaro))


def blocks(df: DataFrame, *keep: str) -> DataFrame:
    """id, the columns in keep, block: the keys under which a contact may meet another one."""
    last = F.element_at(F.split("nk", " "), -1)
    keys = F.array(
        F.concat(F.lit("e:"), "e"), F.concat(F.lit("p:"), "p"), F.concat(F.lit("7:"), phone7("p")), F.concat(F.lit("n:"), "nk", F.lit("|"), "ak"),
        F.concat(F.lit("a:"), "ak"), F.concat(F.lit("s:"), F.soundex(last), F.substring_index("ak", "|", -1)))
    return df.select("id", *keep, F.explode(F.array_distinct(F.array_compact(keys))).alias("block"))


def block_sizes(df: DataFrame, warn: int = BLOCK_WARNING) -> DataFrame:
    """block, n, oversize of blocks with several contacts: reported, never cut."""
    return blocks(df).groupBy("block").agg(F.count("*").alias("n")).where("n > 1").withColumn("oversize", F.col("n") > warn)


def scores(pairs: DataFrame, least: float) -> DataFrame:
    """pairs (nk, ak, s and o_nk, o_ak, o_s: name, address and last digits) with their confidence, where it is enough.
    Pairs whose bounds cannot reach the least score are dropped before any letters are compared; the rest are spread evenly,
    as comparing letters takes longer than finding pairs."""
    digits = F.when(F.col("s") == F.col("o_s"), 0.2).otherwise(0.0)
    place_most = F.when(F.col("ak") == F.col("o_ak"), 0.3).otherwise(F.coalesce(at_most("ak", "o_ak") * 0.2, F.lit(0.0)))
    name_most = F.coalesce(at_most("nk", "o_nk") * 0.6, F.lit(0.0))
    able = pairs.where(name_most + place_most + digits >= least - 1e-9).repartition("nk", "ak", "o_nk", "o_ak")
    name = F.coalesce(similarity("nk", "o_nk") * 0.6, F.lit(0.0))
    place = F.when(F.col("ak") == F.col("o_ak"), 0.3).otherwise(F.coalesce(similarity("ak", "o_ak") * 0.2, F.lit(0.0)))
    return able.withColumn("confidence", F.least(name + place + digits, F.lit(0.98))).where(F.col("confidence") >= least)


def best(scored: DataFrame, *by: str) -> DataFrame:
    """The pair of the highest confidence for each value of by, of the smallest other where several have it."""
    return scored.groupBy(*by).agg(F.min(F.struct((-F.col("confidence")).alias("less"), "other")).alias("m")).select(
        *by, "m.other", (-F.col("m.less")).alias("confidence"))


def fuzzy(incoming: DataFrame, existing: DataFrame, least: float = FUZZY_LEAST) -> DataFrame:
    """Tier 4: id, other, confidence of contacts alike in name, address and last digits; for review only. The best of all
    pairs that share a block, found in two joins. Blocks of e-mails and phones join contacts. Blocks of addresses and
    sounds join each name with its address once: but for equal digits, which share a block of phones, a score depends on
    nothing else. Both sides are keyed tables, written already: they are read several times."""
    alike = ["nk", "ak", "s"]

    def pairs(new: DataFrame, old: DataFrame) -> DataFrame:
        first = written(old.groupBy("block", *alike).agg(F.min("id").alias("other")), "blocks")
        return split_join(new, first.select("block", "other", *[F.col(c).alias(f"o_{c}") for c in alike]), ["block"], "id", "other")

    own = F.col("block").startswith("e:") | F.col("block").startswith("7:") | (F.col("block").startswith("p:") & F.col("s").isNull())
    of = lambda df: blocks(df.withColumn("s", phone7("p")), *alike).where(own)
    direct = scores(pairs(of(incoming), of(existing)), least)
    no = F.lit(None).cast("string")
    shapes = lambda df: written(df.groupBy("nk", "ak").agg(F.min("id").alias("id")).withColumns({"e": no, "p": no, "s": no}), "shapes")
    # a block of a name with its address lies within that of the address
    met = lambda df: blocks(shapes(df), *alike).where(~F.col("block").startswith("n:"))
    by_shape = best(scores(pairs(met(incoming), met(existing)), least), "nk", "ak").withColumnsRenamed({"nk": "f_nk", "ak": "f_ak"})
    same = F.col("nk").eqNullSafe(F.col("f_nk")) & F.col("ak").eqNullSafe(F.col("f_ak"))
    spread = incoming.select("id", "nk", "ak").join(by_shape, same)
    columns = ["id", "other", "confidence"]
    return best(direct.select(columns).unionByName(spread.select(columns)), "id")


def actions(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """id, tier, action, other, confidence of every incoming contact: its surest tier decides. Both sides are keyed
    tables (id, e, p, nk, ak), written already: their keys are read several times."""
    first = written(sure(incoming, existing).select("id", "tier", "other", "confidence"), "sure")
    left = written(incoming.join(first, "id", "left_anti"), "left")
    found = first.unionByName(fuzzy(left, existing).select("id", F.lit(4).alias("tier"), "other", "confidence"))
    action = F.when(F.col("tier") == 2, "UPDATE_EXISTING").when(F.col("tier") > 2, "REVIEW").otherwise("CREATE_NEW")
    return incoming.select("id").join(found, "id", "left").withColumn("action", action)


def decide(actions: DataFrame, decisions: DataFrame) -> DataFrame:
    """actions (id, action, other) under the reviewed decisions (source_id, decision, target)."""
    made = decisions.where("status = 'REVIEWED'").select(F.col("source_id").alias("id"), "decision", "target")
    result = F.when(F.col("decision") == "SKIP", "SKIPPED").when(F.col("decision") == "MERGE", "MERGE").when(F.col("decision") == "CREATE_NEW", "CREATE_NEW")
    return actions.join(made, "id", "left").select(
        "id", F.coalesce(result, "action").alias("action"), F.when(result == "MERGE", F.col("target")).when(result.isNull(), F.col("other")).alias("other"))


def review_queue(actions: DataFrame, queue: DataFrame) -> DataFrame:
    """Contacts to review that the queue (id) does not hold yet, with their warning."""
    return actions.where("action = 'REVIEW'").join(queue.select("id"), "id", "left_anti").select(
        "id", "other", "confidence", F.lit("DUPLICATE_REVIEW_REQUIRED").alias("warning"), F.lit("SKIPPED").alias("state"))
