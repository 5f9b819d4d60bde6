import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from crossload.operators import matching, records

KEYED = "id string, e string, p string, nk string, ak string"


@pytest.mark.parametrize("at_once", [1000, 7, 1])
def test_split_join_makes_every_pair_once(spark, at_once):
    rng = random.Random(1)
    left = [(f"l{k}", rng.choice(["hot"] * 5 + ["a", "b", None]), rng.randrange(2)) for k in range(120)]
    right = [(f"r{k}", rng.choice(["hot"] * 3 + ["a", "c", None]), rng.randrange(2)) for k in range(90)]
    a = spark.createDataFrame(left, "id string, k string, n int")
    b = spark.createDataFrame(right, "other string, k string, n int")
    got = sorted((r.id, r.other) for r in records.split_join(a, b, ["k", "n"], "id", "other", at_once).collect())
    assert got == sorted((x[0], y[0]) for x in left for y in right if x[1] is not None and x[1:] == y[1:])


def test_a_crowded_phone_is_joined_in_parts(spark):
    """10,000 contacts with one phone, of whom five also share an e-mail, against the same table at the destination."""
    n = 10_000
    people = spark.range(n).select(F.concat(F.lit("c"), "id").alias("id"), F.when(F.col("id") < 5, "same@x.y").alias("e"), F.lit("+15550001111").alias("p"), F.lit(None).cast("string").alias("nk"), F.lit(None).cast("string").alias("ak"))
    few = people.limit(40)
    pairs = records.candidates(few, people, [["e"], ["p"], ["nk", "ak"]])
    assert pairs.count() == 40 * (n - 1)
    sizes = [r[0] for r in records.split_join(few.select("id", "p"), people.select(F.col("id").alias("other"), "p"), ["p"], "id", "other").groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 40 * n
    alone = people.limit(600)
    turned = records.candidates(alone, alone, [["e"], ["p"]], 100)
    assert turned.count() == 600 * 599 == turned.distinct().count()


def test_planted_tiers(spark):
    new = [
        ("mail", "a@x.y", "+15550000001", "ana ito", "1oak|1"), ("phone", "b@x.y", "+15550000002", "ben ito", "2oak|2"), ("both", None, "+15550000003", "carla reyes", "3oak|3"),
        ("digits", None, "+15550000004", "dora reyes", None), ("typo", None, None, "maria gonzales", "12oak|12345"), ("far", None, "+15551234567", "jon smith", "1elm|11111"),
        ("short", None, None, "xy", "5oak|5"), ("none", "z@x.y", "+15559999999", "nobody here", "99oak|99"), ("empty", None, None, None, None)]
    old = [
        ("o1", "a@x.y", None, None, None), ("o2", "a@x.y", "+15550000001", None, None), ("o3", "other@x.y", "+15550000002", None, None), ("o4", None, None, "carla reyes", "3oak|3"),
        ("o5", None, "+445550000004", "dora reyes", "4oak|4"), ("o6", None, None, "maria gonzalez", "12oak|12345"), ("o7", None, "+445551234567", "john smith", "1elm|22222"), ("o8", None, None, "xy", "5oak|5")]
    got = {r.id: (r.tier, r.action, r.other, r.confidence and round(r.confidence, 6)) for r in matching.actions(spark.createDataFrame(new, KEYED), spark.createDataFrame(old, KEYED)).collect()}
    # 13 of 14 letters agree, four at the front: 0.6 * 0.971429 + 0.3; 9 of 9 and 10: 0.6 * 0.973333 + 0.2 * 0.8 + 0.2
    assert got == {
        "mail": (2, "UPDATE_EXISTING", "o1", 0.99), "phone": (2, "UPDATE_EXISTING", "o3", 0.99), "both": (3, "REVIEW", "o4", 0.9), "digits": (3, "REVIEW", "o5", 0.85),
        "typo": (4, "REVIEW", "o6", 0.882857), "far": (4, "REVIEW", "o7", 0.944), "short": (4, "REVIEW", "o8", 0.9), "none": (None, "CREATE_NEW", None, None), "empty": (None, "CREATE_NEW", None, None)}


def test_bounds_pass_no_similarity(spark):
    rng, pairs = random.Random(6), []
    for _ in range(3000):
        a = "".join(rng.choice("abcd e") for _ in range(rng.randrange(0, 12)))
        b = list(a)
        for _ in range(rng.randrange(5)):
            b.insert(rng.randrange(len(b) + 1), rng.choice("abcdxyz"))
        rng.random() < 0.3 and rng.shuffle(b)
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame([*pairs, ("same", "same"), (None, "x")], "a string, b string")
    for r in df.select("a", "b", matching.at_most("a", "b").alias("most")).collect():
        if r.a is None:
            assert r.most is None
        else:
            assert matching.jaro_winkler(r.a, r.b) <= r.most + 1e-9, r


def test_fuzzy_equals_all_pairs_of_its_blocks(spark):
    rng = random.Random(8)
    names = ["ana maria ito", "ben novak", "carla reyes", "dora brown"]

    def person(k):
        name = list(rng.choice(names))
        for _ in range(rng.randrange(3)):
            name[rng.randrange(len(name))] = rng.choice("abcdef ")
        return (k, None, rng.choice([None, f"+1555000{rng.randrange(30):04d}"]), "".join(name).strip() or None, rng.choice([None, f"{rng.randrange(4)}oak|1000{rng.randrange(3)}"]))

    new, old = [person(f"n{k:03d}") for k in range(120)], [person(f"o{k:03d}") for k in range(100)]

    def blocks(r):
        out = set()
        if r[2]:
            out |= {"p:" + r[2], "7:" + r[2][-7:]}
        if r[4]:
            out.add("a:" + r[4])
        return out

    sound = defaultdict(set)
    for r in spark.createDataFrame(new + old, KEYED).transform(matching.blocks).collect():
        sound[r.id].add(r.block)
    want = {}
    for x in new:
        assert blocks(x) <= sound[x[0]]
        scored = []
        for y in old:
            if sound[x[0]] & sound[y[0]]:
                score = 0.6 * matching.jaro_winkler(x[3], y[3]) if x[3] and y[3] else 0.0
                score += (0.3 if x[4] == y[4] else 0.2 * matching.jaro_winkler(x[4], y[4])) if x[4] and y[4] else 0.0
                score += 0.2 if x[2] and y[2] and x[2][-7:] == y[2][-7:] else 0.0
                if min(score, 0.98) >= matching.FUZZY_LEAST:
                    scored.append((-min(score, 0.98), y[0]))
        if scored:
            want[x[0]] = min(scored)
    got = {r.id: (-r.confidence, r.other) for r in matching.fuzzy(spark.createDataFrame(new, KEYED), spark.createDataFrame(old, KEYED)).collect()}
    assert got.keys() == want.keys() and len(got) > 20
    assert all(got[k][0] == pytest.approx(want[k][0]) for k in got)
