"""Matching contacts of whom many are alike: joins grow with what differs."""

import random

import pytest

from crossload.operators import matching

KEYED = "id string, e string, p string, nk string, ak string"


def counted(monkeypatch):
    """The numbers of pairs that the joins of blocks make."""
    made, join = [], matching.split_join

    def counting(*args, **kwargs):
        out = join(*args, **kwargs)
        made.append(out.count())
        return out

    monkeypatch.setattr(matching, "split_join", counting)
    return made


def test_alike_contacts_are_compared_once(spark, monkeypatch):
    """400 new and 300 old contacts of two names at two addresses, each with a phone of its own; one phone is shared."""
    made = counted(monkeypatch)
    names = [("maria gonzales", "maria gonzalez"), ("jon smith", "john smith")]
    new = [(f"n{k:03d}", f"n{k}@x.y", f"+1555{k:07d}", names[k % 2][0], f"{k % 2}oak|12345") for k in range(400)]
    old = [(f"o{k:03d}", f"o{k}@x.y", f"+1556{5000 + k:07d}", names[k % 2][1], f"{k % 2}oak|12345") for k in range(300)]
    old.append(("o998", None, "+445550000007", "john smith", "9elm|99999"))
    got = {r.id: (r.other, round(r.confidence, 6)) for r in matching.fuzzy(spark.createDataFrame(new, KEYED), spark.createDataFrame(old, KEYED)).collect()}
    # 13 of 14 letters and 9 of 9 and 10 agree: 0.6 * 0.971429 + 0.3 and 0.6 * 0.973333 + 0.3
    assert got == {f"n{k:03d}": (f"o00{k % 2}", (0.882857, 0.884)[k % 2]) for k in range(400)}
    assert sum(made) <= 8  # 400 * 300 / 2 pairs share an address


def test_one_key_of_all_is_joined_with_one(spark, monkeypatch):
    made = counted(monkeypatch)
    new = spark.createDataFrame([(f"n{k:03d}", "info@x.y", "+15550000000", None, None) for k in range(400)], KEYED)
    old = spark.createDataFrame([(f"o{k:03d}", "info@x.y", "+15550000000", None, None) for k in range(300)], KEYED)
    got = matching.sure(new, old).collect()
    assert len(got) == 400 and {(r.other, r.matched_on) for r in got} == {("o000", "email")}
    assert sum(made) <= 400


@pytest.mark.parametrize("seed", [1, 2])
def test_the_best_pair_of_all_that_share_a_block(spark, seed):
    """Against a loop over all pairs, with the first id of those of equal confidence; some rows lack some keys."""
    rng = random.Random(seed)
    some = lambda *values: rng.choice([None, *values])

    def people(letter, n):
        return [(f"{letter}{k:03d}", some("a@x", "b@x", "c@x"), some("+1555", *(f"+1555000{d:04d}" for d in range(9))), some("ana ito", "ana itoh", "anna ito", "ben novak", "ben nowak"),
                 some(*(f"{d}oak|1000{d % 2}" for d in range(4)))) for k in range(n)]

    new, old = people("n", 80), people("o", 70)
    rng.shuffle(old)
    held = {}
    for r in matching.blocks(spark.createDataFrame(new + old, KEYED)).collect():
        held.setdefault(r.id, set()).add(r.block)
    seven = lambda p: p[-7:] if p and len(p) >= 7 else None
    want = {}
    for x in new:
        scored = []
        for y in old:
            if held.get(x[0], set()) & held.get(y[0], set()):
                score = matching.jaro_winkler(x[3], y[3]) * 0.6 if x[3] and y[3] else 0.0
                score += (0.3 if x[4] == y[4] else matching.jaro_winkler(x[4], y[4]) * 0.2) if x[4] and y[4] else 0.0
                score = min(score + (0.2 if seven(x[2]) and seven(x[2]) == seven(y[2]) else 0.0), 0.98)
                if score >= matching.FUZZY_LEAST:
                    scored.append((-score, y[0]))
        if scored:
            want[x[0]] = min(scored)
    got = {r.id: (-r.confidence, r.other) for r in matching.fuzzy(spark.createDataFrame(new, KEYED), spark.createDataFrame(old, KEYED)).collect()}
    assert got == want and len(got) > 30
