import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from crossload.llm import conversation_repair as cr

TURN = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute(rows):
    """One conversation, by trying every edit of every row."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    faults, seen = [], set()
    for _, _, role, text in rows:
        bare = text.strip(SPACES)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))

    def follows(state, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, initial))

    @functools.cache
    def best(k, state, free):
        tries = [(0, "", ())] if k == len(rows) and state in ("", "a") else []
        if free:
            tries += [(c + 2, "I" + a, (f"{name}:", *r)) for name in ("user", "assistant") if (nxt := follows(state, name[0])) for c, a, r in [best(k, nxt, free - 1)]]
        if k < len(rows):
            _, _, role, text = rows[k]
            c, a, r = best(k + 1, state, 2)
            tries.append((c + 3, "D" + a, r))
            if faults[k] not in ("blank", "duplicate"):
                late = faults[k] == "truncated"
                for letter, cost, name in (("K", 0, role), ("R", 2, "user"), ("R", 2, "assistant")):
                    if nxt := follows(state, name[:1]):
                        c, a, r = best(k + 1, nxt, 2)
                        tries.append((c + cost + late, letter + a, (f"{name}:{text}", *r)))
        return min(tries, default=(10**9, "", ()), key=lambda t: t[:2])

    cost, audit, repaired = best(0, "", 2)
    turns = [r[1] for r in rows if r[1] is not None]
    illegal = sum(x[2][:1] + y[2][:1] not in ("su", "ua", "au") for x, y in itertools.pairwise(rows))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal,
            cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())


def expected(rows):
    after = damaged(rows)
    return {conv: brute([r for r in after if r[0] == conv]) for conv in {r[0] for r in rows}}


def result(spark, tmp_path, rows):
    spark.createDataFrame(rows, TURN).withColumn("at", F.lit("clash")).write.parquet(f"{tmp_path}/conversations.parquet")
    got = cr.op12_conversation_repair(spark, str(tmp_path)).collect()
    assert len(got) == len({r[0] for r in rows})
    return {r.conv_id: tuple(r)[1:] for r in got}


def test_repair_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    texts = ["Yes.", "no", "", " \t", None, "Why?  ", "é!", "half a"]
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts))
            for c in range(150) for t in range(rng.randrange(1, 9)) if rng.random() < 0.9]
    rows += [(None, 0, "user", "Hi."), (None, 0, "user", "Hi."), (None, None, None, None), (900, 0, "user", "x" * 300_000 + ".")]
    rows += [(901, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(150)]
    assert result(spark, tmp_path, rows) == expected(rows)


def test_repair_of_the_given_table(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r.conv_id: tuple(r)[1:] for r in cr.op12_conversation_repair(spark, path).collect()} == expected(rows)


def test_repair_of_nothing(spark, tmp_path):
    assert result(spark, tmp_path, []) == {}
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "Hi.")]
    assert result(spark, tmp_path / "one", rows) == {dropped: (0, 0, 0, 0, 0, 0, "", cr.EMPTY)}


@pytest.mark.parametrize("length", [1, 2, 3, 4])
def test_audits_share_their_ends(length):
    """All signatures of a length: the walk in order of their ends gives what each gives alone."""
    walk = cr.Walk()
    for turned in sorted(map("".join, itertools.product("suaoSUAOx", repeat=length))):
        assert walk(turned) == cr.Walk()(turned)
