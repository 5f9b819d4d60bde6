import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossload.llm import minhash_dedup, ngram_join

DOC = "doc_id long, text string"


def brute(rows, n=3, percent=85):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    by, top = {}, list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for k, s in enumerate(sets):
        for g in s:
            by.setdefault(g, set()).add(k)
    for k, s in enumerate(sets):
        for m in {m for g in s for m in by[g] if m < k}:
            both = len(s & sets[m])
            if 100 * both >= percent * (len(s) + len(sets[m]) - both):
                a, b = sorted((find(k), find(m)))
                top[b] = a
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    return sorted(((d, len(sets[k]), c := least.get(find(k)), d is not None and d == c) for k, (d, _) in enumerate(rows)), key=str)


def family(rng, size, copies, edits):
    words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    for _ in range(copies):
        w = list(words)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(size)] = f"v{rng.randrange(10**6)}"
        yield " ".join(w)


def made():
    rng = random.Random(1)
    texts = [None, "", " \t", "one", "ONE", "one two", "a b c", "A b c d", "same text again here", "same text again here"]
    for size, copies, edits in ((300, 40, 14), (60, 30, 3), (8, 10, 1), (120, 60, 12)):
        texts += family(rng, size, copies, edits)
    texts += [f"w{k} " * 3 for k in range(30)] + ["long " + " ".join(map(str, range(40_000)))] * 2
    rows = list(enumerate(texts))
    return [*rows, (3, "one other text of this id"), (None, texts[20]), (None, "nobody else has this text"), (None, "nor does anyone have this one")]


def got(df, **kw):
    done = minhash_dedup.link(df, **kw).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return sorted((tuple(r) for r in done.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


@pytest.mark.parametrize("crowd", [minhash_dedup.CROWD, 0])
def test_minhash_equals_brute_force(spark, crowd):
    rows = made()
    df = spark.createDataFrame(rows, DOC).withColumns({"sid": F.lit("clash"), "rep": F.lit(1), "halves": F.lit(2)})
    assert got(df, crowd=crowd) == brute(rows)
    assert got(df.limit(0)) == []


def test_tables_join_what_the_diagonal_leaves(spark, monkeypatch):
    """Without the first step all links come from the tables."""
    rows = made()
    df = spark.createDataFrame(rows, DOC)
    monkeypatch.setattr(minhash_dedup, "diagonal", lambda classes: classes.select(F.lit(1).alias("key"), "rep", F.lit(1).alias("often")).limit(0))
    assert got(df, crowd=10**6) == brute(rows)


def test_minhash_of_the_given_table(spark):
    path = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in minhash_dedup.op13_minhash_dedup(spark, path).collect()), key=str) == brute(rows)


def test_recall_of_the_tables():
    """Sets at the threshold meet in a table, and halves agree as often as they should."""
    rng, met, agree = np.random.default_rng(2), 0, 0
    for _ in range(300):
        x = rng.integers(0, 2**63, 200, dtype="uint64")
        y = np.concatenate([x[:184], rng.integers(0, 2**63, 16, dtype="uint64")])  # 184 of 216
        same = (minhash_dedup.halves(x) == minhash_dedup.halves(y)).reshape(2, -1)
        met += same[0].any() and same[1].any()
        agree += same.mean() / 300
    assert met == 300
    assert abs(agree - (184 / 216) ** minhash_dedup.WIDTH) < 0.02


def test_slices_follow_the_texts():
    import pyarrow as pa

    sizes = [1, 5_000_000, 3, None, 2_500_000, 2_500_000] + [1] * 4500
    batch = pa.RecordBatch.from_arrays([pa.array([None if n is None else "x" * n for n in sizes], "string")], ["t"])
    assert [p.num_rows for p in ngram_join.slices(iter([batch]), 0)] == [1, 1, 3, 1, 2000, 2000, 500][:2] + [3] + [2000, 2000, 501][:3]
