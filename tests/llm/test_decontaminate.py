import random

import pytest
from pyspark.sql import functions as F

from crossload.llm import decontaminate as dc

DOC = "doc_id long, text string"
ITEM = "item_id long, text string"


def prose(rng, n, words=3000):
    """Words of a skewed distribution, so that some are in every text."""
    return [f"w{int(words * rng.random() ** 3)}" for _ in range(n)]


def edited(rng, words, share):
    return [f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def tests():
    rng = random.Random(11)
    return [(k, prose(rng, rng.randrange(25, 60))) for k in range(120)]


@pytest.mark.parametrize("share", [0.0, 0.1, 0.2, 0.3, "fifth"])
def test_recall_of_edited_copies(spark, tests, share):
    """Of copies that the alignment itself accepts, at least nine of ten are found, and no clean document is."""
    rng = random.Random(5)
    docs, truth = [], {}
    for k, item in tests:
        copy = [f"x{rng.randrange(10**6)}" if n % 5 == 2 else w for n, w in enumerate(item)] if share == "fifth" else edited(rng, item, share)
        number = {w: n for n, w in enumerate(dict.fromkeys(item))}
        score = dc.align(dc.np.array([number.get(w, -1) for w in copy]), dc.np.array([number[w] for w in item])) / (dc.MATCH * len(item))
        if score >= dc.LEAK:
            truth[k] = k
        docs.append((k, " ".join(prose(rng, 150) + copy + prose(rng, 80))))
    docs += [(1000 + k, " ".join(prose(rng, 300))) for k in range(400)]
    found = dc.matches(spark.createDataFrame(docs, DOC), spark.createDataFrame([(k, " ".join(w)) for k, w in tests], ITEM)).where(f"score >= {dc.LEAK}").collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert all(d == i for d, i in got)
    assert len(truth) > (100 if share != 0.3 else 40)
    assert len(got & set(truth.items())) >= 0.9 * len(truth)


@pytest.mark.parametrize("small", [True, False])
def test_hits_and_scores_equal_brute_force(spark, tests, small, monkeypatch):
    if not small:
        monkeypatch.setattr(dc, "BROADCAST_SEEDS", 0)
        monkeypatch.setattr(dc, "BROADCAST_WINDOWS", 0)
    rng = random.Random(9)
    docs = [(k, " ".join(prose(rng, 60) + edited(rng, item, 0.1) + prose(rng, 60))) for k, item in tests[:15]]
    docs += [(20, None), (21, ""), (22, "..."), (23, docs[3][1]), (3, docs[3][1]), (None, docs[4][1]), (24, " ".join(prose(rng, 60_000) + tests[0][1]))]
    items = [(k, " ".join(w)) for k, w in tests[:15]] + [(50, None), (51, ""), (52, "lone"), (None, " ".join(tests[5][1])), (53, " ".join(tests[6][1]))]
    docs.append((25, "here is a lone word"))
    df = spark.createDataFrame(docs, DOC).withColumns({"row": F.lit(1), "h": F.lit(2), "item_id": F.lit(3)})
    got = {(r.doc_id, r.item_id): round(r.score, 9) for r in dc.matches(df, spark.createDataFrame(items, ITEM)).where("score >= 0.5").collect()}
    want = {}
    for d, text in docs:
        for i, item in items:
            test = dc.words(item)
            if test and dc.words(text):
                number = {w: n for n, w in enumerate(dict.fromkeys(test))}
                score = dc.align(dc.np.array([number.get(w, -1) for w in dc.words(text)]), dc.np.array([number[w] for w in test])) / (dc.MATCH * len(test))
                if score >= 0.5:
                    want[d, i] = round(score, 9)
    assert got == want


def test_query_keeps_ties_and_nothing(spark, tmp_path, tests):
    text = " ".join(tests[0][1])
    spark.createDataFrame([(1, text), (2, "clean words only")], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(9, text), (4, text)], ITEM).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [tuple(r) for r in dc.op5_decontaminate(spark, str(tmp_path)).collect()] == [(1, 4, 1.0, True, 2)]
    assert dc.matches(spark.createDataFrame([], DOC), spark.createDataFrame([(1, "a b c")], ITEM)).count() == 0
    assert dc.matches(spark.createDataFrame([(1, text)], DOC), spark.createDataFrame([], ITEM)).count() == 0
    kept = dc.stage_decontaminate(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert [r.doc_id for r in kept.collect()] == [2]
