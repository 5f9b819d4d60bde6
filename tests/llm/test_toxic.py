import math
import random

import pytest
from pyspark.sql import functions as F

from crossload.llm import toxicity as tx

DOC = "doc_id long, text string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    plain = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(n))
    out = []
    for k in range(400):
        if k % 4 == 0:
            out.append((f"{plain(6)} vile {plain(6)}", 1))
        elif k % 4 == 1:
            out.append((f"{plain(6)} v1lest {plain(3)} vile", 1))
        elif k % 68 == 2:
            out.append((f"{plain(8)} vile bindweed {plain(5)}", 0))  # a name that a lexicon word is part of
        else:
            out.append((plain(15), 0))
    return out


@pytest.mark.parametrize("held", [tx.ENTRIES_HELD, 3])
def test_exception_phrases_are_learned_and_count(spark, rows, monkeypatch, held):
    monkeypatch.setattr(tx, "ENTRIES_HELD", held)
    model = tx.fit(spark.createDataFrame(rows, "text string, label int").repartition(2))
    assert " vile " in model["lexicon"] and "vile bindweed" in model["exceptions"]
    texts = [(0, "a vile thing"), (1, "the vile bindweed grows"), (2, "vile and vile bindweed"), (3, "VІLE thing"), (4, None), (5, ""), (6, "clean words")]
    got = {r.doc_id: r.score for r in tx.score(spark.createDataFrame(texts, DOC), model).collect()}
    assert got[1] == got[4] == got[5] == got[6] < got[0] and got[2] > got[1] and got[3] > got[6]


def test_counts_equal_a_loop(spark, rows, monkeypatch):
    monkeypatch.setattr(tx, "ENTRIES_HELD", 10)
    df = spark.createDataFrame(rows, "text string, label int")
    got = {r.entry: (r.clean, r.toxic) for r in tx.tally(df, lambda t: tx.entries(set(tx.fold(t)))).collect()}
    want: dict = {}
    for text, label in rows:
        for e in tx.entries(set(tx.fold(text))):
            want.setdefault(e, [0, 0])[label] += 1
    assert got == {e: tuple(v) for e, v in want.items()}


def test_scores_equal_a_loop(spark, rows):
    """The automaton's sums against a plain scan of words, on the given texts."""
    model = tx.fit(spark.createDataFrame(rows, "text string, label int"))

    def plain(text):
        words = tx.fold(text)
        if not words:
            return 0.0
        excused = {k + d for k in range(len(words) - 1) if f"{words[k]} {words[k + 1]}" in model["exceptions"] for d in (0, 1)}
        total = 0.0
        for k, w in enumerate(words):
            weights = [model["lexicon"][e] for e in tx.entries({w}) | {f" {w}"} if e in model["lexicon"]]  # a word is a prefix of itself
            total += max(weights, default=0.0) if k not in excused else 0.0
        return total / math.sqrt(len(words))

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).collect()
    texts = [(r.doc_id, r.text) for r in docs] + [(10**6 + k, t) for k, (t, _) in enumerate(rows)] + [(2 * 10**6, "vile " * 50_000)]
    got = {r.doc_id: r.score for r in tx.score(spark.createDataFrame(texts, DOC), model).collect()}
    for i, t in texts:
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(math.log1p(plain(t)) * model["slope"] + model["base"]))))


def test_query_holds_out_what_it_says(spark):
    path = "/root/testdata/sf0.001"
    got = tx.op6_toxicity(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert got.count() == docs.count() and got.where("score < 0 or score > 1 or score is null").count() == 0
    assert got.where((F.col("score") >= 0.7) != (F.col("predicted") == 1)).count() == 0
    assert got.where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string")) % 3 == 1)).count() == 0
