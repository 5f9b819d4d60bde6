import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from crossload.llm import spelling

DOC = "doc_id long, text string"


def brute(rows):
    n = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    by = collections.defaultdict(set)  # by what is left without one letter
    for w in n:
        by[w].add(w)
        for k in range(len(w)):
            by[w[:k] + w[k + 1 :]].add(w)
    near = collections.defaultdict(set)
    for group in by.values():
        for a in group:
            near[a] |= {b for b in group if a != b and one_edit(a, b)}
    out = {}
    for w, k in n.items():
        best = min(near[w], key=lambda b: (-n[b], b), default=None)
        out[w] = best if best and n[best] >= 5 * k else None
    rows = set()
    for w, k in n.items():
        root = w
        while out[root]:
            root = out[root]
        rows.add((w, out[w], root, k, len(near[w]), n[out[w]] if out[w] else None))
    return rows


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(a == b[:k] + b[k + 1 :] for k in range(len(b)))


def made(seed=5):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abeioTéÀÿnst×") for _ in range(rng.randrange(5, 11))) for _ in range(60)] + ["q" * 300]
    words = []
    for s in stems:
        words += [s] * 30
        for _ in range(6):
            k, kind = rng.randrange(len(s)), rng.randrange(3)
            words += [s[:k] + rng.choice(["", rng.choice("abeé")]) + s[k + (kind > 0) :]] * rng.choice([5, 6, 30, 200])
    rng.shuffle(words)
    rows = [(d, " ".join(words[d::40]) + rng.choice(["", "  € ", "\n1", "日本abcdef"])) for d in range(40)]
    return [*rows, (None, "Nullid nullid " * 9), (50, None), (51, ""), (50, "again tiedab tiedac tiedad " * 6), (50, "again tiedab tiedac tiedad " * 6)]


def result(spark, path, rows, **kw):
    spark.createDataFrame(rows, DOC).withColumns({"word": F.lit(1), "n": F.lit(1)}).write.parquet(f"{path}/documents.parquet")
    got = spelling.op11_spelling_variants(spark, str(path)).collect()
    assert len({r.word for r in got}) == len(got)
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


@pytest.mark.parametrize("node_bytes", [spelling.NODE_BYTES, 2000, 60, 0])
def test_variants_equal_brute_force(spark, tmp_path, monkeypatch, node_bytes):
    """Whether nodes are cut never, at some counts, at all, or by halves."""
    rows = made()
    monkeypatch.setattr(spelling.placed, "__defaults__", (node_bytes,))
    monkeypatch.setattr(spelling.variants, "__defaults__", (node_bytes,))
    monkeypatch.setattr(spelling, "BLOCK", 500)
    monkeypatch.setattr(spelling, "WORDS_HELD", 50)
    monkeypatch.setattr(spelling, "PAIRS_BYTES", 3000)
    assert result(spark, tmp_path, rows) == brute(rows)


def test_variants_of_the_given_table(spark):
    path = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.op11_spelling_variants(spark, path).collect()} == brute(rows)


@pytest.mark.parametrize("batch_bytes", [1, 3000])
def test_variants_in_several_batches_of_a_task(spark, tmp_path, monkeypatch, batch_bytes):
    """A node's whole words and those that lost a letter are searched together, also where a task holds many nodes."""
    rows = made(6)
    monkeypatch.setattr(spelling, "BATCH_BYTES", batch_bytes)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert result(spark, tmp_path, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_variants_with_a_very_long_word(spark, tmp_path):
    """Memory goes with the letters held, not with the longest word for each."""
    rows = [(1, " ".join(["a" * 300_000] * 6 + ["a" * 150_000 + "b" + "a" * 150_000] * 30)), *made(7)]
    got = {r[0]: r for r in result(spark, tmp_path, rows)}
    assert got["a" * 300_000][1:] == ("a" * 150_000 + "b" + "a" * 150_000,) * 2 + (6, 1, 30)
    assert {r for w, r in got.items() if len(w) < 300_000} == brute(rows[1:])


def test_variants_of_nothing(spark, tmp_path):
    assert result(spark, tmp_path, []) == set()
