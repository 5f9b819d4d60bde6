"""Toxicity: a learned, weighted lexicon matched by Aho-Corasick on folded text.

Folding: NFKC, lower case, homoglyphs and digit substitutions to Latin letters, zero-width
characters removed, words joined by single spaces. Lexicon entries are whole words and word
prefixes whose document odds are far higher in toxic rows; each carries its log odds. A word
counts once with its heaviest entry. Exception phrases are pairs of neighbouring words with a
lexicon word in them that clean rows hold and toxic rows hold no more often; words inside one do
not count. The sum is normalised by length and a one-feature logistic fit turns it into a score.

Everything is learned from a bounded sample of labelled rows, at most SAMPLE of each class, those
with the smallest hash of doc_id; the fit weighs classes by their counts over all labels. Scoring
reads whole texts.

Null and empty texts score as texts without a hit. Without labels, or without one of the classes,
the lexicon is empty and the score is the smoothed rate of all labels. Ties and repeated rows score
alike; an id that is labelled twice has its higher label. Very long texts are read whole, in one
row's memory. An empty table gives no rows. score() replaces a column of its output's name and
keeps all others.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, free, settle, small_batches, table

SAMPLE = 20_000
MIN_DOCS = 4
MIN_WEIGHT = 2.5
PREFIXES = range(3, 9)
REJECT = 0.7
ENTRIES_HELD = 50_000
# Look-alike letters and digit substitutions, each to its Latin letter.
HOMOGLYPHS = str.maketrans({
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "ı": "i", "​": "", "‌": "", "‍": "", "⁠": "", "­": "", "﻿": "",
})
DIGITS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
ALIKE = re.compile(f"[{''.join(map(chr, HOMOGLYPHS))}]")
WORD = re.compile(r"[\w@$]*\w")
LETTER = re.compile(r"[^\W\d_]")


def fold(text: str | None) -> list[str]:
    """The folded words of a text; a word of digits alone stays as it is."""
    text = text or ""
    text = (text if unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)).lower()
    if ALIKE.search(text):
        text = text.translate(HOMOGLYPHS)
    return [w if w.isalpha() or not LETTER.search(w) else w.translate(DIGITS) for w in WORD.findall(text)]


def entries(words: set[str]) -> set[str]:
    """Lexicon candidates: ' word ' whole, and ' pref' for its longer words."""
    out = {f" {w} " for w in words}
    out.update(f" {w[:n]}" for w in words for n in PREFIXES if len(w) > n)
    return out


def tally(train: DataFrame, found) -> DataFrame:
    """entry, clean, toxic: in how many rows of train (text, label) found(text) has the entry."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, list[int]] = {}

        def out() -> pd.DataFrame:
            made = pd.DataFrame([(e, a, b) for e, (a, b) in seen.items()], columns=["entry", "clean", "toxic"])
            seen.clear()
            return made

        for p in parts:
            for text, label in zip(p["text"], p["label"]):
                for e in found(text):
                    seen.setdefault(e, [0, 0])[label] += 1
                if len(seen) > ENTRIES_HELD:  # a task hands on what it has counted so far
                    yield out()
        yield out()

    rows = train.select("text", "label").mapInPandas(count, "entry string, clean long, toxic long")
    return rows.groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def odds(toxic: int, clean: int):
    """How much likelier an entry is in a toxic row, as a logarithm; negative where clean rows have it more often."""
    return F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))


def learn_lexicon(train: DataFrame) -> tuple[dict[str, float], list[str]]:
    """train (text, label), bounded, to entry weights and exception phrases."""
    many = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    toxic, clean = many.get(1, 0), many.get(0, 0)
    if not toxic or not clean:
        return {}, []
    words = tally(train, lambda t: entries(set(fold(t)))).where(F.col("toxic") >= MIN_DOCS).withColumn("w", odds(toxic, clean))
    lexicon = {r["entry"]: float(r["w"]) for r in words.where(F.col("w") >= MIN_WEIGHT).collect()}
    shared = train.sparkSession.sparkContext.broadcast(lexicon)

    def phrases(text: str | None) -> set[str]:
        w = fold(text)
        held = {x for x in set(w) if not shared.value.keys().isdisjoint(entries({x}))}
        return {f"{a} {b}" for a, b in zip(w, w[1:]) if a in held or b in held}

    excused = tally(train, phrases).where((F.col("clean") >= MIN_DOCS) & (odds(toxic, clean) <= 0))
    return lexicon, sorted(r["entry"] for r in excused.select("entry").collect())


def automaton(lexicon: dict[str, float], exceptions=()):
    import ahocorasick

    found = ahocorasick.Automaton()
    for e, w in lexicon.items():
        found.add_word(e, (len(e), w))
    for e in exceptions:
        phrase = f" {e} "
        found.add_word(phrase, (len(phrase), -1.0))
    found.make_automaton()
    return found


def density(auto, text: str | None) -> float:
    """The summed weight of a text's lexicon words over the square root of its length in words."""
    words = fold(text)
    if not words or not len(auto):
        return 0.0
    heaviest: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    for end, (n, w) in auto.iter(f" {' '.join(words)} "):
        start = end - n + 1
        if w < 0:
            excused.append((start, end))
        elif w > heaviest.get(start, 0.0):
            heaviest[start] = w
    for a, b in excused:
        for s in [s for s in heaviest if a <= s < b]:
            del heaviest[s]
    return sum(heaviest.values()) / math.sqrt(len(words))


def logistic(x: np.ndarray, y1: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps on grouped counts, with a small ridge."""
    b = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        grad = design.T @ (y1 - n * p) - 1e-2 * b
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


def measured(model: dict, spark: SparkSession):
    """A column function from text to density."""
    shared = spark.sparkContext.broadcast((model["lexicon"], model["exceptions"]))

    @F.pandas_udf("double")
    def measure(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        auto = automaton(*shared.value)
        for p in parts:
            yield pd.Series([density(auto, t) for t in p], dtype="float64")

    return measure


def fit(train: DataFrame) -> dict:
    """train (text, label 0/1, and weight or all alike; bounded) to a model: lexicon, exceptions, slope, base."""
    train = train if "weight" in train.columns else train.withColumn("weight", F.lit(1.0))
    model = dict(zip(("lexicon", "exceptions"), learn_lexicon(train)))
    bins = (
        train.select(F.floor(F.log1p(measured(model, train.sparkSession)("text")) * 100).alias("bin"), "label", "weight")
        .groupBy("bin").agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("y")).orderBy("bin").collect()
    )
    x, n, y = (np.array([float(r[k]) for r in bins]) for k in ("bin", "n", "y"))
    slope, base = logistic(x / 100, y, n) if len(bins) else (0.0, 0.0)
    return model | {"slope": max(slope, 0.0), "base": base}


def score(docs: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a score of 0 to 1 in the column out."""
    x = F.log1p(measured(model, docs.sparkSession)(F.col(text))) * F.lit(model["slope"]) + F.lit(model["base"])
    return docs.withColumn(out, 1 / (1 + F.exp(-x)))


def held_out(mod: int, rest: int):
    return F.crc32(F.col("doc_id").cast("string")) % mod == rest


def training(docs: DataFrame, labels: DataFrame, label: str, keep, most: int) -> DataFrame:
    """text, label, weight, doc_id of at most `most` labelled ids of each class.

    Chosen from labels alone, by the smallest hash of doc_id: only those ids, a bounded list, reach
    the driver and are broadcast, so no text is shuffled. weight is the class's count over that of
    its chosen ids."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & keep).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    rows = []
    for kind, many in known.where("label in (0, 1)").groupBy("label").count().collect():
        h = F.xxhash64("doc_id")
        low = int(-(2**63) + min(1.0, 1.2 * most / many + 1e-4) * (2**64 - 1))  # leaves somewhat more than `most` to sort
        ids = known.where((F.col("label") == kind) & (h <= F.lit(min(low, 2**63 - 1)))).orderBy(h, "doc_id").limit(most).select("doc_id").collect()
        rows += [(r[0], kind, many / len(ids)) for r in ids]
    chosen = F.broadcast(docs.sparkSession.createDataFrame(rows, "doc_id long, label int, weight double"))
    spread = max(8, docs.sparkSession.sparkContext.defaultParallelism)
    return docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "label", "weight", "doc_id").repartition(spread, "doc_id")


def learned(docs: DataFrame, labels: DataFrame, keep, most: int = SAMPLE) -> dict:
    train = settle(training(docs, labels, "toxic", keep, most))
    model = fit(train)
    drop(train)
    return model


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(3, 1)
    model = learned(docs, table(spark, sf_dir, "labels"), ~out)
    return score(docs, model).select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted")
    )


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score as toxic; learns from labels of the incoming documents."""
    small_batches(spark)
    model = learned(docs, table(spark, sf_dir, "labels"), F.lit(True))
    name = free(docs, "score")
    return score(docs, model, out=name).where(F.col(name) < REJECT).select(*docs.columns)
