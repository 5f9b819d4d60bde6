"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are folded (lower case, without marks at their ends). Each test item's N-word seeds are
looked up in all n-grams of the documents. How rare a seed is, is counted over the whole corpus: a hit is
worth the logarithm of how many n-grams there are to one of its kind. Hits of a document and an item
on near diagonals (whose places differ alike) add up, and where they are worth as many bits as the corpus has places
(so that chance gives about one such window for a seed, at any size), or SHARE of all bits of the item's
seeds, a window of the document around them is aligned with the whole item by words. So one rare seed or several
common ones lead to an alignment, and copies are found that keep no long run of words. The score is the best local alignment over that of the item with itself,
so edited copies score high and chance seeds low. Items with under N words are one seed.

Benchmark tables are small beside the corpus. What is broadcast of their seeds is counted first: up to
BROADCAST_SEEDS rows; beyond, the n-grams of the documents are shuffled to them instead.

Null, empty or wordless documents and items match nothing. Repeated rows match alike; of equal
scores the smallest item_id wins. A row without a doc_id is compared, and its doc_id stays null; items without an id
are one item. Very long texts are read whole, in one row's memory. Empty tables give empty results. Other columns are not
read, and the stage keeps them, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, free, settle, small_batches, table

N = 3
SHARE = 0.3
BROADCAST_SEEDS = 2_000_000
BROADCAST_WINDOWS = 100_000
LEAK = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
TOKEN = re.compile(r"\w+(?:['’-]\w+)*")


def words(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def word_hashes(text: str | None) -> np.ndarray:
    import xxhash

    w = words(text)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, w), "uint64", len(w))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n-gram of words in order; none if there are fewer words."""
    m = max(len(h) - n + 1, 0)
    x = h[:m]
    for k in range(1, n):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : k + m]
    return (x ^ (x >> np.uint64(31))).view("int64")


def align(doc: np.ndarray, item: np.ndarray) -> int:
    """The best local alignment score of two arrays of word numbers."""
    n = len(doc)
    if not n or not len(item):
        return 0
    row, best, ramp = np.zeros(n + 1, "int64"), 0, np.arange(n + 1) * -GAP
    for x in item:
        diag = row[:-1] + np.where(doc == x, MATCH, MISMATCH)
        new = np.concatenate(([0], np.maximum(np.maximum(diag, row[1:] + GAP), 0)))
        row = np.maximum.accumulate(new + ramp) - ramp  # gaps along the row
        best = max(best, int(row.max()))
    return best


def seeds(items: DataFrame, n: int = N) -> DataFrame:
    """h, wide (its number of words), item_id, at, size: where each item's grams stand in it."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for i, t in zip(p["item_id"].astype(object), p["text"]):
                h = word_hashes(t)
                wide = min(n, len(h))
                rows += [(int(x), wide, i, k, len(h)) for k, x in enumerate(grams(h, wide) if wide else ())]
            yield pd.DataFrame(rows, columns=["h", "wide", "item_id", "at", "size"], dtype=object).astype({"h": "int64", "wide": "int32", "item_id": "Int64", "at": "int32", "size": "int32"})

    return items.select("item_id", "text").mapInPandas(run, "h long, wide int, item_id long, at int, size int")


def hits(docs: DataFrame, known: DataFrame, n: int = N) -> DataFrame:
    """row, h, pos: where seeds stand in the documents (row names a text); and a row without h for each part of the
    corpus, with its number of words as pos."""
    few = known.select("h").distinct()
    widths = sorted(r[0] for r in known.select("wide").distinct().collect()) or [n]  # n, and less where items are shorter
    small = few.count() <= BROADCAST_SEEDS
    wanted = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in few.collect()], "int64")) if small else None)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0
        for p in parts:
            rows, hs, at_all = [], [], []
            for row, text in zip(p["row"], p["text"]):
                own = word_hashes(text)
                total += len(own)
                for wide in widths:
                    h = grams(own, wide)
                    at = np.arange(len(h))
                    if (some := wanted.value) is not None:
                        at = np.flatnonzero(some[np.searchsorted(some, h).clip(max=len(some) - 1)] == h) if len(some) else at[:0]
                    rows.append(np.full(len(at), row, "int64"))
                    hs.append(h[at])
                    at_all.append(at)
            if rows:
                yield pd.DataFrame({"row": np.concatenate(rows), "h": pd.array(np.concatenate(hs), "Int64"), "pos": np.concatenate(at_all).astype("int64")})
        yield pd.DataFrame({"row": [0], "h": pd.array([None], "Int64"), "pos": [total]})

    found = docs.mapInPandas(run, "row long, h long, pos long")
    return found if small else found.join(few, "h", "left_semi").unionByName(found.where("h is null"))


def windows(found: DataFrame, known: DataFrame) -> DataFrame:
    """row, item_id, windows of the documents where the hits on near diagonals are worth an alignment."""
    total = found.where("h is null").agg(F.sum("pos")).first()[0] or 0
    often = found.where("h is not null").groupBy("h").agg(F.count("*").alias("often"))
    bits = F.log2(F.lit(float(max(total, 1))) / F.col("often")) + 1.0
    weighed = settle(known.join(often, "h").select("h", "item_id", "at", "size", bits.alias("bits")))
    # of the seeds that the corpus lacks nothing is known; they are worth no less than any other
    most = known.groupBy("item_id").agg(F.count("*").alias("n"))
    have = weighed.groupBy("item_id").agg(F.sum("bits").alias("bits"), F.count("*").alias("met"))
    lacking = F.log2(F.lit(float(max(total, 2)))) + 1.0
    need = have.join(most, have["item_id"].eqNullSafe(most["item_id"])).select(
        have["item_id"], F.least(F.log2(F.lit(float(max(total, 2)))), SHARE * (F.col("bits") + (F.col("n") - F.col("met")) * lacking)).alias("need"))
    side = weighed.alias("k").join(need.alias("i"), F.col("k.item_id").eqNullSafe(F.col("i.item_id"))).select("k.*", "need")
    if weighed.count() <= BROADCAST_SEEDS:
        side = F.broadcast(side)
    room = (F.col("size") / 4).cast("int") + 4
    # bands of diagonals as wide as twice the room, each hit in the two that overlap there
    each = found.where("h is not null").join(side, "h").select("row", "item_id", "size", "need", "bits", room.alias("room"), (F.col("pos") - F.col("at")).alias("diagonal"))
    band = F.floor(F.col("diagonal") / F.col("room"))
    sums = each.select("*", F.explode(F.array(band, band - 1)).alias("band")).groupBy("row", "item_id", "band").agg(
        F.sum("bits").alias("bits"), F.first("need").alias("need"), F.first("size").alias("size"), F.first("room").alias("room"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"))
    span = F.struct((F.col("low") - F.col("room")).alias("lo"), (F.col("high") + F.col("size") + F.col("room")).alias("hi"))
    return sums.where(F.col("bits") >= F.col("need")).groupBy("row", "item_id").agg(F.array_sort(F.collect_set(span)).alias("windows"))


def matches(docs: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """doc_id, sig (a hash of the text), item_id, score for every document and item that share seeds enough."""
    sig = F.xxhash64("text")
    own = docs.select("doc_id", "text", sig.alias("sig"), F.xxhash64(F.col("doc_id").isNull(), "doc_id", sig).alias("row")).where("text is not null")
    known = settle(seeds(items, n))
    found = settle(hits(own, known, n))
    # repeated rows hit alike: each place counts once
    near = settle(windows(found, known))
    drop(found, shuffles=False)
    tests = items.select("item_id", F.col("text").alias("item")).groupBy("item_id").agg(F.max("item").alias("item"))

    @F.pandas_udf("double")
    def measure(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, tests, windows in parts:
            out = []
            for text, item, spans in zip(texts, tests, windows):
                test = words(item)
                number = {w: k for k, w in enumerate(dict.fromkeys(test))}
                doc = np.array([number.get(w, -1) for w in words(text)], "int64")
                ids = np.array([number[w] for w in test], "int64")
                merged: list[list[int]] = []
                for s in spans:
                    lo, hi = max(s["lo"], 0), s["hi"]
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(hi, merged[-1][1])
                    else:
                        merged.append([lo, hi])
                out.append(max(align(doc[a:b], ids) for a, b in merged) / (MATCH * len(ids)))
            yield pd.Series(out, dtype="float64")

    # few windows go to the texts, so that no text is shuffled; more are joined by hash
    pairs = own.join(F.broadcast(near) if near.count() <= BROADCAST_WINDOWS else near, "row")
    named = pairs.alias("p").join(tests.alias("t"), F.col("p.item_id").eqNullSafe(F.col("t.item_id")))
    return named.select("doc_id", "sig", "p.item_id", measure("text", "item", "windows").alias("score")).dropDuplicates(["doc_id", "sig", "item_id"])


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document that shares a seed with an item: its best item, score, and whether it leaks."""
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    best = F.max_by(F.struct("item_id", "score"), F.struct("score", -F.col("item_id")))
    return found.groupBy("doc_id").agg(best.alias("m"), F.count_if(F.col("score") >= LEAK).alias("n_items")).select(
        "doc_id", "m.item_id", "m.score", (F.col("m.score") >= LEAK).alias("leaks"), "n_items"
    )


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a copy of a benchmark item."""
    small_batches(spark)
    found = matches(docs, table(spark, sf_dir, "benchmark"))
    sig = free(docs, "sig")
    # whether a text leaks depends on the text alone
    bad = found.where(F.col("score") >= LEAK).select(F.col("sig").alias(sig)).distinct()
    return docs.withColumn(sig, F.xxhash64("text")).join(bad, sig, "left_anti").select(*docs.columns)
