"""MinHash near-dedup with tensored banding, links confirmed on whole sets.

A document's set holds 64-bit hashes of its distinct shingles; equal sets are one class. Two small
collections of HALVES half-keys each are computed, of WIDTH minhashes a half; the key of table (i, j)
combines half i of the first collection with half j of the second. So HALVES^2 tables cost
2 * HALVES * WIDTH minhashes, the square root of what tables of their own would. Sets of Jaccard t agree
in a half with t^WIDTH, and meet in no table with (1 - t^WIDTH)^HALVES twice at most: 4e-7 at 0.85.

The tables on the diagonal (i, i) come first: of each key the set that shares keys with the most others is
its hub, and sets are compared with their hubs, so that a group of thousands of near copies costs a star.
Then all tables: a half that only one component holds can't join two, and goes before keys are
formed; of the keys that are left, those of several components have members of different components
compared. Candidates pass exact bounds first (sizes, parity sketches) and are verified on whole sets.
A key of over CROWD members outside of its largest component is not compared pair by pair: its
members go through the parity-sketch join, which finds all their links from rare shingles.

Null, empty and wordless texts have no shingles and stay alone; fewer words than n are one shingle.
Repeated rows share a class. Rows may share a doc_id and differ in text, or have none: each text is
compared, and a component is named by its smallest doc_id (null if all of its rows have none); kept is true
in rows whose id is that name, false in rows without an id. Very long texts are hashed in blocks. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ngram_join
from .common import components, drop, settle, table
from .ngram_join import digest, extended, far, mini, near, shingles, sketch, slices, verified, whole_sets

N = 3
PERCENT = 85
HALVES = 12
WIDTH = 2
CROWD = 200
ROWS_AT_ONCE = 4096
SEEDS = np.random.default_rng(13).integers(1, 2**63, 2 * HALVES * WIDTH, dtype="uint64") | np.uint64(1)


def minhashes(grams: np.ndarray) -> np.ndarray:
    """The smallest of a set's hashes under each seed."""
    least = np.full(len(SEEDS), 2**64 - 1, "uint64")
    for k in range(0, len(grams), ROWS_AT_ONCE):
        x = grams[k : k + ROWS_AT_ONCE, None] * SEEDS
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        np.minimum(least, x.min(axis=0), out=least)
    return least


def halves(grams: np.ndarray) -> np.ndarray:
    """The half-keys of a set: HALVES of the first collection, then of the second."""
    m = minhashes(grams).reshape(2 * HALVES, WIDTH)
    x = np.zeros(2 * HALVES, "uint64")
    for k in range(WIDTH):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + m[:, k]
    return (x ^ (x >> np.uint64(32))).view("int64")


def signed(docs: DataFrame, n: int, text: str) -> DataFrame:
    """doc_id, th (a hash of the text), sid, n_shingles, mini, sketch, halves of every row; a task gives sketches and
    halves once for each set."""
    names = ["doc_id", "th", "sid", "n_shingles", "mini", "sketch", "halves"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for p in slices(parts, 2):
            rows = []
            for t in p.column(2).to_pylist():
                g = shingles(t, n)
                sid = digest(g)
                if sid is None or sid in seen:
                    rows.append((sid, len(g), None, None, None))
                else:
                    seen.add(sid)
                    wide = sketch(g)
                    rows.append((sid, len(g), mini(wide), wide, halves(g)))
            if rows:
                sids, sizes, *found = zip(*rows)
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), pa.array(sids, "int64"), pa.array(sizes, "int64"), *(pa.array(f, pa.list_(pa.int64())) for f in found)], names)

    return docs.select("doc_id", F.xxhash64(text).alias("th"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, th long, sid long, n_shingles long, mini array<long>, sketch array<long>, halves array<long>")


def diagonal(classes: DataFrame) -> DataFrame:
    """(key, rep) of the tables (i, i) that several classes share."""
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("halves")[i], F.col("halves")[HALVES + i]) for i in range(HALVES)))
    rows = classes.select(F.explode(keys).alias("key"), "rep")
    return rows.join(rows.groupBy("key").agg(F.count("*").alias("often")).where("often > 1"), "key")


def open_tables(classes: DataFrame, comp: DataFrame) -> DataFrame:
    """(key, rep, c) of the tables (i, j) that classes of several components c share."""
    own = classes.select("rep", "halves").join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("c"), "halves")
    half = own.select("rep", "c", F.posexplode("halves").alias("i", "half"))

    def several(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.join(rows.groupBy(*keys).agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select(*keys), list(keys))

    kept = settle(several(half, "i", "half"))
    side = lambda second: F.collect_list(F.when((F.col("i") >= HALVES) == F.lit(second), F.struct("i", "half")))
    both = kept.groupBy("rep", "c").agg(side(False).alias("a"), side(True).alias("b"))  # no more than HALVES each
    pairs = both.select("rep", "c", F.explode("a").alias("a"), "b").select("rep", "c", "a", F.explode("b").alias("b"))
    rows = settle(pairs.select(F.xxhash64("a.i", "b.i", "a.half", "b.half").alias("key"), "rep", "c"))
    out = settle(several(rows, "key"))
    drop(kept, rows, shuffles=False)
    return out


def link(docs: DataFrame, n: int = N, percent: int = PERCENT, text: str = "text", crowd: int = CROWD) -> DataFrame:
    """doc_id, th (a hash of the text), n_shingles, component_id, sid for every row of docs."""
    made = settle(signed(docs, n, text))
    sets = made.select("doc_id", "th", "sid", "n_shingles")
    classes = settle(made.where("sid is not null").groupBy(F.col("sid").alias("rep")).agg(
        F.min("doc_id").alias("class_id"), F.min(F.struct("doc_id", "th")).alias("at"), F.first("n_shingles").alias("size"),
        *(F.first(c, ignorenulls=True).alias(c) for c in ("mini", "sketch", "halves"))))
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    named = lambda reps: settle(classes.select("rep", "at.doc_id", "at.th").join(reps, "rep", "left_semi"))

    shared = settle(diagonal(classes))
    weight = shared.groupBy("rep").agg(F.sum("often").alias("weight"))
    hubs = shared.join(weight, "rep").groupBy("key").agg(F.max(F.struct("weight", "rep")).alias("m")).select("key", F.col("m.rep").alias("hub"))
    star = settle(shared.select("key", "rep").join(hubs, "key").where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct())
    able = settle(near(star, classes, percent))
    drop(shared, star, shuffles=False)
    at = named(ends(able))
    full = settle(whole_sets(docs, at, n, text))
    links = settle(verified(able, full, percent))
    drop(able, full, at, shuffles=False)
    comp = settle(components(links))
    member = open_tables(classes, comp)
    per = member.groupBy("key", "c").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"))
    per = per.select("key", "main", (F.col("n") - F.col("most")).alias("others"))
    wide = settle(member.join(per, "key").join(classes.select("rep", "size", "mini"), "rep").withColumn("other", F.col("c") != F.col("main")))
    drop(member)
    x, y = (wide.where(F.col("others") <= crowd).alias(s) for s in "xy")
    differ = (F.col("x.c") != F.col("y.c")) & (~F.col("y.other") | (F.col("x.rep") < F.col("y.rep")))
    rest = x.where("other").join(y, (F.col("x.key") == F.col("y.key")) & differ & ~far("x", "y", percent)).select(
        F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
    rest = settle(near(rest, classes, percent))
    at = named(ends(rest))
    full = settle(whole_sets(docs, at, n, text))
    late = settle(verified(rest, full, percent))
    drop(rest, at, full, shuffles=False)
    crowded = named(wide.where(F.col("others") > crowd).select("rep").distinct())
    if crowded.limit(1).count():
        again = settle(by_class(docs, crowded, text))
        found = ngram_join.link(again, n, percent).where("component_id <> doc_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
        one, late = late, settle(late.unionByName(found))
        drop(one, again, shuffles=False)
    comp = extended(comp, late)
    drop(wide, crowded, late, links, shuffles=False)

    # a component of classes is named by the smallest doc_id of its rows
    own = classes.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("rep", "class_id", F.coalesce("component", "rep").alias("c"))
    least = own.groupBy("c").agg(F.min("class_id").alias("component_id"))
    known = own.join(least, "c").select(F.col("rep").alias("sid"), "component_id")
    out = settle(sets.join(known, "sid", "left").select("doc_id", "th", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "sid"))
    drop(made, classes, comp, shuffles=False)
    return out


def by_class(docs: DataFrame, at: DataFrame, text: str) -> DataFrame:
    """doc_id (the name of the class), text: a row for each class named by at (rep, doc_id, th)."""
    own = docs.select("doc_id", F.xxhash64(text).alias("th"), F.col(text).alias("text")).alias("own")
    same = F.col("own.th").eqNullSafe(F.col("m.th")) & F.col("own.doc_id").eqNullSafe(F.col("m.doc_id"))
    return own.join(at.alias("m"), same).dropDuplicates(["rep"]).select(F.col("rep").alias("doc_id"), "text")


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
