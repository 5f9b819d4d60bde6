"""N-gram Jaccard join by parity sketches, exact at the threshold.

A document's set holds 64-bit hashes of its distinct shingles; equal sets are one class, named by a
digest. At Jaccard >= t two sets of a and b items differ in at most d = (a + b)(1 - t)/(1 + t)
items. Each size band has lanes, and each item flips, by XOR of a wide bit pattern, the lane that
its hash names: a parity sketch. Every differing item changes one lane at most, so lanes that differ
are a lower bound of the symmetric difference, and of more than d non-empty lanes at least one must
agree (pigeonhole). Only the first d + 1 non-empty lanes of a set are joined, in one order that all
sets share, so that the guarantee holds: rare lanes first. How often lanes occur is counted over all
documents (each task drops what it has met once); the FREQUENT most frequent ones make the order, and
what the count misses costs time and no link. Passages that many documents share thus stay out of
the join. A band spans sizes of 1 to (1/t)^STEPS; a set whose smallest partner is of the band below
joins there as well, with the lanes of that band.

Lanes are dealt by key once and sorted; a scan keeps those of several sets, so that only they are
written. A lane met very often is dealt in several parts. A lane's hub is its member that shares
lanes with the most others, the middle of a group of near copies. Candidates whose parity
sketches (folded to BITS bits, then whole) differ in more than d bits are dropped; others are verified on whole sets, in two steps:
every class with the hubs of its lanes; then the members of a lane outside of its largest component with the
others. A group of thousands of near copies costs one star.

Small sets use one lane per item (LANE_ITEMS), so that too few non-empty lanes can't happen; in
larger ones there are twice d + 1 lanes.

Null, empty and wordless texts have no shingles and stay alone; fewer words than n are one shingle.
Repeated rows share a class. Rows may share a doc_id and differ in text, or have none: each text is
compared, and a component is named by its smallest doc_id (null if all of its rows have none). Very
long texts are hashed whole, in one row's memory. An empty table gives no rows. Other columns are not
read; link() names its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, drop, free, settle, small_batches, table

N = 5
PERCENT = 80
LANE_ITEMS = 64
STEPS = 4
BITS = 512
FREQUENT = 200_000
PART_ROWS = 200_000
MOST_COUNTED = 300_000
TEXTS_AT_ONCE = 2000
BYTES_AT_ONCE = 4_000_000
SMALL_SIDE = 300_000
BLOCK = 1_000_000
BASE = 0x9E3779B97F4A7C15
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
POWERS = (np.ones(1, "uint64"), np.ones(1, "uint64"))


def byte_values() -> np.ndarray:
    """A random 64-bit number for each byte, the same for both cases of an ASCII letter."""
    x = np.random.default_rng(5).integers(0, 2**64, 256, dtype="uint64")
    x[ord("A") : ord("Z") + 1] = x[ord("a") : ord("z") + 1]
    return x


BYTES = byte_values()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE modulo 2^64, and of its inverse."""
    global POWERS
    if len(POWERS[0]) < n:
        made = []
        for base in (BASE, pow(BASE, -1, 2**64)):
            x = np.ones(1, "uint64")
            while len(x) < n:
                x = np.concatenate([x, x * np.uint64(pow(base, len(x), 2**64))])
            made.append(x)
        POWERS = tuple(made)
    return POWERS


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, ASCII letters in lower case, mixed
    with its length. Long texts go block by block, each ending at a space."""
    raw, out, at = np.frombuffer(text.encode(), "uint8"), [], 0
    while at < len(raw):
        end = min(at + BLOCK, len(raw))
        while end < len(raw) and not SPACE[raw[end]]:
            more = np.flatnonzero(SPACE[raw[end : end + BLOCK]])
            end = end + int(more[0]) if len(more) else min(end + BLOCK, len(raw))
        part = raw[at:end]
        up, down = powers(len(part) + 1)
        edge = np.diff(np.concatenate(([True], SPACE[part], [True])).view("int8"))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.concatenate((np.zeros(1, "uint64"), np.cumsum(BYTES[part] * up[: len(part)])))
        h = (sums[last] - sums[first]) * down[first] + (last - first).astype("uint64")
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out.append(h ^ (h >> np.uint64(29)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, "uint64")


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """The sorted distinct hashes of a text's n-word shingles."""
    h = word_hashes(text or "")
    if not len(h):
        return h
    wide = min(n, len(h))
    m = len(h) - wide + 1
    x = h[:m]
    for k in range(1, wide):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : k + m]
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    x = np.sort(x ^ (x >> np.uint64(32)))
    return x[np.append(True, x[1:] != x[:-1])]


def sketch(grams: np.ndarray) -> np.ndarray:
    """The parities of a set, as int64: a power of two of bits, BITS at least and four times the set."""
    many = max(BITS, 1 << (4 * len(grams) - 1).bit_length()) if len(grams) else BITS
    odd = np.bincount((grams % np.uint64(many)).astype("int64"), minlength=many) & 1
    return np.packbits(odd.astype("uint8")).view("int64")


def mini(wide: np.ndarray) -> np.ndarray:
    """A sketch folded to BITS bits."""
    return np.bitwise_xor.reduce(wide.reshape(-1, BITS // 64), axis=0)


def band_of(size: int, percent: int = PERCENT) -> int:
    """Band 0 holds the sets of single items, under LANE_ITEMS; each other one spans STEPS thresholds."""
    return 0 if size < LANE_ITEMS else 1 + int(math.log(size / LANE_ITEMS) / (STEPS * math.log(100 / percent)) + 1e-9)


def band_top(band: int, percent: int = PERCENT) -> int:
    """A size that no set of the band passes."""
    return LANE_ITEMS - 1 if not band else math.ceil(LANE_ITEMS * (100 / percent) ** (STEPS * band))


def lanes(grams: np.ndarray, band: int, percent: int = PERCENT) -> np.ndarray:
    """The keys of a set's non-empty lanes in a band."""
    # a mixed copy of the hash both names the lane and is the bit pattern to flip
    x = grams * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    if not band:
        return x.view("int64")
    top = band_top(band, percent)
    many = 2 * (difference(top, top * 100 // percent, percent) + 1)
    lane = (grams % np.uint64(many)).astype("int64")
    sums = np.zeros(many, dtype="uint64")
    np.bitwise_xor.at(sums, lane, x)
    filled = np.flatnonzero(sums)
    keys = sums[filled] + filled.astype("uint64") * np.uint64(0x94D049BB133111EB)
    return (keys ^ np.uint64(band * 0x2545F4914F6CDD1D & (2**64 - 1))).view("int64")


def difference(a: int, b: int, percent: int = PERCENT) -> int:
    """The most items by which linked sets of a and b items can differ."""
    return (a + b) * (100 - percent) // (100 + percent)


def set_keys(grams: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, int]]:
    """The keys of a set in each of its bands, and how many of them to join."""
    n = len(grams)
    if not n:
        return
    own = band_of(n, percent)
    for band in range(band_of(-(-n * percent // 100), percent), own + 1):
        if not band:  # single items: those that a partner can lack
            need = n * (100 - percent) // 100 + 1
        else:
            need = difference(n, n * 100 // percent if band == own else min(n, band_top(band, percent)), percent) + 1
        yield lanes(grams, band, percent), need


def digest(grams: np.ndarray) -> int | None:
    """A set's name."""
    return int.from_bytes(blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True) if len(grams) else None


def slices(parts: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Rows by the size of their texts (in column number text), so that a task's memory stays small: at most
    TEXTS_AT_ONCE with BYTES_AT_ONCE, or one."""
    for p in parts:
        ends = np.cumsum(pc.fill_null(pc.binary_length(p.column(text)), 0).to_numpy().astype("int64"))
        at = 0
        while at < p.num_rows:
            end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES_AT_ONCE, "right"))
            end = min(max(end, at + 1), at + TEXTS_AT_ONCE)
            yield p.slice(at, end - at)
            at = end


def signed(docs: DataFrame, n: int, percent: int, text: str) -> DataFrame:
    """doc_id, th, sid, n_shingles, mini, sketch per row of docs; and in rows with a key, how often a task met it: a
    task counts each set once, and leaves out the keys it met once."""
    names = ["doc_id", "th", "sid", "n_shingles", "mini", "sketch", "key", "times"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        have, often = np.zeros(0, "int64"), np.zeros(0, "int64")
        for p in slices(parts, 2):
            sids, sizes, found, odd = [], [], [have], [np.zeros(0, "int64")]
            for t in p.column(2).to_pylist():
                g = shingles(t, n)
                sids.append(digest(g))
                sizes.append(len(g))
                odd.append(sketch(g))
                if len(g) and sids[-1] not in seen:
                    seen.add(sids[-1])
                    found += [keys for keys, _ in set_keys(g, percent)]
            rows = len(sids)
            bits = pa.ListArray.from_arrays(np.cumsum([len(x) for x in odd]).astype("int32"), np.concatenate(odd))
            small = pa.ListArray.from_arrays(np.arange(rows + 1, dtype="int32") * (BITS // 64), np.concatenate([odd[0], *map(mini, odd[1:])]))
            yield pa.RecordBatch.from_arrays(
                [p.column(0), p.column(1), pa.array(sids, "int64"), pa.array(sizes, "int64"), small, bits, pa.nulls(rows, "int64"), pa.nulls(rows, "int64")], names)
            new = np.sort(np.concatenate(found[1:])) if len(found) > 1 else have[:0]
            first = np.flatnonzero(np.append(True, new[1:] != new[:-1])) if len(new) else np.zeros(0, "int64")
            every, many = np.concatenate([have, new[first]]), np.concatenate([often, np.diff(np.append(first, len(new)))])
            order = np.argsort(every, kind="stable")
            every, many = every[order], many[order]
            first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else first
            have, often = every[first], np.add.reduceat(many, first) if len(first) else many
            if len(have) > MOST_COUNTED:  # lossy counting: what was met once so far goes
                have, often = have[often > 1], often[often > 1]
        have, often = have[often > 1], often[often > 1]
        rows = len(have)
        yield pa.RecordBatch.from_arrays([pa.nulls(rows, "int64")] * 4 + [pa.nulls(rows, pa.list_(pa.int64()))] * 2 + [pa.array(have), pa.array(often)], names)

    return docs.select("doc_id", F.xxhash64(text).alias("th"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, th long, sid long, n_shingles long, mini array<long>, sketch array<long>, key long, times long")


def frequent(counted: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The `most` most frequent keys at most (in the order of keys), and how often they were met."""
    total = counted.groupBy("key").agg(F.sum("times").alias("times"))
    of = total.groupBy("times").count().orderBy(F.desc("times")).collect()  # as many rows as there are different counts
    held, least = 0, math.inf
    for r in of:
        if (held := held + r["count"]) > most:
            break
        least = r["times"]
    got = [] if least == math.inf else total.where(F.col("times") >= least).collect()
    pairs = np.array([(r["key"], r["times"]) for r in got], "int64").reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0])]
    return pairs[:, 0].copy(), pairs[:, 1].copy()


def shared_lanes(docs: DataFrame, known: tuple[np.ndarray, np.ndarray], n: int = N, percent: int = PERCENT) -> DataFrame:
    """docs (text) to the (key, sid) that must be joined and that several sets have."""
    order = docs.sparkSession.sparkContext.broadcast(known)  # FREQUENT numbers at any size of input

    def times(keys: np.ndarray) -> np.ndarray:
        have, often = order.value
        if not len(have):
            return np.zeros(len(keys), "int64")
        at = np.searchsorted(have, keys).clip(max=len(have) - 1)
        return np.where(have[at] == keys, often[at], 0)

    def emit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for p in slices(parts, 0):
            sids, found, parted = [], [np.zeros(0, "int64")], [np.zeros(0, "int64")]
            for t in p.column(0).to_pylist():
                g = shingles(t, n)
                sid = digest(g)
                if sid is None or sid in seen:
                    continue
                seen.add(sid)
                for keys, need in set_keys(g, percent):
                    often = times(keys)
                    if need < len(keys):
                        first = np.lexsort((keys, often))[:need]
                        keys, often = keys[first], often[first]
                    sids.append((sid, len(keys)))
                    found.append(keys)
                    # a lane met very often goes to several tasks, in parts named from 1
                    parts_of = -(-often // PART_ROWS)
                    parted.append(np.where(often > PART_ROWS, 1 + sid % parts_of.clip(min=1), 0))
            sid, many = zip(*sids) if sids else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(found)), pa.array(np.concatenate(parted).astype("int32")), pa.array(np.repeat(np.array(sid, "int64"), many))], ["key", "part", "sid"])

    def several(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of key and sid: those whose key has another sid, or is in parts."""
        key, sid, part = np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0, "int32")
        met = False  # whether the row kept back has a neighbour already

        def out(keep: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(sid[keep])], ["key", "sid"])

        for p in parts:
            key, part, sid = (np.concatenate([a, p.column(k).to_numpy(zero_copy_only=False)]) for k, a in enumerate((key[-1:], part[-1:], sid[-1:])))
            other = np.append(True, (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])) if len(key) else np.zeros(0, bool)
            key, part, sid = key[other], part[other], sid[other]
            if not len(key):
                continue
            pair = key[1:] == key[:-1]
            keep = np.append(met, pair) | np.append(pair, False) | (part > 0)
            met = bool(keep[-1])
            keep[-1] = False
            yield out(keep)
        if len(key) and met:
            yield out(np.arange(len(key)) == len(key) - 1)

    rows = docs.mapInArrow(emit, "key long, part int, sid long")
    return rows.repartition("key", "part").sortWithinPartitions("key", "sid").mapInArrow(several, "key long, sid long")


def unlike(bits, x: str, y: str, percent: int):
    """Whether so many different bits, or their sizes, rule out that two sets link."""
    a, b = F.col(f"{x}.size"), F.col(f"{y}.size")
    return (F.least(a, b) * 100 < F.greatest(a, b) * percent) | (bits * (100 + percent) > (a + b) * (100 - percent))


def far(x: str, y: str, percent: int):
    """unlike() by the folded sketches."""
    return unlike(sum(F.bit_count(F.col(f"{x}.mini")[k].bitwiseXOR(F.col(f"{y}.mini")[k])) for k in range(BITS // 64)), x, y, percent)


def farther(x: str, y: str, percent: int):
    """unlike() by the sketches, the longer one folded to the other's length; sets that may link differ by one fold."""
    m = F.least(F.size(f"{x}.sketch"), F.size(f"{y}.sketch"))
    xor = lambda p, q: p.bitwiseXOR(q)

    def fold(c: str):
        return F.when(F.size(c) == m, F.col(c)).otherwise(F.zip_with(F.slice(c, 1, m), F.slice(c, m + 1, m), xor))

    bits = F.aggregate(F.zip_with(fold(f"{x}.sketch"), fold(f"{y}.sketch"), lambda p, q: F.bit_count(xor(p, q))), F.lit(0), lambda t, n: t + n)
    return unlike(bits, x, y, percent)


def near(pairs: DataFrame, brief: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The (a, b) of pairs that the sketches (rep, size, mini, sketch) do not rule out."""
    side = lambda c, name: brief.select(F.col("rep").alias(c), F.struct("size", name).alias(f"s{c}"))
    some = pairs.join(side("a", "mini"), "a").join(side("b", "mini"), "b").where(~far("sa", "sb", percent)).select("a", "b")
    return some.join(side("a", "sketch"), "a").join(side("b", "sketch"), "b").where(~farther("sa", "sb", percent)).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The (a, b) of pairs whose sets (rep, grams) reach the threshold."""
    whole = lambda c: sets.select(F.col("rep").alias(c), F.col("grams").alias(f"g{c}"))
    a, b, both = F.size("ga"), F.size("gb"), F.size(F.array_intersect("ga", "gb"))
    return pairs.join(whole("a"), "a").join(whole("b"), "b").where(both * 100 >= (a + b - both) * percent).select("a", "b")


def whole_sets(docs: DataFrame, at: DataFrame, n: int, text: str) -> DataFrame:
    """rep, grams of the rows named by at (rep, doc_id, th). Few names are broadcast, so that no text is
    shuffled; more go to the texts by a hash join."""
    many = at.count()
    if not many:
        return docs.sparkSession.createDataFrame([], "rep long, grams array<long>")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in slices(parts, 1):
            grams = [shingles(t, n) for t in p.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, grams)]).astype("int32")
            yield pa.RecordBatch.from_arrays([p.column(0), pa.ListArray.from_arrays(ends, np.concatenate(grams).view("int64"))], ["rep", "grams"])

    own = docs.select("doc_id", F.xxhash64(text).alias("th"), F.col(text).alias("text")).alias("own")
    same = F.col("own.th").eqNullSafe(F.col("m.th")) & F.col("own.doc_id").eqNullSafe(F.col("m.doc_id"))
    found = own.join(F.broadcast(at.alias("m")) if many <= SMALL_SIDE else at.alias("m").hint("shuffle_hash"), same).select("rep", "text")
    return found.mapInArrow(run, "rep long, grams array<long>").dropDuplicates(["rep"])


def extended(comp: DataFrame, late: DataFrame) -> DataFrame:
    """Components (id, component; settled, deleted here) with more links (a, b) between their members or others: only
    components that these touch are joined anew."""
    if not late.limit(1).count():
        return comp
    named = lambda c: comp.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    pairs = late.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = settle(components(pairs))
    top = joined.select(F.col("id").alias("component"), F.col("component").alias("top"))
    # ids that had no component, or were its name, come from the new ones
    old = comp.where("id <> component").join(top, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    names = comp.where("id = component").join(joined.select("id"), "id", "left_anti").select("id", "component")
    made = settle(old.unionByName(names).unionByName(joined))
    drop(comp, joined, shuffles=False)
    return made


def link(docs: DataFrame, n: int = N, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """doc_id, th (a hash of the text), n_shingles, class_id, component_id, sid for every row of docs."""
    made = settle(signed(docs, n, percent, text))
    sets = made.where("key is null").select("doc_id", "th", "sid", "n_shingles", "mini", "sketch")
    known = frequent(made.where("key is not null").select("key", "times"))
    classes = sets.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("class_id"), F.min(F.struct("doc_id", "th")).alias("at"), F.first("n_shingles").alias("size"), F.first("mini").alias("mini"), F.first("sketch").alias("sketch"))
    rows = settle(shared_lanes(docs.select(F.col(text).alias("text")), known, n, percent))
    often = rows.groupBy("key").agg(F.count("*").alias("often")).where("often > 1")
    shared = settle(rows.join(often, "key").withColumnRenamed("sid", "rep"))
    drop(rows)
    weight = shared.groupBy("rep").agg(F.sum("often").alias("weight"))
    rank = F.struct("weight", "rep")
    hubs = shared.join(weight, "rep").groupBy("key").agg(F.max(rank).alias("m")).select("key", F.col("m.rep").alias("hub"))
    together = settle(shared.select("key", "rep").join(hubs, "key"))
    drop(shared)

    brief = settle(classes.join(together.select(F.col("rep").alias("sid")).distinct(), "sid", "left_semi").select(F.col("sid").alias("rep"), "size", "mini", "sketch", "at.doc_id", "at.th"))
    star = settle(
        together.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    )
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    named = lambda reps: settle(brief.select("rep", "doc_id", "th").join(reps, "rep", "left_semi"))
    able = settle(near(star, brief, percent))
    at = named(ends(able))
    full = settle(whole_sets(docs, at, n, text))
    links = settle(verified(able, full, percent))
    drop(able, full, at)
    comp = settle(components(links))
    member = together.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("c"))
    per = member.groupBy("key", "c").agg(F.count("*").alias("n")).groupBy("key").agg(
        F.max_by("c", F.struct("n", "c")).alias("main"), F.count("*").alias("several")).where("several > 1").select("key", "main")
    wide = settle(member.join(per, "key").join(brief.select("rep", "size", "mini"), "rep"))
    drop(together)
    x, y = wide.where("c <> main").alias("x"), wide.alias("y")
    differ = (F.col("x.c") != F.col("y.c")) & ((F.col("y.c") == F.col("y.main")) | (F.col("x.rep") < F.col("y.rep")))
    rest = (
        x.join(y, (F.col("x.key") == F.col("y.key")) & differ & ~far("x", "y", percent))
        .select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
        .join(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    )
    rest = settle(near(rest, brief, percent))
    drop(wide, star)
    at = named(ends(rest))
    full = settle(whole_sets(docs, at, n, text))
    late = settle(verified(rest, full, percent))
    comp = extended(comp, late)
    drop(rest, at, full, late, links, brief)
    # a component of classes is named by the smallest doc_id of its rows
    named = classes.join(comp.withColumnRenamed("id", "sid"), "sid", "left").select("sid", "class_id", F.coalesce("component", "sid").alias("c"))
    least = named.groupBy("c").agg(F.min("class_id").alias("component_id"))
    known_sets = named.join(least, "c").select("sid", "class_id", "component_id")
    out = settle(sets.join(known_sets, "sid", "left").select(
        "doc_id", "th", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"), "sid"))
    drop(made, comp)
    return out


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


def stage_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: of the one with the smallest id, and of its texts one.
    Documents without words all stay. Rows that repeat both id and text are one document."""
    small_batches(spark)
    linked = link(docs)
    group = F.when(F.col("component_id").isNotNull(), F.col("component_id"))
    first = linked.where("sid is not null").groupBy(group.alias("g"), F.when(group.isNull(), F.col("sid")).alias("s")).agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("at")).select("at.doc_id", "at.th")
    keep = settle(first.unionByName(linked.where("sid is null").select("doc_id", "th").distinct()))
    th = free(docs, "th")
    own = docs.withColumn(th, F.xxhash64("text")).alias("own")
    same = F.col(f"own.{th}").eqNullSafe(F.col("k.th")) & F.col("own.doc_id").eqNullSafe(F.col("k.doc_id"))
    kept = own.join(keep.alias("k"), same, "left_semi")
    if linked.groupBy("doc_id", "th").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", th])
    return kept.select(*docs.columns)
