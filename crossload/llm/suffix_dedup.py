"""Repeated 200-byte strings, found with per-shard suffix arrays and removed.

Every WINDOW-byte string of a text has an anchor: the leftmost smallest hash of its K-byte
grams. Equal strings have equal anchors. Neighbouring strings whose anchors have one hash make a
segment of the text; segments are dealt to shards by that hash, so most shards hold every place
of a string. Hashes that occur once are dropped before any text is shuffled. Equal segments are
counted and sent once.

A shard lays its segments end to end and sorts all suffixes by Larsson-Sadakane refinement in
numpy (only groups that are not yet sorted are sorted again, by the rank of the suffix as many
places on as the depth reached). Kasai's pass over the text gives the common prefix of
neighbours, for many stretches of the text at once; neighbours that share WINDOW bytes are one string.

A hash with more than HOT different segments (the edge of a passage that very many documents
hold) is dealt to several shards by segment. Each of them sends its different strings as sorted
runs of 128-bit fingerprints, cut at the same values; a merging task takes the runs of one
range, merges them by binary search, and so finds strings that several shards hold. The result is exact up
to hash collisions.

Null or empty texts, and those under WINDOW bytes, lose nothing. Repeated rows are copies of each
other and lose all strings of WINDOW bytes; so do rows without a doc_id. Very long texts are read whole, in
one row's memory; a stretch that repeats itself is one segment. Ties cannot arise. An empty table gives
no rows. Other columns are not read, and the stage keeps them, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, free, settle, small_batches, table

WINDOW = 200
K = 24
HOT = 4000
SHARD_BYTES = 2_000_000
RANGE_STRINGS = 500_000
STRETCH = 128
U = np.uint64
# a string sent to be merged: its fingerprint, and hash, segment and place of the one to mark (-1: marked already)
REF = np.dtype([("a", "<u8"), ("b", "<u8"), ("h", "<i8"), ("g", "V16"), ("at", "<i4")])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def grams8(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one number; places near the end read zeros."""
    x = raw.astype("uint64")
    for step in (1, 2, 4):
        nxt = np.zeros_like(x)
        nxt[:-step or None] = x[step:]
        x = x | (nxt << U(8 * step))
    return x


def anchored(raw: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text's strings of window bytes: (anchor hash, first start, number of starts, anchors in it) per segment."""
    n = len(raw) - window + 1
    if n < 1:
        e = np.zeros(0, "int64")
        return e, e, e, e
    g = grams8(raw)
    m = len(raw) - K + 1
    h = mix(g[:m] * U(3) + mix(g[8 : m + 8] + mix(g[16 : m + 16])))
    # the leftmost smallest of each run of `wide` grams, by doubling
    wide, have, at = window - K + 1, 1, np.arange(m)
    while have < wide:
        step = min(have, wide - have)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(h[a] <= h[b], a, b)
        have += step
    moved = np.concatenate(([True], at[1:] != at[:-1]))
    key = h[at]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first].view("int64"), first, np.diff(np.append(first, len(at))), np.add.reduceat(moved.astype("int64"), first)


def suffix_array(raw: np.ndarray) -> np.ndarray:
    """The places of raw in the order of their suffixes, a shorter one first."""
    n = len(raw)
    first = grams8(raw).byteswap()
    order = np.argsort(first)
    rank = np.zeros(n + 1, "int64")  # 1 + the slot of the group's head

    def regroup(slots: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Rank the suffixes in these slots, whose keys ascend; gives the slots of groups of several."""
        head = np.concatenate(([True], key[1:] != key[:-1]))
        at = np.flatnonzero(head)
        size = np.diff(np.append(at, len(key)))
        rank[order[slots]] = np.repeat(slots[at], size) + 1
        return slots[np.repeat(size > 1, size)]

    if not n:
        return order
    slots, depth = regroup(np.arange(n), first[order]), 8
    del first
    while len(slots):
        here = order[slots]
        # past the end the shorter comes first, before all others
        then = np.where(here + depth < n, rank[np.minimum(here + depth, n)] + n, n - here)
        key = (rank[here].astype("uint64") << U(32)) | then.astype("uint64")
        by = np.argsort(key)
        order[slots] = here[by]
        slots, depth = regroup(slots, key[by]), min(depth * 2, n)
    return order


def common_prefixes(raw: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Kasai: for each place, how many bytes (up to most) its suffix shares with the one before it in
    the order. From one place to the next a prefix shrinks by one byte at most, so it is extended, not
    counted anew. All stretches of STRETCH places go in step; each counts its first prefix in full."""
    n = len(raw)
    before = np.full(n, -1, "int64")
    before[order[1:]] = order[:-1]
    words = grams8(np.concatenate((raw, np.zeros(most + 8, "uint8"))))
    out, begin = np.zeros(n, "int32"), np.arange(0, n, STRETCH)
    have = np.zeros(len(begin), "int64")
    for step in range(min(STRETCH, n)):
        p = begin + step
        if p[-1] >= n:
            begin, have, p = begin[:-1], have[:-1], p[:-1]
        q = before[p]
        have = np.where(q < 0, 0, np.maximum(have - 1, 0))
        go = np.flatnonzero((q >= 0) & (have < most))
        while len(go):
            differ = words[p[go] + have[go]] ^ words[q[go] + have[go]]
            low = np.frexp((differ & (~differ + U(1))).astype("float64"))[1] - 1
            have[go] += np.where(differ == 0, 8, low >> 3)
            go = go[(differ == 0) & (have[go] < most)]
        np.minimum(have, most, out=have)
        out[p] = have
    return out


def window_classes(segments: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Place and class of every string of window bytes inside the segments laid end to end."""
    raw = np.frombuffer(b"".join(segments), dtype="uint8")
    order = suffix_array(raw)
    kind = np.empty(len(raw), "int64")
    kind[order] = np.cumsum(common_prefixes(raw, order, window)[order] < window)
    sizes = np.array([len(s) for s in segments])
    ends = np.repeat(np.cumsum(sizes), sizes)
    place = np.flatnonzero(np.arange(len(raw)) + window <= ends)
    return place, kind[place]


def fingerprints(raw: np.ndarray, places: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the string of window bytes at each place; window is 8 at least."""
    words = grams8(raw)
    a, b = np.full(len(places), U(window)), np.full(len(places), U(window * 7))
    for k in [*range(0, window - 8, 8), window - 8]:
        w = words[places + k]
        a, b = mix(a * U(3) + w), mix((b ^ w) * U(5) + U(1))
    return a, b


def merge_runs(x: tuple, y: tuple) -> tuple:
    """Two runs (hash, second hash, holders), each sorted by hash, as one: the shorter is searched for in the longer."""
    x, y = sorted((x, y), key=lambda r: -len(r[0]))
    at = np.searchsorted(x[0], y[0])
    near = np.minimum(at, max(len(x[0]) - 1, 0))
    hit = (x[0][near] == y[0]) & (x[1][near] == y[1]) if len(x[0]) else np.zeros(0, bool)
    held = x[2].copy()
    held[near[hit]] += y[2][hit]
    return tuple(np.insert(u, at[~hit], v[~hit]) for u, v in zip((x[0], x[1], held), y))


def runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of neighbouring numbers; places ascend."""
    cut = np.flatnonzero(np.diff(places) > 1)
    return places[np.append(0, cut + 1)], places[np.append(cut, len(places) - 1)]


def anchors(docs: DataFrame, window: int) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            heads, cols = [], []
            for doc, sig, text in zip(p["doc_id"], p["sig"], p["text"]):
                got = anchored(np.frombuffer((text or "").encode(), dtype="uint8"), window)
                heads.append((doc, sig, len(got[0])))
                cols.append(got)
            if cols:
                h, s, n, m = (np.concatenate(c) for c in zip(*cols))
                doc, sig, many = zip(*heads)
                yield pd.DataFrame({"doc_id": np.repeat(doc, many), "sig": np.repeat(sig, many), "h": h, "s": s, "n": n, "m": m})

    return docs.mapInPandas(run, "doc_id long, sig long, h long, s int, n int, m int")


def segments(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The bytes of each wanted segment."""
    lists = wanted.groupBy("doc_id", "sig").agg(F.collect_list(F.struct("h", "s", "n", "m")).alias("all"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for k in range(0, len(p), 200):
                q = p.iloc[k : k + 200]
                rows = []
                for doc, sig, text, many in zip(q["doc_id"], q["sig"], q["text"], q["all"]):
                    raw = text.encode()
                    for a in many:
                        seg = raw[a["s"] : a["s"] + a["n"] + window - 1]
                        rows.append((doc, sig, a["h"], a["s"], a["m"], hashlib.blake2b(seg, digest_size=16).digest(), seg))
                yield pd.DataFrame(rows, columns=["doc_id", "sig", "h", "s", "m", "g", "seg"])

    return docs.join(lists, ["doc_id", "sig"]).select("doc_id", "sig", "text", "all").mapInPandas(
        run, "doc_id long, sig long, h long, s int, m int, g binary, seg binary"
    )


def repeated(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """doc_id, sig, lo, hi: runs of places where a string of window bytes starts that also starts elsewhere.

    docs has doc_id, sig and text; doc_id with sig names a text."""
    found = settle(anchors(docs, window))
    # a segment of several anchors may repeat itself. Written, so that a join dealt by a crowded hash can be split
    often = settle(found.groupBy("h").agg(F.sum("m").alias("c")).where("c > 1").select("h"))
    # repeated rows give the same segments twice, and a list of them for each row
    segs = settle(segments(docs, found.join(often, "h").dropDuplicates(["doc_id", "sig", "h", "s"]), window), packed=True)
    drop(found, often)
    single = settle(segs.groupBy("h", "g").agg(F.count("*").alias("c"), F.first("m").alias("m"), F.first(F.octet_length("seg")).alias("size"), F.first("seg").alias("seg")), packed=True)
    crowd = settle(single.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"))
    parts = F.when(F.col("k") > hot, F.ceil(F.col("k") / max(hot, 1))).otherwise(1)
    kinds = (
        single.join(crowd, "h", "left").where("k > 1 or m > 1").withColumn("parts", F.coalesce(parts, F.lit(1)))
        .select("h", "g", "seg", "size", "parts", F.pmod(F.xxhash64("g"), "parts").alias("part"))
    )
    total, spread = kinds.agg(F.sum("size"), F.sum(F.when(F.col("parts") > 1, F.col("size") - window + 1))).first()
    shards, ranges = max(1, -(-(total or 0) // SHARD_BYTES)), max(1, -(-(spread or 0) // RANGE_STRINGS))
    width = U(-(-(2**64) // ranges) if ranges > 1 else 2**64 - 1)

    def shard(p: pd.DataFrame) -> pd.DataFrame:
        segs = list(p["seg"])
        place, kind = window_classes(segs, window)
        sizes = np.array([len(s) for s in segs])
        owner = np.repeat(np.arange(len(segs)), sizes)[place]
        off = place - (np.cumsum(sizes) - sizes)[owner]
        seen = np.bincount(kind)
        good, rows = seen[kind] > 1, []
        for i, o in zip(*(lambda u, k: (u, np.split(off[good], k[1:])))(*np.unique(owner[good], return_index=True))):
            rows += [(p["h"].iat[i], p["g"].iat[i], int(a), int(b), None, None) for a, b in zip(*runs(o))]
        # one of each string of the split hashes goes on to be merged, with its place if it has no other here
        send = np.flatnonzero(p["parts"].to_numpy()[owner] > 1)
        send = send[np.unique(kind[send], return_index=True)[1]]
        if len(send):
            a, b = fingerprints(np.frombuffer(b"".join(segs), dtype="uint8"), place[send], window)
            by = np.argsort(a, kind="stable")
            a, b, send = a[by], b[by], send[by]
            names = np.frombuffer(b"".join(p["g"]), "V16")
            refs = np.zeros(len(send), REF)
            refs["h"], refs["g"] = p["h"].to_numpy()[owner[send]], names[owner[send]]
            refs["at"] = np.where(seen[kind[send]] > 1, -1, off[send])
            refs["a"], refs["b"] = a, b
            among = (a // width).astype("int64")
            for r, k in zip(*np.unique(among, return_index=True)):
                rows.append((None, None, None, None, int(r), refs[k : np.searchsorted(among, r, "right")].tobytes()))
        return pd.DataFrame(rows, columns=["h", "g", "lo", "hi", "r", "refs"], dtype=object).astype({"h": "Int64", "lo": "Int32", "hi": "Int32", "r": "Int32"})

    def merged(p: pd.DataFrame) -> pd.DataFrame:
        sent = [np.frombuffer(x, REF) for x in p["refs"]]
        left = [(x["a"].copy(), x["b"].copy(), np.ones(len(x), "int64")) for x in sent]
        while len(left) > 1:
            left = [merge_runs(*left[k : k + 2]) if k + 1 < len(left) else left[k] for k in range(0, len(left), 2)]
        a, b, held = left[0]
        rows = []
        for x in sent:
            at = np.searchsorted(a, x["a"])
            x = x[(held[at] > 1) & (b[at] == x["b"]) & (x["at"] >= 0)]
            rows += [(int(h), g.tobytes(), int(o)) for h, g, o in zip(x["h"], x["g"], x["at"])]
        return pd.DataFrame(rows, columns=["h", "g", "lo"])

    sorted_shards = settle(
        kinds.groupBy(F.pmod(F.xxhash64("h", "part"), F.lit(shards)).alias("b"))
        .applyInPandas(lambda p: shard(p), "h long, g binary, lo int, hi int, r int, refs binary")
    )
    across = sorted_shards.where("r is not null").groupBy("r").applyInPandas(lambda p: merged(p), "h long, g binary, lo int")
    whole = single.where("c > 1").select("h", "g", F.lit(0).alias("lo"), (F.col("size") - window).alias("hi"))
    inside = sorted_shards.where("r is null").select("h", "g", "lo", "hi")
    some = settle(inside.unionByName(across.withColumn("hi", F.col("lo"))).unionByName(whole))
    drop(single, crowd, sorted_shards)
    # of the segments only the places are read from here on
    return segs.select("doc_id", "sig", "h", "g", "s").join(some, ["h", "g"]).select(
        "doc_id", "sig", (F.col("s") + F.col("lo")).alias("lo"), (F.col("s") + F.col("hi")).alias("hi")
    )


def signed(docs: DataFrame) -> DataFrame:
    """own_id, doc_id, sig, text: a row without an own id is named by its text."""
    own = docs.select(F.col("doc_id").alias("own_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("sig", F.xxhash64("text"))
    return own.select("own_id", F.coalesce("own_id", "sig").alias("doc_id"), "sig", "text")


def cut_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) for every row of docs."""
    own = signed(docs)
    # a text held by repeated rows repeats as a whole
    copies = own.groupBy("doc_id", "sig").agg(F.count("*").alias("c"), F.max(F.octet_length("text")).alias("n"))
    alike = copies.where((F.col("c") > 1) & (F.col("n") >= window)).select(
        "doc_id", "sig", F.lit(0).alias("lo"), (F.col("n") - window).cast("int").alias("hi")
    )
    # repeated rows are found as copies of each other, and lose what they lose by alike: no text is shuffled to make them one
    found = repeated(own.select("doc_id", "sig", "text"), window)
    lists = found.unionByName(alike).groupBy("doc_id", "sig").agg(
        F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("starts")
    )

    @F.pandas_udf("n_removed long, n_spans long, kept binary")
    def cut(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, starts in parts:
            rows = []
            for text, many in zip(texts, starts):
                raw, kept, at, removed, spans = text.encode(), [], 0, 0, []
                for r in many if many is not None else ():
                    lo, hi = r["lo"], r["hi"] + window
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = max(hi, spans[-1][1])
                    else:
                        spans.append([lo, hi])
                for lo, hi in spans:
                    kept.append(raw[at:lo])
                    removed, at = removed + hi - lo, hi
                rows.append((removed, len(spans), b"".join(kept) + raw[at:]))
            yield pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept"])

    return own.join(lists, ["doc_id", "sig"], "left").withColumn("got", cut("text", "starts")).select(
        F.col("own_id").alias("doc_id"), "sig", F.octet_length("text").cast("long").alias("n_bytes"), "got.n_removed", "got.n_spans", "got.kept"
    )


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def stage_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages. Bytes of a character cut in half are dropped;
    documents of which nothing is left go."""
    small_batches(spark)
    sig, left, new = (free(docs, c) for c in ("sig", "left", "new"))
    # what is left of a text depends on the text alone
    kept = cut_repeats(docs).where("n_removed > 0").select(F.col("sig").alias(sig), F.col("kept").alias(left)).dropDuplicates([sig])

    @F.pandas_udf("string")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield p.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))

    kept = kept.withColumn(new, decode(left))
    own = docs.withColumn(sig, F.xxhash64(F.coalesce("text", F.lit(""))))
    out = own.join(kept, sig, "left").withColumn("text", F.when(F.col(left).isNull(), F.col("text")).otherwise(F.col(new)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.where(F.col(left).isNull() | (F.col("text") != "")).select(*docs.columns)
