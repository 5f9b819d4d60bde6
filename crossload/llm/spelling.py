"""Spelling variants: words that differ by one letter, found with a trie over letter-group counts.

A word's vector says how many letters of each group it has; a trie arranges the words by one count
after the other. One inserted letter is a surplus of one in one group, a replaced one a surplus and a
deficit of one at most. So a depth-first search spends one surplus and one deficit on its way down, and
the words of the leaves that it reaches are compared letter by letter. All words of a task search at
once: a step of the search holds the words that are still on this path, and their nodes.

The trie is one for all words, but its upper levels (length and the first counts) are shuffle keys. A
word goes to the node of its own counts, and to those of its counts less one letter: words that differ
by one letter meet where that letter is taken away. A node that gathers too much is cut at its
next counts, and a crowded leaf by the first and the last half of its words, of which an edit leaves one whole.
A pair may meet in several nodes and is taken in the one of the letter that differs.

Occurrences are counted in each task before they are shuffled; a word's chain of forms is followed by
pointer doubling. Null and empty texts have no words; a null doc_id is hashed as an empty one. Repeated
rows count each time. Very long texts go block by block, each ending between words. Of near words with
equal counts the first in code-point order is the form. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, settle, table

LEAST_LETTERS = 6
LEAST_COUNT = 5
RATIO = 5  # a form is so many times as frequent
FAULT = 199  # one run in so many loses a letter
GROUPS = 12
FIRST_CUT = 2  # counts in the first shuffle key, besides the length
CUT_BY = 2
NODE_BYTES = 400_000
BATCH_BYTES = 4_000_000
PAIRS_BYTES = 16_000_000
BLOCK = 1_000_000
WORDS_HELD = 100_000

# letters by how frequent they are in European prose; a letter outside goes by its code
ORDER = "etaoinshrdlucmfwypvbgkjqxz"
GROUP = np.array([(ORDER.index(chr(c)) if chr(c) in ORDER else c) % GROUPS for c in range(256)])
LETTERS = {*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)}
# of a text in Latin-1: A-Z in lower case, and a space for all that isn't a letter
PLAIN = bytes((c + 32 if 0x41 <= c < 0x5B else c) if c in LETTERS else 32 for c in range(256))


def blocks(text: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        end = text.find(b" ", at + BLOCK)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def counted(docs: DataFrame) -> DataFrame:
    """word, n: the words of all texts, one letter deleted in one run of FAULT by the hash of doc_id and run."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], "string"), pa.array(held.values(), "int64")], ["word", "n"])
            held.clear()
            return made

        for p in parts:
            for doc, text in zip(p.column(0).to_pylist(), p.column(1)):
                begin = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                # a character outside of Latin-1 turns into a question mark, which is no letter either
                for part in blocks((text.as_py() or "").encode("latin-1", "replace").translate(PLAIN)):
                    for word, n in Counter(part.split()).items():
                        if len(word) >= LEAST_LETTERS:
                            h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), begin)
                            if h % FAULT == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                                if len(word) < LEAST_LETTERS:
                                    continue
                            held[word] += n
                if len(held) > WORDS_HELD:
                    yield out()
        yield out()

    parts = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def vectors(words: list[bytes]) -> np.ndarray:
    """How many letters of each group each word has."""
    sizes = np.array([len(w) for w in words], "int64")
    own = np.repeat(np.arange(len(words)), sizes)
    flat = GROUP[np.frombuffer(b"".join(words), "uint8")]
    return np.bincount(own * GROUPS + flat, minlength=len(words) * GROUPS).reshape(-1, GROUPS)


def node_key(length: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of length and counts."""
    x = length.astype("uint64")
    for k in range(counts.shape[1]):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + counts[:, k].astype("uint64") + np.uint64(k + 1)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(32))).view("int64")


def dealt(words: DataFrame, cut: int, above: int | None, halves: bool = False) -> DataFrame:
    """key, above, size, word, n, lost: each word at the nodes of its own counts (lost is -1) and of its counts less
    one letter; lost is the letter's group, or cut for all groups of which the node says nothing. above: the key
    cut earlier. With halves, each twice: by its first and by its last half."""
    names = ["key", "above", "size", "word", "n", "lost"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            words = [w.encode("latin-1") for w in p.column(0).to_pylist()]
            if not words:
                continue
            v = vectors(words)
            size, less = v.sum(1), v[:, :cut]
            who, lost = [np.arange(len(words))], [np.full(len(words), -1)]
            for g in range(GROUPS):
                have = np.flatnonzero(v[:, g] > 0)
                who.append(have)
                lost.append(np.full(len(have), g))
            who, lost = np.concatenate(who), np.concatenate(lost)
            left = v[who]
            taken = lost >= 0
            left[np.flatnonzero(taken), lost[taken]] -= 1
            short = size[who] - taken
            key = node_key(short, left[:, :cut])
            was = node_key(short, left[:, :above]) if above is not None else np.zeros(len(key), "int64")
            lost = np.minimum(lost, cut)
            once = np.unique(np.stack([who, lost]), axis=1, return_index=True)[1]  # groups below the cut are one
            who, lost, key, was, short = (x[once] for x in (who, lost, key, was, short))
            if halves:
                was, parted = key, []
                for i, m, d in zip(who, short, lost):
                    w, h = words[i], m // 2
                    parted.append((zlib.crc32(b"f" + w[:h]), zlib.crc32(b"l" + w[len(w) - (m - h) :])))
                ends = np.array(parted, "uint64").reshape(-1, 2)
                key = np.concatenate([node_key(was.view("uint64"), ends[:, [k]]) for k in (0, 1)])
                who, lost, was = (np.tile(x, 2) for x in (who, lost, was))
            at = pa.array(who)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(was), pa.array(size[who]), p.column(0).take(at), p.column(1).take(at), pa.array(lost.astype("int32"))], names)

    return words.mapInArrow(run, "key long, above long, size long, word string, n long, lost int")


def placed(words: DataFrame, node_bytes: int = NODE_BYTES) -> list[tuple[int, DataFrame, bool]]:
    """The counts that a node's key holds, the words at such nodes, and whether the nodes are halves of leaves:
    crowded nodes are cut at their next counts."""
    made, above, crowd = [], None, None
    for cut in [*range(FIRST_CUT, GROUPS, CUT_BY), GROUPS, None]:
        rows = dealt(words, cut or GROUPS, above, cut is None)
        if crowd is not None:
            rows = rows.join(crowd.select(F.col("key").alias("above")), "above", "left_semi")
        rows = settle(rows)
        if cut is None:  # halves: a node of these is searched as it is
            return [*made, (GROUPS, rows, True)]
        crowd = settle(rows.groupBy("key").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > node_bytes))
        made.append((cut, rows.join(crowd.select("key"), "key", "left_anti"), False))
        if not crowd.limit(1).count():
            return made
        above = cut
    return made


def search(key: np.ndarray, words: list[bytes], lost: np.ndarray, cut: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of places (x, y) of words one letter apart that meet in one node (key), for each pair once
    among all nodes. The trie holds the words that lost a letter; the others search for one with a surplus, and
    those in it for one with a surplus and a deficit, or none of both."""
    v = vectors(words)
    size = np.array([len(w) for w in words])
    width = int(size.max()) + 1
    letters = np.zeros((len(words), width), "uint8")
    letters[np.repeat(np.arange(len(words)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.frombuffer(b"".join(words), "uint8")

    trie = np.flatnonzero(lost >= 0)
    if not len(trie):
        return
    trie = trie[np.lexsort((*v[trie].T[::-1], key[trie]))]
    keys, root = np.unique(key[trie], return_inverse=True)
    nodes, steps = root, []
    for g in range(GROUPS):  # of each level: (node above, count) of its nodes, in order
        code = (nodes << 32) | v[trie, g]
        level, nodes = np.unique(code, return_inverse=True)
        steps.append(level)
    first = np.searchsorted(nodes, np.arange(nodes[-1] + 2))  # of each leaf, and the end

    def leaf(q: np.ndarray, at: np.ndarray, longer: bool, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The queries with the words of their leaves, some at a time, compared by letters."""
        many = first[at + 1] - first[at]
        ends = np.cumsum(many)
        most = max(1, PAIRS_BYTES // width)
        begin = 0
        while begin < len(q):
            stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, "right")))
            n = many[begin:stop]
            x = np.repeat(q[begin:stop], n)
            y = trie[np.repeat(first[at[begin:stop]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            begin = stop
            if same:
                x, y = x[x < y], y[x < y]
            a, b = letters[x], letters[y]
            equal = a == b
            if longer:
                ahead = np.logical_and.accumulate(equal, axis=1)
                good = (ahead[:, :-1] | (a[:, :-1] == b[:, 1:])).all(1)
                p = ahead[good].sum(1)
                x, y = x[good], y[good]
            else:
                good = equal.sum(1) == width - 1
                p = np.argmin(equal[good], axis=1)
                x, y = x[good], y[good]
                own = np.minimum(GROUP[letters[x, p]], cut) == lost[x]
                x, y, p = x[own], y[own], p[own]
            here = np.minimum(GROUP[letters[y, p]], cut) == lost[y]
            yield x[here], y[here]

    def down(g: int, q: np.ndarray, at: np.ndarray, surplus: int, deficit: int, longer: bool, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Queries q at nodes of level g, with what they have yet to spend: a deficit after the surplus, so that
        a pair is met from one side."""
        if not len(q):
            return
        if g == GROUPS:
            yield from leaf(q, at, longer, same)
            return
        for more in (0, 1, -1):
            left = (surplus - (more == 1), deficit - (more == -1))
            if min(left) < 0 or (more == -1 and surplus) or (g + 1 == GROUPS and any(left)):
                continue
            code = (at << 32) | (v[q, g] + more)
            to = np.minimum(np.searchsorted(steps[g], code), len(steps[g]) - 1)
            hit = (steps[g][to] == code) & (v[q, g] + more >= 0)
            yield from down(g + 1, q[hit], to[hit], *left, longer, same)

    whole = np.flatnonzero(lost < 0)
    at = np.minimum(np.searchsorted(keys, key[whole]), len(keys) - 1)
    met = keys[at] == key[whole]
    yield from down(0, whole[met], at[met], 1, 0, True, False)
    yield from down(0, trie, root, 0, 0, False, True)
    yield from down(0, trie, root, 1, 1, False, False)


def near_pairs(nodes: DataFrame, cut: int) -> DataFrame:
    """word, near, near_n: each pair of the words that meet in nodes, both ways."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            key, lost, n = (rows.column(c).to_numpy() for c in ("key", "lost", "n"))
            text = rows.column("word").combine_chunks()
            for x, y in search(key, [w.encode("latin-1") for w in text.to_pylist()], lost, cut):
                a, b = (pa.array(np.concatenate(z)) for z in ((x, y), (y, x)))
                yield pa.RecordBatch.from_arrays([text.take(a), text.take(b), pa.array(n[b.to_numpy()])], ["word", "near", "near_n"])

        held, used = [], 0
        for p in parts:  # whole nodes at a time, and of one length, so that no long word widens the others
            at = 0
            while at < p.num_rows:
                length = p.column(5).to_numpy()
                same = int(np.searchsorted(length, length[at], "right"))
                if held and held[0].column(5)[0].as_py() != length[at]:
                    yield from found(pa.Table.from_batches(held))
                    held, used = [], 0
                held.append(p.slice(at, same - at))
                used += int(p.column(1).to_numpy()[at:same].sum()) * 2
                at = same
                if used > BATCH_BYTES:
                    rows = pa.Table.from_batches(held).combine_chunks()
                    key = rows.column("key").to_numpy()
                    end = int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1])
                    if end:
                        yield from found(rows.slice(0, end))
                    held = rows.slice(end).to_batches()
                    used = int(rows.column("size").to_numpy()[end:].sum()) * 2
        if held:
            yield from found(pa.Table.from_batches(held))

    # a node holds whole words and, one longer, words that lost a letter: its length is one for both
    length = (F.col("size") - (F.col("lost") >= 0).cast("long")).alias("length")
    sorted_rows = nodes.select("key", "size", "word", "n", "lost", length).repartition("key").sortWithinPartitions("length", "key")
    return sorted_rows.mapInArrow(run, "word string, near string, near_n long")


def variants(words: DataFrame, node_bytes: int = NODE_BYTES) -> DataFrame:
    """word, n (distinct words of Latin letters) to word, form, root, n, n_near, form_n."""
    words = settle(words)
    at = placed(words, node_bytes)
    pairs = None
    for cut, rows, halves in at:
        some = near_pairs(rows, cut)
        some = some.distinct() if halves else some  # both halves may agree
        pairs = some if pairs is None else pairs.unionByName(some)
    best = settle(pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("best")))
    kept = F.when(-F.col("best.m") >= F.col("n") * RATIO, F.col("best"))
    formed = settle(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), kept["w"].alias("form"), (-kept["m"]).alias("form_n")))
    hop = settle(formed.where("form is not null").select("word", F.col("form").alias("to")))
    while True:  # each round doubles the steps; a chain has few, as counts grow by RATIO at each
        ahead = hop.select(F.col("word").alias("to"), F.col("to").alias("beyond"))
        moved = settle(hop.join(ahead, "to", "left").select("word", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")))
        drop(hop)
        hop = moved
        if not moved.where("moved").limit(1).count():
            break
    done = settle(formed.join(hop.select("word", F.col("to").alias("root")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
    drop(words, best, formed, hop)
    return done


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(counted(table(spark, sf_dir, "documents")).where(F.col("n") >= LEAST_COUNT))
