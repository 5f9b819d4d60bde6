"""Best-fit packing of tokenised documents into sequences of at most CAPACITY tokens.

Bulk-synchronous best-fit-decreasing. Documents are dealt by (length, bucket) and ranked within
their length, gaps by (size, sequence). Lengths and gaps are whole numbers up to CAPACITY, so
all documents of one length form one step: each step matches the documents, by rank, to the
smallest gaps that hold them (the successor sweep), updates those gaps, and goes on with the
next shorter length. A step handles ranges of ranks and sequences, never single rows: the
driver sees one count per length (at most CAPACITY rows) and makes a plan of ranges, whose
size depends on CAPACITY only; documents then find their sequence from their rank in parallel.

Null or empty text is the single end token. Longer documents are cut into CAPACITY pieces.
Repeated rows are packed each by itself; ties in length are ranked by id. An empty table gives
no rows.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import re
import struct
import sys
import threading
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free, settle, small_batches, table

CAPACITY = 4096
END_ID = 1
BUCKETS = 256
TEXTS_AT_ONCE = 256
KNOWN_CHUNKS = 300_000
LINGER = 5.0


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary: itself where it prints, else the next after 255."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [k for k in range(256) if k not in prints]
    return {k: chr(k) for k in prints} | {k: chr(256 + n) for n, k in enumerate(rest)}


# Fixed pattern: how the tokenizer cuts a text, for the Latin characters that PLAIN admits
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ɏ]+|[0-9¹²³¼½¾]|[^\sa-zªµºß-öø-ɏ0-9¹²³¼½¾]+")
PLAIN = re.compile(r"[!-~¡-įı-ɏ]+")


@functools.lru_cache(1)
def raw_encoder(path: str | None = None):
    """A function from text to its token ids as little-endian 32-bit numbers. The tokenizer drops white
    space and no token crosses it, so a text's ids are those of its chunks between spaces and line
    feeds. Chunks seen before are remembered, and so are the pieces that the tokenizer's own pattern
    makes of them: a new piece goes to the vocabulary's merges alone. Both memories are cleared at
    KNOWN_CHUNKS entries; a worker keeps them from task to task (see lingering)."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path or tokenizer_path())
    pack_ids = [struct.Struct(f"<{n}I").pack for n in range(8)]
    model, letters, known, pieces = made.model, byte_letters(), {}, {}

    def piece(text: str) -> bytes:
        got = pieces.get(text)
        if got is None:
            if len(pieces) >= KNOWN_CHUNKS:
                pieces.clear()
            inner = text if text.isascii() else text.encode().decode("latin-1").translate(letters)
            ids = [k.id for k in model.tokenize(inner)]
            got = pieces[text] = pack_ids[len(ids)](*ids) if len(ids) < 8 else np.array(ids, "<u4").tobytes()
        return got

    def chunk(text: str) -> bytes:
        if len(text) < 100 and PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(piece, PIECES.findall(text.lower())))
        return np.array(made.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(text: str) -> bytes:
        chunks = text.replace("\n", " ").split(" ")
        try:
            return b"".join(map(known.__getitem__, chunks))
        except KeyError:
            if len(known) >= KNOWN_CHUNKS:
                known.clear()
            own = {c: chunk(c) for c in chunks if c not in known}
            known.update((c, x) for c, x in own.items() if len(c) < 100)
            return b"".join([own[c] if c in own else known[c] for c in chunks])

    return encode


def encoder(path: str | None = None):
    """A function from text to the list of its token ids."""
    raw = raw_encoder(path)
    return lambda text: np.frombuffer(raw(text), "<u4").tolist()


def forget() -> None:
    """Drop the encoder with all that it remembers, and hand what is free back to the system."""
    raw_encoder.cache_clear()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):  # where the C library has none
            ctypes.CDLL(None).malloc_trim(0)


class lingering:
    """Within it, a worker has its encoder; LINGER seconds after the last one has ended, the worker forgets it, as Spark keeps
    workers for other work, which would find that memory taken."""

    timer: threading.Timer | None = None

    def __enter__(self) -> None:
        if lingering.timer:
            lingering.timer.cancel()

    def __exit__(self, *error) -> None:
        pa.default_memory_pool().release_unused()  # of the thread that calls it
        lingering.timer = threading.Timer(LINGER, forget)
        lingering.timer.daemon = True
        lingering.timer.start()


def cut(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """docs (doc_id, text) to pieces: doc_id, piece, start, length, ids (little-endian 32-bit)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with lingering():
            encode, end, names = raw_encoder(path), np.array([END_ID], "<u4").tobytes(), ["doc_id", "piece", "start", "length", "ids"]
            for whole in parts:
                for p in (whole.slice(k, TEXTS_AT_ONCE) for k in range(0, whole.num_rows, TEXTS_AT_ONCE)):
                    rows = []
                    for at, text in enumerate(p.column(1).to_pylist()):
                        ids = encode(text or "") + end
                        for n, s in enumerate(range(0, len(ids), 4 * capacity)):
                            rows.append((at, n, s // 4, ids[s : s + 4 * capacity]))
                    at, n, start, ids = zip(*rows)
                    # ids stay Arrow numbers, so that null and large ones pass as they are
                    yield pa.RecordBatch.from_arrays([
                        p.column(0).take(pa.array(at)), pa.array(n, "int32"), pa.array(start, "int64"),
                        pa.array([len(x) // 4 for x in ids], "int64"), pa.array(ids, "binary")], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids binary"
    )


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Counts by length to ranges (length, first rank, rows, first sequence, offset).

    Row first+i of the length goes to sequence first+i at the offset. Longest first; each to
    the fullest sequences with room, else to new ones, several to a new one where they fit.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # size of gap: ranges (first sequence, how many)
    sizes: list[int] = []
    plan, fresh = [], 0

    def add(size: int, first: int, many: int) -> None:
        if size and many:
            if size not in gaps:
                gaps[size] = []
                insort(sizes, size)
            gaps[size].append((first, many))

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect_left(sizes, length)
            if k == len(sizes):
                each = capacity // length
                many = -(-left // each)
                add(capacity, fresh, many)
                fresh += many
                continue
            size = sizes[k]
            first, many = gaps[size].pop()
            if not gaps[size]:
                del gaps[size]
                sizes.pop(k)
            used = min(many, left)
            plan.append((length, rank, used, first, capacity - size))
            add(size, first + used, many - used)
            add(size - length, first, used)
            rank, left = rank + used, left - used
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """pieces (any columns, with doc_id, piece, length) with sequence_id and offset.

    Pieces should be a written table: they are read twice."""
    spark = pieces.sparkSession
    b, before_c, k, rank_c, at_c = (free(pieces, c) for c in ("b", "before", "k", "rank", "at"))
    dealt = pieces.withColumn(b, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", b).agg(F.count("*").alias("n"))
    by_length = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most CAPACITY rows
    plan = sorted(best_fit({r["length"]: r["n"] for r in by_length}, capacity))
    shared = spark.sparkContext.broadcast(np.array(plan, dtype="int64").reshape(-1, 5))
    before = counts.select(
        "length", b,
        (F.sum("n").over(Window.partitionBy("length").orderBy(b).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias(before_c),
    )
    ranked = (
        dealt.withColumn(k, F.row_number().over(Window.partitionBy("length", b).orderBy("doc_id", "piece")))
        .join(before, ["length", b])
        .withColumn(rank_c, F.col(before_c) + F.col(k) - 1)
        .select(*pieces.columns, rank_c)
    )

    @F.pandas_udf("sequence_id long, offset long")
    def find(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        p = shared.value
        first_of = np.searchsorted(p[:, 0], np.arange(capacity + 2))
        for length, rank in parts:
            n, r = length.to_numpy("int64"), rank.to_numpy("int64")
            # ranks restart at each length: shift each length's ranks past the one before
            base = np.zeros(capacity + 2, dtype="int64")
            tops = np.zeros(capacity + 2, dtype="int64")
            np.maximum.at(tops, p[:, 0], p[:, 1] + p[:, 2])
            base[1:] = np.cumsum(tops)[:-1]
            at = np.searchsorted(base[p[:, 0]] + p[:, 1], base[n] + r, side="right") - 1
            at = np.maximum(at, first_of[n])
            yield pd.DataFrame({"sequence_id": p[at, 3] + r - p[at, 1], "offset": p[at, 4]})

    return (
        ranked.withColumn(at_c, find("length", rank_c))
        .withColumns({"sequence_id": F.col(at_c)["sequence_id"], "offset": F.col(at_c)["offset"]})
        .drop(at_c, rank_c)
    )


def sequences(packed: DataFrame) -> DataFrame:
    """Packed pieces to sequence_id, n_tokens, ids: the sequences themselves, pieces in the order of their offsets."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    whole = F.aggregate(F.transform(parts, lambda p: p["ids"]), F.lit(bytearray()), lambda ids, more: F.concat(ids, more))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), whole.alias("ids"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(settle(cut(table(spark, sf_dir, "documents"))))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    packed = pack(settle(cut(docs)))
    return packed.select("doc_id", "piece", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
