"""Quality by compression: zstandard dictionaries from good and from bad labelled text.

A text is compressed in CHUNK-byte pieces under both dictionaries; the difference of the two
sizes over their sum becomes a score through a logistic fit. The dictionaries are fitted on a
bounded sample, at most SAMPLE labelled rows of each class, those with the smallest hash of
doc_id, whole and without repeated texts; every second one teaches and the others calibrate. Each
dictionary is made in a task of its own. Scoring reads whole texts.

Null and empty texts have difference 0. With one class missing, or no labels, the score is the
smoothed rate of all labels. Ties and repeated rows score alike; an id that is labelled twice has its
higher label. Very long texts are compressed piece by piece. An empty table gives no rows. score()
replaces a column of its output's name and keeps all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, settle, table
from .toxicity import held_out, logistic, training

SAMPLE = 3000
DICT_BYTES = 30_000
SLICE = 500
CHUNK = 500
LEVEL = 3
KEEP = 0.3


def learn_dictionary(texts: list[str]) -> bytes:
    """A trained zstandard dictionary; few texts serve as raw content instead."""
    import zstandard

    parts = [raw[k : k + SLICE] for raw in map(str.encode, texts) for k in range(0, len(raw), SLICE)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[:DICT_BYTES]


def measured(good: bytes, bad: bytes, spark: SparkSession):
    """A column function from text to the difference of its sizes."""
    shared = spark.sparkContext.broadcast((good, bad))

    @F.pandas_udf("double")
    def measure(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import zstandard

        packers = [
            zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_content_size=False, write_dict_id=False)
            for d in shared.value
        ]
        for p in parts:
            out = []
            for t in p:
                raw = (t or "").encode()
                g, b = (sum(len(z.compress(raw[k : k + CHUNK])) for k in range(0, len(raw), CHUNK)) for z in packers)
                out.append((b - g) / (b + g) if raw else 0.0)
            yield pd.Series(out, dtype="float64")

    return measure


def fit(train: DataFrame) -> dict:
    """train (text, label 0/1, and weight and doc_id or all alike; bounded) to a model."""
    for name, value in (("weight", F.lit(1.0)), ("doc_id", F.xxhash64("text"))):
        train = train if name in train.columns else train.withColumn(name, value)
    first = train.where(F.length("text") > 0).groupBy("label", "text").agg(F.min(F.struct(F.xxhash64("doc_id"), "doc_id")).alias("o"), F.max("weight").alias("weight"))
    halves = first.withColumn("half", F.row_number().over(Window.partitionBy("label").orderBy("o", "text")) % 2)

    def teach(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"label": p["label"].iloc[:1], "made": [learn_dictionary(list(p["text"]))]})

    taught = halves.where("half = 1").select("label", "text").groupBy("label").applyInPandas(teach, "label int, made binary")
    made = {r["label"]: bytes(r["made"]) for r in taught.collect()}
    if len(made) < 2:
        rate = train.agg(F.sum(F.col("label") * F.col("weight")) / F.sum("weight")).first()[0]
        p = min(max(0.5 if rate is None else rate, 0.01), 0.99)
        return {"good": b"", "bad": b"", "slope": 0.0, "base": float(np.log(p / (1 - p)))}
    rest = halves.where("half = 0").select(measured(made[1], made[0], train.sparkSession)("text").alias("x"), "label", "weight")
    got = np.array([tuple(r) for r in rest.collect()], float).reshape(-1, 3)
    x, y, n = got.T
    slope, base = logistic(x * 20, y * n, n) if len(got) else (1.0, 0.0)
    return {"good": made[1], "bad": made[0], "slope": slope * 20, "base": base}


def score(docs: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a score of 0 to 1 in the column out."""
    x = measured(model["good"], model["bad"], docs.sparkSession)(F.col(text)) * F.lit(float(model["slope"])) + F.lit(float(model["base"]))
    return docs.withColumn(out, 1 / (1 + F.exp(-x)))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(5, 0)
    train = settle(training(docs, table(spark, sf_dir, "labels"), "quality", ~out, SAMPLE))
    model = fit(train)
    drop(train)
    return score(docs, model).select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted")
    )
