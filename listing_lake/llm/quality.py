"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates.

A text's features are its words and word pairs, hashed to ``2**bits`` places; a word that repeats the one before it counts
as the mark of a repeat. A feature's value is its share of the text's n-grams times ``SCALE``, so a score is one sparse dot
product, a sum of looked-up weights. Labelled rows come in a sample of at most ``max_rows`` ids by hash order. Shards of the
sample train apart, each in its own task, and their weights are averaged, which is the model: ``2**bits`` numbers at most.

Null and empty texts have no features and score by the intercept. Rows without a label, and labels without a row, train
nothing; of an id with several labels the greatest counts. Without any sample the score is one half.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listing_lake.llm.common import crc_mod
from listing_lake.llm.textvec import Words, whole_texts

SCALE = 16.0
REPEAT, LEFT, RIGHT = np.uint64(0x5851F42D4C957F2D), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA5A3564F8F3D2B1D)


def ngrams(texts: list[str | None], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and hashed places of all words and word pairs, repeats included, a block of texts at a time."""
    for group in whole_texts(texts):
        found = [(words.number, words.row) for words in (Words(*block) for block in group)]
        one, row = (np.concatenate(x) for x in zip(*found, strict=True))
        number, one = one, one.copy()
        same = row[1:] == row[:-1]
        one[1:][same & (number[1:] == number[:-1])] = REPEAT
        two = (one[:-1] * LEFT ^ (one[1:] >> np.uint64(7)) * RIGHT)[same]
        places = (np.concatenate([one, two]) >> np.uint64(64 - bits)).astype(np.int64)
        yield np.concatenate([row, row[1:][same]]), places


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights after ``epochs`` passes; the last place is the intercept."""
    size = (1 << bits) + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    for _ in range(epochs):
        for at, value, label in rows:
            gone = 1.0 / (1.0 + np.exp(-np.clip(w[at] @ value, -35, 35))) - label
            g = gone * value
            square = g * g
            s = (np.sqrt(n[at] + square) - np.sqrt(n[at])) / alpha
            z[at] += g - s * w[at]
            n[at] += square
            w[at] = np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))
    return w


def sampled(docs: DataFrame, labels: DataFrame, label_col: str, learn: Column, max_rows: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``max_rows`` labelled ids by hash order, with one text each (of rows that repeat an id, the least text). Only ids
    and labels are sorted; the sample is small by that bound and is what gets broadcast."""
    ids = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & learn)
    ids = ids.groupBy(id_col).agg(F.max(label_col).cast("int").alias("_label"))
    ids = ids.orderBy(F.xxhash64(id_col), id_col).limit(max_rows).withColumnRenamed(id_col, "_of")
    some = docs.select(F.col(id_col).alias("_id"), F.col("text").alias("_text"))
    found = some.join(F.broadcast(ids), F.col("_id") == F.col("_of")).filter(F.col("_text").isNotNull())
    return found.groupBy("_id", "_label").agg(F.min("_text").alias("_text"))


def train(
    sample: DataFrame, *, bits: int = 18, shards: int = 4, epochs: int = 4, alpha: float = 0.5, beta: float = 0.1, l1: float = 0.02, l2: float = 0.01
) -> dict[int, float]:
    """Averaged weights of the shards, by place. Bounded by ``2**bits`` + 1 whatever the input."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id", key=lambda ids: ids.map(lambda i: zlib.crc32(str(i).encode())))
        rows = []
        found = list(ngrams(pdf["_text"].tolist(), bits))
        row, place = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(row, kind="stable")
        ends = np.searchsorted(row[order], np.arange(len(pdf) + 1))
        for i, label in enumerate(pdf["_label"]):
            at, count = np.unique(place[order[ends[i] : ends[i + 1]]], return_counts=True)
            value = SCALE * count / max(1, count.sum())
            rows.append((np.append(at, 1 << bits), np.append(value, 1.0), int(label)))
        w = ftrl(rows, bits, epochs, alpha, beta, l1, l2)
        at = np.flatnonzero(w)
        return pd.DataFrame({"place": at, "weight": w[at]})

    dealt = sample.withColumn("_shard", F.pmod(F.xxhash64("_id", F.lit("shard")), F.lit(shards)))
    weights = dealt.groupBy("_shard").applyInPandas(fit, "place long, weight double")
    return {r.place: r.weight for r in weights.groupBy("place").agg((F.sum("weight") / shards).alias("weight")).collect()}


def score(docs: DataFrame, weights: dict[int, float], *, bits: int = 18, text_col: str = "text") -> DataFrame:
    """Adds ``score``, the probability of label 1."""
    dense = np.zeros((1 << bits) + 1, np.float32)
    dense[list(weights)] = list(weights.values())
    shared = docs.sparkSession.sparkContext.broadcast(dense)

    def apply(texts: pd.Series) -> pd.Series:
        w = shared.value
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        for row, place in ngrams(texts.tolist(), bits):
            total += np.bincount(row, w[place], len(texts))
            n += np.bincount(row, minlength=len(texts))
        out = w[-1] + SCALE * total / np.maximum(n, 1)
        return pd.Series(1.0 / (1.0 + np.exp(-np.clip(out, -35, 35))))

    return docs.withColumn("score", F.pandas_udf(apply, "double")(F.col(text_col)))


def digest(docs: DataFrame, labels: DataFrame, *, max_rows: int = 12_000, **parameters) -> DataFrame:
    """The contract's columns. Rows with remainder 1 are held out of the sample."""
    weights = train(sampled(docs, labels, "quality", crc_mod(F.col("doc_id"), 3) != 1, max_rows), **parameters)
    scored = score(docs.select("doc_id", "text"), weights, **{k: v for k, v in parameters.items() if k == "bits"})
    return scored.select(
        "doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
