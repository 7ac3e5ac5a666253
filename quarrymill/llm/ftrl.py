"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its words, pairs of adjacent words and pairs with one word between, each once, hashed into a fixed
number of buckets. FTRL-proximal keeps two numbers a bucket; their rates are per coordinate, and the L1 penalty holds
the weight of every bucket at 0 until its gradient sum exceeds it, so the model is a short list of weights, which is
broadcast. It is fitted on a bounded sample of labelled rows: features are made in parallel, and the learner, which is
sequential, reads them in the order of a hash of doc_id, so that a refit gives the same weights.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.llm.words import M1, M2, WordHashes, frugal, mix, sliced, small_batches

WORDS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    #: log2 of the number of buckets.
    bits: int = 20
    #: Labelled rows used for fitting are about this many, chosen by a hash of doc_id; fewer if there are fewer.
    sample_rows: int = 16_000
    epochs: int = 4
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.1


@dataclass(frozen=True)
class Model:
    """Weights of the buckets that have one, and the bias."""

    bits: int
    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits, np.float32)
        w[self.buckets] = self.weights
        return w


def buckets(text: str, hashes: WordHashes, bits: int) -> np.ndarray:
    """The bucket of every word, pair and skip-pair of a text, with repeats."""
    h = hashes.of([w.encode() for w in WORDS.findall(text.lower())])
    pairs = mix(h[:-1] * M1 + h[1:])
    skips = mix(h[:-2] * M2 + h[2:])
    return (np.concatenate([h, pairs, skips]) >> np.uint64(64 - bits)).astype(np.int32)


def _features(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in sliced(batches, "text"):
            found = [np.unique(buckets(t or "", hashes, bits)) for t in batch.column("text").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("tie"), batch.column("label"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["order", "tie", "label", "features"])

    return run


def _learner(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            lists = batch.column("features")
            flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            keys = zip(batch.column("order").to_pylist(), batch.column("tie").to_pylist())
            rows += [(k, y, flat[a:b].astype(np.int32)) for k, y, a, b in zip(keys, batch.column("label").to_pylist(), offsets, offsets[1:])]
        # Rows that repeat a doc_id are in the order of their texts' hashes, so a refit sees the same order.
        rows.sort(key=lambda r: r[0])
        bias_at = 1 << s.bits
        z, n = np.zeros(bias_at + 1), np.zeros(bias_at + 1)

        def weights(i):
            zi = z[i]
            w = -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(n[i])) / s.alpha + s.l2)
            return np.where((np.abs(zi) > s.l1), w, 0.0)

        for _ in range(s.epochs):
            for _, y, x in rows:
                i = np.append(x, bias_at)
                w = weights(i)
                p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
                g = p - y
                z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / s.alpha * w
                n[i] += g * g
        w = weights(np.arange(bias_at + 1))
        some = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(w[some])], ["bucket", "weight"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str, may_learn: Column, settings: Settings = Settings()) -> Model:
    """A model of ``labels[label]`` (0 or 1) from the rows of ``docs`` for which ``may_learn`` holds.

    Rows without a label or doc_id aren't used. A doc_id with several labels counts as 1 if one of them is. With no
    rows, or one class, the model has a bias at most.
    """
    known = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    known = known.where(may_learn)
    rate = min(1.0, settings.sample_rows / max(1, known.count()))
    order = F.xxhash64(F.col("doc_id"), F.lit("fit"))
    sample = known.where(F.pmod(order, F.lit(1 << 20)) < int(rate * (1 << 20)) + (rate == 1.0))
    rows = docs.select("doc_id", F.col("text")).join(sample, "doc_id").select(order.alias("order"), F.xxhash64("text").alias("tie"), "label", "text")
    made = rows.mapInArrow(frugal(_features(settings.bits)), "order long, tie long, label double, features array<int>")
    # repartition(1), unlike coalesce(1), keeps the making of features parallel.
    got = made.repartition(1).mapInArrow(frugal(_learner(settings)), "bucket long, weight double").toPandas()
    bias_at = 1 << settings.bits
    is_bias = got["bucket"].to_numpy() == bias_at
    return Model(settings.bits, got["bucket"].to_numpy()[~is_bias].astype(np.int32), got["weight"].to_numpy()[~is_bias].astype(np.float32), float(got["weight"].to_numpy()[is_bias].sum()))


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1, from the text alone. A null or empty text scores as the bias does."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        w, hashes = model.dense(), WordHashes()
        for part in parts:
            out = np.empty(len(part))
            for k, t in enumerate(part):
                b = buckets(t or "", hashes, model.bits)
                hit = np.unique(b[w[b] != 0])
                out[k] = 1 / (1 + np.exp(-np.clip(model.bias + w[hit].astype(np.float64).sum(), -35, 35)))
            yield pd.Series(out)

    return docs.withColumn(column, F.pandas_udf(frugal(scores), T.DoubleType())(F.col(text)))


def fold(key: Column, folds: int) -> Column:
    """crc32 of a key's text, modulo ``folds``; null keys are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)), F.lit(0))


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted.

    Learns labels.toxic from documents whose fold of five isn't 0. Null and empty texts are scored too (by the bias);
    repeated rows get equal scores; a null doc_id is held out.
    """
    model = fit(docs, labels, "toxic", fold(F.col("doc_id"), 5) != 0, settings)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
