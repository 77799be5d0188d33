"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ledgerline.llm.arrays import _VALUE, mix, ngrams, span_hashes, texts
from ledgerline.llm.common import text_or_empty

_KIND = np.full(256, 3, dtype=np.uint8)  # 0 white space, 1 letters, 2 digits, 3 marks
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2


class Settings(NamedTuple):
    """sample_rows bounds the labelled rows that are learnt from; bits gives the number of weights."""

    bits: int = 18
    orders: int = 2
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.2
    epochs: int = 4
    sample_rows: int = 12_000
    shards: int = 4


def features(data: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's hashed n-grams: square roots of counts, scaled to length 1; place 0 is constant.

    A word is a run of letters, of digits or of one text's other marks; the letters keep their case.
    """
    kind = _KIND[data]
    edge = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1], [True]))) if len(kind) else np.zeros(1, dtype=np.int64)
    starts, ends = edge[:-1], edge[1:]
    words = kind[starts] > 0
    starts, ends = starts[words], ends[words]
    if not len(starts):
        return np.zeros(1, dtype=np.int64), np.ones(1)
    hashes = span_hashes(_VALUE[data], starts, ends)
    shift = np.uint64(64 - settings.bits)
    every = [mix(hashes) >> shift] + [ngrams(hashes, n) >> shift for n in range(2, settings.orders + 1)]
    counts = np.bincount(np.concatenate(every).view(np.int64), minlength=1)
    places = np.flatnonzero(counts)
    values = np.sqrt(counts[places])
    values *= 4 / math.sqrt(float(values @ values))
    return np.concatenate(([0], places[places > 0])), np.concatenate(([1.0], values[places > 0]))


class Leader:
    """Follow-the-proximally-regularised-leader with per-coordinate rates."""

    def __init__(self, settings: Settings) -> None:
        self.s = settings
        self.z = np.zeros(1 << settings.bits)
        self.n = np.zeros(1 << settings.bits)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n, s = self.z[at], self.n[at], self.s
        return np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

    def update(self, at: np.ndarray, x: np.ndarray, label: int, weight: float) -> None:
        w = self.weights(at)
        slope = (sigmoid(float(w @ x)) - label) * weight * x
        square = slope * slope
        n = self.n[at]
        self.z[at] += slope - (np.sqrt(n + square) - np.sqrt(n)) / self.s.alpha * w
        self.n[at] = n + square


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-min(max(x, -40.0), 40.0)))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), label: str = "quality") -> np.ndarray:
    """The weights learnt from at most settings.sample_rows rows of labels, the first by a hash of doc_id.

    The sample is dealt to a fixed number of shards; each learns from its own rows in an order by hash, and the
    shards' weights are averaged.  Rows with a null label or null doc_id are left out.  With no rows all weights are 0.
    """
    chosen = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    chosen = chosen.withColumn("k", F.xxhash64("doc_id", "y")).orderBy("k", "doc_id").limit(settings.sample_rows)
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")  # at most sample_rows of two numbers
    rows = rows.select(F.pmod(F.shiftright("k", 7), F.lit(settings.shards)).alias("shard"), "k", "y", "text")

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        found = [features(data, settings) for c in table.column("text").chunks for data in texts(c)]
        y = table.column("y").to_pylist()
        share = max(min(sum(y) / len(y), 0.99), 0.01)
        model = Leader(settings)
        for _ in range(settings.epochs):
            for (at, x), label_ in zip(found, y, strict=True):
                model.update(at, x, label_, math.sqrt(0.5 / (share if label_ else 1 - share)))
        return pa.table({"rows": pa.array([len(y)], pa.int64()), "weights": pa.array([model.weights().astype(np.float32).tobytes()])})

    models = rows.groupBy("shard").applyInArrow(learn, "rows long, weights binary").collect()
    total = np.zeros(1 << settings.bits)
    for m in models:
        total += np.frombuffer(bytes(m["weights"]), dtype=np.float32) * m["rows"]
    return (total / max(1, sum(m["rows"] for m in models))).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, settings: Settings = Settings(), name: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 (the chance of label 1) in place of any column of that name.

    The weights are a fixed 2**bits numbers.  A null or empty text has only the constant feature.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    columns = [c for c in docs.columns if c.lower() != name.lower()]

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            found = []
            for data in texts(batch.column(place)):
                at, x = features(data, settings)
                found.append(sigmoid(float(w[at] @ x)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*columns, name])

    kept = docs.select(*[F.col(f"`{c}`") for c in columns])
    place = columns.index("text")
    return kept.mapInArrow(scores, StructType([*kept.schema.fields, StructField(name, DoubleType())]))


def held_out() -> Column:
    """True for the third of documents from which nothing is learnt."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted (1 if score >= 0.5)."""
    weights = train(docs, labels.where(~held_out()), settings)
    scored = score(docs.select("doc_id", "text"), weights, settings)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
