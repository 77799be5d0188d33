"""Importance resampling towards a target: hashed n-gram counts of both corpora, log ratios a bucket, Gumbel draws.

A text is lower-cased (A-Z), every run of separators becomes one blank, and an overlapped regular expression, held at
word boundaries by looking around, gives the span of every run of words; a span's bytes are hashed as they stand.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from operator import methodcaller
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.arrays import texts
from ledgerline.llm.common import cut, removed, table_path

RESULT = ("doc_id", "n_features", "weight", "score", "rank")

#: Bytes of words: 0-9, a-z and everything past ASCII; A-Z are lowered, all others become blanks.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BLANKS = re.compile(rb" {2,}")
_GROUP = methodcaller("group")


class Settings(NamedTuple):
    """Longest run of words, buckets, per cent of the documents drawn, least words of a document to be drawn, seed."""

    longest: int = 1
    buckets: int = 10_000
    percent: int = 10
    least_words: int = 20
    seed: int = 2024


def patterns(longest: int) -> list[regex.Pattern]:
    """For each length the expression of that many words between blanks or ends; overlapped, every start is tried."""
    return [regex.compile(rb"(?<![^ ])[^ ]+(?: [^ ]+){%d}(?![^ ])" % (n - 1)) for n in range(1, longest + 1)]


def buckets_of(data: bytes, spans: list[regex.Pattern], buckets: int) -> tuple[int, np.ndarray]:
    """The number of words of a text, and the bucket of each of its features."""
    clean = _BLANKS.sub(b" ", data.translate(_CLEAN))
    found = [np.fromiter(map(zlib.crc32, map(_GROUP, p.finditer(clean, overlapped=True))), dtype=np.uint32) for p in spans]
    return len(found[0]), (np.concatenate(found) % np.uint32(buckets)).astype(np.uint32)


def features(docs: DataFrame, key: str, s: Settings) -> DataFrame:
    """Per row: the key as doc_id, n_words, n_features and the features' buckets as little-endian 32-bit numbers."""
    fields = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.binary())])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = patterns(s.longest)
        for batch in batches:
            found = [buckets_of(data.tobytes(), spans, s.buckets) for data in texts(batch.column(1))]
            columns = [batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([len(b) for _, b in found], pa.int64()), pa.array([b.tobytes() for _, b in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=fields)

    return docs.select(F.col(key).cast("long").alias("doc_id"), "text").mapInArrow(scanned, "doc_id long, n_words long, n_features long, buckets binary")


def totals(found: DataFrame, s: Settings) -> np.ndarray:
    """How many features fall into each bucket; a task adds its own up first, so it sends one row a bucket at most."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(s.buckets, dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                counts += np.bincount(np.frombuffer(value.as_buffer(), dtype="<u4"), minlength=s.buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["bucket", "times"])

    rows = found.select("buckets").mapInArrow(added, "bucket long, times long").groupBy("bucket").agg(F.sum("times").alias("times")).toArrow()
    counts = np.zeros(s.buckets, dtype=np.int64)
    counts[rows.column("bucket").to_numpy()] = rows.column("times").to_numpy()
    return counts


def gains(raw: np.ndarray, target: np.ndarray, s: Settings) -> np.ndarray:
    """Thousandths of the log of how much likelier a feature of each bucket is in the target, each bucket counting one more."""
    all_raw, all_target = float(raw.sum() + s.buckets), float(target.sum() + s.buckets)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_raw / ((r + 1.0) * all_target))) for r, t in zip(raw.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Thousandths of a Gumbel value of a document; that of a null doc_id is of the empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, s: Settings = Settings(), target_key: str = "item_id") -> DataFrame:
    """Per row: doc_id, n_features, weight (mean gain), score (weight and noise) and rank among those drawn, null if not drawn.

    Of the documents with enough words the given share of the highest scores is drawn; ties go to the smaller doc_id, of
    equal doc_ids in any order.  A text is scanned once: its buckets are written to the shared folder, counted there, and
    read again when the gains are known.  What is sent to tasks is one number a bucket.  Null, empty and wordless texts
    have no features and the weight 0, and are not drawn; repeated rows count and are drawn each for itself.  Without any
    target text every bucket's gain follows from the documents alone.  Other columns of docs and target are not read.
    """
    spark = docs.sparkSession
    path = table_path(spark, "features")
    features(docs, "doc_id", s).write.parquet(path)
    found = spark.read.parquet(path)
    gain = spark.sparkContext.broadcast(gains(totals(found, s), totals(features(target, target_key, s), s), s))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = []
            for n, value in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                weights.append(int(gain.value[np.frombuffer(value.as_buffer(), dtype="<u4")].sum()) // n if n else 0)
            scores = [w + noise(d, s.seed) for w, d in zip(weights, batch.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weights, pa.int64()), pa.array(scores, pa.int64())], names=["doc_id", "n_words", "n_features", "weight", "score"])

    scored = cut(found.mapInArrow(weighed, "doc_id long, n_words long, n_features long, weight long, score long"))
    removed(spark, path)
    able = F.col("n_words") >= s.least_words
    ranked = numbered(scored.where(able), ["score desc", "doc_id"], "rank")
    drawn = s.percent * scored.where(able).count() // 100
    out = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return out.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long"))).select(*RESULT)


def numbered(df: DataFrame, order: list[str], name: str, rows_at_once: int = 20_000, most_ranges: int = 10_000) -> DataFrame:
    """Numbers from 1 in an order ("column" or "column desc"): rows are dealt to ranges, each counts its own, sizes are added up.

    Equal rows may be told apart in any way, so the numbered ranges are kept as written.
    """
    by = [F.col(c.removesuffix(" desc")).desc() if c.endswith(" desc") else F.col(c).asc() for c in order]
    parts = min(most_ranges, max(1, -(-df.count() // rows_at_once)))
    place = F.monotonically_increasing_id()
    ranged = cut(df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_place", place))
    part, within = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    ends, before = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).orderBy("_part").collect(), 0  # one row a range
    starts = []
    for r in ends:
        starts.append((r["_part"], before))
        before += r["_n"]
    table = df.sparkSession.createDataFrame(starts, "_part long, _before long")
    return ranged.withColumns({"_part": part, "_in": within}).join(F.broadcast(table), "_part").withColumn(name, F.col("_before") + F.col("_in") + 1).drop("_place", "_part", "_in", "_before")
