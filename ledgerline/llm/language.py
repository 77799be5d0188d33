"""Language identification by prediction by partial matching: code lengths under frozen byte context trees."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.arrays import _LOWER, texts
from ledgerline.llm.common import text_or_empty

PAD = 32  # stands before the first byte


class Trees(NamedTuple):
    """languages; symbol of each byte; state of each context of three symbols; bits of each (state, symbol, language)."""

    languages: list[str]
    symbols: np.ndarray
    states: np.ndarray
    bits: np.ndarray


def grams(data: np.ndarray) -> np.ndarray:
    """Each byte with the three before it, as one number."""
    d = np.concatenate(([PAD] * 3, _LOWER[data])).astype(np.uint32)
    return (d[:-3] << np.uint32(24)) | (d[1:-2] << np.uint32(16)) | (d[2:-1] << np.uint32(8)) | d[3:]


def build(rows: list[tuple[str, int, int]]) -> Trees:
    """Context trees of up to three bytes from counts of (language, bytes, times).

    A byte seen after a context has the chance count / (total + distinct) there; the escape to the context without
    its first byte has distinct / (total + distinct).  A context that a language has not seen costs nothing to leave.
    Below the empty context every byte has the chance 1 / 256.  The bits of all states, symbols and languages are
    worked out once: a state is a context that some language has seen, else its longest such suffix.
    """
    languages = sorted({r[0] for r in rows})
    code = {x: i for i, x in enumerate(languages)}
    lang = np.array([code[r[0]] for r in rows], dtype=np.int64)
    gram = np.array([r[1] for r in rows], dtype=np.int64)
    times = np.array([r[2] for r in rows], dtype=np.float64)
    seen = np.unique(np.concatenate([(gram >> s) & 255 for s in (0, 8, 16, 24)]))
    symbols = np.zeros(256, dtype=np.int64)  # 0 stands for bytes that were not seen
    symbols[seen] = np.arange(1, len(seen) + 1)
    a, n = len(seen) + 1, len(languages)
    parts = [symbols[(gram >> s) & 255] for s in (24, 16, 8, 0)]
    bits = np.full((1, a, n), 8.0, dtype=np.float32)
    rows_of = np.zeros(1, dtype=np.int64)  # the state below each context of the order before
    tables = [bits]
    base = 0
    for order in range(4):
        contexts = np.zeros(len(gram), dtype=np.int64)
        for p in parts[3 - order : 3]:
            contexts = contexts * a + p
        known, place = np.unique(contexts, return_inverse=True)
        counts = np.zeros((len(known), a, n), dtype=np.float32)
        np.add.at(counts, (place, parts[3], lang), times)
        total, distinct = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
        shorter = known % a ** (order - 1) if order else known
        below = np.concatenate(tables)[rows_of[shorter] if order else np.zeros(len(known), dtype=np.int64)]
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = -np.log2(counts / (total + distinct))
            leave = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0) + below
        tables.append(np.where(counts > 0, hit, leave))
        base += len(tables[-2])
        if order:  # a context of one more symbol falls back on the state of its suffix
            rows_of = np.tile(rows_of, a)
        else:
            rows_of = np.zeros(1, dtype=np.int64)
        rows_of[known] = base + np.arange(len(known))
    return Trees(languages, symbols, rows_of.astype(np.int32), np.concatenate(tables).astype(np.float32))


def code_lengths(data: np.ndarray, trees: Trees) -> np.ndarray:
    """The bits that each language's tree needs for the bytes of a text."""
    a = trees.bits.shape[1]
    total = np.zeros(len(trees.languages))
    step = 1 << 18
    for at in range(0, len(data), step):
        lead = data[max(0, at - 3) : at]
        s = trees.symbols[np.concatenate(([PAD] * (3 - len(lead)), _LOWER[lead], _LOWER[data[at : at + step]])).astype(np.int64)]
        state = trees.states[(s[:-3] * a + s[1:-2]) * a + s[2:-1]]
        total += trees.bits[state, s[3:]].sum(axis=0, dtype=np.float64)
    return total


def train(docs: DataFrame, per_language: int = 400) -> Trees | None:
    """Trees from about per_language documents of each value of lang, those of the least hashes of doc_id and text.

    Which documents are learnt from follows from the counts of each language, so nothing is sorted or gathered; what
    comes to the driver is bounded by the sample: one count for each sequence of four bytes.
    """
    rows = docs.where("lang is not null and doc_id is not null")
    share = rows.groupBy("lang").agg((F.lit(float(per_language)) / F.count("*")).alias("share"))
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("language")), F.lit(1 << 20)) / float(1 << 20)
    chosen = rows.join(F.broadcast(share), "lang").where(draw < F.col("share")).select("lang", text_or_empty().alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            found: dict[str, list[np.ndarray]] = {}
            for name, data in zip(names, texts(batch.column(1)), strict=True):
                found.setdefault(name, []).append(grams(data))
            for name, parts in found.items():
                keys, times = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(times.astype(np.int64))], names=["lang", "gram", "times"])

    counts = chosen.mapInArrow(count, "lang string, gram long, times long").groupBy("lang", "gram").agg(F.sum("times").alias("times"))
    found = counts.toPandas()
    return build(list(zip(found["lang"], found["gram"].tolist(), found["times"].tolist(), strict=True))) if len(found) else None


def held_out() -> Column:
    """True for the fifth of documents from which nothing is learnt."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def predict(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """Per row: doc_id, lang_pred (the language of the least code length) and score.

    The score is the share of that language among 2 ** -bits of all.  Ties go to the first name.  A null text, one
    without a letter, and any text when nothing was learnt give `und` and 0.
    """
    kept = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), text_or_empty().alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(trees)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            names, scores = [], []
            for letters, data in zip(batch.column(1).to_pylist(), texts(batch.column(2)), strict=True):
                if not letters or known is None:
                    names.append("und")
                    scores.append(0.0)
                    continue
                bits = code_lengths(data, known)
                best = int(np.argmin(bits))
                names.append(known.languages[best])
                scores.append(float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return kept.mapInArrow(each, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, per_language: int = 400) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score; learnt only from rows that are not held out."""
    found = predict(docs, train(docs.where(~held_out()), per_language))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
