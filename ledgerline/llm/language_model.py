"""Stupid-backoff scores: n-gram counts partitioned by hash, joined to the documents' n-grams, summed per document."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.arrays import U, _VALUE_LOWER, chunks, mix, ngrams, span_hashes, word_spans
from ledgerline.llm.common import ended

SCORES = "doc_id long, n_tokens long, score double, mean_score double, backed_off long"


class Settings(NamedTuple):
    """Longest n-gram, weight of a step back, bytes of a block of texts and n-grams of a part of the counts."""

    order: int = 3
    alpha: float = 0.4
    block_bytes: int = 16_000_000
    part_grams: int = 1_500_000


class Block(NamedTuple):
    """Texts laid end to end: the text of each word, where each text's words begin, and for each order the n-grams' hashes and first words."""

    owner: np.ndarray
    base: np.ndarray
    keys: list[np.ndarray]
    at: list[np.ndarray]


#: The key of the empty n-gram, which stands once for each word.
EMPTY = U(1)


def block_of(column: pa.ChunkedArray, order: int) -> Block:
    """The n-grams of each order, as 56-bit hashes, of all texts of a column; each text has a line end behind it."""
    words, counts = [np.zeros(0, dtype=U)], [np.zeros(0, dtype=np.int64)]
    for part in column.chunks:
        for _, data, bounds in chunks(part):
            firsts, ends = word_spans(data)
            words.append(span_hashes(_VALUE_LOWER[data], firsts, ends) if len(firsts) else words[0])
            counts.append(np.diff(np.searchsorted(firsts, bounds)))
    every, sizes = np.concatenate(words), np.concatenate(counts)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    keys, at = [], []
    for n in range(1, order + 1):
        there = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :]).astype(np.int32)
        keys.append((mix(ngrams(every, n)[there] + U(n)) if n > 1 else mix(every)) >> U(8))
        at.append(there)
    return Block(owner, np.concatenate(([0], np.cumsum(sizes))), keys, at)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, the low ones first; the planes of zeros at the top are left out."""
    wide = int(values.max(initial=1)).bit_length() + 7 >> 3
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T)
    raw = planes[-1].tobytes()
    top = zlib.compress(raw, 1)
    return bytes([wide]) + len(top).to_bytes(4, "little") + top + planes[:-1].tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    wide, size = data[0], int.from_bytes(data[1:5], "little")
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, wide - 1] = np.frombuffer(zlib.decompress(data[5 : 5 + size]), dtype=np.uint8)
    if wide > 1:
        out[:, : wide - 1] = np.frombuffer(data[5 + size :], dtype=np.uint8).reshape(wide - 1, n).T
    return out.view("<u8").reshape(-1)


def block_scores(block: Block, totals: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sum of log2 scores of its words, and how many words had to step back.

    totals are the counts of the block's distinct n-grams, order by order (the empty one is with the words), each in order
    of their keys.  Counts are those of
    all documents less the document's own, so that it does not speak for itself.  The block's keys are used up.
    """
    docs, words = len(block.base) - 1, len(block.owner)
    if not words:
        return np.zeros(docs), np.zeros(docs, dtype=np.int64)
    parts, done, everything = [], 0, 0
    for n in range(s.order):  # order by order, so that little stands in memory at once
        keys, owner = block.keys[n], block.owner[block.at[n]]
        block.keys[n] = np.zeros(0, dtype=U)
        if n == 0:
            keys, owner = np.append(keys, EMPTY), np.append(owner, np.int32(-1))
        # A stable sort brings equal n-grams together, those of one text next to each other, so own counts are lengths of runs.
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        other = np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)]
        own = np.flatnonzero(other | np.concatenate(([True], owner[1:] != owner[:-1]))[: len(keys)])
        place = np.cumsum(other, dtype=np.int32)
        net = totals[done + place - 1]
        done += int(place[-1]) if len(place) else 0
        if n == 0:
            everything = int(net[np.flatnonzero(order == len(order) - 1)[0]])
        times = np.diff(own, append=len(order)).astype(np.int32)
        net -= np.repeat(times, times)
        counts = np.empty(len(order), dtype=np.int64)
        counts[order] = np.maximum(net, 0, out=net)
        parts.append(counts[:words] if n == 0 else counts)
    rest = np.maximum(everything - np.diff(block.base), 1)[block.owner]
    score = np.where(parts[0] > 0, parts[0], 1) / rest  # a word that no other text has counts once
    stepped = parts[0] == 0 if s.order == 1 else np.zeros(words, dtype=bool)
    before = parts[0]  # by first word
    for n in range(2, s.order + 1):
        at, full = block.at[n - 1], parts[n - 1]
        last, context = at + (n - 1), before[at]
        score[last] *= s.alpha
        hit = (full > 0) & (context > 0)
        score[last[hit]] = full[hit] / context[hit]
        if n == s.order:
            stepped[last] = ~hit
        before = np.zeros(words, dtype=np.int64)
        before[at] = full
    return np.bincount(block.owner, np.log2(score), docs), np.bincount(block.owner[stepped], minlength=docs)


def score(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per row: doc_id, n_tokens, score (sum of log2), mean_score per token, backed_off (words that stepped back).

    Documents are dealt to blocks of about as many bytes.  Each block lists its distinct n-grams with their counts, cut by hash into parts;
    a part adds up the counts of all blocks and answers each block's list in its order; a block then scores its own
    documents.  So an n-gram is sent once a block however frequent it is, and no task gathers more than a part or a
    block.  All n-grams of all documents are counted.  Null and wordless texts have no tokens and a score of 0.
    """
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    blocks = max(1, math.ceil(size / settings.block_bytes))
    parts = max(1, math.ceil(size / 6 / settings.part_grams))  # of each order: about as many words as a sixth of the bytes
    # A hash of the whole row, so that only rows equal in everything stay together; their n-grams are listed once.
    whole = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    dealt = docs.select(F.col("doc_id").cast("long"), ended().alias("text"), F.pmod(F.xxhash64(*whole), F.lit(blocks)).cast("int").alias("block"))

    def ask(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        found = block_of(table.column("text"), settings.order)
        out: dict[str, list] = {x: [] for x in ("part", "block", "size", "grams", "counts")}
        for n in range(settings.order):
            keys = found.keys[n] if n else np.append(found.keys[0], EMPTY)
            found.keys[n] = np.zeros(0, dtype=U)
            known, counts = np.unique(keys, return_counts=True)
            if n == 0:
                counts[np.searchsorted(known, EMPTY)] += len(found.owner) - 1
            bounds = np.searchsorted(known >> U(32), -(-np.arange(parts + 1, dtype=np.int64) * (1 << 24) // parts).astype(U))
            for part, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                if b <= a:
                    continue
                steps = np.diff(known[a:b], prepend=U(0))
                for name, value in zip(out, (n * parts + part, block, b - a, int(steps[0]).to_bytes(8, "little") + pack(steps[1:]) if b - a > 1 else int(steps[0]).to_bytes(8, "little"), pack(counts[a:b])), strict=True):
                    out[name].append(value)
        return pa.table({"part": pa.array(out["part"], pa.int32()), "block": pa.array(out["block"], pa.int32()), "size": pa.array(out["size"], pa.int32()), "grams": pa.array(out["grams"], pa.binary()), "counts": pa.array(out["counts"], pa.binary())})

    def grams(row_grams: bytes, size: int) -> np.ndarray:
        first = np.frombuffer(row_grams[:8], dtype="<u8")
        return np.cumsum(np.concatenate([first, unpack(row_grams[8:], size - 1)]) if size > 1 else first, dtype=U)

    def answer(table: pa.Table) -> pa.Table:
        sizes = table.column("size").to_pylist()
        known = np.concatenate([grams(g.as_py(), n) for g, n in zip(table.column("grams"), sizes, strict=True)])
        counts = np.concatenate([unpack(c.as_py(), n) for c, n in zip(table.column("counts"), sizes, strict=True)])
        _, back = np.unique(known, return_inverse=True)
        totals = np.bincount(back, weights=counts).astype(np.int64)[back]
        ends = np.cumsum([0, *sizes])
        replies = [pack(totals[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.table({"block": table.column("block"), "part": table.column("part"), "size": table.column("size"), "totals": pa.array(replies, pa.binary())})

    def combine(own: pa.Table, replies: pa.Table) -> pa.Table:
        replies = replies.sort_by("part")
        totals = [unpack(t.as_py(), n) for t, n in zip(replies.column("totals"), replies.column("size").to_pylist(), strict=True)]
        block = block_of(own.column("text"), settings.order)
        scores, backed = block_scores(block, np.concatenate(totals).astype(np.int64), settings)
        sizes = np.diff(block.base)
        return pa.table({"doc_id": own.column("doc_id"), "n_tokens": pa.array(sizes), "score": pa.array(scores), "mean_score": pa.array(scores / np.maximum(sizes, 1)), "backed_off": pa.array(backed)})

    asked = dealt.groupBy("block").applyInArrow(ask, "part int, block int, size int, grams binary, counts binary")
    replies = asked.groupBy("part").applyInArrow(answer, "block int, part int, size int, totals binary")
    return dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(combine, SCORES)
