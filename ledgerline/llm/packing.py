"""Best-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.arrays import mix, span_hashes
from ledgerline.llm.common import cut, text_or_empty

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECE + ", sequence_id long, offset long"


# ---------------------------------------------------------------- token ids
@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """By code point: 0 letter, 1 number, 2 other, 3 white space, as the byte-level pattern sees them."""
    import regex

    every = "".join(map(chr, range(0xD800))) + "퟿" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    kinds = np.full(0x110000, 2, dtype=np.uint8)
    for kind, pattern in ((0, r"\p{L}+"), (1, r"\p{N}+"), (3, r"\s+")):
        for m in regex.finditer(pattern, every):
            kinds[m.start() : m.end()] = kind
    return kinds


def token_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True where a pre-token of the byte-level pattern begins.

    points: code points of texts laid end to end; ends: where each text ends.  White space before a word keeps its
    last blank with the word, a run at the end of a text stays whole, and '\\'s', '\\'t', '\\'re' and the like split off.
    """
    n = len(points)
    kind = _symbols()[points]
    first = np.zeros(n + 1, dtype=bool)
    first[0] = True
    first[ends] = True
    start = np.empty(n, dtype=bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= first[:n]
    white = kind == 3
    tail = np.flatnonzero(white[:-1] & ~white[1:] & ~first[1:n])  # the last of white space before a word
    start[tail] = True
    start[tail[points[tail] == 32] + 1] = False
    quote = np.flatnonzero((points == 39) & start)
    if len(quote):
        last = np.searchsorted(ends, quote, side="right")
        room = ends[last] - quote
        at = lambda k: np.where(room > k, points[np.minimum(quote + k, n - 1)], 0)
        one, two = at(1), at(2)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for hit, size in ((quote[short], 2), (quote[long & ~short], 3)):
            start[hit + 1] = False
            after = hit + size
            start[after[after < n]] = True
    return start


class Ids:
    """Token ids of many texts at once: pre-tokens are found by array operations, and the tokenizer encodes each distinct one once.

    The cache of encoded pre-tokens holds at most `most` entries; it starts afresh beyond that.
    """

    def __init__(self, path: str, most: int = 1_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)  # sorted hashes, and for each its place and count in ids
        self.place, self.count = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        if len(self.known) + len(hashes) > self.most:
            self.clear()
        found = [x.ids for x in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        places = len(self.ids) + np.cumsum(counts) - counts
        self.ids = np.concatenate([self.ids, np.fromiter((i for f in found for i in f), dtype=np.uint32, count=int(counts.sum()))])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known, self.place, self.count = known[order], np.concatenate([self.place, places])[order], np.concatenate([self.count, counts])[order]

    def __call__(self, some: list[str], least: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and each text's count; arrays of some 100 bytes a character are of about `least` characters at a time."""
        ends = np.cumsum([0, *map(len, some)])
        parts, at = [], 0
        while at < len(some):
            end = max(at + 1, int(np.searchsorted(ends, ends[at] + least, side="right")) - 1)
            parts.append(self.encoded(some[at:end]))
            at = end
        ids, counts = zip(*parts, strict=True) if parts else ([np.zeros(0, dtype=np.uint32)], [np.zeros(0, dtype=np.int64)])
        return np.concatenate(ids), np.concatenate(counts)

    def encoded(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined, sizes = "".join(some), np.fromiter(map(len, some), dtype=np.int64, count=len(some))
        if not joined:
            return np.zeros(0, dtype=np.uint32), np.zeros(len(some), dtype=np.int64)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum(sizes)
        starts = np.flatnonzero(token_starts(points, np.unique(ends)))
        stops = np.append(starts[1:], len(points))
        hashes = span_hashes(mix(points.astype(np.uint64)), starts, stops)
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        new = (at == len(self.known)) | (self.known[np.minimum(at, max(len(self.known) - 1, 0))] != distinct) if len(self.known) else np.ones(len(distinct), dtype=bool)
        if new.any():
            if len(self.known) + int(new.sum()) > self.most:
                new[:] = True
            self.learn(distinct[new], [joined[a:b] for a, b in zip(starts[where[new]].tolist(), stops[where[new]].tolist(), strict=True)])
            at = np.searchsorted(self.known, distinct)
        counts, places = self.count[at][back], self.place[at][back]
        total = np.cumsum(counts)
        ids = self.ids[np.repeat(places - total + counts, counts) + np.arange(int(total[-1]))]
        before = np.concatenate(([0], total))
        bounds = np.searchsorted(starts, np.concatenate(([0], ends)))
        return ids, np.diff(before[bounds])


@lru_cache(maxsize=2)
def _ids(path: str) -> Ids:
    return Ids(path)


def pieces(docs: DataFrame, tokenizer_path: str, length: int = 1024, end_id: int = 2, batch_chars: int = 2_000_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (of the ids as little-endian 32-bit).

    A document longer than `length` tokens is cut from its end into full pieces; its first piece may be shorter.
    Null and empty texts give one piece that holds only the end id.  Repeated rows are packed each for itself.
    """

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _ids(tokenizer_path)
        tail = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            names, all_texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(all_texts):
                some, chars = [], 0
                while at + len(some) < len(all_texts) and chars < batch_chars:
                    some.append(all_texts[at + len(some)].as_py())
                    chars += len(some[-1])
                ids, counts = encode(some)
                rows: list[tuple[int, int, int, int, int]] = []
                begin = 0
                for i, count in enumerate(counts.tolist()):
                    own = np.concatenate([ids[begin : begin + count], tail])
                    begin += count
                    bounds = [0, *range((count + 1) % length or length, count + 2, length)]
                    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                        rows.append((i, k, a, b - a, zlib.crc32(own[a:b].tobytes())))
                columns = np.array(rows, dtype=np.int64).T
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(columns[0] + at)), pa.array(columns[1].astype(np.int32)), *map(pa.array, columns[2:])],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )
                at += len(some)

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(cut_up, PIECE)


# ---------------------------------------------------------------- packing
class OpenBins:
    """A segment tree over remaining capacities 0..size: how many open bins have each, and the tightest that fits."""

    def __init__(self, size: int) -> None:
        self.leaf = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaf)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, name: int) -> None:
        self.bins[room].append(name)
        at = self.leaf + room
        while at:
            self.tree[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (room, bin) of the least room that is at least need."""
        at = self.leaf + need
        if not self.tree[at]:
            while at > 1 and (at & 1 or not self.tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaf:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        room = at - self.leaf
        while at:
            self.tree[at] -= 1
            at >>= 1
        return room, self.bins[room].pop()


def best_fit(lengths: list[int], size: int) -> tuple[list[int], list[int], int]:
    """Best-fit for lengths already in falling order: each one's bin and offset, and the number of bins."""
    open_bins, bins, offsets, n = OpenBins(size), [], [], 0
    for need in lengths:
        found = open_bins.take(need)
        room, name = found if found else (size, n)
        n += not found
        bins.append(name)
        offsets.append(size - room)
        if room > need:
            open_bins.add(room - need, name)
    return bins, offsets, n


def pack(items: DataFrame, length: int = 1024, shard_pieces: int = 100_000) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most `length` tokens by best-fit decreasing.

    Pieces are dealt by a hash to shards of about `shard_pieces`, each packed by itself, so that no
    task sees more; the loss against packing all at once is about the square root of a shard's pieces.  Sequence ids
    are the shard's number times 2**32 plus the bin's.
    """
    items = cut(items)
    shards = max(1, math.ceil(items.count() / shard_pieces))

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets, _ = best_fit(table.column("length").to_pylist(), length)
        shard = table.column("shard")[0].as_py() if len(table) else 0
        names = pa.array(np.array(bins, dtype=np.int64) + (shard << 32))
        return table.drop_columns(["shard"]).append_column("sequence_id", names).append_column("offset", pa.array(offsets, type=pa.int64()))

    # A row's place among the written rows is a part of its hash, so that equal rows are dealt out too.
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(fill, PACKED)


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = 1024, end_id: int = 2) -> DataFrame:
    """Tokenises, cuts and packs all documents: one row per piece with its sequence and its place there."""
    return pack(pieces(docs, tokenizer_path, length, end_id), length)
