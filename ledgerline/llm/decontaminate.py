"""Benchmark decontamination: every training passage queries a BM25 index of test items with block-max WAND."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import partial, reduce
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.arrays import ngrams, texts, word_hashes
from ledgerline.llm.common import cut, fresh, text_or_empty

K1, B = 1.2, 0.75
FOUND = "item_id long, score double, question_overlap double, answer_overlap double, first_word long, last_word long"


class Item(NamedTuple):
    name: int
    question: np.ndarray  # sorted n-gram hashes
    answer: np.ndarray
    length: int
    sizes: tuple[int, int]  # words of the n-grams of both
    place: int  # among the items


class Index(NamedTuple):
    """Postings by term, cut into blocks; impacts are shares of the item's score against itself, so 1 is a full match."""

    terms: np.ndarray  # sorted word hashes
    most: np.ndarray  # the largest impact of each term
    items: list[list[int]]  # by term: the items in rising order,
    impacts: list[list[float]]  # their impacts,
    ends: list[list[int]]  # the last item of each block
    peaks: list[list[float]]  # and the largest impact in it
    block: int
    ranges: np.ndarray  # by term and range of items: the largest impact there
    known: list[Item]  # by entry: a long item has several, each a piece of it


def parts(text: str) -> tuple[str, str]:
    """Question and answer of an item: the last sentence of a text is its answer, or the last third of a single one."""
    cuts = [m.end() for m in re.finditer(r"[.!?:]\s+", text.rstrip())]
    if cuts and len(text[cuts[-1] :].split()) < 3 and len(cuts) > 1:
        cuts.pop()
    if cuts:
        return text[: cuts[-1]], text[cuts[-1] :]
    words = text.split()
    at = len(words) - max(1, len(words) // 3)
    return " ".join(words[:at]), " ".join(words[at:])


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), dtype=np.uint8)


class Corpus(NamedTuple):
    """What BM25 needs to know of all entries: their number, their mean length, and how many have each of some terms."""

    entries: int
    usual: float
    terms: np.ndarray  # sorted word hashes
    often: np.ndarray


def bags(text: str, piece: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct words of each entry of an item and their counts: its even pieces of at most `piece` words."""
    words = word_hashes(_bytes(text))
    return [np.unique(some, return_counts=True) for some in np.array_split(words, -(-len(words) // piece))] if len(words) else []


def build(rows: list[tuple[int, str]], n: int = 5, block: int = 32, ranges: int = 64, piece: int = 64, corpus: Corpus | None = None) -> Index:
    """The index of items given as (item_id, text); items without words are left out.

    Unless told what all entries are like, these items are all there are.

    An item of over `piece` words has an entry for each of its even pieces of at most that many, so that any one lies
    within a passage.  The entries are also cut into a fixed number of ranges, so that all bounds of a text come from one array operation.
    """
    known, own_bags = [], []
    for place, (name, text) in enumerate(sorted(rows, key=lambda r: (r[0], r[1]))):
        words = word_hashes(_bytes(text))
        if len(words):
            question, answer = (word_hashes(_bytes(t)) for t in parts(text))
            sizes = tuple(min(n, max(1, len(x))) for x in (question, answer))
            item = Item(name, *(np.unique(ngrams(x, size)) for x, size in zip((question, answer), sizes, strict=True)), len(words), sizes, place)
            for bag in bags(text, piece):
                known.append(item)
                own_bags.append(bag)
    terms, often = np.unique(np.concatenate([b[0] for b in own_bags]), return_counts=True) if own_bags else (np.zeros(0, dtype=np.uint64), np.zeros(0))
    lengths = [int(b[1].sum()) for b in own_bags]
    entries, usual = len(own_bags), sum(lengths) / max(1, len(lengths))
    if corpus is not None:
        entries, usual, often = corpus.entries, corpus.usual, corpus.often[np.searchsorted(corpus.terms, terms)]
    idf = np.log(1 + (entries - often + 0.5) / (often + 0.5))
    items: list[list[int]] = [[] for _ in terms]
    impacts: list[list[float]] = [[] for _ in terms]
    for i, (words, counts) in enumerate(own_bags):
        at = np.searchsorted(terms, words)
        value = idf[at] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * lengths[i] / usual))
        for t, v in zip(at.tolist(), (value / value.sum()).tolist(), strict=True):
            items[t].append(i)
            impacts[t].append(v)
    cut_up = [range(0, len(x), block) for x in items]
    ends = [[x[min(k + block, len(x)) - 1] for k in ks] for x, ks in zip(items, cut_up, strict=True)]
    peaks = [[max(x[k : k + block]) for k in ks] for x, ks in zip(impacts, cut_up, strict=True)]
    wide = np.zeros((len(terms), ranges), dtype=np.float32)
    for t, (own, values) in enumerate(zip(items, impacts, strict=True)):
        np.maximum.at(wide[t], np.array(own) * ranges // len(known), np.nextafter(np.array(values, dtype=np.float32), np.float32(2)))
    return Index(terms, np.array([max(x) for x in impacts]), items, impacts, ends, peaks, block, wide, known)


def wand(index: Index, terms: list[int], threshold: float) -> list[tuple[int, float]]:
    """All items whose impacts over the terms sum to the threshold at least, by block-max WAND.

    Cursors stand at each term's next item.  The pivot is the first item at which the terms' largest impacts can reach
    the threshold; if the blocks that hold it can't, the cursors jump past the nearest end of those blocks.
    """
    found = []
    done = len(index.known)
    cursors = [[index.items[t][0], t, 0, 0] for t in terms]  # item, term, place, block
    while cursors:
        cursors.sort()
        bound, pivot = 0.0, -1
        for k, c in enumerate(cursors):
            bound += index.most[c[1]]
            if bound >= threshold:
                pivot = k
                break
        if pivot < 0:
            break
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        bound, end = 0.0, done
        for c in cursors[: pivot + 1]:
            ends = index.ends[c[1]]
            while c[3] < len(ends) and ends[c[3]] < item:
                c[3] += 1
            if c[3] < len(ends):
                bound += index.peaks[c[1]][c[3]]
                end = min(end, ends[c[3]])
        if bound < threshold:
            target = end + 1
            if pivot + 1 < len(cursors):
                target = min(target, cursors[pivot + 1][0])
            target = max(target, item + 1)
        elif cursors[0][0] == item:
            score = sum(index.impacts[c[1]][c[2]] for c in cursors[: pivot + 1])
            if score >= threshold:
                found.append((item, score))
            target = item + 1
        else:
            target = item
        for c in cursors[: pivot + 1]:
            own = index.items[c[1]]
            c[2] = max(c[2], c[3] * index.block) if c[0] < target else c[2]
            while c[2] < len(own) and own[c[2]] < target:
                c[2] += 1
            c[0] = own[c[2]] if c[2] < len(own) else done
        cursors = [c for c in cursors if c[0] < done]
    return found


class Settings(NamedTuple):
    """Words of a passage and between starts of passages; the score an item must reach; the overlaps that confirm it."""

    size: int = 128
    step: int = 64
    threshold: float = 0.6
    question: float = 0.6
    answer: float = 0.5
    whole: float = 0.7
    n: int = 5


def search(data: np.ndarray, index: Index, s: Settings = Settings()) -> list[tuple[int, float, float, float, int, int]]:
    """Confirmed items in a text, each once with the best score of its entries: (item_id, score, overlaps, first and last word)."""
    words = word_hashes(data)
    if not len(words) or not len(index.terms):
        return []
    at = np.minimum(np.searchsorted(index.terms, words), len(index.terms) - 1)
    where = np.flatnonzero(index.terms[at] == words)
    if not len(where):
        return []
    v, passage = len(index.terms), where // s.step
    spread = s.size // s.step
    pairs = np.unique(np.concatenate([(passage - k) * v + at[where] for k in range(spread)]))
    pairs = pairs[pairs >= 0]
    passage, term = pairs // v, pairs % v
    first_of = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
    bounds = np.add.reduceat(index.ranges[term], first_of, axis=0).max(axis=1)
    best: dict[int, tuple[int, float, float, float, int, int]] = {}
    for k in np.flatnonzero(bounds >= s.threshold).tolist():
        p, a, b = int(passage[first_of[k]]), int(first_of[k]), int(first_of[k + 1]) if k + 1 < len(first_of) else len(term)
        for i, score in wand(index, term[a:b].tolist(), s.threshold):
            item = index.known[i]
            first, last = max(0, p * s.step - item.length), min(len(words), p * s.step + s.size + item.length)
            region = words[first:last]
            q, r = (float(np.isin(x, ngrams(region, size)).mean()) if len(x) else 1.0 for x, size in zip((item.question, item.answer), item.sizes, strict=True))
            total = len(item.question) + len(item.answer)
            if (q >= s.question and r >= s.answer) or q * len(item.question) + r * len(item.answer) >= s.whole * total:
                if item.place not in best or score > best[item.place][1]:
                    best[item.place] = (item.name, score, q, r, p * s.step, min(len(words), p * s.step + s.size))
    return sorted(best.values())


def _indexes(items: DataFrame, settings: Settings, items_at_once: int, bytes_at_once: int = 1 << 24) -> Iterator[object]:
    """Broadcast indexes of the items, at most about items_at_once and bytes_at_once of text in each, so that what is sent is bounded.

    Terms are weighed by how many of all items' entries have them, so an item scores alike whatever it shares an index with.
    """
    named = items.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null")
    size = named.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    shares = max(1, math.ceil(size["n"] / items_at_once), math.ceil(size["bytes"] / bytes_at_once))
    dealt = named.withColumn("share", F.pmod(F.xxhash64("item_id", "text"), F.lit(shares)).cast("int"))
    piece = max(1, settings.size - settings.step)
    spark = items.sparkSession

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for share, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for words, counts in bags(text, piece):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), share, dtype=np.int32)), pa.array(words.view(np.int64)), pa.array(counts)], names=["share", "term", "times"])

    if shares > 1:
        seen = cut(dealt.select("share", "text").mapInArrow(terms, "share int, term long, times long").groupBy("share", "term").agg(F.count("*").alias("entries")))
        often = cut(seen.join(seen.groupBy("term").agg(F.sum("entries").alias("often")), "term").select("share", "term", "often"))
        sizes = dealt.select("share", "text").mapInArrow(lambda batches: _sizes(batches, piece), "entries long, words long").agg(F.sum("entries"), F.sum("words")).first()
    for share in range(shares):
        corpus = None
        if shares > 1:
            own = often.where(F.col("share") == share).toArrow()
            known = own.column("term").to_numpy().view(np.uint64)
            order = np.argsort(known)
            corpus = Corpus(sizes[0] or 0, (sizes[1] or 0) / max(1, sizes[0] or 0), known[order], own.column("often").to_numpy()[order])
        rows = dealt.where(F.col("share") == share).select("item_id", "text").collect()
        yield spark.sparkContext.broadcast(build([(r[0], r[1]) for r in rows], settings.n, piece=piece, corpus=corpus))


def _sizes(batches: Iterator[pa.RecordBatch], piece: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [bag for text in batch.column(1).to_pylist() for bag in bags(text, piece)]
        yield pa.RecordBatch.from_arrays([pa.array([len(found)], pa.int64()), pa.array([int(sum(c.sum() for _, c in found))], pa.int64())], names=["entries", "words"])


def leaks(docs: DataFrame, items: DataFrame, settings: Settings = Settings(), items_at_once: int = 20_000) -> DataFrame:
    """One row per row of docs and confirmed item: doc_id, item_id, score, overlaps, first_word, last_word.

    With more than items_at_once items the documents are read once per share of them, with the same result.  Null and wordless texts and
    items match nothing; equal items each match.
    """
    kept = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))

    def part(sent) -> DataFrame:  # noqa: ANN001
        def query(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, hits = [], []
                for k, data in enumerate(texts(batch.column(1))):
                    for hit in search(data, sent.value, settings):
                        at.append(k)
                        hits.append(hit)
                columns = list(zip(*hits, strict=True)) or [()] * 6
                kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", *[x.split()[0] for x in FOUND.split(", ")]])

        return kept.mapInArrow(query, f"doc_id long, {FOUND}")

    return reduce(DataFrame.unionByName, _one_by_one(part, _indexes(items, settings, items_at_once)))


def _one_by_one(part: Callable[[object], DataFrame], indexes: Iterator) -> Iterator[DataFrame]:
    """The part of each index; where there are several each is written before the next index is built, so one is held at a time."""
    first = next(indexes)
    second = next(indexes, None)
    if second is None:
        yield part(first)
        return
    for sent in chain((first, second), indexes):
        yield cut(part(sent))
        sent.unpersist()


def clean(docs: DataFrame, items: DataFrame, settings: Settings = Settings(), items_at_once: int = 20_000) -> DataFrame:
    """docs without the rows that hold a benchmark item; all columns stay.

    With one share of items nothing is shuffled.  With more, each share's matches are written as hashes of doc_id and text
    (equal rows match alike), and the rows that have none are kept by one join on them.
    """
    place = docs.columns.index("text")
    key = fresh(docs, "key")
    keyed = docs.select(F.xxhash64("doc_id", "text").alias(key), text_or_empty().alias("text"))

    def found(sent) -> DataFrame:  # noqa: ANN001
        def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                some = pa.array([bool(search(data, sent.value, settings)) for data in texts(batch.column(1))], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(some)], names=[key])

        return keyed.mapInArrow(hits, f"`{key}` long")

    def keep(sent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
        for batch in batches:
            yield batch.filter(pa.array([not search(data, sent.value, settings) for data in texts(batch.column(place))], pa.bool_()))

    indexes = _indexes(items, settings, items_at_once)
    first = next(indexes)
    second = next(indexes, None)
    if second is None:
        return docs.mapInArrow(partial(keep, first), docs.schema)
    parts = reduce(DataFrame.unionByName, _one_by_one(found, chain((first, second), indexes)))
    return docs.withColumn(key, F.xxhash64("doc_id", "text")).join(parts.distinct(), key, "left_anti").drop(key)
