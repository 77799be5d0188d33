"""Substring dedup: MinHash banding of paragraphs, exact Jaccard of those that collide, removal by components.

A text's paragraphs are its lines of as many words as a shingle has, long ones being cut at sentence ends, and a short
text as a whole.  They are banded by MinHash and compared; those of one or two shingles are like none but their equals,
so they are not banded.  As a copied passage need not keep to lines, runs of `size` words count as paragraphs too, if they are equal; they start where the text itself says: at the least hash among any `window` neighbouring n-grams.  Two texts
that share a run of ``window - 1 + size`` words therefore share a whole paragraph, wherever the run stands in either.
What is found is widened to all words that agree before and after it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerline.llm.arrays import U, _TURN, _VALUE_LOWER, chunks, list_array, mix, ngrams, signed, span_hashes, word_spans
from ledgerline.llm.common import cut, ended, is_marked, marked
from ledgerline.llm.ngram_join import connect, neighbours, verified

#: Tables of two or three numbers a row are sent to all tasks up to this many rows (about 5 MB).
SMALL = 100_000


class Settings(NamedTuple):
    """Words of a run, the choice of its start, its shingles, the bands, the least words of a line, and those of its pieces.

    Six bands of two rows find a paragraph of Jaccard 0.75 with a chance of 0.993, one of 0.85 with 0.9996, and equal
    ones always.  Short runs far apart find edited passages as well as longer ones compared by Jaccard do: a run that
    is like another is equal but for its ends.
    """

    size: int = 20
    window: int = 28
    n: int = 5
    bands: int = 6
    rows: int = 2
    threshold: int = 75
    line: int = 5
    least: int = 48
    most: int = 96

    @property
    def sure(self) -> int:
        """Words that two texts have to share to be sure to share a paragraph."""
        return self.window - 1 + self.size


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The least or largest of each run of width values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = best(x[:-step], x[step:])
        done += step
    return x


def starts(grams: np.ndarray, owner: np.ndarray, base: np.ndarray, s: Settings) -> np.ndarray:
    """Where the runs start: n-grams that are least in some window of one text, with room for a run.

    owner: the text of each word; base: the first word of each text, then the number of words.
    """
    m = len(grams) - s.window + 1
    if m <= 0:
        return np.zeros(0, dtype=np.int64)
    within = owner[:m] == owner[s.window + s.n - 2 :]
    least = np.where(within, _sliding(grams, s.window, np.minimum), U(0))
    pad = np.zeros(s.window - 1, dtype=U)
    chosen = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), s.window, np.maximum) == grams)
    return chosen[chosen + s.size <= base[owner[chosen] + 1]]


_ODD = np.array([U(pow(0x8EBC6AF09C88C6E3, k + 1, 1 << 64)) for k in range(64)], dtype=U)
_STOPS = np.zeros(256, dtype=bool)
_STOPS[[*b".!?"]] = True


def lines(data: np.ndarray, firsts: np.ndarray, ends: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """First and end words of the lines of at least `line` words; those of over `most` are cut past `least` at sentence ends."""
    row = np.searchsorted(np.flatnonzero(data == 10), firsts)
    edges = np.concatenate((np.flatnonzero(np.diff(row, prepend=-1)), [len(row)]))
    stops = 1 + np.flatnonzero(_STOPS[data[ends - 1]])
    more = []
    for k in np.flatnonzero(np.diff(edges) > s.most).tolist():
        a, b = int(edges[k]), int(edges[k + 1])
        while b - a > s.most:
            at = int(np.searchsorted(stops, a + s.least))
            a = int(stops[at]) if at < len(stops) and stops[at] <= a + s.most else a + s.most
            if a < b:
                more.append(a)
    edges = np.sort(np.concatenate((edges, np.array(more, dtype=edges.dtype))))
    long = np.diff(edges) >= s.line
    return edges[:-1][long], edges[1:][long]


class Found(NamedTuple):
    owner: np.ndarray  # the text of each paragraph
    at: np.ndarray  # its first word in that text
    ends: np.ndarray
    names: np.ndarray  # one number for equal runs of words
    whole: np.ndarray  # whether it is a line or a whole text
    words: np.ndarray  # the texts' words
    base: np.ndarray  # and where those of each begin
    grams: np.ndarray  # the texts' n-grams, then one for each paragraph of fewer words than n
    first: np.ndarray  # the first n-gram of each paragraph
    sizes: np.ndarray  # and how many it has


def paragraphs(data: np.ndarray, bounds: np.ndarray, s: Settings) -> Found:
    """The paragraphs of texts laid end to end, each with a line end behind it."""
    firsts, ends = word_spans(data)
    words = span_hashes(_VALUE_LOWER[data], firsts, ends) if len(firsts) else np.zeros(0, dtype=U)
    base = np.searchsorted(firsts, bounds)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(base))
    grams = ngrams(words, s.n)
    runs = starts(grams, owner, base, s)
    a, b = lines(data, firsts, ends, s) if len(words) else (runs, runs)
    few = np.flatnonzero((np.diff(base) > 0) & (np.diff(base) <= s.sure))
    at, ends = np.concatenate((runs, a, base[few])), np.concatenate((runs + s.size, b, base[few + 1]))
    whole = np.repeat([False, True], [len(runs), len(a) + len(few)])
    names = span_hashes(words, at, ends) if len(at) else np.zeros(0, dtype=U)
    short = ends - at < s.n
    first = np.where(short, len(grams) + np.cumsum(short) - 1, at)
    own = owner[at] if len(at) else at
    return Found(own, at - base[own], ends - base[own], names, whole, words, base, np.concatenate((grams, names[short])), first, np.where(short, 1, ends - at - s.n + 1))


def shingles(found: Found, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of some paragraphs in a row, and where each one's begin."""
    first, sizes = found.first[some], found.sizes[some]
    begin = np.cumsum(sizes) - sizes
    return found.grams[np.arange(int(sizes.sum())) + np.repeat(first - begin, sizes)], begin


def band_keys(grams: np.ndarray, begin: np.ndarray, s: Settings) -> np.ndarray:
    """The keys of each paragraph: the least of `rows` hashes of its n-grams, joined, for each band.  They are even."""
    keys = np.empty((len(begin), s.bands), dtype=U)
    for band in range(s.bands):
        total = np.full(len(begin), U(band + 1), dtype=U)
        for row in range(s.rows):
            total = mix(total + np.minimum.reduceat(grams * _ODD[band * s.rows + row], begin) * _TURN[row])
        keys[:, band] = total & ~U(1)
    return keys


def bitmaps(items: list[np.ndarray]) -> np.ndarray:
    """256 bits of each set, one for each of its elements, as four numbers."""
    counts = np.fromiter(map(len, items), dtype=np.int64, count=len(items))
    if not len(counts):
        return np.zeros((0, 4), dtype=U)
    flat = np.concatenate(items)
    begin, part = np.cumsum(counts) - counts, (flat >> U(6)) & U(3)
    bit = U(1) << (flat & U(63))
    return np.stack([np.bitwise_or.reduceat(np.where(part == U(k), bit, U(0)), begin) for k in range(4)], axis=1)


_WORDS = ("b0", "b1", "b2", "b3")


def may_reach(threshold: int) -> Callable[[str, str], Column]:
    """A bound on what two paragraphs share: the bits that both have, and the n-grams that had no bit of their own."""

    def reach(a: str, b: str) -> Column:
        n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
        both, x, y = (reduce(lambda p, q: p + q, [F.bit_count(v) for v in some]) for some in ([F.col(f"{a}.{w}").bitwiseAND(F.col(f"{b}.{w}")) for w in _WORDS], [F.col(f"{a}.{w}") for w in _WORDS], [F.col(f"{b}.{w}") for w in _WORDS]))
        return (both + F.least(n - x, m - y)) * (100 + threshold) >= threshold * (n + m)

    return reach


def _kept(df: DataFrame, rows_at_once: int = 20_000) -> DataFrame:
    """The rows written to the shared folder, read by no more tasks than they need."""
    out = cut(df)
    return out.coalesce(max(1, -(-out.count() // rows_at_once)))


def _banded(texts_of: DataFrame, s: Settings) -> DataFrame:
    """(h, cls, low, high, times): for each key the distinct paragraphs, the least and largest text that has each, and how many have it.

    Every paragraph has its name as a key, made odd; lines and whole texts have those of the bands too, which are even.
    A text goes by its task's partition and its place among the task's texts, so that equal texts stay several.  What
    repeats within a batch of rows is added up before it is dealt out.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = TaskContext.get().partitionId() << 40
        for batch in batches:
            names, owners, times, bands, keys = [], [], [], [], []
            for at, data, bounds in chunks(batch.column(0)):
                found = paragraphs(data, bounds, s)
                if not len(found.names):
                    continue
                order = np.lexsort((found.owner, found.names))
                own, who, new = found.names[order], found.owner[order], _firsts(found.names[order])
                last = np.append(new[1:], len(own)) - 1
                names.append(own[new])
                times.append(np.add.reduceat(np.concatenate(([True], (own[1:] != own[:-1]) | (who[1:] != who[:-1]))).astype(np.int64), new))
                owners.append(np.stack((who[new], who[last]), axis=1) + (text + at))
                lines_ = np.flatnonzero(np.maximum.reduceat(found.whole[order], new) & (found.sizes[order[new]] * (100 - s.threshold) >= s.threshold))  # a chunk's equal ones are banded once
                bands.append(own[new][lines_])
                keys.append(band_keys(*shingles(found, order[new[lines_]]), s) if len(lines_) else np.zeros((0, s.bands), dtype=U))
            text += len(batch)
            if not names:
                continue
            every, owner, often = np.concatenate(names), np.concatenate(owners), np.concatenate(times)
            order = np.argsort(every, kind="stable")
            first = _firsts(every[order])
            every, low, high = every[order[first]], np.minimum.reduceat(owner[order, 0], first), np.maximum.reduceat(owner[order, 1], first)
            often = np.add.reduceat(often[order], first)
            banded, one = np.unique(np.concatenate(bands), return_index=True)
            wide, at = np.concatenate(keys)[one], np.searchsorted(every, banded)
            for h, some in ((every | U(1), slice(None)), *((wide[:, band], at) for band in range(s.bands))):
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.ascontiguousarray(h))), pa.array(signed(every[some])), pa.array(low[some]), pa.array(high[some]), pa.array(often[some])], names=["h", "cls", "low", "high", "times"])

    return texts_of.mapInArrow(rows, "h long, cls long, low long, high long, times long")


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Where each distinct value of a sorted array begins."""
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))


FIELDS, ORDER = ("cls", "n", "pos", "rare", *_WORDS), ("rare", "n", "cls")


def _sets(texts_of: DataFrame, needed: DataFrame, s: Settings) -> DataFrame:
    """(cls, n, items, b0..b3): the n-grams, by 32 bits, of the lines and whole texts whose names are needed."""
    sieve = texts_of.sparkSession.sparkContext.broadcast(marked(needed, "cls"))

    def with_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, bounds in chunks(batch.column(0)):
                found = paragraphs(data, bounds, s)
                some = np.flatnonzero(found.whole & is_marked(sieve.value, found.names))
                own, at = np.unique(found.names[some], return_index=True)
                items = [np.unique(found.grams[a : a + n]) for a, n in zip(found.first[some[at]].tolist(), found.sizes[some[at]].tolist(), strict=True)]
                bits = bitmaps(items)
                columns = [pa.array(signed(own)), pa.array([len(x) for x in items], pa.int64()), list_array([np.unique((x >> U(32)).astype(np.uint32)).view(np.int32) for x in items], pa.int32()), *[pa.array(signed(np.ascontiguousarray(bits[:, k]))) for k in range(4)]]
                yield pa.RecordBatch.from_arrays(columns, names=["cls", "n", "items", *_WORDS])

    kind = "cls long, n long, items array<int>, " + ", ".join(f"{w} long" for w in _WORDS)
    return texts_of.mapInArrow(with_items, kind).join(needed, "cls", "left_semi").dropDuplicates(["cls"])


def repeats(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The runs of words to remove: doc_id, first_word, end_word, component_id, kept_doc_id, paragraphs, row (a hash of doc_id and text).

    Lines and whole texts link when their sets of n-grams have the Jaccard similarity of the threshold, and all
    paragraphs that are equal do.  Of each component the
    document of the smallest doc_id keeps its text; in all others the paragraphs' words are to go, with those around them
    that agree too, overlapping ones being one run.  kept_doc_id is the smallest of the documents that keep a copy of a part of the run.  A repeat
    within one document does not count, nor do null texts and null doc_ids.  Rows that share a doc_id are one document, but
    each has its own runs; rows equal in doc_id and text have the same.
    """
    texts_of = docs.select(ended().alias("text"))
    # Only keys of several texts are kept; most keys are those of one text, whose paragraphs overlap.
    whole = W.partitionBy("h")
    every = _banded(texts_of, s).repartition("h").withColumns({"_low": F.min("low").over(whole), "_high": F.max("high").over(whole), "several": F.min("cls").over(whole) != F.max("cls").over(whole)})
    near = _kept(every.where("_low <> _high and (several or h & 1 = 1)").groupBy("h", "cls").agg((-F.sum("times")).alias("rare")))
    like = near.where("h & 1 = 0")
    sets = _kept(_sets(texts_of, _kept(like.select("cls").distinct()), s))
    # Of a key's paragraphs the one that most texts have comes first: edited copies are like it rather than one another.
    shared = _kept(like.join(sets.drop("items"), "cls")).withColumns({"pos": F.lit(0), "salt": F.lit(-1)})

    def check(pairs: DataFrame) -> DataFrame:
        return verified(pairs, lambda needed: sets.select("cls", "items").join(needed, "cls", "left_semi"), s.threshold)

    keys = _kept(like.groupBy("cls").agg(F.collect_list("h").alias("keys")))  # as many as there are bands
    roots = connect(neighbours(shared, FIELDS, ORDER), check, s.threshold, rows=shared.join(keys, "cls"), fields=FIELDS, extra=may_reach(s.threshold), order=ORDER)
    exact = near.where("h & 1 = 1").select("cls").distinct().join(roots.select(F.col("node").alias("cls")), "cls", "left_anti").select("cls", F.col("cls").alias("root"))
    flagged = _kept(roots.select(F.col("node").alias("cls"), "root").unionByName(exact))
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row"), ended().alias("text"))
    hits = _kept(_sent(flagged, _placed(named, flagged, s)))
    # For each class the words of the document that keeps it: of the same class there, else of the root's first.
    spot = F.struct("doc_id", "row", "at", "end")
    classes = _kept(hits.groupBy("root", "cls").agg(F.min(spot).alias("own"), F.max("doc_id").alias("last")))
    tops = _kept(classes.groupBy("root").agg(F.min("own").alias("first"), F.max("last").alias("last")).where("first.doc_id <> last").drop("last"))
    known = _sent(tops, classes.drop("last"), "root").select("cls", F.col("first.doc_id").alias("kept"), F.when(F.col("own.doc_id") == F.col("first.doc_id"), F.col("own")).otherwise(F.col("first")).alias("like"))
    rows = _sent(_kept(known), hits).where("doc_id <> kept")
    # What one document keeps of another's words is widened first, then all that overlaps is one run.
    near = _runs(rows, ("doc_id", "row", "kept")).agg(
        F.min("at").alias("at"), F.max("end").alias("end"), F.min_by(F.struct("like.row", "like.at"), F.struct("at", "end", "cls")).alias("left"), F.max_by(F.struct("like.row", "like.end"), F.struct("end", "at", "cls")).alias("right"),
        F.min_by("root", F.struct("at", "root")).alias("root"), F.collect_set("at").alias("places"),
    )
    wide = _widened(_kept(near.select("*", F.col("left.row").alias("l_row"), F.col("left.at").alias("l_at"), F.col("right.row").alias("r_row"), F.col("right.end").alias("r_at")).drop("left", "right")), named, s)
    runs = _runs(wide, ("doc_id", "row")).agg(F.min("at").cast("long").alias("first_word"), F.max("end").cast("long").alias("end_word"), F.min_by("root", F.struct("kept", "at", "root")).alias("component_id"), F.min("kept").alias("kept_doc_id"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("paragraphs"))
    return runs.select("doc_id", "first_word", "end_word", "component_id", "kept_doc_id", "paragraphs", "row")


def _sent(table: DataFrame, rows: DataFrame, key: str = "cls") -> DataFrame:
    """rows joined with a table of one row a key: by broadcast if it is small, else by a shuffle, whose skew Spark splits."""
    return rows.join(F.broadcast(table) if table.count() <= SMALL else table, key)


def _placed(named: DataFrame, flagged: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, row, at, end, cls) of the paragraphs whose names are flagged, and a few others."""
    sieve = named.sparkSession.sparkContext.broadcast(marked(flagged, "cls"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, bounds in chunks(batch.column(2)):
                found = paragraphs(data, bounds, s)
                some = np.flatnonzero(is_marked(sieve.value, found.names))
                columns = [found.at[some].astype(np.int32), found.ends[some].astype(np.int32), signed(found.names[some])]
                own = pa.array(found.owner[some] + first)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), *map(pa.array, columns)], names=["doc_id", "row", "at", "end", "cls"])

    return named.mapInArrow(placed, "doc_id long, row long, at int, end int, cls long")


def _runs(rows: DataFrame, where: tuple[str, ...]) -> GroupedData:
    """Rows (at, end) grouped by where and by the run of overlapping ones that they are in."""
    order = W.partitionBy(*where).orderBy("at", "end", "root")
    so_far = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(F.col("at") <= so_far, 0).otherwise(1))
    return rows.withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0))).groupBy(*where, "run")


def _widened(runs: DataFrame, named: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, row, at, end, kept, root, places): the runs with the words before and after that agree with the kept text.

    A longer stretch of equal words holds a paragraph of its own, so `window + size - 2` words on either side do.  They
    are read where a sieve of the places says so, so no text is shuffled; a word is compared by 16 bits.
    """
    reach = s.window + s.size - 2
    asked = [runs.select(F.col(row).alias("row"), F.col(place).alias("place"), F.lit(side).alias("side")) for row, place, side in (("row", "at", 0), ("l_row", "l_at", 0), ("row", "end", 1), ("r_row", "r_at", 1))]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(signed(_spot(*(c.to_numpy(zero_copy_only=False) for c in batch.columns))))], names=["key"])

    keys = _kept(reduce(DataFrame.unionByName, asked).mapInArrow(keyed, "key long").distinct())
    sieve = named.sparkSession.sparkContext.broadcast(marked(keys, "key"))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, data, bounds in chunks(batch.column(1)):
                found = paragraphs(data, bounds, s)
                words = (found.words >> U(48)).astype(np.uint16).view(np.int16)
                rows = []
                for side, places in ((0, found.at), (1, found.ends)):
                    at = np.unique(np.stack((found.owner, places), axis=1), axis=0)
                    hit = is_marked(sieve.value, _spot(ids[at[:, 0] + first], at[:, 1], np.full(len(at), side)))
                    for k, place in at[hit].tolist():
                        a, b = found.base[k], found.base[k + 1]
                        rows.append((k + first, place, side, words[a + place : min(b, a + place + reach)] if side else words[max(a, a + place - reach) : a + place][::-1]))
                docs, places, sides, near = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs, pa.int64())), pa.array(places, pa.int32()), pa.array(sides, pa.int32()), list_array(list(near), pa.int16())], names=["row", "place", "side", "words"])

    # Equal rows have equal words.
    words = _kept(named.select("row", "text").mapInArrow(around, "row long, place int, side int, words array<smallint>").groupBy("row", "place", "side").agg(F.max("words").alias("words")))
    for side, place, other, like in ((0, "at", "l_at", "l_row"), (1, "end", "r_at", "r_row")):
        one = words.where(F.col("side") == side)
        for row, at, name in (("row", place, "own"), (like, other, "others")):
            runs = runs.join(one.select(F.col("row").alias(row), F.col("place").alias(at), F.col("words").alias(name)), [row, at])
        differ = F.array_position(F.zip_with("own", "others", lambda x, y: x.eqNullSafe(y)), False)
        runs = runs.withColumn(f"more_{side}", F.when(differ > 0, differ - 1).otherwise(F.size("own"))).drop("own", "others")
    return runs.select("doc_id", "row", (F.col("at") - F.col("more_0")).alias("at"), (F.col("end") + F.col("more_1")).alias("end"), "kept", "root", "places")


def _spot(ids: np.ndarray, places: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """One number for a document, a place and a side."""
    return mix(mix(ids.astype(np.int64).view(U)) + (places * 2 + sides).astype(U))
