"""Phrase collocation mining by Toivonen's method: a sample proposes phrases and their negative border, full passes count.

Phrases are runs of words within a piece between marks, counted for each language apart.  All phrases that are frequent
in a sample of documents, at a lowered threshold, are marked in a table of bits.  A pass over all documents counts every
phrase whose two parts (all words but the last, all but the first) are marked: these are the sample's phrases and the
negative border, as far as it occurs at all.  Frequent phrases that were not marked are failures of the border; they are
marked too, and another pass counts the phrases that this adds, until no frequent phrase is unmarked.  As a bit may be
set by another phrase, more is counted than needed, never less, and every count is of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerline.llm.arrays import U, _LOWER, _TURN, _VALUE, _VALUE_LOWER, chunks, mix, signed, span_hashes
from ledgerline.llm.common import cut, ended, is_marked, marked

RESULT = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


class Settings(NamedTuple):
    """Longest phrase, least count, size of the sample (per cent of documents), how far its threshold is
    lowered, how many are listed, bits of the table, keys held by a task.
    """

    longest: int = 5
    least: int = 100
    sample: int = 10
    lowered: float = 0.6
    top: int = 2000
    bits: int = 1 << 27
    held: int = 2_000_000

    @property
    def sample_least(self) -> int:
        """The count that makes a phrase frequent in the sample; the chance of missing one is what the lowering keeps small."""
        return max(2, int(self.least * self.sample * self.lowered / 100))


_MARKS = np.isin(np.arange(256), [*b".,;:!?\n\v\f\r"])
_APART = _MARKS | np.isin(np.arange(256), [32, 9])


class Words(NamedTuple):
    """Words of texts laid end to end: their bytes' bounds, hashes, the piece that each is in and the text of each."""

    firsts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    piece: np.ndarray
    owner: np.ndarray


def words_of(data: np.ndarray, bounds: np.ndarray) -> Words:
    edge = np.diff(np.concatenate(([True], _APART[data], [True])).astype(np.int8))
    firsts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    hashes = span_hashes(_VALUE_LOWER[data], firsts, ends) if len(firsts) else np.zeros(0, dtype=U)
    piece = np.searchsorted(np.flatnonzero(_MARKS[data]), firsts)  # texts end with a line end, so no piece crosses texts
    return Words(firsts, ends, hashes, piece, np.searchsorted(bounds, firsts, side="right") - 1)


def keys_of(words: Words, langs: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length the key of the phrase that begins at each word, and whether it lies in one piece.

    A key is of the language and of all words, its last three bits are the number of words; langs has a number for each
    text's language.
    """
    total = langs[words.owner]
    for k in range(1, longest + 1):
        m = max(len(words.hashes) - k + 1, 0)
        total = total[:m] + words.hashes[k - 1 : k - 1 + m] * _TURN[k]
        yield key_of(total, k), words.piece[:m] == words.piece[k - 1 : k - 1 + m]


def key_of(total: np.ndarray, k: int) -> np.ndarray:
    return mix(total) & ~U(7) | U(k)


def lang_numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """A number for each text's language, the languages' numbers and their names; null is und."""
    names = column.fill_null("und").dictionary_encode()
    raw = [np.frombuffer(name.encode() + b"\n", dtype=np.uint8) for name in names.dictionary.to_pylist()]
    codes = np.array([span_hashes(_VALUE[x], np.array([0]), np.array([len(x)]))[0] for x in raw], dtype=U)
    return codes[names.indices.to_numpy(zero_copy_only=False)] if len(raw) else np.zeros(0, dtype=U), codes, names.dictionary.to_pylist()


#: Where the ranges of keys begin that a task merges and hands on one after another; keys are hashes, so ranges hold about as many.
_RANGES = np.arange(1, 16, dtype=U) << U(60)


class Tally:
    """Counts of keys and the largest spot of each, merged as they come; what a task holds is bounded, as it hands them on when they are many.

    They wait by ranges of keys, and a range is merged by itself, so no second copy of all that waits is made.
    """

    def __init__(self, held: int) -> None:
        self.held = held
        self.clear()

    def clear(self) -> None:
        self.waiting: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(len(_RANGES) + 1)]
        self.size = 0

    def add(self, keys: np.ndarray, times: np.ndarray, spots: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        if len(keys):
            found = merged(keys, times, spots)
            bounds = [0, *np.searchsorted(found[0], _RANGES).tolist(), len(found[0])]
            for own, a, b in zip(self.waiting, bounds[:-1], bounds[1:], strict=True):
                if b > a:
                    own.append(tuple(x[a:b].copy() for x in found))  # a view would hold all of them
            self.size += len(found[0])
        if self.size > 2 * self.held:
            self.merge()
            if self.size > self.held:
                yield from self.all()

    def merge(self) -> None:
        for i, own in enumerate(self.waiting):
            if len(own) > 1:
                self.waiting[i] = [merged(*(np.concatenate(x) for x in zip(*own, strict=True)))]
        self.size = sum(len(x[0]) for own in self.waiting for x in own)

    def all(self) -> Iterator[tuple[np.ndarray, ...]]:
        """All that waits, a range of keys at a time."""
        self.merge()
        waiting = self.waiting
        self.clear()
        while waiting:
            yield from waiting.pop()


def merged(keys: np.ndarray, times: np.ndarray, spots: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[new], np.add.reduceat(times[order], new), np.maximum.reduceat(spots[order], new)


def counted(texts_of: DataFrame, s: Settings, table: np.ndarray | None = None, before: np.ndarray | None = None) -> DataFrame:
    """(key, times, spot): how often each phrase occurs, with the spot of a text that holds it; under the key of no words, how many words a language has.

    With a table only phrases whose two parts are marked in it, and every word; with another one of before, only those
    that it did not mark so, and no words.
    """
    context = texts_of.sparkSession.sparkContext
    now, old = context.broadcast(table), context.broadcast(before)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, table, before = Tally(s.held), now.value, old.value
        out = lambda found: pa.RecordBatch.from_arrays([pa.array(signed(found[0])), pa.array(found[1]), pa.array(found[2])], names=["key", "times", "spot"])
        for batch in batches:
            numbers, codes, _ = lang_numbers(batch.column(0))
            places = batch.column(2).to_numpy()
            for at, data, bounds in chunks(batch.column(1)):
                words = words_of(data, bounds)
                own, spots = numbers[at:][words.owner], places[at:][words.owner]
                if before is None:
                    yield from map(out, tally.add(key_of(codes, 0), np.array([np.count_nonzero(own == c) for c in codes], dtype=np.int64), np.zeros(len(codes), dtype=np.int32)))
                parts = parts_before = None
                for k, (keys, whole) in enumerate(keys_of(words, numbers[at:], s.longest), 1):
                    some = whole
                    if table is not None:
                        some = whole & parts[:-1] & parts[1:] if k > 1 else whole
                        parts = whole & is_marked(table, keys)
                    if before is not None:
                        some = some & ~(parts_before[:-1] & parts_before[1:]) if k > 1 else np.zeros(len(keys), dtype=bool)
                        parts_before = whole & is_marked(before, keys)
                    some = np.flatnonzero(some)
                    yield from map(out, tally.add(keys[some], np.ones(len(some), dtype=np.int64), spots[some]))
        yield from map(out, tally.all())

    return texts_of.select("lang", "text", "spot").mapInArrow(rows, "key long, times long, spot int").groupBy("key").agg(F.sum("times").alias("times"), F.max("spot").alias("spot"))


def frequent(texts_of: DataFrame, s: Settings) -> DataFrame:
    """(key, times, spot) of all phrases up to the longest that occur `least` times in texts_of (lang, text, spot), and of no words.

    Bits are only ever added to the table, so a phrase was counted by an earlier pass if and only if both its parts were
    marked then.  When no frequent phrase that could be a part is unmarked, all phrases with two frequent parts have been
    counted, and no other phrase can be frequent.
    """
    sample = texts_of.where(F.pmod("spot", F.lit(100)) < s.sample)
    failed = cut(counted(sample, s).where(F.col("times") >= s.sample_least).select("key"))
    table, before, found = marked(failed, "key", s.bits), None, []
    while True:
        found.append(cut(counted(texts_of, s, table, before).where(F.col("times") >= s.least)))
        failed = cut(unmarked(found[-1].where(F.col("key").bitwiseAND(F.lit(7)).between(1, s.longest - 1)), table))
        if not failed.take(1):
            return reduce(DataFrame.unionByName, found)
        before, table = table, grown(table, failed)


def grown(table: np.ndarray, keys: DataFrame) -> np.ndarray:
    """The table with the bits of more keys."""
    out, more = table.copy(), marked(keys, "key", len(table) * 8, exact=True)
    return np.bitwise_or(out, more, out=out)


def unmarked(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """The keys that a table does not mark."""
    sent = rows.sparkSession.sparkContext.broadcast(table)

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy().view(U)
            yield pa.RecordBatch.from_arrays([pa.array(signed(keys[~is_marked(sent.value, keys)]))], names=["key"])

    return rows.select("key").mapInArrow(sieve, "key long")


def where(keys: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """One number for a phrase and the spot of a text."""
    return mix(keys + spots.astype(np.int64).view(U) * _TURN[0])


def spelled(texts_of: DataFrame, phrases: DataFrame, s: Settings) -> DataFrame:
    """For each of some phrases (key, times, spot), once: times as a, lang, phrase, the language's key, and those of the parts at each cut.

    Each phrase is read in the text of its spot only, so what is sent grows with the phrases, not with how often they occur.
    """
    context = texts_of.sparkSession.sparkContext

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(signed(where(batch.column(0).to_numpy().view(U), batch.column(1).to_numpy())))], names=["there"])

    of_keys = context.broadcast(marked(phrases, "key", s.bits))
    of_spots = context.broadcast(marked(phrases.select("key", "spot").mapInArrow(keyed, "there long"), "there", s.bits))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = [np.zeros(0, dtype=U)] * (s.longest + 1)  # what the task has spelled already; forgotten when it is many, as a repeat does no harm
        for batch in batches:
            numbers, codes, names = lang_numbers(batch.column(0))
            places = batch.column(2).to_numpy()
            for at, data, bounds in chunks(batch.column(1)):
                words = words_of(data, bounds)
                pairs = list(keys_of(words, numbers[at:], s.longest))
                every = [keys for keys, _ in pairs]
                raw, spots = _LOWER[data].tobytes(), places[at:][words.owner]
                for k in range(2, s.longest + 1):
                    keys, whole = pairs[k - 1]
                    some = np.flatnonzero(whole & is_marked(of_keys.value, keys))
                    some = some[is_marked(of_spots.value, where(keys[some], spots[some]))]
                    own, one = np.unique(keys[some], return_index=True)
                    place = some[one]
                    if len(done[k]):
                        new = done[k][np.minimum(np.searchsorted(done[k], own), len(done[k]) - 1)] != own
                        own, place = own[new], place[new]
                    if not len(own):
                        continue
                    done[k] = np.sort(np.concatenate((done[k], own)), kind="stable") if len(done[k]) < s.held else own
                    langs = numbers[at:][words.owner[place]]
                    lang = [names[c] for c in np.argmax(langs[:, None] == codes, axis=1).tolist()]
                    phrase = [b" ".join(raw[a:b].split()).decode() for a, b in zip(words.firsts[place].tolist(), words.ends[place + k - 1].tolist(), strict=True)]
                    left, right = ([every[j - 1][place] for j in range(1, k)], [every[k - j - 1][place + j] for j in range(1, k)])
                    offsets = pa.array(np.arange(len(own) + 1, dtype=np.int32) * (k - 1))
                    lists = [pa.ListArray.from_arrays(offsets, pa.array(signed(np.stack(x, axis=1).ravel()))) for x in (left, right)]
                    yield pa.RecordBatch.from_arrays([pa.array(signed(own)), pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(signed(key_of(langs, 0))), *lists], names=["key", "lang", "phrase", "total", "left", "right"])

    kind = "key long, lang string, phrase string, total long, left array<long>, right array<long>"
    # Spelled and counted rows of a key meet in one group; what only a bit has let through has no count.
    found = texts_of.select("lang", "text", "spot").mapInArrow(rows, kind).unionByName(phrases.select("key", F.col("times").alias("a")), allowMissingColumns=True)
    return found.groupBy("key").agg(*[F.max(x).alias(x) for x in ("a", "lang", "phrase", "total", "left", "right")]).where("a is not null and phrase is not null")


def score_of(a: Column, n: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000 * a * n / (l * r)) in whole numbers of 38 digits; it is at most 1000 * n / least, so the result fits 64 bits."""
    a, n, l, r = (x.cast("decimal(19,0)") for x in (a, n, l, r))  # noqa: E741
    return F.call_function("div", a * n * F.lit(1000).cast("decimal(4,0)"), l * r)


def mine(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Each language's phrases of highest score: lang, rank, phrase, a, l, r, n, score.

    Null, empty and wordless texts have no phrases; a null lang is und; a null doc_id only takes part in the choice of the
    sample; repeated rows count each.  Ties of score go to the larger count, then to the smaller phrase in bytes.
    """
    texts_of = docs.select(F.col("lang").cast("string"), ended().alias("text"), F.shiftright(F.xxhash64("doc_id", "lang", "text"), 32).cast("int").alias("spot"))
    counts = cut(frequent(texts_of, s))
    phrases = cut(spelled(texts_of, counts.where(F.col("key").bitwiseAND(F.lit(7)) > 1), s))

    def count_of(key: str, name: str) -> DataFrame:
        return counts.select(F.col("key").alias(key), F.col("times").alias(name))

    # A phrase is as frequent as a longer one around it only if it is so as one with a word more, before or after.
    inside = F.explode(F.array(F.element_at("left", -1), F.element_at("right", 1)))
    longer = phrases.select(inside.alias("key"), "a").groupBy("key").agg(F.max("a").alias("longer"))
    alone = phrases.join(longer, "key", "left").where(F.coalesce(F.col("longer") < F.col("a"), F.lit(True)))
    totals = count_of("total", "n").where(F.col("total").bitwiseAND(F.lit(7)) == 0)
    cuts = alone.join(F.broadcast(totals) if totals.count() <= 100_000 else totals, "total").select("key", "lang", "phrase", "a", "n", F.posexplode(F.arrays_zip("left", "right")).alias("at", "cut"))
    cuts = cuts.select("key", "lang", "phrase", "a", "n", "at", F.col("cut.left").alias("left"), F.col("cut.right").alias("right")).join(count_of("left", "l"), "left").join(count_of("right", "r"), "right")
    lowest = F.min(F.struct(score_of(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("score"), "at", "l", "r"))
    scored = cut(cuts.groupBy("key", "lang", "phrase", "a", "n").agg(lowest.alias("low")).select("key", "lang", "phrase", "a", "low.l", "low.r", "n", "low.score"))
    # First the best of each of some shares of a language, then the best of those: neither sees all of a language's phrases.
    shares = max(1, round((scored.count() / s.top) ** 0.5))
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = scored.withColumn("share", F.pmod("key", F.lit(shares))).withColumn("rank", F.row_number().over(W.partitionBy("lang", "share").orderBy(*best))).where(F.col("rank") <= s.top)
    return some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= s.top).select(*RESULT)


def mine_sql(s: Settings = Settings()) -> str:
    """The same in DuckDB's SQL, which counts every phrase."""
    span = "array_to_string(w[{}:{}], ' ')".format
    return rf"""
    WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
      FROM documents),
    worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM worded GROUP BY lang),
    spans AS (
      SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: {span("i", "i + k - 1")})) AS phrase
      FROM worded, range(1, {s.longest + 1}) AS lengths(k) WHERE len(w) >= k),
    counts AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM spans GROUP BY ALL HAVING count(*) >= {s.least}),
    several AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM counts WHERE k > 1),
    inside AS (
      SELECT lang, {span("i", "i + m - 1")} AS phrase, max(f) AS longer
      FROM several, range(2, {s.longest}) AS sizes(m), range(1, {s.longest}) AS firsts(i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
    alone AS (
      SELECT s.* FROM several s LEFT JOIN inside i USING (lang, phrase) WHERE i.longer IS NULL OR i.longer < s.f),
    cuts AS (
      SELECT a.lang, a.phrase, a.f AS a, x.f AS l, y.f AS r, n, j, (1000 * a.f * n) // (x.f * y.f) AS score
      FROM alone a, range(1, {s.longest}) AS places(j), counts x, counts y, totals t
      WHERE j < a.k AND x.lang = a.lang AND y.lang = a.lang AND t.lang = a.lang AND x.phrase = {span("1", "j").replace("w[", "a.w[")} AND y.phrase = {span("j + 1", "a.k").replace("w[", "a.w[")}),
    lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
    FROM lowest QUALIFY rank <= {s.top}"""
