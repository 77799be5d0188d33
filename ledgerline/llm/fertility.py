"""Quality rules: how well public vocabularies fit a text, and plain counts of symbols, lines and repeated words.

A text's words are put to two vocabularies, each word with a blank before it: characters a token under both, the share
of byte tokens and the entropy of the tokens under the one of pieces.  Bands for the script that most letters belong to
(or for the language, where a column names it) decide.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.arrays import U, _VALUE, chunks, mix, ngrams, span_hashes, word_spans
from ledgerline.llm.common import ended


class Band(NamedTuple):
    """What a document's measures may be; entropy is in bits, its least also at most `spread` of the log2 of the tokens."""

    least_piece_chars: float
    most_piece_chars: float
    least_byte_chars: float
    most_byte_chars: float
    most_fallback: float
    least_entropy: float
    most_entropy: float
    spread: float = 0.6


#: Scripts as a regular expression engine knows them, in the order in which ties are settled.
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Thai", "Hangul", "Hiragana", "Katakana", "Han")

# Scripts with spaces and an alphabet that the vocabularies know have one to eight characters a token; below one, words
# break up into less than letters.  Scripts that they know little take several byte tokens a character.
_KNOWN, _BYTES, _CHARACTERS = Band(1.2, 8.0, 1.2, 9.0, 0.10, 3.0, 13.0), Band(0.25, 6.0, 0.25, 6.0, 0.95, 2.5, 13.0), Band(0.25, 3.0, 0.2, 3.0, 0.95, 2.5, 13.0)
BANDS: dict[str, Band] = {
    "Latin": _KNOWN,
    "Cyrillic": _KNOWN._replace(least_byte_chars=0.4),
    **dict.fromkeys(("Greek", "Arabic", "Hebrew", "Devanagari", "Thai"), _BYTES),
    **dict.fromkeys(("Hangul", "Hiragana", "Katakana", "Han"), _CHARACTERS),
    "Other": Band(0.1, 8.0, 0.1, 9.0, 1.0, 2.0, 13.0),
    "None": Band(0.8, 8.0, 0.8, 9.0, 0.50, 2.0, 13.0),  # no letters: numbers and signs
}


class Settings(NamedTuple):
    """Least words, words of a window that counts as repeated, and the most per cent of words in such windows."""

    least_words: int = 20
    window: int = 8
    most_repeated: int = 30


@lru_cache(maxsize=1)
def _scripts() -> np.ndarray:
    """By code point: the place in SCRIPTS, then other letters, then all else."""
    import regex

    every = "".join(map(chr, range(0xD800))) + "퟿" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    kinds = np.full(0x110000, len(SCRIPTS) + 1, dtype=np.uint8)
    for kind, pattern in ((len(SCRIPTS), r"\p{L}+"), *((k, rf"[\p{{L}}&&\p{{Script={name}}}]+") for k, name in enumerate(SCRIPTS))):
        for m in regex.finditer(pattern, every, flags=regex.V1):
            kinds[m.start() : m.end()] = kind
    return kinds


class Vocabularies:
    """Tokens of words under both vocabularies; each distinct word is encoded once, at most `most` are remembered."""

    def __init__(self, pieces: str, byte_pairs: str, most: int = 500_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.pieces, self.byte_pairs, self.most = SentencePieceProcessor(model_file=pieces), Tokenizer.from_file(byte_pairs), most
        self.byte_pairs.encode_special_tokens = True
        self.size = self.pieces.vocab_size()
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.size)])
        self.clear()

    def clear(self) -> None:
        self.known, self.facts = np.zeros(0, dtype=U), np.zeros((0, 4), dtype=np.int64)  # place and count of ids, byte tokens, tokens of byte pairs
        self.ids = np.zeros(0, dtype=np.int32)

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        if len(self.known) + len(hashes) > self.most:
            self.clear()
        found = self.pieces.encode(words, num_threads=1)
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        ids = np.fromiter((i for f in found for i in f), dtype=np.int32, count=int(counts.sum()))
        pairs = [len(x) for x in self.byte_pairs.encode_batch_fast([" " + w for w in words], add_special_tokens=False)]
        fallen = np.bincount(np.repeat(np.arange(len(found)), counts), self.is_byte[ids], len(found)).astype(np.int64)
        facts = np.stack((len(self.ids) + np.cumsum(counts) - counts, counts, fallen, np.array(pairs, dtype=np.int64)), axis=1)
        self.ids = np.concatenate((self.ids, ids))
        known = np.concatenate((self.known, hashes))
        order = np.argsort(known, kind="stable")
        self.known, self.facts = known[order], np.concatenate((self.facts, facts))[order]

    def __call__(self, data: np.ndarray, firsts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The facts of each word; their ids stand in self.ids until the next call."""
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        new = ~np.isin(distinct, self.known)
        if new.any():
            if len(self.known) + int(new.sum()) > self.most:
                new[:] = True
            at = where[new]
            self.learn(distinct[new], [data[a:b].tobytes().decode() for a, b in zip(firsts[at].tolist(), ends[at].tolist(), strict=True)])
        return self.facts[np.searchsorted(self.known, distinct)][back]


@lru_cache(maxsize=2)
def _vocabularies(pieces: str, byte_pairs: str) -> Vocabularies:
    return Vocabularies(pieces, byte_pairs)


_SYMBOL = np.isin(np.arange(256), [*b"#*$%&|<>"])
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_pieces", "n_byte_pieces", "n_byte_pairs")


def counts(data: np.ndarray, bounds: np.ndarray, vocabularies: Vocabularies, s: Settings) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The counts, the entropy of the pieces and the script of texts laid end to end, each with a line end behind it."""
    docs = len(bounds) - 1
    firsts, ends = word_spans(data)
    base = np.searchsorted(firsts, bounds)
    owner = np.repeat(np.arange(docs), np.diff(base))
    total = lambda of, some=None: np.bincount(of, some, docs).astype(np.int64)
    out = {"n_words": np.diff(base)}
    begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # code points before each byte
    out["word_chars"] = total(owner, begins[ends] - begins[firsts])
    out["n_symbols"] = total(np.searchsorted(bounds, np.flatnonzero(_SYMBOL[data]), side="right") - 1)

    stops = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], stops[:-1] + 1)).astype(np.int64)[: len(stops)]
    full = np.searchsorted(firsts, stops) > np.searchsorted(firsts, starts)
    starts, stops = starts[full], stops[full]
    of_line = np.searchsorted(bounds, starts, side="right") - 1
    values = _VALUE[data]
    own = mix(span_hashes(values, starts, stops) + of_line.astype(U)) if len(starts) else np.zeros(0, dtype=U)
    _, one = np.unique(own, return_index=True)
    out["n_dup_lines"] = total(of_line) - total(of_line[one])

    hashes = span_hashes(values, firsts, ends) if len(firsts) else np.zeros(0, dtype=U)
    grams, covered = ngrams(hashes, s.window), np.zeros(len(hashes) + 1, dtype=np.int64)
    whole = np.flatnonzero(owner[: len(grams)] == owner[s.window - 1 :]) if len(grams) else np.zeros(0, dtype=np.int64)
    if len(whole):
        _, back, times = np.unique(mix(grams[whole] + owner[whole].astype(U)), return_inverse=True, return_counts=True)
        again = whole[times[back] > 1]
        covered += np.bincount(again, minlength=len(covered)) - np.bincount(again + s.window, minlength=len(covered))
    out["n_repeat_words"] = total(owner, np.cumsum(covered)[:-1] > 0)

    facts = vocabularies(data, firsts, ends, hashes) if len(firsts) else np.zeros((0, 4), dtype=np.int64)
    for k, name in enumerate(("n_pieces", "n_byte_pieces", "n_byte_pairs"), 1):
        out[name] = total(owner, facts[:, k])
    sizes = facts[:, 1]
    upto = np.cumsum(sizes)
    ids = vocabularies.ids[np.repeat(facts[:, 0] - upto + sizes, sizes) + np.arange(int(sizes.sum()))]
    key, times = np.unique(np.repeat(owner, sizes) * vocabularies.size + ids, return_counts=True)
    n = np.maximum(out["n_pieces"], 1)
    entropy = np.log2(n) - np.bincount(key // vocabularies.size, times * np.log2(times), docs) / n

    kinds = _scripts()[np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)]
    width = len(SCRIPTS) + 2
    letters = np.flatnonzero(kinds < width - 1)
    of_letter = np.searchsorted(begins[bounds], letters, side="right") - 1
    seen = np.bincount(of_letter * width + kinds[letters], minlength=docs * width).reshape(docs, width)
    script = np.where(seen.any(axis=1), seen.argmax(axis=1), width - 1)
    return out, np.maximum(entropy, 0.0), script


def measured(docs: DataFrame, pieces: str, byte_pairs: str, s: Settings = Settings()) -> DataFrame:
    """Per row: doc_id, lang (null if there is no such column), the counts, the entropy in bits and the script of its letters.

    The vocabularies' files are read by each task from their paths, which every executor must have.
    """
    names = (*SCRIPTS, "Other", "None")
    schema = "doc_id long, lang string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", entropy double, script string"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabularies(pieces, byte_pairs)
        for batch in batches:
            for at, data, bounds in chunks(batch.column(2)):
                found, entropy, script = counts(data, bounds, known, s)
                some = [batch.column(k).slice(at, len(entropy)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*some, *(pa.array(found[c], pa.int64()) for c in _COUNTS), pa.array(entropy), pa.array([names[k] for k in script.tolist()])], names=["doc_id", "lang", *_COUNTS, "entropy", "script"])

    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    return docs.select(F.col("doc_id").cast("long"), lang.cast("string").alias("lang"), ended().alias("text")).mapInArrow(rows, schema)


def _of_band(bands: Mapping[str, Band], field: str) -> Column:
    """A field of the band of the row's language, else of its script."""
    table = F.create_map(*[F.lit(x) for name, band in bands.items() for x in (name, float(getattr(band, field)))])
    return F.coalesce(table[F.coalesce("lang", F.lit(""))], table[F.col("script")], table[F.lit("Other")])


def rules(docs: DataFrame, pieces: str, byte_pairs: str, bands: Mapping[str, Band] = BANDS, s: Settings = Settings()) -> DataFrame:
    """Per row: doc_id, the counts, base_failed, kept, the four measures, the script and the first rule that rejects it.

    A document fails the base rules with too few words or too many of them in repeated windows; the others have to lie
    in the band of their language, if bands name it, else of their script.  Null, empty and wordless texts have zeros and
    fail the base rules; repeated rows are judged each for itself; a tie of scripts goes to the first of SCRIPTS.  Nothing
    is shuffled, and a document's verdict depends on its own text (and lang) alone.
    """
    n, chars = F.greatest("n_pieces", F.lit(1)), F.col("word_chars")
    found = measured(docs, pieces, byte_pairs, s).withColumns({
        "piece_chars": chars / n, "byte_pair_chars": chars / F.greatest("n_byte_pairs", F.lit(1)), "fallback_share": F.col("n_byte_pieces") / n,
        "base_failed": (F.col("n_words") < s.least_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(s.most_repeated) * F.col("n_words")),
    })
    least_entropy = F.least(_of_band(bands, "least_entropy"), _of_band(bands, "spread") * F.log2(n))
    broken = (
        (F.col("base_failed"), "base"),
        (~F.col("piece_chars").between(_of_band(bands, "least_piece_chars"), _of_band(bands, "most_piece_chars")), "piece_chars"),
        (~F.col("byte_pair_chars").between(_of_band(bands, "least_byte_chars"), _of_band(bands, "most_byte_chars")), "byte_pair_chars"),
        (F.col("fallback_share") > _of_band(bands, "most_fallback"), "fallback_share"),
        (~F.col("entropy").between(least_entropy, _of_band(bands, "most_entropy")), "entropy"),
    )
    reason = F.coalesce(*[F.when(c, F.lit(name)) for c, name in broken])
    return found.withColumns({"rejected_by": reason}).withColumn("kept", F.col("rejected_by").isNull()).select("doc_id", *_COUNTS[:5], "base_failed", "kept", "piece_chars", "byte_pair_chars", "fallback_share", "entropy", "script", "rejected_by")
