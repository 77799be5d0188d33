"""NumPy helpers that run inside Spark tasks: words, shingles and hashes of one UTF-8 text at a time.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lowered.  A word's hash is a polynomial over
its bytes (each byte first sent through a table of 64-bit values) followed by a 64-bit finaliser, all from array
operations, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_GOLD = U(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x + _GOLD
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_VALUE = mix(np.arange(256, dtype=U))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE_LOWER = _VALUE[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = {"up": np.ones(1, dtype=U), "down": np.ones(1, dtype=U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            step = np.full(size, U(base), dtype=U)
            step[0] = U(1)
            _powers[name] = np.multiply.accumulate(step)
    return _powers["up"][:n], _powers["down"][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end]; values are 64-bit codes of the symbols."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words of a text given as uint8."""
    edge = np.diff(np.concatenate(([True], _SPACE[data], [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(data: np.ndarray) -> np.ndarray:
    starts, ends = word_spans(data)
    return span_hashes(_VALUE_LOWER[data], starts, ends) if len(starts) else np.zeros(0, dtype=U)


_TURN = [U(pow(0xA0761D6478BD642F, k + 1, 1 << 64)) for k in range(16)]


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; empty if there are fewer."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=U)
    total = np.zeros(m, dtype=U)
    for k in range(n):
        total += words[k : k + m] * _TURN[k]
    return mix(total)


def shingle_set(data: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; a text of fewer words is one shingle, one of no words has none."""
    words = word_hashes(data)
    if not len(words):
        return words
    return np.unique(ngrams(words, min(n, len(words))))


def shingle_sets(column: pa.Array, n: int = 5) -> Iterator[np.ndarray]:
    """The shingle_set of each text of a column; the words of many texts are hashed at once.  Each text ends with a line end."""
    for _, data, bounds in chunks(column):
        firsts, ends = word_spans(data)
        words = span_hashes(_VALUE_LOWER[data], firsts, ends) if len(firsts) else np.zeros(0, dtype=U)
        base, grams = np.searchsorted(firsts, bounds).tolist(), ngrams(words, n)
        for a, b in zip(base[:-1], base[1:], strict=True):
            if b - a >= n:
                found = np.sort(grams[a : b - n + 1])
                new = found[1:] != found[:-1]
                yield found if new.all() else np.concatenate((found[:1], found[1:][new]))
            else:
                yield ngrams(words[a:b], b - a) if b > a else words[a:b]


def with_end(column: pa.Array) -> pa.Array:
    """The texts (null ones empty) with a line end behind each."""
    kind = pa.large_string()
    return pc.binary_join_element_wise(column.cast(kind).fill_null(""), pa.scalar("", kind), pa.scalar("\n", kind))


def texts(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each text; a null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, dtype=np.uint8)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield data[a:b]


def chunks(column: pa.Array, least: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `least` bytes: the place of the first, the bytes of all, and where each begins and ends.

    So that array operations see many short texts at once.  Each text has to end with a line end (see `ended`), so that
    neither words nor lines run from one into the next.
    """
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        end = min(len(column), max(at + 1, int(np.searchsorted(offsets, offsets[at] + least, side="right")) - 1))
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from arrays."""
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=kind.to_pandas_dtype())
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=kind))
