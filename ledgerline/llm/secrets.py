"""Secret scans: an Aho-Corasick keyword prefilter, anchored expressions near its hits, then checksum validation."""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ledgerline.llm.arrays import texts
from ledgerline.llm.common import fresh

#: Kinds in the order that spans of one start are listed in; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "github", "jwt", "card", "iban", "pem")
SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())]))

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
GITHUB = re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(rb"[A-Za-z0-9_-]+(?:(\.)[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{10,})?")
#: Characters of a web token's header; longer ones are none.
JWT_HEADER = 4096
PEM = re.compile(rb"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
#: What stands between a key's header and its end: a line end (or one written as an escape), indents and marks of quoted text.
_GAP = rb"(?:\\[rnt]|[\s>#*|\"',+;])"
PEM_FIELDS = re.compile(rb"(?:%s*+(?:Proc-Type|DEK-Info|Comment|[Xx]-[A-Za-z-]+): ?[^\r\n\\]*+)*+" % _GAP)
PEM_LINES = re.compile(rb"%s*+[A-Za-z0-9+/=]{16,}+(?:%s++[A-Za-z0-9+/=]{16,}+)*+(?:(?<!=)%s++[A-Za-z0-9+/]{1,15}={0,2}(?![A-Za-z0-9+/=])(?=[\"',+;]*[ \t]*(?:[\r\n\\]|\Z)))?" % ((_GAP,) * 3))
KEYWORDS = {b"password": "assign", b"passwd": "assign", b"secret": "assign", b"token": "assign", b"apikey": "assign", b"api_key": "assign", b"akia": "access", b"eyj": "jwt", b"private key-----": "pem"} | {b"gh%c_" % c: "github" for c in b"pousr"}
HEX_LENGTH, ACCESS_LENGTH, VALUE_LENGTH = 24, 20, 6
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_HEX = np.zeros(256, dtype=bool)
_HEX[[*b"0123456789abcdef"]] = True
CARD = re.compile(rb"(?<![0-9])[2-6][0-9]{12,18}(?![0-9])")
IBAN = re.compile(rb"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])")
#: The countries whose bank account numbers are international ones.
IBAN_COUNTRIES = "AD AE AL AT AZ BA BE BG BH BI BR BY CH CR CY CZ DE DJ DK DO EE EG ES FI FK FO FR GB GE GI GL GR GT HN HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV LY MC MD ME MK MN MR MT MU NI NL NO OM PK PL PS PT QA RO RS RU SA SC SD SE SI SK SM SO ST SV TL TN TR UA VA VG XK YE".split()
#: These keep their case: a country's letters with the first check digit, and the first two digits of a card.
EXACT_KEYWORDS = {f"{c}{d}": "iban" for c in IBAN_COUNTRIES for d in range(10)} | {str(n): "card" for n in range(20, 70)}


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


#: What the issuers' card numbers begin with (from, to) and their lengths.
ISSUERS = (((4, 4), (13, 16, 19)), ((51, 55), (16,)), ((2221, 2720), (16,)), ((34, 34), (15,)), ((37, 37), (15,)), ((6011, 6011), (16, 19)), ((644, 649), (16, 19)), ((65, 65), (16, 19)), ((3528, 3589), (16, 19)), ((300, 305), (14,)), ((36, 36), (14,)), ((38, 39), (14,)))


def issued(digits: bytes) -> bool:
    """Whether a number is of an issuer's range and length, and its check digit is right."""
    return any(low <= int(digits[: len(str(low))]) <= high and len(digits) in sizes for (low, high), sizes in ISSUERS) and luhn(digits)


def iban(text: bytes) -> bool:
    return int("".join(str(int(chr(c), 36)) for c in text[4:] + text[:4])) % 97 == 1


def github(match: re.Match[bytes]) -> bool:
    """The last six characters are the CRC-32 of the first thirty in base 62."""
    value, shown = zlib.crc32(match[1]), bytearray(b"000000")
    for i in range(5, -1, -1):
        value, k = divmod(value, 62)
        shown[i] = BASE62[k]
    return bytes(shown) == match[2]


def jwt(text: bytes) -> bool:
    head = text.split(b".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4)))
    except (ValueError, TypeError, binascii.Error, RecursionError):  # deeply nested JSON is no header
        return False


def key_end(raw: bytes, header: re.Match[bytes]) -> int:
    """Where a private key ends: after the END line of its label, or with its base64 lines where that is missing."""
    other = raw.find(b"-----BEGIN ", header.end())
    at = raw.find(b"-----END %s-----" % header[1], header.end(), other if other >= 0 else len(raw))
    if at >= 0:
        return at + len(header[1]) + 14
    fields = PEM_FIELDS.match(raw, header.end())
    body = PEM_LINES.match(raw, fields.end())
    return body.end() if body else fields.end() if fields[0] else header.end()


def runs(member: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of True of at least that length."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], member, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


@lru_cache(maxsize=1)
def _automata():  # noqa: ANN202
    """One of the keywords in any case, one of those that keep it."""
    import ahocorasick

    both = []
    for words in ({w.decode(): k for w, k in KEYWORDS.items()}, EXACT_KEYWORDS):
        found = ahocorasick.Automaton()
        for word, kind in words.items():
            found.add_word(word, (kind, len(word)))
        found.make_automaton()
        both.append(found)
    return both


def find(data: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) in bytes, sorted."""
    raw = data.tobytes()
    spans: list[tuple[int, int, int]] = []
    done = dict.fromkeys(KINDS, 0)
    dot = rest = 0  # where the header and the whole of the web token end whose characters are being looked at; the same for all places in its header

    def put(kind: str, start: int, end: int) -> None:
        spans.append((start, KINDS.index(kind), end))

    any_case, exact = _automata()
    for end, (kind, size) in any_case.iter(raw.lower().decode("latin-1")):
        at = end + 1 - size
        if kind == "assign" and at >= done[kind] and (m := ASSIGN.match(raw, at)):
            done[kind] = m.end()
            if m.end(2) - m.start(2) >= VALUE_LENGTH:
                put(kind, m.start(), m.end())
        elif kind == "access" and at >= done[kind] and (m := ACCESS.match(raw, at)):
            done[kind] = m.end()
            if m.end() - m.start() >= ACCESS_LENGTH:
                put(kind, m.start(), m.end())
        elif kind == "github" and (m := GITHUB.match(raw, at)) and github(m):
            put(kind, m.start(), m.end())
        elif kind == "jwt" and at >= done[kind] and raw.startswith(b"eyJ", at):
            if at >= dot:
                m = JWT.match(raw, at)
                dot, rest = (m.start(1), m.end()) if m[1] else (0, 0)
                done[kind] = 0 if m[1] else m.end()  # without a rest no place in the run begins a token
            if at < dot and 8 <= dot - at <= JWT_HEADER and jwt(raw[at:rest]):
                done[kind] = rest
                put(kind, at, rest)
        elif kind == "pem" and (at := raw.rfind(b"-----BEGIN ", max(0, end - 60), end)) >= done[kind] and (m := PEM.match(raw, at)):
            done[kind] = key_end(raw, m)
            put(kind, m.start(), done[kind])
    for a, b in runs(_HEX[data], HEX_LENGTH):
        put("hex", a, b)
    for end, (kind, size) in exact.iter(raw.decode("latin-1")):
        at = end + 1 - size
        if at >= done[kind] and (m := (IBAN if kind == "iban" else CARD).match(raw, at)):
            done[kind] = m.end()
            if iban(m[0]) if kind == "iban" else issued(m[0]):
                put(kind, m.start(), m.end())
    return sorted(spans)


def scan(docs: DataFrame, name: str = "spans") -> DataFrame:
    """docs with the column `name`, in place of any of that name: array of (kind, start, end) by start, then kind.

    Positions are code points, ends exclusive.  The base kinds assign, access and hex are leftmost non-overlapping
    matches of their expression, those too short being dropped.  The other kinds have a checksum or structure that is
    validated: GitHub tokens (CRC-32 in base 62), JSON web tokens (a header with alg), card numbers (an issuer's range, Luhn), bank
    account numbers (modulo 97) and private keys with their body and END line.  Null and empty texts have no spans.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, kinds, starts, stops = [0], [], [], []
            for data in texts(batch.column(place)):
                spans = find(data)
                if spans:
                    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # code points before each byte
                    for a, k, b in spans:
                        kinds.append(KINDS[k])
                        starts.append(int(points[a]))
                        stops.append(int(points[b]))
                ends.append(len(kinds))
            each = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(stops, pa.int64())], names=["kind", "start", "end"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)], names=[*batch.schema.names, name])

    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != name.lower()])
    place = kept.columns.index("text")
    return kept.mapInArrow(found, StructType([*kept.schema.fields, StructField(name, SPANS)]))


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda x: x == kind


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts of the base kinds, the digest of the base spans and all spans as a string."""
    base = F.filter("spans", lambda x: x["kind"].isin(*KINDS[:3]))
    counts = [F.size(F.filter(F.transform("spans", lambda x: x["kind"]), _is(k))).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return scan(docs.select(F.col("doc_id").cast("long"), "text")).select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, kinds: tuple[str, ...] = KINDS, mark: str = "<{}>") -> DataFrame:
    """docs with every span of the given kinds replaced by a mark of its kind; overlapping spans are replaced as one.

    All columns stay as they are but for the text; a null text stays null, and a text without spans is not changed.
    """
    wanted, marks = {KINDS.index(k) for k in kinds}, [mark.format(k).encode() for k in KINDS]

    def cleaned(data: np.ndarray) -> bytes:
        raw, out, at = data.tobytes(), [], 0
        for a, k, b in find(data):
            if k in wanted:
                if a >= at:
                    out += (raw[at:a], marks[k])
                at = max(at, b)
        return b"".join((*out, raw[at:]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(place)
            new = [x if there else None for x, there in zip(map(cleaned, texts(old)), old.is_valid().to_pylist(), strict=True)]
            yield batch.set_column(place, "text", pa.array(new, pa.binary()).cast(pa.string()))

    place = [x.lower() for x in docs.columns].index("text")
    return docs.mapInArrow(rows, docs.schema)
