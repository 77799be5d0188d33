"""Expressions over text: tidying, tokens, canonical addresses and names, snippets, labelled values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions import Col, col, parse_local_number

# Spellings of address words and the form they count as.
ADDRESS_WORDS = {
    "JALAN": "JL", "JLN": "JL", "JL": "JL", "GANG": "GANG", "GG": "GANG", "PERUMAHAN": "PERUM", "PERUM": "PERUM", "DUSUN": "DUSUN", "DSN": "DUSUN", "DESA": "DESA", "DS": "DESA",
    "NOMOR": "NO", "NOMER": "NO", "NRO": "NO", "NO": "NO", "GD": "GEDUNG", "GDG": "GEDUNG", "GEDUNG": "GEDUNG", "KOMP": "KOMPLEK", "KOMPLEKS": "KOMPLEK", "KOMPLEK": "KOMPLEK",
    "KEC": "KEC", "KECAMATAN": "KEC", "KEL": "KEL", "KELURAHAN": "KEL", "KAB": "KAB", "KABUPATEN": "KAB", "PROP": "PROV", "PROV": "PROV", "PROVINSI": "PROV", "BLK": "BLOK", "BLOK": "BLOK",
    "LT": "LANTAI", "LANTAI": "LANTAI", "STREET": "ST", "ST": "ST", "ROAD": "RD", "RD": "RD", "AVENUE": "AVE", "AV": "AVE", "AVE": "AVE", "SUITE": "SUITE", "STE": "SUITE", "FLOOR": "FLOOR", "FL": "FLOOR",
    "BUILDING": "BUILDING", "BLDG": "BUILDING",
}
# Titles and legal forms that say nothing about who is named.
NAME_STOPWORDS = "PT CV UD PD TBK PERSERO HOLDING BAPAK IBU BP SDR H HJ DR IR DRS SE SH MM MBA ST MSI MR MRS MS LTD LIMITED INC CORP LLC".split()
# Words too frequent in regulations to tell sections apart.
STOPWORDS = "yang dan atau dengan untuk pada dalam dari dimaksud sebagaimana ayat huruf bagi serta oleh ini itu tersebut adalah dapat wajib harus tidak akan sebagai telah bank umum jika maka agar antara lain paling atas juga bila".split()


def tidy(c: Col) -> Column:
    """Runs of blanks and tabs as one blank, lines trimmed, at most one empty line in between."""
    out = F.regexp_replace(col(c), r"[ \t]+", " ")
    out = F.regexp_replace(out, r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def tokens(c: Col, least: int = 3, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Lower-case words of letters and digits, long enough and not stopwords."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    return F.filter(found, lambda t: (F.length(t) >= least) & ~t.isin(*stopwords))


def canonical_address(c: Col) -> Column:
    """Upper case, only letters and digits, known words in one spelling; the key by which addresses are equal."""
    plain = F.trim(F.regexp_replace(F.upper(F.coalesce(col(c), F.lit(""))), "[^0-9A-Z]+", " "))
    words = F.create_map(*[F.lit(x) for kv in ADDRESS_WORDS.items() for x in kv])
    return F.array_join(F.transform(F.split(plain, " "), lambda t: F.coalesce(words[t], t)), " ")


def name_tokens(c: Col) -> Column:
    """Words of a name without dots, titles, legal forms and single letters, each once."""
    plain = F.regexp_replace(F.replace(F.upper(col(c)), F.lit("."), F.lit("")), "[^0-9A-Z]+", " ")
    return F.array_distinct(F.filter(F.split(plain, " "), lambda t: (F.length(t) > 1) & ~t.isin(*NAME_STOPWORDS)))


def snippet(c: Col, most: int = 600) -> Column:
    """The text, cut at the last blank before `most` characters and marked where it is longer."""
    return F.when(F.length(col(c)) > most, F.concat(F.regexp_replace(F.substring(col(c), 1, most), r"\s+\S*\z", ""), F.lit("..."))).otherwise(col(c))


_LAST = r"(\(?-?[0-9][0-9.,]*\)?%?)\s*$"


def value_after(line: Col, label: str) -> Column:
    """The last number of a line on which a label (an expression) stands before it; null without either."""
    found = F.regexp_extract(col(line), f"(?i)(?:{label}).*?{_LAST}", 1)
    return F.when(found != "", parse_local_number(found))


def join_label_value(lines: Col) -> Column:
    """Lines of a label followed by one of only a number become one line; an array of lines in, one out."""
    number = r"^\s*\(?\s*-?\s*(?:[Rr][Pp]\.?\s*)?[0-9][0-9.,]*\s*\)?\s*$"

    def step(state: Column, line: Column) -> Column:
        last = F.element_at(state, -1)
        fits = (F.size(state) > 0) & line.rlike(number) & ~F.coalesce(last, F.lit("")).rlike(number) & ~F.coalesce(last, F.lit("")).rlike(r"[0-9]\s*$") & (F.trim(F.coalesce(last, F.lit(""))) != "")
        joined = F.concat(F.slice(state, 1, F.greatest(F.size(state) - 1, F.lit(0))), F.array(F.concat_ws(" ", F.trim(last), F.trim(line))))
        return F.when(fits, joined).otherwise(F.array_append(state, line))

    # Without a line of only a number nothing is joined.
    folded = F.aggregate(col(lines), F.array().cast("array<string>"), step)
    return F.when(F.exists(col(lines), lambda x: x.rlike(number)), folded).otherwise(col(lines))


def window_starts(length: Column, size: int, overlap: int) -> Column:
    """Where windows of a size with an overlap start; one window if the text is no longer than that."""
    return F.when(length <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0)), F.lit(size - overlap)))


def scores_of(c: Col, markers: Mapping[str, Sequence[tuple[str, int]]]) -> Column:
    """(score, -place, name) of each kind: the weights of its markers that stand in the text."""
    low = F.lower(col(c))
    rows = []
    for k, (name, words) in enumerate(markers.items()):
        total = F.lit(0)
        for w, weight in words:
            total = total + F.when(F.contains(low, F.lit(w)), weight).otherwise(0)
        rows.append(F.struct(total.alias("score"), F.lit(-k).alias("place"), F.lit(name).alias("name")))
    return F.array(*rows)


def classify(c: Col, markers: Mapping[str, Sequence[tuple[str, int]]], least: int = 5) -> Column:
    """The kind of the highest score (the first of equal ones) if it reaches least, else unknown."""
    best = F.array_max(scores_of(c, markers))
    return F.when(best["score"] >= least, best["name"]).otherwise("unknown")


def page_groups(pages: Col, budget: int) -> Column:
    """Groups of pages in order whose lengths stay within a budget: an array of (page, length) in, (page, group) out."""
    start = F.struct(F.lit(0).alias("group"), F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<page:bigint,group:int>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        new = (state["used"] > 0) & (state["used"] + x["length"] > budget)
        group = F.when(new, state["group"] + 1).otherwise(state["group"])
        used = F.when(new, x["length"]).otherwise(state["used"] + x["length"])
        return F.struct(group.alias("group"), used.cast("long").alias("used"), F.array_append(state["out"], F.struct(x["page"].cast("long").alias("page"), group.alias("group"))).alias("out"))

    return F.aggregate(col(pages), start, step, lambda s: s["out"])
