"""Reading documents: facts by a table of rules with their evidence, holders, forms and collateral, chunks, reduction to a budget."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerline.functions import null_if_zero, parse_local_number
from ledgerline.functions.text import join_label_value
from ledgerline.operators.relational import keep_first


class Rule(NamedTuple):
    """A fact's name, the expressions that its label matches (case apart), the kind of its value and its priority."""

    item: str
    labels: tuple[str, ...]
    kind: str = "money"  # money, percent, int or number
    priority: int = 100


#: Words of a unit and what they stand for; the first that a text names counts.
UNITS = (("trillion", 1e12), ("billion", 1e9), ("million", 1e6), ("thousand", 1e3))
# A line: its label, then its last number, in parentheses if negative, with a sign of per cent or a unit's word behind it.
_LINE = r"^(.*?)[\s:.]*((?:\b(?:rp|idr|usd|eur)\.?\s*)?\(?-?\b[0-9][0-9.,]*\)?\s*%?)\s*({units})?s?\s*$"


def clean_lines(text: Column) -> Column:
    """The lines of a text without those of only blanks, blanks in a row as one."""
    plain = F.regexp_replace(text, r"[ \t\x0B\f\r]+", " ")  # once a text: white space but for line ends
    return F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def unit_of(text: Column, units: Sequence[tuple[str, float]]) -> Column:
    """What "in thousands" and the like make of a page's amounts; one if it names no unit."""
    out = F.lit(1.0)
    for word, scale in reversed(units):
        out = F.when(F.coalesce(text, F.lit("")).rlike(rf"(?i)\bin\s+(?:[a-z]+\s+)?{word}s?\b"), F.lit(scale)).otherwise(out)
    return out


def facts(pages: DataFrame, rules: Sequence[Rule], units: Sequence[tuple[str, float]] = UNITS) -> DataFrame:
    """(doc, item, kind, value, unit, score, page, line, quote): what the rules find on pages (doc, page, text).

    A label and a number on the next line are one line.  A line's number is its last; what stands before it is the label
    that rules are held against, so each line is taken apart once, whatever the number of rules.  Of a page each
    expression of a rule gives its first line only.  Money is scaled by the unit's word on the line, else by the page's;
    a per cent is a share; an int is rounded.  The score is the priority, more for a total and for a colon.
    """
    words = "|".join(word for word, _ in units)
    number = _LINE.format(units=words)
    # Beside a generator it would be worked out for each line: a page's unit comes before.
    rows = pages.select("doc", "page", "text", unit_of(F.col("text"), units).alias("page_unit"))
    rows = rows.select("doc", "page", "page_unit", F.posexplode(join_label_value(clean_lines(F.col("text")))).alias("line", "quote"))
    # One match a line: unit's word, number and label between line ends, which no line holds itself.
    split = F.split(F.regexp_replace("quote", f"(?i){number}", "\n$3\n$2\n$1\n"), "\n")
    rows = rows.where(F.col("quote").rlike("[0-9]")).select("*", split.alias("_p"))
    raw = F.regexp_replace(F.get("_p", 2), r"^[A-Za-z]+\.?\s*|\s+", "")
    rows = _once(rows, {"label": F.trim(F.get("_p", 3)), "raw": raw, "word": F.lower(F.get("_p", 1))}).where("raw <> '' and label <> ''")
    line_unit = F.coalesce(*[F.when(F.col("word") == word, F.lit(scale)) for word, scale in units])
    rows = _once(rows, {"read": parse_local_number("raw"), "unit": F.coalesce(line_unit, "page_unit")}).where("read is not null")
    hits = []
    for r in rules:
        value = {"money": F.col("read") * F.col("unit"), "int": F.round("read")}.get(r.kind, F.col("read"))
        for k, label in enumerate(r.labels):
            hits.append(F.when(F.col("label").rlike(f"(?i){label}"), F.struct(F.lit(r.item).alias("item"), F.lit(k).alias("k"), F.lit(r.kind).alias("kind"), value.alias("value"), F.when(F.lit(r.kind == "money"), F.col("unit")).otherwise(1.0).alias("unit"), F.lit(r.priority).alias("priority"))))
    bonus = F.when(F.col("quote").rlike(r"(?i)\btotal\b"), 15).otherwise(0) + F.when(F.contains("quote", F.lit(":")), 2).otherwise(0)
    found = rows.select("doc", "page", "line", "quote", F.inline(F.array(*hits))).where("item is not null")
    # What was found of a document lies together: its first lines, its best facts and sums over it need no other shuffle.
    rest = F.struct("line", "quote", "kind", "value", "unit", "priority")
    first = found.repartition("doc").groupBy("doc", "page", "item", "k").agg(F.min(rest).alias("x")).select("doc", "page", "item", "x.*")
    return first.select("doc", "item", "kind", "value", "unit", (F.col("priority") + bonus).alias("score"), "page", "line", "quote")


def _once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """df with columns that are worked out once, in a projection of their own, however many expressions and filters read them.

    A projection shares what its expressions have in common, a generator doesn't; the generator above it only keeps filters
    from being moved below, where they would work the columns out again.
    """
    packed = df.select("*", F.struct(*[x.alias(name) for name, x in columns.items()]).alias("_s"))
    return packed.select(*df.columns, F.inline(F.array("_s")))


def best_facts(found: DataFrame) -> DataFrame:
    """Of each document's items the fact of the highest score, then of the earliest page and line."""
    order = F.struct((-F.col("score")).alias("lost"), "page", "line", "value", "kind", "unit", "quote")
    best = found.groupBy("doc", "item").agg(F.min(order).alias("x")).select("doc", "item", "x.*")
    return best.select("doc", "item", "kind", "value", "unit", (-F.col("lost")).alias("score"), "page", "line", "quote")


def _next(lines: Column, i: Column, k: int) -> Column:
    return F.coalesce(F.get(lines, i + k), F.lit(""))


POSITIONS = "director|commissioner|shareholder|president|manager|partner|trustee"
_TOTAL = "^[Tt][Oo][Tt][Aa][Ll]"
_COUNT = r"^\(?\s*([0-9]{1,3}(?:[.,][0-9]{3})+)\s*\)?$"
_PERCENT = r"^(?:[0-9]+[.)]\s*)?(.*?[^\s:-])\s*[:-]?\s*([0-9]{1,3}(?:[.,][0-9]+)?)\s*%$"


def holders(docs: DataFrame, positions: str = POSITIONS, most: int = 12) -> DataFrame:
    """(doc, place, name, share, position) of the holders that a document (doc, text) lists, the largest first.

    A holder is a line of a name and a per cent, or three lines of a name, a number of shares and a position.  Shares are of
    the line TOTAL (its number there or on the next line), else of their sum.  A document with holders of the second form
    is read by it alone; of one name, case apart, the first counts.
    """
    lines = docs.select("doc", clean_lines(F.col("text")).alias("l"))
    i = F.sequence(F.lit(0), F.size("l") - 1)
    shares = lambda x: F.regexp_extract(x, _COUNT, 1)
    there = F.when(F.size("l") > 0, i).otherwise(F.array().cast("array<int>"))
    total = F.filter(there, lambda k: F.get("l", k).rlike(_TOTAL))
    # Each step is a projection of its own: a line is held against an expression once, by what it is cheap to see first.
    read = _once(lines, {"c": F.transform("l", shares), "total": F.get(total, 0)})
    after = F.coalesce(F.get("c", F.col("total") + 1), F.lit(""))
    sum_line = F.coalesce(*[F.when(x != "", parse_local_number(x)) for x in (F.regexp_extract(_next(F.col("l"), F.col("total"), 0), r"([0-9]{1,3}(?:[.,][0-9]{3})+)\s*$", 1), after)])

    def stacked(k: Column) -> Column:
        name = F.get("l", k)
        fits = (F.get("c", k + 1) != "") & (F.get("c", k) == "") & (F.length(name) > 2) & ~name.rlike(_TOTAL)
        return fits & name.rlike("[A-Za-z]") & _next(F.col("l"), k, 2).rlike(f"(?i){positions}")

    def counted(k: Column) -> Column:
        return F.struct(k.alias("at"), F.get("l", k).alias("name"), parse_local_number(F.get("c", k + 1)).alias("n"), _next(F.col("l"), k, 2).alias("position"))

    read = _once(read, {"many": F.transform(F.filter(there, stacked), counted), "whole": sum_line})
    parts = F.transform(F.filter(there, lambda k: F.contains(F.get("l", k), F.lit("%"))), lambda k: F.struct(k.alias("at"), F.regexp_extract(F.get("l", k), _PERCENT, 1).alias("name"), F.regexp_extract(F.get("l", k), _PERCENT, 2).alias("part")))
    values = F.transform(F.filter(parts, lambda x: (x["part"] != "") & (F.length(x["name"]) > 2)), lambda x: F.struct(x["at"].alias("at"), x["name"].alias("name"), F.replace(x["part"], F.lit(","), F.lit(".")).cast("double").alias("n")))
    few = F.transform(F.filter(values, lambda x: (x["n"] > 0) & (x["n"] <= 100)), lambda x: F.struct(x["at"].alias("at"), x["name"].alias("name"), (x["n"] / 100).alias("n"), F.lit(None).cast("string").alias("position")))
    rows = read.select("doc", F.col("whole").alias("total"), (F.size("many") > 0).alias("counted"), F.inline(F.when(F.size("many") > 0, F.col("many")).otherwise(few)))
    once = keep_first(rows.withColumn("_name", F.lower("name")), ["doc", "_name"], [F.col("at")])
    whole = F.coalesce("total", F.sum("n").over(W.partitionBy("doc")))
    shared = once.withColumn("share", F.when(F.col("counted"), F.col("n") / null_if_zero(whole)).otherwise(F.col("n")))
    ranked = shared.withColumn("place", F.row_number().over(W.partitionBy("doc").orderBy(F.col("share").desc(), "at")))
    return ranked.where(F.col("place") <= most).select("doc", "place", "name", "share", "position")


def fields(docs: DataFrame, aliases: Mapping[str, Sequence[str]], flags: Sequence[str] = ()) -> DataFrame:
    """(doc, a column a field): the values of a form (doc, text) by the labels that stand for each field, the first label first.

    A label is a whole line or stands before a colon or a wide gap; its value is on the same line, else it is the next
    line, unless that is a label itself.  A label "A / B" gives its parts' values "x / y", part by part, if no line has the
    part alone.  Fields in flags are true for yes, true or a tick, false for what else stands there.
    """
    lines = docs.select("doc", F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "").alias("l"))
    label = lambda x: F.trim(F.regexp_extract(x, r"^([^:\t]+?)(?:\s*:|\t|\s{2,}|$)", 1))
    value = lambda x: F.trim(F.regexp_extract(x, r"^[^:\t]+?(?:\s*:|\t|\s{2,})\s*(.*)$", 1))
    known = [a.lower() for names in aliases.values() for a in names]

    def entry(x: Column, i: Column) -> Column:
        after = F.coalesce(F.get("l", i + 1), F.lit(""))
        taken = after.endswith(":") | F.lower(label(after)).isin(*known) & (value(after) != "")
        own = F.when(value(x) != "", value(x)).when(~taken, after)
        return F.struct(F.lower(label(x)).alias("k"), F.nullif(own, F.lit("")).alias("v"))

    read = lines.withColumn("e", F.transform("l", entry))
    parts = F.flatten(F.transform(F.filter("e", lambda x: F.contains(x["k"], F.lit(" / ")) & x["v"].isNotNull()), lambda x: F.arrays_zip(F.split(x["k"], " / ").alias("k"), F.split(x["v"], " / ").alias("v"))))
    read = read.withColumn("e", F.concat("e", F.transform(parts, lambda x: F.struct(F.trim(x["k"]).alias("k"), F.trim(x["v"]).alias("v")))))

    def first(names: Sequence[str]) -> Column:
        return F.coalesce(*[F.get(F.filter("e", _named(a.lower())), 0)["v"] for a in names])

    return read.select("doc", *[(F.lower(first(names)).rlike("^(?:yes|true|y|x|✓)") if field in flags else first(names)).alias(field) for field, names in aliases.items()])


def _named(label: str) -> Callable[[Column], Column]:
    return lambda x: (x["k"] == label) & x["v"].isNotNull()


def collateral(docs: DataFrame, appraised: str = "appraised", liquidation: str = "liquidation", units: Sequence[tuple[str, float]] = UNITS) -> DataFrame:
    """(doc, place, kind, appraised, liquidation): numbered goods with two values, on one line or on three.

    One line: "1. Land and building appraised 9,000 liquidation 7,000"; three: "1. Land and building", then a line of each
    value.  A unit's word behind a number counts.
    """
    text = F.array_join(clean_lines(F.col("text")), "\n")
    amount = rf"(?:[A-Za-z]{{1,3}}\.?[ ]*)?([0-9][0-9.,]*)[ ]*({'|'.join(w for w, _ in units)})?s?"
    pattern = rf"(?im)^[0-9]+\.[ ]+([^\n]+?)\s+{appraised}[ :]*\s?{amount}\s+{liquidation}[ :]*\s?{amount}[ ]*$"
    whole = F.regexp_extract_all(text, F.lit(pattern), 0)
    scaled = lambda x, k: parse_local_number(F.regexp_extract(x, pattern, k)) * F.coalesce(*[F.when(F.lower(F.regexp_extract(x, pattern, k + 1)) == w, F.lit(s)) for w, s in units], F.lit(1.0))
    rows = docs.select("doc", F.posexplode(whole).alias("place", "x"))
    return rows.select("doc", (F.col("place") + 1).alias("place"), F.regexp_replace(F.regexp_extract("x", pattern, 1), r"\s+", " ").alias("kind"), scaled(F.col("x"), 2).alias("appraised"), scaled(F.col("x"), 4).alias("liquidation"))


def chunks(docs: DataFrame, section: str, chapter: str, size: int = 1200, overlap: int = 150, least: int = 40) -> DataFrame:
    """(doc, place, chapter, section, at, first_page, last_page, chunk, label): a document's pages (doc, page, text) cut for search.

    A line that is a section's mark (the expression's first group is its name) opens a section; a chapter's mark names the
    chapter of those that follow and has no text of its own.  What is longer than size goes in windows: a window ends at
    its last line break if that lies past its middle, the next starts `overlap` before the end, and never sooner than
    size - overlap after the last start.  at counts from the document's begin, pages joined by line ends.
    """
    body = F.array_sort(F.collect_list(F.struct(F.col("page").cast("long").alias("page"), F.coalesce("text", F.lit("")).alias("text"))))
    whole = docs.groupBy("doc").agg(body.alias("p")).withColumn("text", F.array_join(F.transform("p", lambda x: x["text"]), "\n"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<page:bigint,at:bigint,end:bigint>>").alias("out"))
    spans = F.aggregate("p", start, lambda s, x: F.struct((s["at"] + F.length(x["text"]) + 1).cast("long").alias("at"), F.array_append(s["out"], F.struct(x["page"].alias("page"), s["at"].alias("at"), (s["at"] + F.length(x["text"]) + 1).cast("long").alias("end"))).alias("out")), lambda s: s["out"])
    lines = whole.select("doc", spans.alias("pages"), F.split("text", "\n").alias("l"))
    # Runs of lines: each mark opens one, with the offset of its first character.
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit(None).cast("string").alias("chapter"), F.array().cast("array<struct<at:bigint,chapter:string,section:string,text:string,kept:boolean>>").alias("runs"))
    group = lambda x, pattern: F.when(x.rlike(pattern), F.regexp_extract(x, pattern, 1))

    def step(state: Column, x: Column) -> Column:
        new_chapter, new_section = group(x, chapter), group(x, section)
        now = F.coalesce(new_chapter, state["chapter"])
        last = F.element_at(state["runs"], -1)
        run = lambda at, ch, sec, text, kept: F.struct(at.cast("long").alias("at"), ch.cast("string").alias("chapter"), sec.cast("string").alias("section"), text.alias("text"), kept.alias("kept"))
        opened = F.array_append(state["runs"], run(state["at"], F.when(new_section.isNotNull(), state["chapter"]), new_section, x, new_chapter.isNull()))
        longer = F.array_append(F.slice(state["runs"], 1, F.greatest(F.size(state["runs"]) - 1, F.lit(0))), run(last["at"], last["chapter"], last["section"], F.concat(last["text"], F.lit("\n"), x), last["kept"]))
        mark = new_chapter.isNotNull() | new_section.isNotNull() | (F.size(state["runs"]) == 0)
        return F.struct((state["at"] + F.length(x) + 1).cast("long").alias("at"), now.alias("chapter"), F.when(mark, opened).otherwise(longer).alias("runs"))

    runs = lines.select("doc", "pages", F.posexplode(F.aggregate("l", begin, step, lambda s: s["runs"])).alias("run", "r")).where("r.kept")
    windows = runs.select("doc", "pages", "run", "r.chapter", "r.section", F.col("r.at").alias("base"), "r.text", F.inline(_windows(F.col("r.text"), size, overlap)))
    piece = F.substring(F.col("text"), F.col("from") + 1, F.col("upto") - F.col("from"))
    cut = windows.withColumns({"chunk": F.regexp_replace(piece, r"^\s+|\s+$", ""), "at": F.col("base") + F.col("from"), "_end": F.col("base") + F.col("upto")}).where(F.length("chunk") >= least)
    on = F.filter("pages", lambda p: (p["at"] < F.col("_end")) & (p["end"] > F.col("at")))
    rows = cut.withColumns({"first_page": F.array_min(F.transform(on, lambda p: p["page"])), "last_page": F.array_max(F.transform(on, lambda p: p["page"]))})
    label = F.concat_ws(" · ", F.concat(F.lit("doc "), F.col("doc").cast("string")), F.concat(F.lit("section "), "section"), F.concat(F.lit("p. "), F.col("first_page").cast("string")))
    place = F.row_number().over(W.partitionBy("doc").orderBy("at")).cast("long")
    return rows.select("doc", place.alias("place"), "chapter", "section", "at", "first_page", "last_page", "chunk", label.alias("label"))


def _windows(text: Column, size: int, overlap: int) -> Column:
    """(from, upto) of the windows of a text; a fold, as each start depends on where the last window was cut."""
    n, step = F.length(text), max(1, size - overlap)
    most = F.sequence(F.lit(0), F.floor(n / F.lit(step)).cast("int"))  # no more windows than that
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,upto:int>>").alias("out"))

    def fold(state: Column, _: Column) -> Column:
        at = state["at"]
        piece = F.substring(text, at + 1, F.lit(size))
        last = F.lit(size) - F.instr(F.reverse(piece), "\n")  # place of the last line break, size if there is none
        cut = F.when((at + size < n) & (F.instr(piece, "\n") > 0) & (last > size // 2), last).otherwise(F.length(piece))
        row = F.struct(at.cast("int").alias("from"), (at + cut).cast("int").alias("upto"))
        more = (at < n) | (F.size(state["out"]) == 0)
        return F.when(more, F.struct((at + F.greatest(F.lit(step), cut - overlap)).cast("int").alias("at"), F.array_append(state["out"], row).alias("out"))).otherwise(state)

    whole = F.array(F.struct(F.lit(0).alias("from"), n.cast("int").alias("upto")))
    return F.when(n <= size, whole).otherwise(F.aggregate(most, start, fold, lambda s: s["out"]))


def reduced(pages: DataFrame, keywords: Sequence[str], budget: int = 14_000, short: int = 1800, first: int = 6, near: int = 1, head: float = 0.72) -> DataFrame:
    """(doc, reduced, original, chosen): a document's pages (doc, page, text) reduced to a budget of characters.

    Short pages stay whole.  Of others the first lines stay and those with a keyword, with their neighbours.  What is still
    over the budget keeps its head and tail around a mark, which counts, so that the result is never over the budget.
    Pages without text are left out; each has a line with its number.
    """
    page = pages.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("t", F.regexp_replace("text", r"^\s+|\s+$", ""))
    lines = F.filter(F.transform(F.split("t", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    hit = lambda x: F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(F.lower(x), k))
    page = page.withColumn("l", lines).withColumn("h", F.transform("l", hit))
    around = lambda i: F.exists(F.slice("h", F.greatest(i + 1 - near, F.lit(1)), F.least(i + 1 + near, F.size("h")) - F.greatest(i + 1 - near, F.lit(1)) + 1), lambda h: h)
    chosen = F.filter("l", lambda x, i: (i < first) | around(i))
    short_ = F.length("t") <= short
    page = page.select("doc", "page", F.length("text").alias("n"), F.when(short_, F.size("l")).otherwise(F.size(chosen)).alias("lines"), F.concat(F.lit("[page "), F.col("page").cast("string"), F.lit("]\n"), F.when(short_, F.col("t")).otherwise(F.array_join(chosen, "\n"))).alias("block"))
    # A document's blocks meet in one row only as far as the budget's head and tail can reach.
    size = F.length("block") + 2
    order = W.partitionBy("doc").orderBy("page", "block")
    page = page.withColumns({"before": F.sum(size).over(order.rowsBetween(W.unboundedPreceding, 0)) - size, "whole": F.sum(size).over(W.partitionBy("doc"))})
    reach = (F.col("before") < budget) | (F.col("before") + size > F.col("whole") - budget)
    kept = page.groupBy("doc").agg(F.sum("n").alias("original"), F.sum("lines").alias("chosen"), F.max("whole").alias("whole"), F.array_sort(F.collect_list(F.when(reach, F.struct("page", "block")))).alias("b"))
    text = F.array_join(F.transform("b", lambda x: x["block"]), "\n\n")
    mark = "\n\n[... reduced ...]\n\n"
    room = budget - len(mark)
    at_head, at_tail = int(room * head), room - int(room * head)
    cut = F.concat(F.regexp_replace(F.substring(text, 1, at_head), r"\s+$", ""), F.lit(mark), F.regexp_replace(F.right(text, F.lit(at_tail)), r"^\s+", ""))
    return kept.select("doc", F.when(F.col("whole") - 2 > budget, cut).otherwise(text).alias("reduced"), "original", "chosen")
