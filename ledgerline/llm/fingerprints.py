"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, subtracted and peeled by built-in functions.

A sketch has three tables of q cells.  Every distinct paragraph digest is put into one cell of each table: the cell's
count grows by one, its key and check take the exclusive or of the digest and of the digest's hash.  The difference of
two sketches of one size holds only the paragraphs that the texts don't share; peeling takes out, round after round,
the digests of cells that hold just one.  If cells are left over, larger sketches of both texts are made.  Texts of many
paragraphs are compared part by part: the digests are dealt to groups by their first bits, so the work grows with their
number and not with that of cells times paragraphs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerline.llm.common import text_or_empty

#: Cells of each table, from the sketch that is the fingerprint to the largest that is tried for a group of digests.
SIZES = (8, 32, 128)
ROUNDS = 30
#: Digests of a group, about, and the most bits that tell groups apart.
GROUP, GROUP_BITS = 8, 40


def paragraphs(text: Column) -> Column:
    """A text's paragraphs: its lines; those of over 400 characters are cut at ends of sentences past 200 characters.

    Where there is none within 400 characters the line is cut there.  Blank ends do not count; empty ones are dropped.
    """

    def short(line: Column) -> Column:
        cut = F.split(F.regexp_replace(line, "(.{200,399}?[.!?|] |.{400})", "$1\n"), "\n")
        return F.when(F.length(line) > 400, cut).otherwise(F.array(line))

    lines = F.flatten(F.transform(F.split(text, "\n"), short))
    return F.filter(F.transform(lines, lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def digests(text: Column) -> Column:
    """Sorted distinct 64-bit digests of the paragraphs."""
    return F.array_sort(F.array_distinct(F.transform(paragraphs(text), lambda s: F.xxhash64(s))))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _placed(keys: Column, table: int, q: int, count: Callable[[Column], Column], key: Callable[[Column], Column]) -> Column:
    """(p, c, k, h) of each element: its cell in a table and what it adds there."""
    place = lambda x: F.pmod(F.shiftrightunsigned(key(x), 21 * table), F.lit(q)).cast("int")
    return F.transform(keys, lambda x: F.struct(place(x).alias("p"), count(x).alias("c"), key(x).alias("k"), F.xxhash64(key(x)).alias("h")))


def _fold(cell: Column, placed: Column, i: Column, sign: int) -> Column:
    """A cell with the elements placed there added or taken away."""
    own = F.filter(placed, lambda x: x["p"] == i)
    return F.aggregate(own, cell, lambda a, x: F.struct((a["c"] + sign * x["c"]).alias("c"), a["k"].bitwiseXOR(x["k"]).alias("k"), a["h"].bitwiseXOR(x["h"]).alias("h")))


def sketch(found: Column, q: int) -> list[Column]:
    """The three tables of an array of digests."""
    empty = F.struct(F.lit(0).alias("c"), F.lit(0).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("h"))
    cells = F.sequence(F.lit(0), F.lit(q - 1))
    tables = []
    for j in range(3):
        placed = _placed(found, j, q, lambda x: F.lit(1), lambda x: x)
        tables.append(_let(placed, lambda own: F.transform(cells, lambda i: _fold(empty, own, i, 1))))
    return tables


def subtract(one: list[Column], other: list[Column]) -> list[Column]:
    return [F.zip_with(a, b, lambda x, y: F.struct((x["c"] - y["c"]).alias("c"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h"))) for a, b in zip(one, other, strict=True)]


def peel(tables: list[Column], q: int, rounds: int = ROUNDS) -> Column:
    """The digests in the difference of two sketches: structs (k, c), c being 1 or -1; null if cells are left over."""
    names = ("t0", "t1", "t2")
    start = F.struct(*[t.alias(n) for t, n in zip(tables, names, strict=True)], F.array().cast("array<struct<k:bigint,c:int>>").alias("found"), F.lit(True).alias("more"))

    def step(state: Column, _: Column) -> Column:
        alone = F.concat(*[F.filter(state[n], lambda x: (F.abs(x["c"]) == 1) & (F.xxhash64(x["k"]) == x["h"])) for n in names])
        once = F.array_distinct(F.transform(alone, lambda x: F.struct(x["k"].alias("k"), x["c"].alias("c"))))

        def without(pure: Column) -> Column:
            left = []
            for j, n in enumerate(names):
                placed = _placed(pure, j, q, lambda x: x["c"], lambda x: x["k"])
                left.append(_taken(state[n], placed))
            return F.struct(*[t.alias(n) for t, n in zip(left, names, strict=True)], F.concat(state["found"], pure).alias("found"), (F.size(pure) > 0).alias("more"))

        return F.when(state["more"], _let(once, without)).otherwise(state)

    def result(state: Column) -> Column:
        empty = F.lit(True)
        for n in names:
            empty = empty & ~F.exists(state[n], lambda x: (x["c"] != 0) | (x["k"] != 0))
        return F.when(empty, state["found"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, result)


def _taken(table: Column, placed: Column) -> Column:
    return _let(placed, lambda own: F.transform(table, lambda x, i: _fold(x, own, i, -1)))


def _tried(one: Column, other: Column, sizes: tuple[int, ...]) -> Column:
    """The number of digests that just one of two short arrays has, by sketches of rising size.

    A size is passed over if the arrays' lengths alone differ by more than it can hold.  Should even the largest leave
    cells over, the arrays are compared themselves.
    """
    tries = []
    for q in sizes:
        fits = F.abs(F.size(one) - F.size(other)) <= int(3 * q * 0.8)
        tries.append(F.when(fits, F.array_size(peel(subtract(sketch(one, q), sketch(other, q)), q))))
    exact = F.size(F.array_except(one, other)) + F.size(F.array_except(other, one))
    return F.coalesce(*tries, exact)


def groups(one: Column, other: Column) -> Column:
    """Structs (one, other) of the digests of two sorted arrays that have the same first bits, about GROUP in each."""
    bits = F.least(F.greatest(F.ceil(F.log2(F.greatest(F.size(one), F.size(other), F.lit(1)) / F.lit(float(GROUP)))), F.lit(0)), F.lit(GROUP_BITS)).cast("int")
    tagged = F.array_sort(F.concat(F.transform(one, lambda x: F.struct(x.alias("k"), F.lit(1).alias("c"))), F.transform(other, lambda x: F.struct(x.alias("k"), F.lit(-1).alias("c")))))

    def own(part: Column, sign: int) -> Column:
        return F.transform(F.filter(part, lambda x: x["c"] == sign), lambda x: x["k"])

    def divided(all_: Column) -> Column:
        """Sorted digests of one group stand together, so a group is a slice from where the first bits change."""
        return _let(F.transform(all_["t"], lambda x: F.call_function("shiftrightunsigned", x["k"], all_["s"])), lambda g: _let(
            F.filter(F.sequence(F.lit(1), F.size(g)), lambda i: (i == 1) | (F.get(g, i - 1) != F.get(g, i - 2))),
            lambda at: F.transform(at, lambda start, k: F.slice(all_["t"], start, F.coalesce(F.get(at, k + 1), F.size(g) + 1) - start)),
        ))

    parts = F.when(F.size(tagged) == 0, F.array().cast("array<array<struct<k:bigint,c:int>>>")).otherwise(F.when(bits == 0, F.array(tagged)).otherwise(_let(F.struct(tagged.alias("t"), (F.lit(64) - bits).alias("s")), divided)))
    return F.transform(parts, lambda x: F.struct(own(x, 1).alias("one"), own(x, -1).alias("other")))


def difference(one: Column, other: Column, sizes: tuple[int, ...] = SIZES) -> Column:
    """The number of digests that just one of two sorted arrays has, group by group."""
    many = F.aggregate(groups(one, other), F.lit(0), lambda total, g: total + _tried(g["one"], g["other"], sizes))
    return F.when((F.size(one) <= GROUP) & (F.size(other) <= GROUP), _tried(one, other, sizes)).otherwise(many)


def likeness(one: Column, other: Column, sizes: tuple[int, ...] = SIZES) -> Column:
    """Shared paragraphs as a share of all of two arrays of digests; 1 if both are empty."""
    n = F.size(one) + F.size(other)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.element_at(F.transform(F.array(difference(one, other, sizes)), lambda d: (n - d) / (n + d)), 1)).cast("double")


def fingerprint(found: Column, q: int = SIZES[0]) -> Column:
    """The number of digests and the cells (count, key, check) of the smallest sketch, as text: enough to subtract and peel."""
    cells = F.concat(*sketch(found, q))
    return F.concat_ws(";", F.size(found).cast("string"), F.transform(cells, lambda x: F.concat_ws(":", F.hex(x["c"]), F.hex(x["k"]), F.hex(x["h"]))))


def with_next(docs: DataFrame, rows_at_once: int = 2000, most_ranges: int = 10_000, hot_share: float = 0.001, hot_parts: int = 1024) -> DataFrame:
    """Adds next_text, the text of the row after it in descending doc_id (of the first after the last row).

    Rows are dealt to ranges of doc_id, sorted within each, and a range's last row takes the first text of the next
    range, of which there is one a range; so no task sees all rows.  Null doc_ids come last.  Rows of one doc_id are in
    order of a hash of the text, then of the text; a doc_id (or null) that has over a hot_share of the rows is a range of
    its own and is cut by that hash.  Beyond rows_at_once times most_ranges rows the ranges grow; they are sorted, which
    spills, and never gathered.
    """
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).withColumn("k", F.xxhash64("text"))
    n = rows.count()
    ranges = max(1, min(most_ranges, math.ceil(n / rows_at_once)))
    marks = rows.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)] or [0.5], 20 * ranges)).first()[0] or []
    # at most 1 / hot_share of them
    hot = [r[0] for r in rows.groupBy("doc_id").agg(F.count("*").alias("rows")).where(F.col("rows") > max(rows_at_once, n * hot_share)).collect()]
    named = [x for x in hot if x is not None]
    bounds = sorted({*(marks if ranges > 1 else []), *named, *(x + 1 for x in named if x < (1 << 63) - 1)})
    # the position among the bounds, by halving: a literal array is searched in about log2 steps
    at = _search(F.col("doc_id"), bounds)
    cut_up = F.col("doc_id").isin(named) if named else F.lit(False)
    if None in hot:
        cut_up = F.coalesce(cut_up, F.lit(True)) if named else F.col("doc_id").isNull()
    part = F.when(cut_up, F.floor((F.col("k") / float(1 << 64) + 0.5) * hot_parts).cast("int")).otherwise(0)
    ranged = rows.withColumn("range", F.struct((-F.when(F.col("doc_id").isNull(), -1).otherwise(at)).alias("r"), part.alias("p")))
    over = W.partitionBy("range").orderBy(F.col("doc_id").desc_nulls_last(), "k", "text")
    led = ranged.withColumns({"follows": F.lead("text").over(over), "last": F.lead(F.lit(1)).over(over).isNull()})
    heads = ranged.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.bitwise_not("doc_id").alias("down"), "k", "text")).alias("first")).select("range", F.col("first.text").alias("head"))
    numbers = ranged.select("range").distinct()  # two numbers a range; the texts stay where they are
    ring = numbers.select("range", F.lead("range").over(W.orderBy("range")).alias("following")).crossJoin(F.broadcast(numbers.agg(F.min("range").alias("least"))))
    after = F.broadcast(ring.select("range", F.coalesce("following", "least").alias("following")))
    firsts = heads.withColumnRenamed("range", "following").join(after, "following").select("range", F.col("head").alias("after"))
    return led.join(firsts, "range").select("doc_id", "text", F.when(F.col("last"), F.col("after")).otherwise(F.col("follows")).alias("next_text"))


def _search(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most value."""
    if not bounds:
        return F.lit(0)
    middle = len(bounds) // 2
    return F.when(value < bounds[middle], _search(value, bounds[:middle])).otherwise(F.lit(middle + 1) + _search(value, bounds[middle + 1 :]))


def compare(docs: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """Per row: its fingerprint, that of its edited text, and the likenesses of its own to the edited and next one's.

    The edited text has the last half (rounded down) of the code points replaced by the first as many of the next
    row's text.  Null texts count as empty; an empty text has no paragraphs, and two of them are alike.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    rows = with_next(docs).withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("text")).alias("own"), digests(F.col("edited")).alias("changed"), digests(F.col("next_text")).alias("next"))
    own, changed, following = F.col("own"), F.col("changed"), F.col("next")
    return rows.select("doc_id", "n_chars", "edited_sha256", fingerprint(own).alias("fingerprint"), fingerprint(changed).alias("edited_fingerprint"), likeness(own, changed, sizes).alias("near_edited"), likeness(own, following, sizes).alias("near_next"))
