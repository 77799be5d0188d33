"""Near-duplicate join on sets of word n-grams: rare-first prefixes, length, positional and suffix filters.

Two texts link when ``100 * |A & B| >= threshold * |A | B|`` over their sets of distinct n-grams.  The join is exact;
it does not write out the pairs within a group of copies, only enough verified links to connect what is linked.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window as W

from ledgerline.llm.arrays import list_array, shingle_sets, signed, with_end
from ledgerline.llm.common import components, cut, ended, fresh

#: Counters of document frequency (a fixed 4 MB), kept in segments, and bins of the suffix filter.
COUNTER_BITS, SEGMENT_BITS, SUFFIX_BINS = 20, 16, 256
#: Rows of one n-gram that one task compares at the first round, and from which on the second filters within the join.
HOT, LARGE = 4096, 64
#: A text has a word if this is found in it.
WORD = r"[^\x20\x09-\x0D]"
_TOP = np.uint64(64 - COUNTER_BITS)

#: The sorted distinct hashes of each text of a column, each text having a line end behind it.
Sets = Callable[[pa.Array], Iterator[np.ndarray]]


def frequencies(texts_of: DataFrame, sets: Sets) -> np.ndarray:
    """Document frequencies of all n-grams, added up in hashed counters.

    The counters have a fixed size, so their table may be sent to every task.  They only order the n-grams of a
    text: a collision can make a rare one look more frequent, which costs time but never loses a pair.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << COUNTER_BITS, dtype=np.uint32)
        waiting: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for own in sets(batch.column(0)):
                found = own >> _TOP
                waiting.append(found)
                size += len(found)
                if size > 1 << 18:
                    table += np.bincount(np.concatenate(waiting).view(np.int64), minlength=len(table)).astype(np.uint32)
                    waiting, size = [], 0
        if waiting:
            table += np.bincount(np.concatenate(waiting).view(np.int64), minlength=len(table)).astype(np.uint32)
        if table.any():
            parts = table.reshape(-1, 1 << SEGMENT_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts])], names=["segment", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << SEGMENT_BITS, dtype=np.uint64)
        for x in table.column("counts"):
            total += np.frombuffer(zlib.decompress(x.as_py()), dtype=np.uint32)
        total = np.minimum(total, np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return pa.table({"segment": table.column("segment").slice(0, 1), "counts": pa.array([total.tobytes()])})

    kind = "segment int, counts binary"
    rows = texts_of.mapInArrow(count, kind).groupBy("segment").applyInArrow(add, kind).collect()
    table = np.zeros((1 << COUNTER_BITS - SEGMENT_BITS, 1 << SEGMENT_BITS), dtype=np.uint32)
    for r in rows:
        table[r["segment"]] = np.frombuffer(bytes(r["counts"]), dtype=np.uint32)
    return table.reshape(-1)


def _class(found: np.ndarray) -> int:
    """One number for equal sets."""
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def members(docs: DataFrame, sets: Sets, extra: tuple[str, ...] = ()) -> DataFrame:
    """(extra, doc_id, n, cls) of every row; cls is null for an empty set."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names = [], []
            for found in sets(batch.column(batch.num_columns - 1)):
                sizes.append(len(found))
                names.append(_class(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(names, pa.int64())], names=names_out)

    kept = docs.select(*extra, "doc_id", ended().alias("text"))
    names_out = [*kept.columns[:-1], "n", "cls"]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(describe, kind + ", n long, cls long")


def prefixes(texts_of: DataFrame, sets: Sets, counters: object, threshold: int) -> DataFrame:
    """(cls, n, prefix, hot, suffix) of each distinct set: its rarest n-grams, each one's frequency class, and the bins of all."""

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counters.value  # type: ignore[attr-defined]
        usual = 2 * (table.sum(dtype=np.uint64) >> np.uint64(COUNTER_BITS))
        for batch in batches:
            names, sizes, firsts, hots, bins = [], [], [], [], []
            for found in sets(batch.column(0)):
                n = len(found)
                if not n:
                    continue
                often = table[(found >> _TOP).view(np.int64)]
                order = np.lexsort((found, often))[: n - (threshold * n + 99) // 100 + 1]
                names.append(_class(found))
                sizes.append(n)
                firsts.append(signed(found[order]))
                hots.append(((often[order] - np.minimum(often[order], usual)) // HOT).astype(np.int32))
                counts = np.bincount((found & np.uint64(SUFFIX_BINS - 1)).view(np.int64), minlength=SUFFIX_BINS)
                bins.append((counts if counts.max() < 128 else counts[:0]).astype(np.int8))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), list_array(firsts, pa.int64()), list_array(hots, pa.int32()), list_array(bins, pa.int8())], names=["cls", "n", "prefix", "hot", "suffix"])

    return texts_of.mapInArrow(ordered, "cls long, n long, prefix array<long>, hot array<int>, suffix array<tinyint>").dropDuplicates(["cls"])


def _may_link(a: str, b: str, threshold: int) -> Column:
    """Length and positional filter for rows that share an n-gram at places pos of their orders."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    rest = F.least(n - F.col(f"{a}.pos"), m - F.col(f"{b}.pos"))
    return (F.least(n, m) * 100 >= threshold * F.greatest(n, m)) & (rest * (100 + threshold) >= threshold * (n + m))


def _overlap_may_do(one: Column, other: Column, n: Column, threshold: int) -> Column:
    """Suffix filter: two sets of n elements together share no more than their bins do.  Sets too large for bins pass."""
    shared = F.aggregate(F.zip_with(one, other, lambda x, y: F.least(x, y).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    return (F.size(one) == 0) | (F.size(other) == 0) | (shared * (100 + threshold) >= threshold * n)


def _pair(a: str, b: str) -> list[Column]:
    low = F.col(f"{a}.cls") < F.col(f"{b}.cls")
    return [F.when(low, F.col(f"{x}.cls")).otherwise(F.col(f"{y}.cls")).alias(name) for x, y, name in ((a, b, "a"), (b, a, "b"))]


def verified(pairs: DataFrame, items: Callable[[DataFrame], DataFrame], threshold: int, bins: DataFrame | None = None) -> DataFrame:
    """Those of the pairs (a, b) of classes that link: suffix filter on the bins, then the exact sets, once per pair.

    items gives (cls, items), an array of hashes, for the classes of a table that it is called with.
    """
    kept = pairs.distinct()
    if bins is not None:
        left, right = (bins.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("suffix").alias(f"s_{x}")) for x in "ab")
        kept = kept.join(left, "a").join(right, "b").where(_overlap_may_do(F.col("s_a"), F.col("s_b"), F.col("n_a") + F.col("n_b"), threshold)).select("a", "b")
    kept = cut(kept)
    needed = cut(kept.select(F.col("a").alias("cls")).unionByName(kept.select(F.col("b").alias("cls"))).distinct())
    if needed.isEmpty():
        return kept
    found = items(needed).dropDuplicates(["cls"])
    one, two = (found.select(F.col("cls").alias(x), F.col("items").alias(f"i_{x}")) for x in "ab")
    both = F.size(F.array_intersect("i_a", "i_b")).cast("long")
    exact = kept.join(one, "a").join(two, "b").withColumn("both", both)
    return exact.where(F.col("both") * 100 >= threshold * (F.size("i_a") + F.size("i_b") - F.col("both"))).select("a", "b")


def only(rows: DataFrame, needed: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """The rows whose cls is in needed: by broadcast if its size is small, else by a shuffled join."""
    return rows.join(F.broadcast(needed) if needed.count() <= broadcast_rows else needed, "cls", "left_semi")


FIELDS = ("cls", "n", "pos")
Extra = Callable[[str, str], Column]


def _across(rows: DataFrame, threshold: int, fields: tuple[str, ...] = FIELDS, extra: Extra | None = None) -> DataFrame:
    """Pairs (a, b) of different roots that share a key: each class outside of its largest root, with all others.

    With a field keys, all keys of a row, a pair comes from the least of the keys that both have.
    """
    with_bins = "suffix" in rows.columns
    columns = [*fields, "root", "out", *["suffix"] * with_bins]
    me = rows.where("out").select("h", F.struct(*columns).alias("me"))
    other = rows.select("h", F.struct(*columns).alias("with"))
    apart = (F.col("me.root") != F.col("with.root")) & (~F.col("with.out") | (F.col("me.cls") < F.col("with.cls"))) & _may_link("me", "with", threshold)
    if extra is not None:
        apart = apart & extra("me", "with")
    if "keys" in fields:
        apart = F.when(apart, F.array_min(F.array_intersect("me.keys", "with.keys")) == F.col("h")).otherwise(False)
    if with_bins:
        apart = F.when(apart, _overlap_may_do(F.col("me.suffix"), F.col("with.suffix"), F.col("me.n") + F.col("with.n"), threshold)).otherwise(False)
    return me.withColumnRenamed("h", "_h").join(other, (F.col("_h") == F.col("h")) & apart).select(*_pair("me", "with"))


ORDER = ("pos", "n", "cls")


def neighbours(every: DataFrame, fields: tuple[str, ...] = FIELDS, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Rows (h, salt, cls, n, pos) that share their key h, each with the previous and the first of its (h, salt)."""
    row = F.struct(*fields)
    group = W.partitionBy("h", "salt").orderBy(*order)
    near = every.withColumns({"before": F.lag(row).over(group), "first": F.first(row).over(group), "next": F.lead("cls").over(group)})
    # Of a key that only one class has nothing is kept; one in a salted share may have others elsewhere.
    return near.withColumn("me", row).where("before is not null or next is not null or salt >= 0").select("h", "salt", "me", "before", "first")


def connect(near: DataFrame, check: Callable[[DataFrame], DataFrame], threshold: int, bins: DataFrame | None = None, rows: DataFrame | None = None, fields: tuple[str, ...] = FIELDS, extra: Extra | None = None, order: tuple[str, ...] = ORDER) -> DataFrame:
    """(node, root) of all classes that link with another, from the rows of neighbours, which are in the same order.

    rows are those of near by themselves, where there is a table of them, and may have all keys of each.  extra is one more filter on two rows.

    A first round compares every class with the first and the previous of its key in order of place (of a salted
    share of them where the key is frequent; the shares' first ones are then compared).  The class with the fewest
    rarer n-grams is the likeliest centre of a group of edited copies.  What the round connects is contracted.  A
    second round compares all remaining pairs that share a key and whose components differ, so no pair is dropped
    and none within a connected group is written out.
    """
    row = F.struct(*fields)
    filters = _may_link("me", "with", threshold) & (extra("me", "with") if extra else F.lit(True))
    heads = near.where("before is null and salt >= 0").select("h", "me.*")
    over = W.partitionBy("h").orderBy(*order)
    heads = heads.withColumns({"me": row, "before": F.lag(row).over(over), "first": F.first(row).over(over)})
    star = near.select("me", "before", "first").unionByName(heads.select("me", "before", "first"))
    pairs = star.select("me", F.explode(F.array("before", "first")).alias("with")).where("with.cls <> me.cls").where(filters).select(*_pair("me", "with"))
    roots = cut(components(cut(check(pairs))))

    if rows is not None and "keys" in rows.columns:
        fields = (*fields, "keys")
    rows = (near.select("h", "me.*") if rows is None else rows.select("h", *fields)).join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    rows = cut(rows)
    sizes = rows.groupBy("h", "root").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("h").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.count("*").alias("roots"), F.sum("k").alias("k")).where("roots > 1").select("h", "main", (F.col("k") > LARGE).alias("large"))
    rows = rows.join(largest, "h").withColumn("out", F.col("root") != F.col("main"))
    if bins is None:
        more = _across(rows, threshold, fields, extra)
    else:
        more = _across(rows.where("not large"), threshold).unionByName(_across(rows.where("large").join(bins.select("cls", "suffix"), "cls"), threshold))
    more = cut(check(more))
    if more.isEmpty():
        return roots
    return tied_roots(roots, more.select(F.col("a").alias("cls"), F.col("b").alias("low")))


def links(docs: DataFrame, n: int = 5, threshold: int = 75) -> tuple[DataFrame, DataFrame]:
    """(members, roots): each row's class of equal sets, and the component of each class that links with another."""

    def sets(column: pa.Array) -> Iterator[np.ndarray]:
        return shingle_sets(column, n)

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for x in sets(batch.column(0)) if len(x)]
            yield pa.RecordBatch.from_arrays([pa.array([_class(x) for x in found], pa.int64()), list_array([signed(x) for x in found], pa.int64())], names=["cls", "items"])

    texts_of = docs.select(ended().alias("text"))
    counters = docs.sparkSession.sparkContext.broadcast(frequencies(texts_of, sets))
    classes = cut(prefixes(texts_of, sets, counters, threshold))
    every = classes.select("cls", "n", F.posexplode(F.arrays_zip("prefix", "hot")).alias("pos", "x"))
    every = every.select(F.col("x.prefix").alias("h"), "cls", "n", F.col("pos").cast("int"), F.when(F.col("x.hot") > 0, F.pmod("cls", F.col("x.hot") + 1)).otherwise(-1).cast("int").alias("salt"))
    bins = classes.select("cls", "n", "suffix")
    roots = connect(
        cut(neighbours(every)),
        lambda pairs: verified(pairs, lambda needed: only(texts_of.mapInArrow(with_sets, "cls long, items array<long>"), needed), threshold, bins),
        threshold, bins,
    )
    return members(docs, sets), roots


def near_duplicates(docs: DataFrame, n: int = 5, threshold: int = 75) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest doc_id reachable by links (its own if none).

    A null or wordless text has no n-grams and links with nothing.  Texts of fewer than n words are one n-gram.  Equal
    sets link however many rows have them.  Rows that share a doc_id are texts of one node, so what any of them links
    with is in the component of all.  Rows whose doc_id is null take part and pass on links; only the doc_ids that are
    not null can be a component's.
    """
    found, roots = links(docs.select("doc_id", "text"), n, threshold)
    found = cut(found)
    repeated = cut(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("cls").alias("low"), F.max("cls").alias("high")).where("rows > 1"))
    tied = cut(found.where("cls is not null").join(repeated.where("low <> high").select("doc_id", "low"), "doc_id").where("cls <> low").select("cls", "low").distinct())
    if not tied.isEmpty():
        roots = tied_roots(roots, tied)
    each = found.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"))
    tops = each.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    tops = cut(tops.join(tops.groupBy("root").agg(F.min("least").alias("component")), "root").select("cls", "component"))
    rows = found.join(tops, "cls", "left").withColumn("component", F.coalesce("component", "doc_id"))
    if not repeated.isEmpty():  # a row without words goes with the other rows of its doc_id
        least = rows.join(repeated.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component").alias("least"))
        rows = rows.join(least, "doc_id", "left").withColumn("component", F.coalesce("least", "component"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def tied_roots(roots: DataFrame, ties: DataFrame) -> DataFrame:
    """(node, root) with further ties (cls, low) between classes taken in."""
    top = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"r_{name}"))
    pairs = ties.join(top("cls"), "cls", "left").join(top("low"), "low", "left").select(F.coalesce("r_cls", "cls").alias("a"), F.coalesce("r_low", "low").alias("b"))
    upper = cut(components(pairs))
    below = roots.join(upper.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return cut(below.unionByName(upper.select("node", "root").join(roots.select("node"), "node", "left_anti")))


def keep_one(docs: DataFrame, n: int = 5, threshold: int = 75) -> DataFrame:
    """docs with one row of each group of linked texts: that of its smallest doc_id, nulls being the largest.  All columns stay.

    Here a row is a text by itself, whatever doc_id it has, so rows of one doc_id with unlike texts all stay.  Of rows
    with one doc_id and equal sets any one stays.  Null and wordless texts are like nothing and all stay.
    """
    found, roots = links(docs.select("doc_id", "text"), n, threshold)
    rows = found.where("cls is not null").groupBy("cls", "doc_id").agg(F.count("*").alias("rows"))
    rows = rows.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "cls", "rows")).alias("f"))
    cls, doc, count = (fresh(docs, x) for x in ("cls", "kept_doc_id", "rows"))
    first = cut(first.select(F.col("f.cls").alias(f"{cls}_kept"), F.col("f.doc_id").alias(doc), F.col("f.rows").alias(count)))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [_class(x) if len(x) else None for x in shingle_sets(with_end(batch.column(place)), n)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.int64())], names=[*batch.schema.names, cls])

    place = docs.columns.index("text")
    named = docs.mapInArrow(name, StructType([*docs.schema.fields, StructField(cls, LongType())]))
    kept = named.where(F.col(cls).isNotNull()).join(first, (F.col(cls) == F.col(f"{cls}_kept")) & F.col("doc_id").eqNullSafe(F.col(doc)))
    if first.where(F.col(count) > 1).isEmpty():
        one = kept
    else:
        one = kept.where(F.col(count) == 1).unionByName(kept.where(F.col(count) > 1).dropDuplicates(["doc_id", cls]))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return one.select(*columns).unionByName(docs.where(~F.col("text").rlike(WORD) | F.col("text").isNull()))
