"""Row-wise operators on a whole table: choice and naming of columns, row numbers, filled features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df, if it has all the columns; else an error that names those it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}; there are: {', '.join(df.columns)}")
    return df


def scan(df: DataFrame, columns: Sequence[str], max_rows: int | None = None, order: str | None = None) -> DataFrame:
    """Chosen columns and, where a cap is asked for, that many rows (the first by order)."""
    out = require(df, columns).select(*columns)
    if max_rows is None:
        return out
    return (out.orderBy(order) if order else out).limit(max_rows)


def renamed(df: DataFrame, names: Mapping[str, str], origin: str) -> tuple[DataFrame, list[str]]:
    """The columns of the dictionary that exist, renamed, with the name of the source; and those that do not exist."""
    there = [c for c in names if c in df.columns]
    return df.select(*[F.col(c).alias(names[c]) for c in there], F.lit(origin).alias("origin")), [c for c in names if c not in there]


def range_of(df: DataFrame, order: Sequence[str], rows_at_once: int = 100_000, most_ranges: int = 4096) -> Column:
    """The number of a row's range in the order of the columns (nulls first); ranges hold about rows_at_once rows.

    The bounds come from a small sample and are constants of the plan, so every use of the column agrees.
    """
    n = df.count()
    ranges = min(most_ranges, -(-n // rows_at_once))
    if ranges < 2:
        return F.lit(0)
    keys = df.select(F.struct(*order).alias("k"))
    sample = keys.sample(fraction=min(1.0, 20 * ranges / n), seed=1).orderBy("k").collect()
    kinds = [df.schema[c].dataType for c in order]
    bounds = [sample[len(sample) * i // ranges]["k"] for i in range(1, ranges)] if sample else []
    literal = [F.struct(*[F.lit(v).cast(kind).alias(c) for v, kind, c in zip(b, kinds, order, strict=True)]) for b in dict.fromkeys(bounds)]

    def search(some: list[Column]) -> Column:
        if not some:
            return F.lit(0)
        middle = len(some) // 2
        return F.when(F.struct(*order) < some[middle], search(some[:middle])).otherwise(F.lit(middle + 1) + search(some[middle + 1 :]))

    return search(literal)


def add_row_id(df: DataFrame, name: str, order: Sequence[str], start: int = 1) -> DataFrame:
    """Dense numbers in the order of the given columns, which must tell rows apart.

    Rows are dealt to ranges of the order; each range counts its own rows, and only the counts of ranges are added up
    in one place, so no task sees all rows.
    """
    ranged = df.withColumn("_range", range_of(df, order))
    within = W.partitionBy("_range").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = ranged.withColumn("_within", F.row_number().over(within)).join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range")
    return numbered.withColumn(name, (F.col("_before") + F.col("_within") + start - 1).cast("long")).drop("_range", "_within", "_before")


def rescale(df: DataFrame, source: str, target: str, start: int, length: int) -> DataFrame:
    """A column stretched from its observed range onto start .. start + length, in whole numbers."""
    bounds = df.agg(F.min(source).alias("_lo"), F.max(source).alias("_hi"))
    share = (F.col(source) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0)).cast("double")
    return df.crossJoin(F.broadcast(bounds)).withColumn(target, F.lit(start) + F.floor(share * length)).drop("_lo", "_hi")


def prefix_block(df: DataFrame, prefix: str, keep: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in keep else prefix + c) for c in df.columns])


def select_block(df: DataFrame, keep: Sequence[str] = (), prefixes: Sequence[str] = (), forbidden: Sequence[str] = ()) -> DataFrame:
    """The kept columns and those of the prefixes, without the forbidden ones."""
    return df.select(*[c for c in df.columns if c not in forbidden and (c in keep or any(c.startswith(p) for p in prefixes))])


def filled_from(defaults: Mapping[str, float], measured: Mapping[str, Column]) -> tuple[dict[str, Column], Column]:
    """Measured features with defaults in place of nulls, and the array of names that were filled."""
    values = {n: F.coalesce(c, F.lit(defaults[n])) for n, c in measured.items()}
    return values, F.array_compact(F.array(*[F.when(c.isNull(), F.lit(n)) for n, c in measured.items()]))


def conform_to(df: DataFrame, template: Mapping[str, str]) -> DataFrame:
    """The template's columns in its order and types; those that df lacks are null."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in template.items()])
