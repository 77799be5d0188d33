"""Exact percentiles of any number of columns and groups, without one buffer that holds all values.

Distinct values are counted, the counts are added up range by range in the order of group, column and value, and the
values at the wanted places are picked.  Between two values the result is interpolated.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.windows import running_sum


def quantiles(df: DataFrame, columns: Mapping[str, Column | str] | Sequence[str], points: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, name, n, distinct, usual, q): per group and column the number of its values that are not null, of distinct ones,
    the most frequent (the least of equals), and their percentiles, an array as long as points.

    A column without a value in a group has no row.
    """
    named = columns if isinstance(columns, Mapping) else {c: c for c in columns}
    each = [F.struct(F.lit(n).alias("name"), (F.col(v) if isinstance(v, str) else v).cast("double").alias("_v")) for n, v in named.items()]
    long = df.select(*by, F.explode(F.array(*each)).alias("_x")).select(*by, "_x.*").where("_v is not null")
    counts = long.groupBy(*by, "name", "_v").agg(F.count("*").alias("_n"))
    upto = running_sum(counts, [*by, "name", "_v"], "_n", "_upto", 1_000_000)
    sizes = upto.groupBy(F.struct(*by, "name").alias("_g")).agg(F.min(F.col("_upto") - F.col("_n")).alias("_base"), F.max("_upto").alias("_end"))
    rows = upto.withColumn("_h", F.struct(*by, "name")).join(sizes, F.col("_g") == F.col("_h"))
    n, last = F.col("_end") - F.col("_base"), F.col("_upto") - F.col("_base")

    def at(place: Column) -> Column:
        return F.max(F.when((last > place) & (last - F.col("_n") <= place), F.col("_v")))

    picked = [x for p in points for pos in (p * (n - 1),) for x in (at(F.floor(pos)), at(F.ceil(pos)))]
    out = rows.groupBy("_g").agg(F.max(n).alias("n"), F.count("*").alias("distinct"), F.max_by("_v", F.struct("_n", -F.col("_v"))).alias("usual"), F.array(*picked).alias("_p"))
    place = [p * (F.col("n") - 1) for p in points]
    mixed = [F.when(F.col("_p")[2 * k] == F.col("_p")[2 * k + 1], F.col("_p")[2 * k]).otherwise((F.ceil(x) - x) * F.col("_p")[2 * k] + (x - F.floor(x)) * F.col("_p")[2 * k + 1]) for k, x in enumerate(place)]
    return out.select("_g.*", "n", "distinct", "usual", F.array(*mixed).alias("q"))


def medians(df: DataFrame, columns: Mapping[str, Column | str] | Sequence[str], by: Sequence[str], digits: int | None = 6) -> DataFrame:
    """The groups with the median of each column, null where a group has no value."""
    found = quantiles(df, columns, [0.5], by)
    middle = lambda name: F.max(F.when(F.col("name") == name, F.col("q")[0]))
    wide = found.groupBy(*by).agg(*[(F.round(middle(c), digits) if digits is not None else middle(c)).alias(c) for c in columns])
    empty = df.select(*by).distinct()
    return empty.join(wide.select(F.struct(*by).alias("_g"), *columns), F.struct(*by) == F.col("_g"), "left").drop("_g") if by else wide


def row_of(df: DataFrame, columns: Mapping[str, Column | str] | Sequence[str], points: Sequence[float], prefix: str = "") -> DataFrame:
    """One row with an array of percentiles for each column, named with a prefix; null for a column without values."""
    found = quantiles(df, columns, points)
    return found.agg(*[F.max_by("q", F.when(F.col("name") == c, F.col("n"))).alias(f"{prefix}{c}") for c in columns])
