"""Window operators: ranks, panels, versions, cap tables.  Ranks over a whole table go range by range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerline.functions import null_if_zero
from ledgerline.operators.rows import add_row_id, range_of


def running_sum(df: DataFrame, order: Sequence[str], value: str, name: str, rows_at_once: int = 100_000) -> DataFrame:
    """The sum of a value up to and with each row in the order of columns that tell rows apart."""
    ranged = df.withColumn("_range", range_of(df, order, rows_at_once))
    totals = ranged.groupBy("_range").agg(F.sum(value).alias("_total"))
    before = F.coalesce(F.sum("_total").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.sum(value).over(W.partitionBy("_range").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(W.unboundedPreceding, 0))
    return ranged.withColumn(name, within).join(F.broadcast(totals.select("_range", before.alias("_before"))), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """The rank of a value from 1, ties sharing their mean; null for null.

    Only distinct values are ranked, with their counts, and joined back.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    ranks = running_sum(counts, ["_v"], "_n", "_upto").select("_v", (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))
    return df.join(ranks, F.col(value) == F.col("_v"), "left").drop("_v")


def percentile_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Average rank as a share of the values that are not null."""
    n = df.agg(F.count(value).alias("_all"))
    return average_rank(df, value, name).crossJoin(F.broadcast(n)).withColumn(name, F.col(name) / null_if_zero("_all")).drop("_all")


def percent_rank_first(df: DataFrame, value: str, tie: str, name: str) -> DataFrame:
    """Row number by value, ties by another column, as a share of all rows that have a value."""
    there = add_row_id(df.where(F.col(value).isNotNull()), "_i", [value, tie])
    n = df.agg(F.count(value).alias("_all"))
    out = there.crossJoin(F.broadcast(n)).withColumn(name, F.col("_i") / F.col("_all")).drop("_i", "_all")
    return out.unionByName(df.where(F.col(value).isNull()).withColumn(name, F.lit(None).cast("double")))


def quantile_bucket(rank: Column, n: int) -> Column:
    return F.coalesce(F.least(F.greatest(F.ceil(F.round(rank * n, 9)), F.lit(1)), F.lit(n)), F.lit(1)).cast("long")


def winsorize(df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Columns bounded by their percentiles, all found together."""
    from ledgerline.operators.quantiles import row_of

    bounds = row_of(df, columns, [low, high], "_b_")
    out = df.crossJoin(F.broadcast(bounds))
    for c in columns:
        b = F.col(f"_b_{c}")
        out = out.withColumn(c, F.when(F.col(c).isNotNull(), F.greatest(b[0], F.least(b[1], F.col(c)))))
    return out.drop(*[f"_b_{c}" for c in columns])


def scd2_from_changes(df: DataFrame, key: str, at: str, value: str, order: str) -> DataFrame:
    """Versions of a value: (key, value, valid_from, valid_to, is_current); one ends the day before the next begins.

    Of several values on a day the last one by order counts.
    """
    run = W.partitionBy(key).orderBy(at)
    daily = df.groupBy(key, at).agg(F.max_by(value, order).alias(value))
    changed = daily.withColumn("_p", F.lag(value).over(run)).where(F.col("_p").isNull() | (F.col("_p") != F.col(value)))
    following = F.lead(at).over(run)
    return changed.select(key, value, F.col(at).alias("valid_from"), F.date_sub(following, 1).alias("valid_to"), following.isNull().alias("is_current"))


OPEN = "9999-12-31"


def balance(df: DataFrame, by: Sequence[str], weight: str, name: str, tie: str, digits: int = 4) -> DataFrame:
    """Weights as shares of their group rounded to digits, the rest going to the largest, so that they add up to 1."""
    whole = W.partitionBy(*by)
    share = F.round(F.col(weight) / F.sum(weight).over(whole), digits)
    rows = df.withColumn("_s", share).withColumns({"_rest": F.round(1 - F.sum("_s").over(whole), digits), "_r": F.row_number().over(W.partitionBy(*by).orderBy(F.col("_s").desc(), tie))})
    return rows.withColumn(name, F.round(F.col("_s") + F.when(F.col("_r") == 1, F.col("_rest")).otherwise(0.0), digits)).drop("_s", "_rest", "_r")


def cap_table(rel: DataFrame, rel_id: str, key: str, weight: str) -> DataFrame:
    """Holdings by elementary interval: (rel_id, key, share, valid_from, valid_to), shares adding up to 1 in each.

    A key's intervals lie between all its boundaries; a relation is active in those it covers whole.  Relations that
    are never active (none or negative length) stay as one row with their share of all weights of the key.
    """
    end = F.coalesce("valid_to", F.lit(OPEN).cast("date"))
    rows = rel.select(rel_id, key, weight, "valid_from", end.alias("_end"))
    marks = rows.select(key, F.explode(F.array("valid_from", "_end")).alias("_a")).distinct()
    segments = marks.withColumn("_b", F.lead("_a").over(W.partitionBy(key).orderBy("_a"))).where("_b is not null")
    active = rows.join(segments, key).where("valid_from <= _a and _end >= _b")
    shares = balance(active, [key, "_a"], weight, "share", rel_id)
    open_end = F.when(F.col("_b") != F.lit(OPEN).cast("date"), F.col("_b"))
    kept = shares.select(rel_id, key, "share", F.col("_a").alias("valid_from"), open_end.alias("valid_to"))
    never = rows.where("_end <= valid_from").join(rows.groupBy(key).agg(F.sum(weight).alias("_w")), key)
    return kept.unionByName(never.select(rel_id, key, F.round(F.col(weight) / F.col("_w"), 4).alias("share"), "valid_from", F.col("_end").alias("valid_to")))


def collapse(segments: DataFrame, rel_id: str, key: str) -> DataFrame:
    """One row per relation: the first interval's share, the whole span, open if any interval is."""
    return segments.groupBy(rel_id, key).agg(F.min_by("share", F.struct("valid_from", "share")).alias("share"), F.min("valid_from").alias("valid_from"), F.when(~F.bool_or(F.col("valid_to").isNull()), F.max("valid_to")).alias("valid_to"))
