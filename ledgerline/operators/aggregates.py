"""Aggregations, profiles and statistics of columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerline.functions import null_if_zero
from ledgerline.operators.quantiles import quantiles, row_of


def degrees(edges: DataFrame, src: str, dst: str, nodes: DataFrame | None = None, node: str = "node") -> DataFrame:
    """How often a node is an end of an edge; with a table of nodes, 0 for those without edges."""
    counts = edges.select(F.explode(F.array(src, dst)).alias(node)).groupBy(node).agg(F.count("*").alias("degree"))
    if nodes is None:
        return counts
    return nodes.select(node).join(counts, node, "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def top_degree_subgraph(edges: DataFrame, src: str, dst: str, k: int) -> DataFrame:
    """The edges between the k nodes of the most edges (ties by name)."""
    top = degrees(edges, src, dst).orderBy(F.col("degree").desc(), "node").limit(k)
    return edges.join(top.select(F.col("node").alias(src)), src, "left_semi").join(top.select(F.col("node").alias(dst)), dst, "left_semi")


def hhi(weight: str) -> Column:
    """Concentration of a group: sum of squared shares; null where the total is not positive.  One pass."""
    total = F.sum(weight)
    return F.when(total > 0, F.sum(F.col(weight) * F.col(weight)) / (total * total))


def member_lists(df: DataFrame, group: str, member: str, most: int) -> DataFrame:
    """(group, part, members): the distinct members in order, comma-joined, at most so many in a row."""
    place = F.row_number().over(W.partitionBy(group).orderBy(member))
    rows = df.select(group, member).distinct().withColumn("part", F.floor((place - 1) / most).cast("long"))
    return rows.groupBy(group, "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(member)), lambda x: x.cast("string")), ",").alias("members"))


def share_where(flag: Column, amount: Column | None = None) -> Column:
    """The share of rows, or of an amount, for which a flag holds."""
    if amount is None:
        return F.avg(F.when(flag, 1.0).otherwise(0.0))
    return F.sum(F.when(flag, amount).otherwise(0.0)) / null_if_zero(F.sum(amount))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / null_if_zero(F.sum(weight))


def first_non_null(columns: Sequence[str], order: str) -> list[Column]:
    """The first value of each column that is not null, in an order."""
    return [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]


def profile(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """One row per numeric column: type, counts, share of nulls and zeros, mean, deviation, bounds, percentiles, and the most frequent value as a sample."""
    points = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}

    def row(c: str) -> Column:
        v = F.col(c).cast("double")
        each = {"n": F.count(v), "nulls": F.avg(v.isNull().cast("double")), "zeros": F.avg((v == 0).cast("double")), "mean": F.avg(v), "std": F.stddev(v), "low": F.min(v), "high": F.max(v)}
        out = [F.lit(c).alias("name"), F.lit(df.schema[c].dataType.simpleString()).alias("kind")] + [(x if n == "n" else F.round(x, digits)).alias(n) for n, x in each.items()]
        return F.struct(*out)

    rows = df.agg(F.array(*[row(c) for c in columns]).alias("rows")).select(F.inline("rows"))
    return rows.join(spread(df, columns, points, digits), "name", "left").withColumn("distinct", F.coalesce("distinct", F.lit(0)))


def spread(df: DataFrame, columns: Sequence[str], points: Mapping[str, float], digits: int) -> DataFrame:
    found = quantiles(df, columns, list(points.values()))
    return found.select("name", "distinct", F.round("usual", digits).alias("sample"), *[F.round(F.col("q")[i], digits).alias(n) for i, n in enumerate(points)])


def missing(df: DataFrame, n: int) -> DataFrame:
    """The n columns with the most nulls (ties by name): name, nulls and their share in percent."""
    rows = [F.struct(F.lit(c).alias("name"), F.sum(F.col(c).isNull().cast("long")).alias("nulls"), F.round(F.avg(F.col(c).isNull().cast("double")) * 100, 4).alias("percent")) for c in df.columns]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows")).orderBy(F.col("nulls").desc(), "name").limit(n)


def bad_rates(df: DataFrame, dims: Sequence[str], target: str) -> DataFrame:
    """Rows, labelled ones, events, their rate and censored rows by any dimensions."""
    y = F.col(target)
    return df.groupBy(*dims).agg(F.count("*").alias("rows"), F.count(y).alias("labelled"), F.coalesce(F.sum(y), F.lit(0)).cast("long").alias("events"), F.round(F.avg(y), 6).alias("rate"), F.count_if(y.isNull()).alias("censored"))


def positive_quartiles(df: DataFrame, value: str) -> DataFrame:
    """A bucket: 'zero' for what is not positive, else the quartile among the positive values by exact bounds."""
    bounds = row_of(df.where(F.col(value) > 0), {"b": value}, [0.25, 0.5, 0.75], "_")
    v, b = F.col(value), F.col("_b")
    bucket = F.when(v <= 0, "zero").when(v <= b[0], "Q1").when(v <= b[1], "Q2").when(v <= b[2], "Q3").when(v.isNotNull(), "Q4")
    return df.crossJoin(F.broadcast(bounds)).withColumn("bucket", bucket).drop("_b")


def trimmed_medians(df: DataFrame, values: Mapping[str, Column], plausible: Mapping[str, Column], defaults: Mapping[str, float], least: int) -> DataFrame:
    """One row: of each value the median of the plausible ones if there are more than so many, else a default."""
    found = quantiles(df, {n: F.when(plausible[n], v) for n, v in values.items()}, [0.5])
    middle = lambda n: F.max(F.when((F.col("name") == n) & (F.col("n") > least), F.col("q")[0]))
    return found.agg(*[F.coalesce(middle(n), F.lit(defaults[n])).alias(n) for n in values])


def frequencies(df: DataFrame, value: str, worst_first: Sequence[str]) -> DataFrame:
    """Shares of values and their sum from the worst one on."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    place = F.array_position(F.array(*map(F.lit, worst_first)), F.col(value))
    rows = counts.withColumns({"place": place, "share": F.col("n") / F.sum("n").over(W.partitionBy())})  # one row a value
    return rows.withColumn("cumulative", F.sum("share").over(W.orderBy("place").rowsBetween(W.unboundedPreceding, 0)))


def with_defaults(df: DataFrame, key: str, value: str, defaults: Mapping[str, float]) -> DataFrame:
    """A table of values by key in which keys without one have their default."""
    spark = df.sparkSession
    base = spark.createDataFrame(list(defaults.items()), f"{key} string, _default double")
    return base.join(df, key, "full").select(key, F.coalesce(value, "_default").alias(value))


def histogram(df: DataFrame, value: str, bins: int, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Counts of equal-width bins between two percentiles; values outside count in the end bins."""
    bounds = row_of(df, {"b": value}, [low, high], "_")
    lo, hi = F.col("_b")[0], F.col("_b")[1]
    at = F.floor((F.col(value) - lo) / null_if_zero(hi - lo) * bins)
    return df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(bounds)).withColumn("bin", F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)).cast("long")).groupBy("bin").agg(F.count("*").alias("n"))
