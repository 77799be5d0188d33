"""Data-quality, leakage and lineage checks.

Each check is one row: check, passed, critical, detail (a count).  The counting is distributed; the gate unites the
rows and may raise on the critical ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerline.operators.quantiles import row_of


def result(counted: DataFrame, check: str, critical: bool = True) -> DataFrame:
    """A check from a table with one number: it passes at 0."""
    n = F.col(counted.columns[0])
    return counted.select(F.lit(check).alias("check"), (n == 0).alias("passed"), F.lit(critical).alias("critical"), n.cast("long").alias("detail"))


def count_where(df: DataFrame, bad: Column, check: str, critical: bool = True) -> DataFrame:
    return result(df.agg(F.count_if(bad).alias("n")), check, critical)


def pk_unique(df: DataFrame, keys: Sequence[str], check: str, critical: bool = True) -> DataFrame:
    """Keys that stand more than once."""
    return result(df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").agg(F.count("*").alias("n")), check, critical)


def fk_orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str, check: str, critical: bool = True) -> DataFrame:
    """Rows whose key is not null and not in the parent."""
    return result(child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti").agg(F.count("*").alias("n")), check, critical)


def forbidden_columns(df: DataFrame, forbidden: Sequence[str], prefixes: Sequence[str], check: str) -> DataFrame:
    """Columns of the table that are forbidden or of no known prefix; the table's schema is enough to tell."""
    bad = [c for c in df.columns if c in forbidden or not any(c.startswith(p) for p in prefixes)]
    return df.limit(1).agg(F.lit(len(bad)).alias("n")).transform(result, check)


def scd2_no_overlap(df: DataFrame, key: str, check: str) -> DataFrame:
    """Versions that begin before the one before has ended, and keys without exactly one current version."""
    run = W.partitionBy(key).orderBy("valid_from")
    overlaps = df.withColumn("_bad", F.lag("valid_to").over(run).isNull() & F.lag("valid_from").over(run).isNotNull() | (F.lag("valid_to").over(run) >= F.col("valid_from"))).agg(F.count_if("_bad").alias("n"))
    current = df.groupBy(key).agg(F.count_if("is_current").alias("_c")).where("_c <> 1").agg(F.count("*").alias("m"))
    return result(overlaps.crossJoin(current).select((F.col("n") + F.col("m")).alias("n")), check)


def tail_ratio(df: DataFrame, columns: Sequence[str], most: float, check: str) -> DataFrame:
    """Columns whose largest value is more than so many times their 99th percentile."""
    tails = row_of(df, columns, [0.99], "_p_").crossJoin(F.broadcast(df.agg(*[F.max(c).alias(f"_m_{c}") for c in columns])))
    bad = [F.when(F.col(f"_m_{c}") > most * F.col(f"_p_{c}")[0], 1).otherwise(0) for c in columns]
    return result(tails.select(reduce(lambda a, b: a + b, bad).alias("n")), check, False)


def gate(checks: Sequence[DataFrame], path: str | None = None, strict: bool = False) -> DataFrame:
    """All checks in one table, written if a path is given; strict raises with the names of the critical failures."""
    every = reduce(DataFrame.unionByName, checks)
    if path:
        every.write.mode("overwrite").parquet(path)
        every = every.sparkSession.read.parquet(path)
    if strict:
        failed = [r[0] for r in every.where("critical and not passed").select("check").collect()]  # one row a check
        if failed:
            raise ValueError("critical checks failed: " + ", ".join(sorted(failed)))
    return every
