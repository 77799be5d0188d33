"""What the operators of this subpackage share: inputs, shared-folder checkpoints and components."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import graph
from ledgerline.operators.graph import cut, shared

__all__ = ["components", "cut", "ended", "fresh", "is_marked", "marked", "read", "removed", "shared", "table_path", "text_or_empty", "written"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def table_path(spark: SparkSession, name: str) -> str:
    """A path of its own for a table in the shared folder."""
    return f"{shared(spark)}/tables/{uuid.uuid4().hex}-{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of its own in the shared folder."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def fresh(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of df has it (Spark does not tell upper from lower case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ended(name: str = "text") -> Column:
    """The text (a null one is empty) with a line end behind it, as arrays.chunks needs it."""
    return F.concat(text_or_empty(name), F.lit("\n"))


def marked(names: DataFrame, name: str, most_bits: int = 1 << 27, exact: bool = False) -> np.ndarray:
    """Bits that are set where the values of a long column fall, as an array of bytes of at most most_bits / 8 (16 MB).

    About 16 bits a value while they fit, so that a task that knows the bits passes over nearly all other values before
    they reach Spark.  It is only a first sieve: a join with the values themselves has to follow.  If exact, it is most_bits
    long, whatever the values.
    """
    bits = most_bits if exact else 1 << max(10, min(most_bits.bit_length() - 1, (16 * names.count()).bit_length()))
    place = names.select(F.pmod(F.col(name), F.lit(bits)).cast("int").alias("p"))
    words = place.selectExpr("p div 32 AS w", "shiftleft(1L, p % 32) AS b")
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(bits // 32, dtype=np.uint32)
    table[rows.column("w").to_numpy()] = rows.column("b").to_numpy().astype(np.uint32)
    return table.view(np.uint8)


def is_marked(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values & np.uint64(len(table) * 8 - 1)
    return (table[(at >> np.uint64(3)).view(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of an edge table, root being the smallest node; nodes without a link to another have no row."""
    return graph.components(links, a, b)
