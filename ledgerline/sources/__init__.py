"""Sources and sinks: tables of a layer, CSV, JSON lines, JDBC, vector indexes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerline.operators.rows import require
from ledgerline.operators.search import normalised


def read_csv(spark: SparkSession, path: str, schema: StructType | str, columns: Sequence[str] | None = None, max_rows: int | None = None) -> DataFrame:
    """A CSV file with a header by an explicit schema; only the chosen columns are parsed."""
    df = spark.read.schema(schema).csv(path, header=True, enforceSchema=False)
    df = df.select(*columns) if columns else df
    return df.limit(max_rows) if max_rows is not None else df


def read_table(spark: SparkSession, root: str, layer: str, name: str, columns: Sequence[str] = (), required: Sequence[str] = ()) -> DataFrame:
    """A Parquet table of a layer; an error names the columns that it lacks."""
    df = require(spark.read.parquet(f"{root}/{layer}/{name}"), [*columns, *required])
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, root: str, layer: str, name: str) -> int:
    """Overwrites a Parquet table of a layer; returns its rows, read from the footers of the files.

    Rows are not observed while they are written: once a session has observed anything, Spark 4.1 can't send a logistic
    model that was fitted in it to its tasks (the model's training summary holds the session).
    """
    path = f"{root}/{layer}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path).count()


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV files with a header, one a task; a single file is for small tables such as a data dictionary."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True)


def read_goldens(spark: SparkSession, path: str) -> DataFrame:
    """Test cases of extraction, a JSON object a line."""
    return spark.read.schema("id string, source_name string, page int, page_text string, expected_raw_facts map<string,string>, forbidden_facts array<string>").json(path)


def jdbc_options(url: str, table: str, user: str = "", batch: int = 20_000, driver: str | None = None) -> dict[str, str]:
    """Options of a batched JDBC write; whole numbers that may be null stay whole numbers."""
    return {"url": url, "dbtable": table, "user": user, "batchsize": str(batch), "rewriteBatchedInserts": "true"} | ({"driver": driver} if driver else {})


def write_jdbc(df: DataFrame, options: Mapping[str, str], mode: str = "overwrite") -> None:
    df.write.format("jdbc").options(**options).mode(mode).save()


def read_jdbc(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(**options).load()


def write_vector_index(chunks: DataFrame, vector: str, model: str, path: str) -> None:
    """Chunks with vectors of length 1 and the name of the model that made them."""
    chunks.withColumns({vector: normalised(vector).cast("array<float>"), "model": F.lit(model)}).write.mode("overwrite").parquet(path)


def read_vector_index(spark: SparkSession, path: str, model: str) -> DataFrame:
    """The index, if its vectors are of the model asked for."""
    df = spark.read.parquet(path)
    others = [r[0] for r in df.select("model").distinct().limit(3).collect() if r[0] != model]
    if others:
        raise ValueError(f"the index is of {', '.join(others)}, not of {model}")
    return df.drop("model")
