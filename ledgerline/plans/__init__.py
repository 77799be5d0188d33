"""Registered queries: each binds an operator to the driver's tables and gives the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

MODULES = ("scalar", "relational", "aggregates", "windows", "credit", "quality", "graphs", "models", "texts")


class Tables:
    """The tables of a folder by name: t.orders reads orders.parquet."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


class Query(NamedTuple):
    build: Callable[[Tables], DataFrame]
    sql: str | None = None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


class Register(dict[str, Query]):
    """A table of queries; used as a decorator it adds the function by its name."""

    def __call__(self, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
        def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            self[build.__name__] = Query(build, sql)
            return build

        return add


def registry() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for name in MODULES:
        found |= import_module(f"ledgerline.plans.{name}").query
    return found
