"""Registry of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bindings as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables, and the record tables Spark derives from them, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in B.DERIVED:
            return B.DERIVED[name](self)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None, uses: str = ""):
    """Register ``fn(tables)`` with the SQL that gives the same rows; ``uses`` names derived tables of the SQL."""

    def register(fn: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ctes = ", ".join(f"{t} AS ({B.SQL[t]})" for t in uses.split())
            ORACLES[name] = (f"WITH {ctes} " if ctes else "") + sql.strip()
        return fn

    return register
