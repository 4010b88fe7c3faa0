"""Queries and their SQL side by side, and the supplied tables they run on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """tables.documents is the Parquet table of that name; sql() runs SQL over literal rows."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def rows(self, names: str, values: str) -> DataFrame:
        """A literal table; the same VALUES text serves DuckDB."""
        return self.spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")


def query(name: str, sql: str | None = None):
    """Register a function of Tables as a query, with the SQL that gives the same rows."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add
