"""The list of the subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without ``sql`` it is checked by tests against brute force."""
    def add(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(docs: DataFrame, *columns: str) -> tuple[DataFrame, list[str], list[str]]:
    """``docs`` with columns c0, c1, ... (so that no name meets one used inside an operator), the new names of
    ``columns``, and the old names for ``toDF`` at the end."""
    names = docs.columns
    return docs.toDF(*(f"c{i}" for i in range(len(names)))), [f"c{names.index(c)}" for c in columns], names
