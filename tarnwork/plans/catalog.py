"""Registry of queries over the given tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, ints: tuple[str, ...] = ()):
    """Register a function (spark, sf_dir) -> DataFrame under ``name``; ``ints`` are columns that SQL must narrow to integer."""
    if sql and ints:
        sql = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS INTEGER) AS {c}' for c in ints)}) FROM ({sql})"

    def add(f):
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, with its time columns as timestamps (UTC)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


#: Modules that register queries.
MODULES = ("queries_access", "queries_canonical", "queries_evidence", "queries_incremental", "queries_outcomes", "queries_search", "queries_sources", "queries_text")


def load() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        importlib.import_module(f"tarnwork.plans.{name}")
