"""The registered queries and their SQL, and what query modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r4(c: Column | str) -> Column:
    """Four decimals; scores have six, so products tie at the fifth and get 1e-9 first."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, 4)
