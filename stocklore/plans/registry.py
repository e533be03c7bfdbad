"""Registry of the library's queries: name -> callable(spark, folder), and SQL giving the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf}/{table}.parquet")


def query(sql: str | None = None):
    """Registers a query under its function's name, with SQL where the whole table can be checked that way."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


from . import data_quality, record_ops, reference_ops  # noqa: E402, F401
