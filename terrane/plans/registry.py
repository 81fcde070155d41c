"""Registered queries of the engine and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "r08_vulnerability"


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zero: the same figures for any order of summation."""
    return df.withColumns({f.name: F.round(f.name, digits) + 0.0 for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def register(name: str, sql: str | None = None, digits: int = 6) -> Callable:
    """Decorator: a query by name, with DuckDB SQL that gives the same rows; doubles are rounded."""

    def add(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: tidy(build(spark, sf_dir), digits)
        QUERIES[name].__doc__ = build.__doc__
        if sql is not None:
            ORACLE[name] = sql
        return build

    return add


from terrane.plans import queries_commands, queries_files, queries_model, queries_parts, queries_space, queries_stream, queries_table  # noqa: E402, F401
