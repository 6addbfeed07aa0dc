"""Where the query modules register queries and the DuckDB SQL that gives the same rows.

Queries are thin: load, apply one operator, name and round the columns. Values
are rounded in the outermost select only, to six decimals, in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.sources import star

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with its double columns rounded; -0.0 becomes 0.0.

    Rounds the scaled double, as DuckDB does, so that ties fall alike.
    """
    scale = 10.0**digits
    return df.select(*((F.round(F.col(f"`{c}`") * scale) / scale + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def on_series(op: Callable[[DataFrame], DataFrame]) -> Query:
    """A query that applies an operator to the monthly series of all entities."""
    return lambda spark, sf_dir: rounded(op(star.series(star.monthly(star.facts(spark, sf_dir)))))


def on_facts(op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(op(star.facts(spark, sf_dir)))


def on_monthly(op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(op(star.monthly(star.facts(spark, sf_dir))))


def on_table(name: str, op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(op(star.table(spark, sf_dir, name)))


def with_series(sql: str) -> str:
    return f"WITH {star.SERIES_SQL}\n{sql}"


def with_recursive_series(sql: str) -> str:
    return f"WITH RECURSIVE {star.SERIES_SQL}\n{sql}"


def with_monthly(sql: str) -> str:
    return f"WITH {star.MONTHLY_SQL}\n{sql}"


def with_facts(sql: str) -> str:
    return f"WITH {star.FACTS_SQL}\n{sql}"
