"""Named queries over the given tables, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        @wraps(build)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return build(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def six(value: Column | str) -> Column:
    """Six decimals, and no negative zero."""
    return F.round(value, 6) + F.lit(0.0)


def six_off_ties(value: Column | str) -> Column:
    """Six decimals of a ratio of whole numbers, which may lie exactly between two of them."""
    return F.round((F.col(value) if isinstance(value, str) else value) + F.lit(1e-9), 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: six(F.col(c)) for c in columns})
