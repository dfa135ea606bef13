"""Where queries are registered, each with the DuckDB SQL that gives the same rows, and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_CAMEL = "trim(regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g'))"


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def norm_sql(x: str) -> str:
    """SQL of ``terms.norm_label``."""
    return f"lower({_CAMEL.format(x=x)})"


def pascal_sql(x: str) -> str:
    """SQL of ``terms.class_local_name`` where there are words."""
    return f"array_to_string(list_transform(string_split({norm_sql(x)}, ' '), lambda w: upper(w[1]) || w[2:]), '')"
