"""Registry of runnable queries and their ANSI SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def add(fn):
        if key in QUERIES:
            raise KeyError(key)
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn

    return add


def edge(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Presentation form: chosen columns, rounded doubles, wide ints, text dates."""
    out = []
    kinds = dict(df.dtypes)
    for c in columns or df.columns:
        k = kinds[c]
        if k in ("double", "float"):
            out.append(F.round(F.col(c).cast("double"), digits).alias(c))
        elif k in ("int", "smallint", "tinyint"):
            out.append(F.col(c).cast("bigint").alias(c))
        elif k == "date":
            out.append(F.date_format(c, "yyyy-MM" if c == "period" else "yyyy-MM-dd").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)
