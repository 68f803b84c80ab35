"""Named queries over the star schema, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DIGITS = 6


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    """Round doubles for comparison between engines; adding 0.0 removes negative zero."""
    return df.withColumns({c: F.round(F.col(c), DIGITS) + F.lit(0.0) for c in cols})


def r(expr: str) -> str:
    return f"round({expr}, {DIGITS}) + 0e0"


def hash_sql(seed: int, purpose: str, *keys: str) -> str:
    """The keyed hash in SQL."""
    return f"('0x' || substr(md5(concat_ws(':', '{seed}', '{purpose}', {', '.join(keys)})), 1, 15))::BIGINT"
