"""Helpers of registered queries: the same rounding and text keys in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACES = 6


def shown(df: DataFrame, keys: Sequence[str], values: dict[str, Column] | Sequence[str]) -> DataFrame:
    """Times as text, doubles rounded, the rest as it is."""
    values = {v: F.col(v) for v in values} if not isinstance(values, dict) else values
    kinds = dict(df.dtypes)
    out = [F.date_format(k, "yyyy-MM-dd HH:mm:ss").alias(k) if kinds[k].startswith("timestamp") else F.col(k) for k in keys]
    df = df.withColumns(values)
    kinds = dict(df.dtypes)
    return df.select(*out, *[(F.round(v, PLACES) + 0.0).alias(v) if kinds[v] == "double" else F.col(v) for v in values])


def over(n: int | None = None, by: str = "symbol", order: str = "ts") -> str:
    """SQL of a trailing window of n rows; without n, of all rows so far."""
    start = "UNBOUNDED" if n is None else str(n - 1)
    return f"(PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {start} PRECEDING AND CURRENT ROW)"


def w(by: str = "symbol", order: str = "ts") -> str:
    return f"(PARTITION BY {by} ORDER BY {order})"


def r(expression: str, name: str) -> str:
    return f"round({expression}, {PLACES}) + 0.0 AS {name}"


def least(column: str, k: int, expression: str, n: int | None) -> str:
    """SQL of an aggregate over a window with at least k known values."""
    return f"CASE WHEN count({column}) OVER {over(n)} >= {k} THEN {expression} OVER {over(n)} END"


KEY = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"
