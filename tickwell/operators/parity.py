"""Comparing two runs of one session: curves by time, decisions by place, and where they part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differences(a: DataFrame, b: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(value, n_both, n_left, n_right, max_abs, at): for each value the largest difference over common keys and where it is; and how many keys only one side has."""
    x = a.select(*on, *[F.col(v).cast("double").alias(f"__a_{v}") for v in values], F.lit(1).alias("__a"))
    y = b.select(*on, *[F.col(v).cast("double").alias(f"__b_{v}") for v in values], F.lit(1).alias("__b"))
    both = x.join(y, list(on), "full")
    long = both.select(*on, "__a", "__b", F.explode(F.array(*[F.struct(F.lit(v).alias("value"), F.abs(F.col(f"__a_{v}") - F.col(f"__b_{v}")).alias("d")) for v in values])).alias("s"))
    key = F.concat_ws(",", *[F.col(k).cast("string") for k in on])
    count = lambda t: F.sum(t.cast("long"))
    return long.groupBy("s.value").agg(
        count(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("n_both"), count(F.col("__b").isNull()).alias("n_left"), count(F.col("__a").isNull()).alias("n_right"), F.max("s.d").alias("max_abs"), F.max_by(key, F.struct("s.d", key)).alias("at"),
    )


def first_parting(a: DataFrame, b: DataFrame, on: Sequence[str], flag: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, on of the first key at which the flag differs, both flags), one row a group that parts."""
    x = a.select(*by, *on, F.col(flag).alias("left_flag"))
    y = b.select(*by, *on, F.col(flag).alias("right_flag"))
    rows = x.join(y, [*by, *on]).where(~F.col("left_flag").eqNullSafe(F.col("right_flag")))
    first = F.min_by(F.struct(*on, "left_flag", "right_flag"), F.struct(*on)).alias("f")
    return (rows.groupBy(*by).agg(first) if by else rows.agg(first).where("f IS NOT NULL")).select(*by, "f.*")
