"""As-of joins, by a union of both sides and windows: no range join.

A key's rows are cut into slices of time, so that a window has the rows of one key in one slice. What
a slice hands to the others (its last or first match) is one row, carried over the slices of its key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of a slice of time.
SLICE = "day"


def _carried(both: DataFrame, by: Sequence[str], of_slice: Column, back: bool) -> DataFrame:
    """(by, __slice, __carry): what the nearest earlier (or later) slice of the key with a match hands over. There are as many as keys and slices, so a join with them merges."""
    slices = both.groupBy(*by, "__slice").agg(of_slice.alias("__own"))
    w = Window.partitionBy(*by).orderBy("__slice")
    w = w.rowsBetween(Window.unboundedPreceding, -1) if back else w.rowsBetween(1, Window.unboundedFollowing)
    pick = F.last if back else F.first
    return slices.select(*by, "__slice", pick("__own", ignorenulls=True).over(w).alias("__carry")).hint("merge")


def _on(by: Sequence[str]) -> Column:
    """Null keys meet null keys, as in a window."""
    on = F.col("a.__slice").eqNullSafe(F.col("c.__slice"))
    for k in by:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"c.{k}"))
    return on


def backward(left: DataFrame, right: DataFrame, by: Sequence[str], value: str, on: str = "ts", unit: str = SLICE) -> DataFrame:
    """``left`` with the right side's ``value`` of the latest time at or before its own; null where there is none."""
    sides = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias(f"__{value}"), F.lit(1).alias("__side"))
    other = right.select(*by, on, F.col(value).alias(f"__{value}"), F.lit(0).alias("__side"))
    both = sides.unionByName(other, allowMissingColumns=True).withColumn("__slice", F.date_trunc(unit, on))
    own = F.when(F.col(f"__{value}").isNotNull(), F.struct(F.col(on), F.col(f"__{value}").alias("v")))
    carried = _carried(both, by, F.max(own), True)
    w = Window.partitionBy(*by, "__slice").orderBy(on, "__side").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn(value, F.last(f"__{value}", ignorenulls=True).over(w)).where("__side = 1").drop("__side", f"__{value}")
    rows = rows.alias("a").join(carried.alias("c"), _on(by), "left")
    return rows.select(*[F.coalesce(f"a.{c}", "c.__carry.v").alias(c) if c == value else F.col(f"a.{c}") for c in [*[x for x in left.columns if x != value], value]])


def forward(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, value: str, unit: str = SLICE) -> DataFrame:
    """``left`` with the first right row strictly later than its own time: its ``value`` and time; null where there is none."""
    kind = right.schema[value].dataType
    a = left.withColumns({"__t": F.col(left_time), "__v": F.lit(None).cast(kind), "__side": F.lit(1)})
    b = right.select(*by, F.col(right_time).alias("__t"), F.col(value).alias("__v"), F.lit(0).alias("__side"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__slice", F.date_trunc(unit, "__t"))
    match = F.when(F.col("__side") == 0, F.struct(F.col("__t").alias("t"), F.col("__v").alias("v")))
    carried = _carried(both, by, F.min(match), False)
    later = Window.partitionBy(*by, "__slice").orderBy(F.col("__t"), F.col("__side")).rowsBetween(1, Window.unboundedFollowing)
    rows = both.withColumn("__hit", F.first(match, ignorenulls=True).over(later)).where("__side = 1")
    rows = rows.alias("a").join(carried.alias("c"), _on(by), "left").withColumn("__found", F.coalesce("a.__hit", "c.__carry"))
    return rows.select(*[F.col(f"a.{c}") for c in left.columns], F.col("__found.v").alias(value), F.col("__found.t").alias(right_time))


def session_map(source: DataFrame, target: DataFrame) -> DataFrame:
    """(source_session, close_at, target_session, open_at): each source session goes to the first target session that opens after it closed; of several, a target keeps the latest. Both: (session, open_at, close_at)."""
    s = source.select(F.lit(0).alias("k"), F.col("session").alias("source_session"), "close_at")
    t = target.select(F.lit(0).alias("k"), F.col("session").alias("target_session"), "open_at")
    hit = forward(s, t, ["k"], "close_at", "open_at", "target_session").where("target_session IS NOT NULL").drop("k")
    latest = F.row_number().over(Window.partitionBy("target_session").orderBy(F.desc("close_at")))
    return hit.withColumn("__n", latest).where("__n = 1").drop("__n")
