"""Joins of points with the intervals that hold them: by equal cells of a tree over time, not by a comparison of all pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Times are whole numbers of 20 bits (days: 1,400 years to either side of the epoch); a level of the tree takes two of them.
_LEVELS, _HALF = 10, 1 << 19

_CELLS = f"""aggregate(sequence(0, {_LEVELS}), named_struct('l', l, 'r', r, 'cells', cast(array() as array<bigint>)), (s, k) ->
  named_struct('l', shiftright(s.l + 3, 2), 'r', shiftright(s.r, 2), 'cells', if(s.l >= s.r, s.cells, concat(s.cells, transform(
    if(shiftright(s.l + 3, 2) > shiftright(s.r, 2), sequence(s.l, s.r - 1), concat(
      if(s.l % 4 = 0, cast(array() as array<bigint>), sequence(s.l, 4 * shiftright(s.l + 3, 2) - 1)),
      if(s.r % 4 = 0, cast(array() as array<bigint>), sequence(4 * shiftright(s.r, 2), s.r - 1)))),
    x -> x * {_LEVELS + 1} + k)))),
  s -> s.cells)"""


def _place(at: Column) -> Column:
    return at.cast("long") + F.lit(_HALF)


def _cut(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """A row for each cell of each interval. Spark takes an explosion for no larger than what it explodes, so joins with it say that they merge."""
    least, most = F.lit(-_HALF), F.lit(_HALF)
    cut = intervals.withColumns({
        "l": _place(F.greatest(F.col(start).cast("long"), least)), "r": _place(F.least(F.coalesce(F.col(end).cast("long"), most), most)),
    }).where(F.col(start).isNotNull())
    return cut.withColumn("__cell", F.explode(F.expr(_CELLS))).drop("l", "r")


def _asked(points: DataFrame, at: str) -> DataFrame:
    """A row for each level's cell of each point."""
    inside = F.when(F.abs(F.col(at).cast("long")) >= _HALF, F.raise_error(F.lit("a time is outside the tree"))).otherwise(_place(F.col(at)))
    cells = F.transform(F.sequence(F.lit(0), F.lit(_LEVELS)), lambda k: F.floor(inside / F.pow(F.lit(4), k)).cast("long") * (_LEVELS + 1) + k)
    return points.where(F.col(at).isNotNull()).withColumn("__cell", F.explode(cells))


def holding(points: DataFrame, intervals: DataFrame, by: Sequence[str], at: str = "at", start: str = "start", end: str = "end") -> DataFrame:
    """Each row of ``points`` with each row of ``intervals`` of the same ``by`` that holds its time: start <= at < end, without an end for ever.

    An interval is cut into at most some 60 cells of a tree of fours, which are disjoint; a point lies in one cell of each of the eleven levels; so
    the join is by equality, and a pair meets once. Rows that lack a key or a time meet nothing, nor do intervals that end before they start.
    ``points`` and ``intervals`` must not share names besides ``by``.
    """
    return _asked(points, at).join(_cut(intervals, start, end).hint("merge"), [*by, "__cell"]).drop("__cell")


#: States of a finding, from the highest to the lowest.
LADDER = ("accepted", "descriptive_only", "expired", "quarantined", "invalidated")


def lowered(status: Column, *ceilings: Column) -> Column:
    """The lowest of a status and of what evidence leaves it (null: all): evidence never raises."""
    ladder = F.array(*map(F.lit, LADDER))
    return F.element_at(ladder, F.greatest(*[F.array_position(ladder, s).cast("int") for s in (status, *ceilings)]))


def point_in_time(studies: DataFrame, flags: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(study, statistical, active, codes, falsified): what is known of a study at its own evaluation, and its status after it.

    ``studies``: (study, driver, target, evaluation, primary); ``flags``: (driver, target, code, effective, resolved), active from ``effective`` until
    before ``resolved``; ``diagnostics``: (study, family, status, as_of), of which those after the evaluation count for nothing. Times are whole numbers.
    An active flag invalidates; a family that falsifies lowers to descriptive_only at most.
    Flags of a cell are counted by code before they meet the evaluations, and studies of one pair and time ask once: pairs of a study and a flag, which
    grow with the square of the tables where drivers and targets stay, are never rows.
    """
    by = ["driver", "target"]
    cells = _cut(flags.select(*by, "code", "effective", "resolved"), "effective", "resolved").groupBy(*by, "__cell", "code").agg(F.count(F.lit(1)).alias("n"))
    asked = _asked(studies.select(*by, "evaluation").distinct(), "evaluation")
    at = asked.join(cells.hint("merge"), [*by, "__cell"]).groupBy(*by, "evaluation").agg(F.sum("n").alias("active"), F.collect_set("code").alias("codes"))
    hit = studies.select("study", *by, "evaluation").join(at.hint("merge"), [*by, "evaluation"])
    active = hit.groupBy("study").agg(F.sum("active").alias("active"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("codes"))
    known = diagnostics.join(studies.select("study", "evaluation").hint("merge"), "study").where("as_of <= evaluation")
    against = known.groupBy("study").agg(F.max(F.col("status") == "falsifies").alias("falsified"))
    rows = studies.join(active.hint("merge"), "study", "left").join(against.hint("merge"), "study", "left").withColumns({
        "active": F.coalesce("active", F.lit(0)), "codes": F.coalesce("codes", F.array().cast("array<string>")), "falsified": F.coalesce("falsified", F.lit(False)),
    })
    after = lowered(F.col("primary"), F.when(F.col("active") > 0, "invalidated"), F.when(F.col("falsified"), "descriptive_only"))
    return rows.select("study", after.alias("statistical"), "active", "codes", "falsified")
