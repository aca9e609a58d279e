"""Consensus of bars from several providers: providers, then independent groups, then two-of-three votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwell.operators.market_rules import row_reasons

FIELDS = ("open", "high", "low", "close", "volume")
#: Relative spread up to which values agree, and above which a session is put aside, for prices and for volume.
PASS, QUARANTINE = {"price": 0.005, "volume": 0.05}, {"price": 0.02, "volume": 0.25}


def spread(values: Column) -> Column:
    """(largest - smallest) over the larger size of the two; 0 of fewer than two values or of zeros."""
    low, high = F.array_min(values), F.array_max(values)
    return F.when(F.size(values) < 2, 0.0).otherwise(F.coalesce(F.try_divide(high - low, F.nullif(F.greatest(F.abs(low), F.abs(high)), F.lit(0.0))), F.lit(0.0)))


def session_votes(captures: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """A row for each session: the accepted bar, how many groups stand behind it, spreads, status and sorted reasons.

    ``captures``: (provider, grp, session, open, high, low, close, volume). Bad rows (not finite, not
    positive, impossible shape) do not vote. Captures of a provider, then providers of a group, collapse
    to their medians. Groups agree where their fields are within PASS of each other; a session needs two that do. Above QUARANTINE it is put aside. Sessions outside the calendar (session) are put aside, sessions of it without any row are missing.
    """
    rows = captures.withColumn("__why", row_reasons())
    ok = rows.where(F.size("__why") == 0)
    median = lambda c: F.percentile(c, F.lit(0.5)).alias(c)
    groups = ok.groupBy("session", "grp", "provider").agg(*map(median, FIELDS)).groupBy("session", "grp").agg(*map(median, FIELDS))
    bars = F.sort_array(F.collect_list(F.struct("grp", *FIELDS)))
    votes = groups.groupBy("session").agg(bars.alias("g"))
    near = lambda a, b, limits: F.forall(F.array(*[F.struct(F.lit(limits["volume" if f == "volume" else "price"]).alias("most"), F.abs(a[f] - b[f]).alias("d"), F.greatest(F.abs(a[f]), F.abs(b[f])).alias("of")) for f in FIELDS]), lambda x: x["d"] <= x["most"] * x["of"])
    # A group's voice counts where some other group agrees with it; three that agree only along a chain are no consensus.
    votes = votes.withColumn("agree", F.filter("g", lambda a: F.exists("g", lambda b: (a["grp"] != b["grp"]) & near(a, b, PASS))))
    votes = votes.withColumn("whole", F.forall("agree", lambda a: F.forall("agree", lambda b: near(a, b, PASS))))
    each = lambda groups, f: F.transform(groups, lambda a: a[f])
    values = {f: each("agree", f) for f in FIELDS}
    votes = votes.withColumns({f"{f}_spread": spread(each("g", f)) for f in FIELDS})
    mid = lambda xs: F.try_divide(F.element_at(F.sort_array(xs), F.floor((F.size(xs) + 1) / 2).cast("int")) + F.element_at(F.sort_array(xs), F.floor(F.size(xs) / 2).cast("int") + 1), F.lit(2.0))
    good = (F.size("agree") >= 2) & F.col("whole")
    votes = votes.withColumns({"n_groups": F.size("g"), "n_agree": F.size("agree")} | {f: F.when(good, mid(values[f])) for f in FIELDS})
    far = F.greatest(*[F.col(f"{f}_spread") / QUARANTINE["volume" if f == "volume" else "price"] for f in FIELDS]) > 1
    bad = rows.groupBy("session").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("__why")))).alias("row_reasons"))
    out = bad.join(votes, "session", "left")
    if sessions is not None:
        out = out.join(sessions.select("session", F.lit(True).alias("__known")), "session", "full")
    else:
        out = out.withColumn("__known", F.lit(True))
    known = F.coalesce("__known", F.lit(False))
    have = F.coalesce(F.col("n_groups"), F.lit(0))
    reasons = F.array_sort(F.array_compact(F.array(
        F.when(~known, F.lit("outside_calendar")), F.when(known & (have < 2), F.lit("too_few_groups")), F.when((have >= 2) & (F.size("agree") < 2), F.lit("no_agreement")),
        F.when((F.size("agree") >= 2) & ~F.col("whole"), F.lit("bridge_only")), F.when(far & (have >= 2), F.lit("wide_spread")),
    )))
    accepted = known & F.coalesce(F.col("close").isNotNull(), F.lit(False))
    status = F.when(~known, "quarantined").when(have == 0, "missing").when(accepted & ~F.coalesce(far, F.lit(False)), "accepted").when(accepted, "accepted_with_warning").otherwise("quarantined")
    return out.select("session", status.alias("status"), have.alias("n_groups"), F.coalesce("n_agree", F.lit(0)).alias("n_agree"), *[F.when(accepted, F.col(f)).alias(f) for f in FIELDS], *[f"{f}_spread" for f in FIELDS], reasons.alias("reasons"), F.coalesce("row_reasons", F.array().cast("array<string>")).alias("row_reasons"))
