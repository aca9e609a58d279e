"""Streaming forms: bars from events, and sessions and levels that carry state from bar to bar.

State holds a few numbers a key; the step is the one that the batch operators fold, so a stream
replayed from the start gives the batch's rows.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickwell.operators.conformal import GAMMAS, Levels
from tickwell.operators.ledger import CURVE, STATE, RiskLimits, Session


def bars(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Bars of a stream of (event_type, ts, event_id, value): a bar is final once the watermark has passed it; later events are dropped by the watermark."""
    at = F.struct("ts", "event_id")
    rows = events.where("value > 0").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", width), F.col("event_type").alias("symbol")).agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return out.select("symbol", F.col("window.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


def known_at(rows: DataFrame, cutoff: str, available: str = "available_at") -> DataFrame:
    """Rows that were known by the cutoff: no later fact may take part."""
    return rows.where(F.col(available) <= F.lit(cutoff).cast("timestamp"))


def sessions(targets: DataFrame, capital: float = 10_000.0, limits: RiskLimits | None = None, **book: float) -> DataFrame:
    """The curve of one session for each symbol over a stream of (symbol, ts, close, target). Bars of one micro-batch are taken in time order; a bar older than the last one is not taken again."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session, last = Session.new(capital, limits, **book), None
        if state.exists:
            *kept, last = state.get
            session.resume(tuple(kept))
        out = []
        for ts, close, target in pd.concat(list(frames)).sort_values("ts")[["ts", "close", "target"]].itertuples(index=False):
            if last is not None and ts.value <= last:
                continue
            if (row := session.step(ts, float(close), float(target))) is None:
                break
            last = ts.value
            out.append((*key, *row))
        if last is not None:
            state.update((*session.state(), last))
        yield pd.DataFrame(out, columns=["symbol", *(c.split()[0] for c in CURVE.split(", "))])

    return targets.groupBy("symbol").applyInPandasWithState(step, f"symbol string, {CURVE}", f"{STATE}, last long", "append", GroupStateTimeout.NoTimeout)


def aci_levels(misses: DataFrame, target: float = 0.1, gamma: float = 0.01) -> DataFrame:
    """The level after each row of a stream of (symbol, ts, miss)."""
    return _levels(misses, target, (gamma,), 0.0)


def dtaci_levels(misses: DataFrame, target: float = 0.1, eta: float = 0.1) -> DataFrame:
    """The same for several step sizes, weighted by their losses."""
    return _levels(misses, target, GAMMAS, eta)


def _levels(misses: DataFrame, target: float, steps: tuple[float, ...], eta: float) -> DataFrame:
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        levels = Levels(target, steps, eta, *(state.get if state.exists else ()))
        rows = pd.concat(list(frames)).sort_values("ts")
        rows["alpha"] = levels.feed(rows["miss"].to_numpy())
        state.update((levels.level.tolist(), levels.loss.tolist()))
        yield rows[["symbol", "ts", "alpha"]]

    return misses.groupBy("symbol").applyInPandasWithState(step, "symbol string, ts timestamp_ntz, alpha double", "level array<double>, loss array<double>", "append", GroupStateTimeout.NoTimeout)


def halted(flag: str) -> bool:
    """Whether a halt file stops new cycles."""
    return os.path.exists(flag)


def cycle(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, halt_flag: str | None = None) -> StreamingQuery | None:
    """One poll: take what has arrived since the last one, hand each micro-batch to ``work``, stop. Nothing while halted."""
    if halt_flag and halted(halt_flag):
        return None
    query = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
