"""Lead-lag study between two markets: designs by joins and windows, one regression task a specification."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickwell.operators.inference import benjamini_hochberg

#: The family of specifications.
WINDOWS, HORIZONS, OUTCOMES = (63, 126, 252), (1, 2, 3, 4, 5), ("gap", "intraday", "total")


def consensus_returns(bars: DataFrame) -> DataFrame:
    """(symbol, ts, gap, intraday, total): ln(open / previous close), ln(close / open) and ln(close / previous close)."""
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("ts"))
    log = lambda a, b: F.when((a > 0) & (b > 0), F.log(a / b))
    return bars.select("symbol", "ts", log(F.col("open"), before).alias("gap"), log(F.col("close"), F.col("open")).alias("intraday"), log(F.col("close"), before).alias("total"))


def designs(target: DataFrame, links: DataFrame, driver: DataFrame, controls: DataFrame | None = None) -> DataFrame:
    """Complete rows of every specification: (window, horizon, outcome, pos, end_pos, y, x).

    ``target``: (session, gap, intraday) on its own calendar; ``links``: (source_session, target_session);
    ``driver`` and ``controls``: (session, value), on source sessions. x is 1, the driver at the linked source session, the control if
    given, and the target's own last total. A row needs every outcome up to its horizon, and its base to lie in the window's last sessions.
    """
    at = Window.partitionBy(F.lit(0)).orderBy("session")  # one row a session of one market
    rows = target.withColumns({"pos": F.row_number().over(at) - 1, "last": F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) - 1, "own": F.lag(F.col("gap") + F.col("intraday")).over(at)})
    ahead = lambda c, h: F.when(F.count(c).over(at.rowsBetween(0, h - 1)) == h, F.sum(c).over(at.rowsBetween(0, h - 1)))
    values = {"gap": F.col("gap"), "intraday": F.col("intraday"), "total": F.col("gap") + F.col("intraday")}
    ys = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(o).alias("outcome"), ahead(values[o], h).alias("y")) for h in HORIZONS for o in OUTCOMES])
    rows = rows.withColumn("ys", ys).join(links.select(F.col("target_session").alias("session"), "source_session"), "session").join(driver.select(F.col("session").alias("source_session"), F.col("value").alias("driver")), "source_session")
    xs = [F.lit(1.0), F.col("driver")]
    if controls is not None:
        rows = rows.join(controls.select(F.col("session").alias("source_session"), F.col("value").alias("control")), "source_session")
        xs.append(F.col("control"))
    rows = rows.where("own IS NOT NULL").withColumn("x", F.array(*xs, F.col("own"))).withColumn("s", F.explode("ys")).withColumn("window", F.explode(F.array(*map(F.lit, WINDOWS))))
    rows = rows.select("window", F.col("s.horizon").alias("horizon"), F.col("s.outcome").alias("outcome"), "pos", (F.col("pos") + F.col("s.horizon") - 1).alias("end_pos"), F.col("s.y").alias("y"), "x", "last")
    return rows.where((F.col("y").isNotNull()) & (F.col("pos") > F.col("last") - F.col("window")) & F.forall("x", lambda v: v.isNotNull())).drop("last")


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(x, y, rcond=None)[0]


def _resampled(n: int, block: int, draws: int, rng: np.random.Generator) -> np.ndarray:
    """(draws, n) positions of a stationary bootstrap."""
    fresh = rng.random((draws, n)) < 1 / min(block, n)
    fresh[:, 0] = True
    run_from = np.maximum.accumulate(np.where(fresh, np.arange(n), 0), axis=1)
    starts = rng.integers(0, n, (draws, n))
    return (np.take_along_axis(starts, run_from, axis=1) + np.arange(n) - run_from) % n


def estimate(rows: DataFrame, draws: int = 499, block: int = 10, alpha: float = 0.05, least_per_parameter: int = 10, seed: int = 7, oos_train: int = 40, embargo: int = 5) -> DataFrame:
    """A row for each specification: n, coefficient, standardized, low, high, p, oos_improvement, break_p. Too few observations or a singular design leave nulls and p = 1. Seeds come from the specification, so results do not depend on where a task runs."""
    schema = "window int, horizon int, outcome string, n long, coefficient double, standardized double, low double, high double, p double, oos_improvement double, break_p double"

    def run(key: tuple, one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values("pos")
        x, y = np.stack(one["x"].to_numpy()), one["y"].to_numpy()
        n, k = x.shape
        none = pd.DataFrame([(*key, n, None, None, None, None, 1.0, None, None)], columns=[c.split()[0] for c in schema.split(", ")])
        if n < least_per_parameter * k or np.linalg.matrix_rank(x) < k:
            return none
        beta, null = _fit(x, y), np.delete(x, 1, axis=1)
        base = _fit(null, y)
        rest, rest0 = y - x @ beta, y - null @ base
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256(repr((seed, *key)).encode()).digest()[:8], "big"))
        pick = _resampled(n, block, draws, rng)
        pinv = np.linalg.pinv(x)[1]
        boot = beta[1] + (rest - rest.mean())[pick] @ pinv
        fake = (null @ base) @ pinv + (rest0 - rest0.mean())[pick] @ pinv
        p = (1 + int((np.abs(fake) >= abs(beta[1])).sum())) / (draws + 1)
        scale = y.std(ddof=1)
        full, plain = [], []
        pos, end = one["pos"].to_numpy(), one["end_pos"].to_numpy()
        for i in range(n):
            old = np.flatnonzero(end[:i] < pos[i] - embargo)
            if len(old) >= max(oos_train, least_per_parameter * k):
                full.append((y[i] - x[i] @ _fit(x[old], y[old])) ** 2)
                plain.append((y[i] - null[i] @ _fit(null[old], y[old])) ** 2)
        better = 1 - np.mean(full) / np.mean(plain) if full and np.mean(plain) > 0 else None
        half, shift = n // 2, None
        if half > k:
            change = lambda v: _fit(x[half:], v[half:])[1] - _fit(x[:half], v[:half])[1]
            fitted, own = x @ beta, abs(change(y))
            shift = (1 + sum(abs(change(fitted + (rest - rest.mean())[row])) >= own for row in pick[:199])) / (len(pick[:199]) + 1)
        return pd.DataFrame([(*key, n, beta[1], beta[1] * x[:, 1].std(ddof=1) / scale if scale else None, *np.quantile(boot, [alpha / 2, 1 - alpha / 2]), p, better, shift)], columns=none.columns)

    return rows.groupBy("window", "horizon", "outcome").applyInPandas(run, schema)


def family(estimates: DataFrame) -> DataFrame:
    """All specifications in order, missing ones with p = 1, with family-wide q-values."""
    spark = estimates.sparkSession
    every = spark.createDataFrame([(i, w, h, o) for i, (w, h, o) in enumerate((w, h, o) for w in WINDOWS for h in HORIZONS for o in OUTCOMES)], "id int, window int, horizon int, outcome string")
    rows = every.join(estimates, ["window", "horizon", "outcome"], "left").withColumns({"p": F.coalesce("p", F.lit(1.0)), "n": F.coalesce("n", F.lit(0))})
    return benjamini_hochberg(rows, "p")


def half_life(rows: DataFrame) -> DataFrame:
    """(window, outcome, half_life): ln 2 over the decay of the sizes of marginal responses, relative to the first one, over horizons; null unless every horizon has a coefficient and the sizes fall."""
    w = Window.partitionBy("window", "outcome").orderBy("horizon")
    step = F.col("coefficient") - F.coalesce(F.lag("coefficient").over(w), F.lit(0.0))
    rows = rows.withColumn("m", F.abs(step)).withColumns({"base": F.first("m").over(w), "x": F.col("horizon") - 1.0})
    y = F.when((F.col("m") > 1e-12) & (F.col("base") > 1e-12), F.log(F.col("m") / F.nullif(F.col("base"), F.lit(0.0))))
    out = rows.withColumn("ly", y).groupBy("window", "outcome").agg(F.count("coefficient").alias("n"), F.count("ly").alias("k"), F.regr_slope("ly", "x").alias("slope"), F.first("base").alias("base"))
    value = F.when((F.col("n") < len(HORIZONS)) | (F.col("base") <= 1e-12), None).when(F.col("k") < 2, 0.0).when(F.col("slope") < 0, math.log(2) / -F.col("slope"))
    return out.select("window", "outcome", value.alias("half_life"))


def gates(rows: DataFrame, q_most: float = 0.05, standardized_least: float = 0.05) -> DataFrame:
    """Adds ``reasons`` (sorted) and ``status``: identified needs an interval off zero, a q-value, a size, an out-of-sample gain and no break."""
    c, fails = F.col, lambda t, name: F.when(~F.coalesce(t, F.lit(False)), F.lit(name))
    reasons = F.array_sort(F.array_compact(F.array(
        fails((c("low") > 0) | (c("high") < 0), "interval_covers_zero"), fails(c("q_value") <= q_most, "q_value"), fails(F.abs("standardized") >= standardized_least, "small_effect"),
        fails(c("oos_improvement") > 0, "no_oos_gain"), fails(c("break_p") >= 0.05, "break"),
    )))
    return rows.withColumn("reasons", reasons).withColumn("status", F.when(c("coefficient").isNull(), "INSUFFICIENT").when(F.size("reasons") == 0, "IDENTIFIED").otherwise("NOT_IDENTIFIED"))


