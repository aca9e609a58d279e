"""Conformal prediction: scores, quantiles, and levels that adapt to the misses of a series."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Step sizes of the experts.
GAMMAS = (0.001, 0.005, 0.01, 0.05, 0.1)
_RANGE = (1e-4, 1 - 1e-4)
#: A rank is bracketed by approximate quantiles this far below and above it; groups of up to _WHOLE scores are their own bracket.
_APART, _ACCURACY, _WHOLE = 0.002, 10_000, 4_000


def quantile(scores: DataFrame, score: str = "score", alpha: float = 0.1, by: tuple[str, ...] = ()) -> DataFrame:
    """(n, quantile): the order statistic with finite-sample coverage 1 - alpha; unknown scores do not count.

    Exact, without a list or a sort of a whole group: approximate quantiles (their error of rank is bounded) give a
    bracket around the wanted rank, what lies below is counted, and only distinct scores in the bracket are put in order.
    """
    key = list(by) or ["__all"]
    s = scores.where(F.col(score).isNotNull()).select(*(by or [F.lit(0).alias("__all")]), F.col(score).alias("__x"))
    n = F.col("n")
    ends = F.percentile_approx("__x", [max(0.0, 1 - alpha - _APART), min(1.0, 1 - alpha + _APART)], _ACCURACY)
    groups = s.groupBy(*key).agg(F.count("__x").alias("n"), F.min("__x").alias("__min"), F.max("__x").alias("__max"), ends.alias("__ends"))
    level = F.least(F.lit(1.0), F.ceil(F.round((n + 1) * (1 - alpha), 9)) / n)
    groups = groups.select(
        *key, "n", (F.ceil(F.round(level * (n - 1), 9)) + 1).alias("__rank"),
        F.when(n <= _WHOLE, F.col("__min")).otherwise(F.col("__ends")[0]).alias("__low"), F.when(n <= _WHOLE, F.col("__max")).otherwise(F.col("__ends")[1]).alias("__high"),
    )
    near = s.join(groups if by else F.broadcast(groups), key)  # without groups: one row
    counts = near.where("__x <= __high").groupBy(*key, "n", "__rank", F.when(F.col("__x") >= F.col("__low"), F.col("__x")).alias("__x")).agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*key).orderBy(F.asc_nulls_first("__x")).rowsBetween(Window.unboundedPreceding, 0))
    out = counts.withColumn("__upto", upto).where("__upto >= __rank").groupBy(*key, "n").agg(F.min("__x").alias("quantile"))
    return out if by else out.drop("__all")


def interval(center: Column, q: Column | float, sigma: Column) -> tuple[Column, Column]:
    return center - q * sigma, center + q * sigma


def lagged_volatility(x: np.ndarray, halflife: float = 20.0, floor: float = 1e-8, known: int = 5) -> np.ndarray:
    """Deviation around the exponentially weighted mean as it stood one bar earlier, unbiased for its weights.

    A value that lies k bars back weighs 2 ** (-k / halflife); unknown ones weigh nothing. Before ``known``
    values there is no deviation, and the bars before the first one take that.
    """
    fade = 0.5 ** (1 / halflife)
    there = ~np.isnan(x)
    value = np.where(there, x, 0.0)
    faded = lambda add, by: np.fromiter(accumulate(add, lambda old, new: by * old + new), float, len(x))
    weight, squares = faded(there.astype(float), fade), faded(there.astype(float), fade * fade)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = faded(value, fade) / weight
        spread = np.maximum(faded(value * value, fade) / weight - mean * mean, 0.0) / (1 - squares / (weight * weight))
    out = np.full(len(x), np.nan)
    out[1:] = np.where(np.cumsum(there) >= known, np.sqrt(spread), np.nan)[:-1]
    first = np.flatnonzero(~np.isnan(out))
    if len(first):
        out[: first[0]] = out[first[0]]
    return np.fmax(out, floor) if len(first) else out


def standardized_scores(df: DataFrame, residual: str, halflife: float = 20.0) -> DataFrame:
    """Adds ``sigma`` and ``score`` = size of the residual over it, per symbol."""
    schema = T.StructType([*df.schema.fields, T.StructField("sigma", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def run(one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values("ts")
        one["sigma"] = lagged_volatility(one[residual].to_numpy(float), halflife)
        one["score"] = one[residual].abs() / one["sigma"]
        return one

    return df.groupBy("symbol").applyInPandas(run, schema)


class Levels:
    """Error levels of experts with a step size each, fed with misses; what it gives is their mean, weighted by their losses.

    By the definition of the pinball loss, a miss costs an expert (1 - target) times its level, and a hit target
    times what its level leaves of 1. All rows fed at once are one array of rows by experts; ``level`` and
    ``loss`` carry over to the next rows.
    """

    def __init__(self, target: float = 0.1, steps: Sequence[float] = GAMMAS, eta: float = 0.1, level: Sequence[float] | None = None, loss: Sequence[float] | None = None) -> None:
        self.target, self.steps, self.eta = target, np.array(steps), eta
        self.level = np.full(len(steps), target) if level is None else np.array(level, float)
        self.loss = np.zeros(len(steps)) if loss is None else np.array(loss, float)

    def feed(self, misses: np.ndarray) -> np.ndarray:
        """The level after each of ``misses``."""
        missed = np.asarray(misses, bool)[:, None]
        pushes = self.steps * (self.target - missed)
        path = np.array(list(accumulate(pushes, lambda level, push: np.clip(level + push, *_RANGE), initial=self.level)))
        cost = np.where(missed, (1 - self.target) * path[:-1], self.target * (1 - path[:-1]))
        losses = self.loss + np.cumsum(cost, axis=0)
        if len(cost):
            self.level, self.loss = path[-1], losses[-1]
        share = np.exp(self.eta * (losses.min(axis=1, keepdims=True) - losses))
        return (share * path[1:]).sum(axis=1) / share.sum(axis=1)


def aci_path(misses: DataFrame, target: float = 0.1, gamma: float = 0.01, miss: str = "miss") -> DataFrame:
    """Adds ``alpha``: one expert's level after each row of a symbol's misses (0 or 1). One symbol's rows are one group."""
    return _path(misses, miss, target, (gamma,), 0.0)


def dtaci_path(misses: DataFrame, target: float = 0.1, eta: float = 0.1, miss: str = "miss") -> DataFrame:
    return _path(misses, miss, target, GAMMAS, eta)


def _path(df: DataFrame, miss: str, target: float, steps: tuple[float, ...], eta: float) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField("alpha", T.DoubleType())])

    def run(one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values("ts")
        return one.assign(alpha=Levels(target, steps, eta).feed(one[miss].to_numpy()))

    return df.groupBy("symbol").applyInPandas(run, schema)


def weight_policy(df: DataFrame, weight: str = "weight", ret: str = "ret", alpha: float = 0.1, halflife: float = 20.0, gamma: float = 0.01, low: float = 0.1, high: float = 1.0) -> DataFrame:
    """Adds ``scale`` and ``scaled_weight``: each symbol's weight by how its last return fell in its interval. The first row keeps its weight. A miss lowers the level, so the scale rises."""
    schema = T.StructType([*df.schema.fields, T.StructField("scale", T.DoubleType()), T.StructField("scaled_weight", T.DoubleType())])
    normal = NormalDist()

    def run(one: pd.DataFrame) -> pd.DataFrame:
        one, levels, now, scale = one.sort_values("ts"), Levels(alpha, eta=gamma * 10), alpha, [1.0]
        r = one[ret].to_numpy(float)
        for z in (np.abs(r) / lagged_volatility(r, halflife))[:-1]:
            now = float(levels.feed([not z <= normal.inv_cdf(1 - now / 2)])[0])
            scale.append(low + (high - low) * min(1.0, max(0.0, 1 - now)))
        one["scale"] = scale[: len(one)]
        one["scaled_weight"] = one[weight] * one["scale"]
        return one

    return df.groupBy("symbol").applyInPandas(run, schema)
