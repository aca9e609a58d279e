"""Signals and strategy targets, as columns; holds and freezes over trade constraints."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwell.functions import windows as W
from tickwell.operators import indicators as I
from tickwell.operators import market_rules as M


def dual_ma(fast: int = 20, slow: int = 60, field: str = "close") -> Column:
    """1 while the fast average is above the slow one, else 0 (also before both are full)."""
    return F.coalesce(W.mean(field, fast, fast) > W.mean(field, slow, slow), F.lit(False)).cast("double")


def dual_ma_targets(fast: int = 8, slow: int = 21, leverage: float = 2.0) -> Column:
    a, b = W.mean("close", fast, fast), W.mean("close", slow, slow)
    return F.when(a > b, leverage).when(a < b, -leverage).otherwise(0.0)


def tsmom_targets(lookback: int = 168, leverage: float = 1.5, threshold: float = 0.0, long_only: bool = False) -> Column:
    """Sign of the return over ``lookback`` bars, where it is at least ``threshold`` in size."""
    r = I.change("close", lookback)
    big = F.abs(r) >= threshold
    return F.when(big & (r > 0), leverage).when(big & (r < 0), 0.0 if long_only else -leverage).otherwise(0.0)


def bollinger_targets(n: int = 20, k: float = 2.0, leverage: float = 1.5) -> Column:
    _, upper, lower = I.bollinger("close", n, k)
    return F.when(F.col("close") > upper, leverage).when(F.col("close") < lower, -leverage).otherwise(0.0)


def rsi_targets(bars: DataFrame, n: int = 14, overbought: float = 70.0, oversold: float = 30.0, leverage: float = 1.5) -> DataFrame:
    """Adds ``target``: with the move at either end of the RSI."""
    return I.strategy_rsi(bars, n).withColumn("target", F.when(F.col("rsi") >= overbought, leverage).when(F.col("rsi") <= oversold, -leverage).otherwise(0.0)).drop("rsi")


def rsi_reversion(bars: DataFrame, n: int = 14, low: float = 30.0, high: float = 70.0) -> DataFrame:
    """Adds ``signal``: 1 from an RSI below ``low`` until one above ``high``; held in between, 0 at first."""
    rows = I.exponential(bars, spans=(), rsi=n)
    event = F.when(F.col(f"rsi_{n}") < low, 1.0).when(F.col(f"rsi_{n}") > high, 0.0)
    return rows.withColumn("signal", F.coalesce(W.filled(event), F.lit(0.0))).select(*bars.columns, "signal")


@dataclass(frozen=True)
class Strategy:
    """A named rule and its parameters: ``apply`` adds ``target`` to bars."""

    name: str
    params: dict

    def apply(self, bars: DataFrame) -> DataFrame:
        if self.name == "rsi":
            return rsi_targets(bars, **self.params)
        rule = {"dual_ma": dual_ma_targets, "tsmom": tsmom_targets, "bollinger": bollinger_targets}[self.name]
        return bars.withColumn("target", rule(**self.params))


#: Other names of strategies.
_ALIASES = {"ma": "dual_ma", "dualma": "dual_ma", "momentum": "tsmom", "bb": "bollinger", "bbands": "bollinger"}


def strategy(name: str, **params: float) -> Strategy:
    """By name or alias; ``tsmom_long`` is tsmom over 168 bars, long only, at leverage 1."""
    key = name.strip().lower()
    if key == "tsmom_long":
        return Strategy("tsmom", {"lookback": 168, "leverage": 1.0, "long_only": True, **params})
    key = _ALIASES.get(key, key)
    if key not in ("dual_ma", "tsmom", "rsi", "bollinger"):
        raise ValueError(f"unknown strategy {name!r}")
    return Strategy(key, dict(params))


def constrained(bars: DataFrame, signal: str = "signal", board: str = "main", block_suspended: bool = True) -> DataFrame:
    """Adds ``signal_ok``: the signal in [0, 1], with increases only on bars that can be bought, cuts only on bars that can be sold, and holds over suspensions. One symbol's bars are one group, in which each bar depends on the last."""
    flags = M.annotate(bars, board)
    schema = T.StructType([*bars.schema.fields, T.StructField("signal_ok", T.DoubleType())])

    def run(one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values("ts")
        held, out = 0.0, []
        for want, halted, buy, sell in zip(one[signal].fillna(0.0).clip(0.0, 1.0), one["is_suspended"], one["can_buy"], one["can_sell"], strict=True):
            if not (block_suspended and halted) and (abs(want - held) <= 1e-12 or (buy if want > held else sell)):
                held = float(want)
            out.append(held)
        one["signal_ok"] = out
        return one[schema.fieldNames()]

    return flags.groupBy("symbol").applyInPandas(run, schema)
