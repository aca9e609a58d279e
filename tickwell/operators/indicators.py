"""Indicators of bars. Windows are native columns; exponential averages run per symbol in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwell.functions import windows as W


def change(c: Column | str, n: int = 1) -> Column:
    """x[t] / x[t - n] - 1; null on a zero base."""
    return F.try_divide(W.col(c), W.lag(c, n)) - 1


def log_return(c: Column | str) -> Column:
    ratio = F.try_divide(W.col(c), W.lag(c))
    return F.when(ratio > 0, F.log(ratio))


def forward_return(c: Column | str, n: int = 5) -> Column:
    return F.try_divide(W.lead(c, n), W.col(c)) - 1


def sma(c: Column | str, n: int) -> Column:
    return W.mean(c, n, n)


def bollinger(c: Column | str = "close", n: int = 20, k: float = 2.0) -> tuple[Column, Column, Column]:
    mid, dev = sma(c, n), W.std(c, n, n)
    return mid, mid + k * dev, mid - k * dev


def true_range() -> Column:
    """Largest of the bar's range and its distances from the previous close; the first bar has its range alone."""
    before = W.lag("close")
    return F.greatest(F.abs(F.col("high") - F.col("low")), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def atr(bars: DataFrame, n: int = 14, name: str = "atr") -> DataFrame:
    return bars.withColumn("__tr", true_range()).withColumn(name, W.mean("__tr", n, n)).drop("__tr")


def ewm(series: pd.Series, alpha: float, least: int = 0) -> pd.Series:
    return series.ewm(alpha=alpha, adjust=False, min_periods=least).mean()


def exponential(bars: DataFrame, spans: tuple[int, ...] = (12, 26), macd: tuple[int, int, int] = (12, 26, 9), rsi: int = 14, field: str = "close") -> DataFrame:
    """Adds ``ema_<span>``, ``macd``, ``macd_signal``, ``macd_hist`` and ``rsi_<n>``.

    Averages start at the first value and are not bias-adjusted. RSI (Wilder) is null before ``n``
    changes and where no change was a loss. One symbol's bars are one group.
    """
    names = [*(f"ema_{s}" for s in spans), "macd", "macd_signal", "macd_hist", f"rsi_{rsi}"]
    schema = T.StructType([*bars.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values("ts")
        x = one[field].astype(float)
        average = lambda v, span: ewm(v, 2 / (span + 1))
        for s in spans:
            one[f"ema_{s}"] = average(x, s)
        line = average(x, macd[0]) - average(x, macd[1])
        one["macd"], one["macd_signal"] = line, average(line, macd[2])
        one["macd_hist"] = line - one["macd_signal"]
        delta = x.diff()
        up, down = ewm(delta.clip(lower=0), 1 / rsi, rsi), ewm(-delta.clip(upper=0), 1 / rsi, rsi)
        one[f"rsi_{rsi}"] = 100 - 100 / (1 + up / down.where(down != 0))
        return one

    return bars.groupBy("symbol").applyInPandas(run, schema)


def strategy_rsi(bars: DataFrame, n: int = 14, field: str = "close") -> DataFrame:
    """Wilder RSI as strategies read it: 100 without losses, 0 without gains, null without either. Adds ``rsi``."""
    schema = T.StructType([*bars.schema.fields, T.StructField("rsi", T.DoubleType())])

    def run(one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values("ts")
        delta = one[field].astype(float).diff()
        up, down = ewm(delta.clip(lower=0), 1 / n, n), ewm(-delta.clip(upper=0), 1 / n, n)
        rsi = 100 - 100 / (1 + up / down.where(down > 0))
        one["rsi"] = rsi.mask((down == 0) & (up > 0), 100.0).mask((down == 0) & (up == 0))
        return one

    return bars.groupBy("symbol").applyInPandas(run, schema)


def core_pack(bars: DataFrame) -> DataFrame:
    """SMA 20/50/200, EMA 12/26, RSI 14, MACD, Bollinger 20, ATR 14, returns over 1/5/20 bars and their deviation over 20."""
    mid, upper, lower = bollinger()
    out = exponential(bars).withColumns({**{f"sma_{n}": sma("close", n) for n in (20, 50, 200)}, "bb_mid": mid, "bb_upper": upper, "bb_lower": lower, **{f"ret_{n}": change("close", n) for n in (1, 5, 20)}, "__tr": true_range()})
    return out.withColumns({"atr_14": W.mean("__tr", 14, 14), "vol_20": W.std("ret_1", 20, 20)}).drop("__tr")


def feature_frame(bars: DataFrame) -> DataFrame:
    """The core pack, the return of the next five bars, and the distances from the 20- and 50-bar averages."""
    return core_pack(bars).withColumns({"fwd_ret_5": forward_return("close", 5), "dist_sma20": F.try_divide(F.col("close"), F.col("sma_20")) - 1, "dist_sma50": F.try_divide(F.col("close"), F.col("sma_50")) - 1})
