"""Factor libraries over bars, as one projection of window columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwell.functions import windows as W
from tickwell.operators import indicators as I

EPS = 1e-12
#: Operators and windows of the 158-factor set, in their published order.
ROLLING = (
    "ROC", "MA", "STD", "BETA", "RSQR", "RESI", "MAX", "MIN", "QTLU", "QTLD", "RANK", "RSV", "IMAX", "IMIN", "IMXD",
    "CORR", "CORD", "CNTP", "CNTN", "CNTD", "SUMP", "SUMN", "SUMD", "VMA", "VSTD", "WVMA", "VSUMP", "VSUMN", "VSUMD",
)
SPANS = (5, 10, 20, 30, 60)


def kbar() -> dict[str, Column]:
    o, h, l, c = map(F.col, ("open", "high", "low", "close"))
    span, top, bottom = h - l + EPS, F.greatest(o, c), F.least(o, c)
    of = F.try_divide
    return {
        "KMID": of(c - o, o), "KLEN": of(h - l, o), "KMID2": of(c - o, span), "KUP": of(h - top, o), "KUP2": of(h - top, span),
        "KLOW": of(bottom - l, o), "KLOW2": of(bottom - l, span), "KSFT": of(2 * c - h - l, o), "KSFT2": of(2 * c - h - l, span),
    }


def prices(fields: Sequence[str] = ("OPEN", "HIGH", "LOW", "VWAP"), lags: Sequence[int] = (0,)) -> dict[str, Column]:
    base = {f: F.col(f.lower()) for f in ("OPEN", "HIGH", "LOW", "CLOSE")} | {"VWAP": (F.col("high") + F.col("low") + F.col("close")) / 3}
    return {f"{f}{d}": F.try_divide(W.lag(base[f], d) if d else base[f], F.col("close")) for f in fields for d in lags}


def volumes(lags: Sequence[int] = (0, 1, 2, 3, 4)) -> dict[str, Column]:
    return {f"VOLUME{d}": (W.lag("volume", d) if d else F.col("volume")) / (F.col("volume") + EPS) for d in lags}


def _prepared(bars: DataFrame) -> DataFrame:
    """Per-bar inputs of the rolling operators, so that each window reads plain columns."""
    c, v, c1, v1 = F.col("close"), F.col("volume"), W.lag("close"), W.lag("volume")
    up = lambda x: F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))
    return bars.withColumns(
        {
            "__i": F.row_number().over(W.ordered()).cast("double"), "__dc": c - c1, "__dv": v - v1, "__up": F.coalesce(c > c1, F.lit(False)).cast("double"), "__down": F.coalesce(c < c1, F.lit(False)).cast("double"),
            "__gc": up(c - c1), "__lc": up(c1 - c), "__gv": up(v - v1), "__lv": up(v1 - v), "__w": F.abs(F.try_divide(c, c1) - 1) * v,
            "__lnv": F.log(v + 1), "__rc": F.try_divide(c, c1), "__rv": F.when(F.try_divide(v, v1) > -1, F.log(F.try_divide(v, v1) + 1)),
        }
    )


def _rolling(op: str, d: int) -> Column:
    c, v = F.col("close"), F.col("volume")
    per = lambda x: F.try_divide(x, c)
    if op == "ROC":
        return per(W.lag("close", d))
    if op == "MA":
        return per(W.mean(c, d))
    if op == "STD":
        return per(W.std(c, d))
    if op in ("BETA", "RSQR", "RESI"):
        slope, fit, rest = W.ols("close", "__i", d)
        flat = F.coalesce(W.std(c, d) <= 2e-5, F.lit(False))
        return per(slope) if op == "BETA" else F.when(~flat, fit) if op == "RSQR" else per(rest)
    if op == "MAX":
        return per(W.highest("high", d))
    if op == "MIN":
        return per(W.lowest("low", d))
    if op in ("QTLU", "QTLD"):
        return per(W.quantile(c, 0.8 if op == "QTLU" else 0.2, d))
    if op == "RANK":
        return W.percent_rank_of_last(c, d)
    if op == "RSV":
        return (c - W.lowest("low", d)) / (W.highest("high", d) - W.lowest("low", d) + EPS)
    if op in ("IMAX", "IMIN", "IMXD"):
        top, bottom = W.place_of_extreme("high", d), W.place_of_extreme("low", d, largest=False)
        return (top if op == "IMAX" else bottom if op == "IMIN" else top - bottom) / d
    if op == "CORR":
        return W.correlation("close", "__lnv", d)
    if op == "CORD":
        return W.correlation("__rc", "__rv", d)
    if op in ("CNTP", "CNTN", "CNTD"):
        up, down = W.mean("__up", d), W.mean("__down", d)
        return up if op == "CNTP" else down if op == "CNTN" else up - down
    if op in ("SUMP", "SUMN", "SUMD", "VSUMP", "VSUMN", "VSUMD"):
        x = "v" if op[0] == "V" else "c"
        gain, loss, size = W.total(f"__g{x}", d), W.total(f"__l{x}", d), W.total(F.abs(F.col(f"__d{x}")), d) + EPS
        return {"P": gain, "N": loss, "D": gain - loss}[op[-1]] / size
    if op == "VMA":
        return W.mean(v, d) / (v + EPS)
    if op == "VSTD":
        return W.std(v, d) / (v + EPS)
    return W.std("__w", d) / (W.mean("__w", d) + EPS)  # WVMA


def alpha158(bars: DataFrame, spans: Sequence[int] = SPANS, include: Sequence[str] | None = None, exclude: Sequence[str] = (), volume: Sequence[int] | None = None) -> DataFrame:
    """(symbol, ts) and the 158 factors: 9 of the candle, 4 prices, 29 rolling operators over each span.

    ``include`` and ``exclude`` choose rolling operators; ``volume`` adds lagged volumes. One window
    sort for all columns; needs a halo of max(spans) bars.
    """
    ops = [op for op in ROLLING if (include is None or op in include) and op not in exclude]
    cols = kbar() | prices() | (volumes(volume) if volume is not None else {}) | {f"{op}{d}": _rolling(op, d) for op in ops for d in spans}
    return _prepared(bars).select("symbol", "ts", *[c.alias(n) for n, c in cols.items()])


def alpha62(bars: DataFrame) -> DataFrame:
    """(symbol, ts) and 62 factors: candle, lagged closes, averages and distances from them, volatility, skew, kurtosis, volume relations, RSI, MACD, bands, ranges. A volume of 0 is missing."""
    c, third = F.col("close"), lambda n, k: max(k, n // 3)
    rows = I.exponential(bars, spans=(), rsi=6)
    for n in (14, 24):
        rows = I.exponential(rows.drop("macd", "macd_signal", "macd_hist"), spans=(), rsi=n)
    rows = rows.withColumns({"__v": F.nullif(F.col("volume"), F.lit(0.0)), "__r": I.log_return("close"), "__ret": I.change("close"), "__tr": I.true_range(), "__range": F.try_divide(F.col("high") - F.col("low"), c)})
    k, v = kbar(), F.col("__v")
    out = {"KMID": k["KMID"], "KLEN": k["KLEN"], "KSFT": k["KMID2"], "KUP": k["KUP"], "KLOW": k["KLOW"], "KSHUP": k["KUP2"], "KSHDN": k["KLOW2"]}
    out |= {f"ROC_{n}": F.try_divide(W.lag("close", n), c) - 1 for n in (1, 2, 3, 5, 10, 20, 30, 60)}
    for n in SPANS:
        average = W.mean(c, n, third(n, 3))
        out |= {f"MA_{n}": average, f"MADEV_{n}": F.try_divide(c - average, F.nullif(average, F.lit(0.0))), f"VOL_{n}": W.std("__r", n, third(n, 3)), f"SKEW_{n}": W.skew("__ret", n), f"KURT_{n}": W.kurtosis("__ret", n)}
    for n in (5, 10, 20):
        both = F.count(F.when(c.isNotNull(), v)).over(W.trailing(n)) >= third(n, 3)
        out |= {f"CORR_VOL_{n}": F.when(both, W.correlation("close", "__v", n, 0.0)), f"VOL_RATIO_{n}": F.try_divide(v, W.mean(v, n, third(n, 3)))}
    out |= {f"RSI_{n}": F.col(f"rsi_{n}") for n in (6, 14, 24)} | {x.upper(): F.col(x) for x in ("macd", "macd_signal", "macd_hist")}
    mid, dev = W.mean(c, 20, 20), W.std(c, 20, 20)
    out |= {"BB_UPPER_20": F.try_divide(mid + 2 * dev - c, c), "BB_LOWER_20": F.try_divide(c - mid + 2 * dev, c), "BB_WIDTH_20": F.try_divide(4 * dev, F.nullif(mid, F.lit(0.0)))}
    out |= {f"ATR_{n}": F.try_divide(W.mean("__tr", n, n), c) for n in (14, 24)}
    out |= {"VOL_CHANGE": F.try_divide(v, W.lag(v)) - 1, "VOL_MA5_RATIO": F.try_divide(v, W.mean(v, 5, 3)), "VOL_MA20_RATIO": F.try_divide(v, W.mean(v, 20, 5)), "RANGE": F.col("__range"), "RANGE_MA5": W.mean("__range", 5, 3)}
    return rows.select("symbol", "ts", *[x.alias(n) for n, x in out.items()])


def style(bars: DataFrame, market_cap: str | None = None) -> DataFrame:
    """(symbol, ts) and six style factors, each a z-score against its own last 60 bars: value, momentum, quality, size, low_vol, liquidity."""
    money = F.col("close") * F.col("volume")
    rows = bars.withColumns({"__ret": I.change("close"), "__money": money})
    log_of = lambda x: F.log(F.when(x.isNotNull(), F.greatest(x, F.lit(1.0))))
    raw = {
        "value": -I.change("close", 60), "momentum": I.change("close", 252) - I.change("close", 21), "quality": -W.std("__ret", 60, 20),
        "size": log_of(F.col(market_cap) if market_cap else W.mean("__money", 60, 20)), "low_vol": -W.std("__ret", 20, 10), "liquidity": log_of(W.mean("__money", 20, 10)),
    }
    rows = rows.withColumns(raw)
    return rows.select("symbol", "ts", *[W.zscore(n, 60).alias(n) for n in raw])


def combine(features: DataFrame, columns: Sequence[str], weights: Sequence[float] | None = None, name: str = "factor_score") -> DataFrame:
    """Adds a composite of trailing z-scores (RSI turned round as 50 - x). Equal weights average what is known; given ones, normed to 1, add and take a missing score as 0."""
    z = [W.zscore(50 - F.col(c) if c.startswith("rsi") else F.col(c)) for c in columns]
    if weights is None:
        known = reduce(lambda a, b: a + b, [x.isNotNull().cast("int") for x in z])
        score = F.try_divide(reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in z]), known)
    else:
        score = reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) * (w / sum(weights)) for x, w in zip(z, weights, strict=True)])
    return features.withColumn(name, score)


def momentum_panel(bars: DataFrame, lookback: int = 20) -> DataFrame:
    return bars.select("symbol", "ts", I.change("close", lookback).alias("signal"))


def dual_ma_panel(bars: DataFrame, fast: int = 20, slow: int = 60) -> DataFrame:
    return bars.select("symbol", "ts", F.coalesce(I.sma("close", fast) > I.sma("close", slow), F.lit(False)).cast("double").alias("signal"))


def expanding_signal(scores: DataFrame, score: str, high: float = 0.7, low: float = 0.3, least: int = 40, long_only: bool = True, short_wins: bool = False) -> DataFrame:
    """Adds ``signal``: 1 above the expanding high quantile, -1 below the low one unless ``long_only``, else 0."""
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(score)
    up = x >= W.quantile(x, high, 0, least, w)
    down = F.lit(False) if long_only else x <= W.quantile(x, low, 0, least, w)
    first, second = ((down, -1.0), (up, 1.0)) if short_wins else ((up, 1.0), (down, -1.0))
    return scores.withColumn("signal", F.when(first[0], first[1]).when(second[0], second[1]).otherwise(0.0))
