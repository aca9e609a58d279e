"""Scoring, filtering and choosing a universe; headline sentiment."""

from __future__ import annotations

import math
from collections.abc import Sequence

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwell.functions import windows as W
from tickwell.operators import cross_section as X
from tickwell.operators import indicators as I

#: Weights of the scores of each mode.
MODES = {
    "momentum": {"ret_60": 0.7, "mom_quality": 0.3},
    "quality_trend": {"mom_quality": 0.4, "trend_bull": 0.3, "low_vol": 0.3},
    "mean_reversion": {"low_rsi": 1.0, "low_ret": 0.5},
    "composite": {"ret_60": 0.35, "mom_quality": 0.25, "trend_bull": 0.2, "low_vol": 0.1, "dist_sma50": 0.1},
}
#: Words of good and of bad news.
POSITIVE = ("利好", "上涨", "突破", "创新高", "超预期", "增长", "盈利", "买入", "推荐", "看多", "反弹", "放量", "涨停", "利好消息", "利多", "bullish", "upgrade", "beat", "outperform", "buy", "strong")
NEGATIVE = ("利空", "下跌", "跌破", "创新低", "不及预期", "下降", "亏损", "卖出", "减持", "看空", "暴跌", "缩量", "跌停", "利空消息", "bearish", "downgrade", "miss", "underperform", "sell", "weak")


def score_universe(bars: DataFrame, mode: str = "composite", asof: str | None = None, momentum: int = 60, volatility: int = 20, fast: int = 20, slow: int = 50) -> DataFrame:
    """A row for each symbol with enough bars: features of its last bar, ``score`` and ``rank`` (ties to the smaller symbol)."""
    rows = bars.select("symbol", "ts", "close")
    rows = rows.where(F.col("ts") <= F.lit(asof).cast("timestamp_ntz")) if asof else rows
    rows = I.exponential(rows, spans=(), rsi=14).withColumn("__r", I.change("close"))
    sma_s = W.mean("close", slow)
    rows = rows.withColumns({
        "ret_20": I.change("close", 20), "ret_60": I.change("close", momentum), "vol_ann": W.std("__r", volatility, volatility - 1) * math.sqrt(252), "dist_sma50": F.try_divide(F.col("close"), sma_s) - 1,
        "trend_bull": (W.mean("close", fast) > sma_s).cast("double"), "__n": F.row_number().over(W.ordered()), "__last": F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts"))),
    })
    last = rows.where((F.col("__last") == 1) & (F.col("__n") >= max(momentum, slow) + 5))
    last = last.withColumn("mom_quality", F.when(F.col("vol_ann") > 1e-8, F.col("ret_60") / F.col("vol_ann")))
    parts = {"low_vol": -F.col("vol_ann"), "low_rsi": -F.col("rsi_14"), "low_ret": -F.col("ret_20")}
    every = Window.partitionBy(F.lit(0))  # a row for each symbol
    score = F.lit(0.0)
    for c, weight in MODES[mode].items():
        x = parts.get(c, F.col(c))
        sd = F.stddev_pop(x).over(every)
        score = score + weight * F.when(F.coalesce(sd, F.lit(0.0)) == 0, 0.0 * x).otherwise((x - F.avg(x).over(every)) / F.nullif(sd, F.lit(0.0)))
    last = last.withColumn("score", score)
    keep = ["symbol", F.col("ts").alias("asof"), "close", "ret_20", "ret_60", "vol_ann", "mom_quality", "dist_sma50", "trend_bull", "rsi_14", "score"]
    return last.select(*keep, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("score"), "symbol")).alias("rank"))


def filters(scores: DataFrame, min_price: float | None = 5.0, max_vol: float | None = 1.2, uptrend: bool = False, min_ret_60: float | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """Adds ``reject_reason``: the first rule that a row breaks, in this order; null if none. A missing value breaks none."""
    rules = []
    if min_price is not None:
        rules.append((F.col("close") < min_price, f"price<{min_price}"))
    if max_vol is not None:
        rules.append((F.col("vol_ann") > max_vol, f"vol>{max_vol}"))
    if uptrend:
        rules.append((F.col("trend_bull") < 0.5, "not_uptrend"))
    if min_ret_60 is not None:
        rules.append((F.col("ret_60") < min_ret_60, f"ret60<{min_ret_60}"))
    if exclude:
        rules.append((F.col("symbol").isin(list(exclude)), "excluded"))
    return scores.withColumn("reject_reason", F.coalesce(*[F.when(t, F.lit(r)) for t, r in rules], F.lit(None).cast("string")))


def select(bars: DataFrame, n: int = 5, mode: str = "composite", scheme: str = "equal", max_weight: float = 0.35, **rules: float) -> DataFrame:
    """Scores with their reject reasons and target weights: the n best of those that pass, others 0."""
    scored = filters(score_universe(bars, mode), **rules)
    best = X.top_n(scored.where("reject_reason IS NULL"), "score", n, "symbol", scheme=scheme, max_weight=max_weight)
    return scored.join(best.select("symbol", F.col("weight").alias("target_weight")), "symbol", "left").withColumn("target_weight", F.coalesce("target_weight", F.lit(0.0)))


def sentiment(text: Column) -> Column:
    """(good - bad) / (good + bad) of how many of the words occur anywhere in the lower-cased text; 0 where none does."""
    low = F.lower(F.coalesce(text, F.lit("")))
    count = lambda words: reduce(lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("int") for w in words])
    good, bad = count(POSITIVE), count(NEGATIVE)
    return F.coalesce(F.try_divide(good - bad, F.nullif(good + bad, F.lit(0))), F.lit(0.0)).cast("double")


def sentiment_factor(headlines: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """(symbol, sentiment), the mean over a symbol's headlines (symbol, text); with ``dates`` (ts) one row for each of them too."""
    out = headlines.groupBy("symbol").agg(F.avg(sentiment(F.col("text"))).alias("sentiment"))
    return out if dates is None else out.crossJoin(dates.select("ts").distinct())
