"""Vectorised backtests and performance summaries: lags, running products and grouped aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwell.functions import windows as W

#: Two-sided all-in cost of a round trip, as a share of what is traded.
COST_TIERS = {"low": 0.002, "mid": 0.004, "high": 0.005}


def cost_bps(fee_bps: float = 5.0, slippage_bps: float = 0.0, tier: str | None = None, two_sided_bps: float | None = None, cancel_fee: float = 0.0, order_notional: float = 100_000.0) -> float:
    """Basis points charged for each unit of one-sided turnover. A tier or a two-sided rate covers both legs, so half of it is charged; the plain fee and slippage are for one side already. A cancel fee is per order."""
    if tier is not None and two_sided_bps is not None:
        raise ValueError("give a tier or a two-sided rate, not both")
    if tier is not None and tier not in COST_TIERS:
        raise ValueError(f"unknown cost tier {tier!r}")
    if cancel_fee < 0 or (two_sided_bps or 0) < 0 or (cancel_fee > 0 and order_notional <= 0):
        raise ValueError("fees are not negative, and a cancel fee needs an order size")
    base = COST_TIERS[tier] * 1e4 / 2 if tier else two_sided_bps / 2 if two_sided_bps is not None else fee_bps + slippage_bps
    return base + (cancel_fee / order_notional * 1e4 if cancel_fee else 0.0)


def long_only(df: DataFrame, signal: str = "signal", close: str = "close", capital: float = 1.0, by: Sequence[str] = ("symbol",), **costs: float | str) -> DataFrame:
    """Adds ``position``, ``turnover``, ``ret`` and ``equity``. A signal (cut to [-1, 1], null 0) is held from the next bar on."""
    rate, w = cost_bps(**costs) / 1e4, W.ordered(tuple(by))
    target = F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(signal))), F.lit(0.0))
    df = df.where(F.col(close).isNotNull()).withColumn("__t", target)
    df = df.withColumns({"position": F.coalesce(W.lag("__t", 1, w), F.lit(0.0)), "__r": F.coalesce(F.try_divide(F.col(close), W.lag(close, 1, w)) - 1, F.lit(0.0))})
    df = df.withColumn("turnover", F.coalesce(F.abs(F.col("position") - W.lag("position", 1, w)), F.abs("position")))
    df = df.withColumn("ret", F.col("position") * F.col("__r") - F.col("turnover") * rate)
    return df.withColumn("equity", W.compounded("ret", W.expanding(tuple(by))) * capital).drop("__t", "__r")


def rebalance_mask(rule: str, w) -> Column:  # noqa: ANN001
    """Whether a bar is the last of its week, month or quarter, or the last of all; D and none: every bar."""
    if rule in ("D", "none"):
        return F.lit(True)
    key = F.date_trunc({"W": "week", "M": "month", "Q": "quarter"}[rule], F.col("ts"))
    return F.coalesce(key != F.lead(key).over(w), F.lit(True))


def masked(targets: DataFrame, tradeable: DataFrame) -> DataFrame:
    """Targets (symbol, ts, weight) with nothing in what cannot be traded (symbol, ts, tradeable; a missing row cannot).

    Where something is still wanted long, the rest of that time is long only and adds up to one; else its weights stay as they are.
    """
    rows = targets.join(tradeable.select("symbol", "ts", "tradeable"), ["symbol", "ts"], "left")
    free = F.when(F.coalesce("tradeable", F.lit(False)), F.coalesce("weight", F.lit(0.0))).otherwise(0.0)
    rows = rows.withColumn("weight", free).withColumn("__long", F.sum(F.greatest("weight", F.lit(0.0))).over(Window.partitionBy("ts")))
    weight = F.when(F.col("__long") > 0, F.try_divide(F.greatest("weight", F.lit(0.0)), F.col("__long"))).otherwise(F.col("weight"))
    return rows.withColumn("weight", weight).drop("__long", "tradeable")


def portfolio(prices: DataFrame, targets: DataFrame, rebalance: str = "M", fee_bps: float = 5.0, slippage_bps: float = 0.0, capital: float = 1.0, tradeable: DataFrame | None = None) -> DataFrame:
    """(ts, ret, turnover, gross, equity) of target weights (symbol, ts, weight) over prices (symbol, ts, close).

    Weights known at one bar are wanted from the next. They are taken up on rebalance bars, and on any bar
    while nothing is held; in between the last ones stay, without drift. As a held row is always
    some earlier wanted row, it is the latest one that was taken up: the latest rebalance bar, or a later bar at which the
    book was still empty, whichever came last. With ``tradeable``, targets are ``masked`` by it first.
    """
    w = W.ordered()
    if tradeable is not None:
        every = prices.select("symbol", "ts").join(targets.select("symbol", "ts", "weight"), ["symbol", "ts"], "left")
        targets = masked(every, tradeable)
    rows = prices.select("symbol", "ts", "close").join(targets.select("symbol", "ts", F.col("weight").alias("__w")), ["symbol", "ts"], "left")
    rows = rows.withColumns({"__want": F.coalesce(W.lag(F.coalesce("__w", F.lit(0.0)), 1, w), F.lit(0.0)), "__r": F.coalesce(F.try_divide(F.col("close"), W.lag("close", 1, w)) - 1, F.lit(0.0))})
    days = rows.groupBy("ts").agg(F.sum(F.abs("__want")).alias("__gross"))
    one = Window.partitionBy(F.lit(0)).orderBy("ts")  # a row for each bar of the calendar
    days = days.withColumn("__mask", rebalance_mask(rebalance, one))
    before = one.rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumns({"__seg": F.sum(F.col("__mask").cast("int")).over(before)})
    inside = Window.partitionBy("__seg").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    # Within the stretch that a rebalance bar opens, the first bar with anything wanted is what is held from there on.
    days = days.withColumn("__from", F.coalesce(F.min(F.when(F.col("__gross") >= 1e-15, F.col("ts"))).over(inside), F.col("ts")))
    held = rows.select("symbol", F.col("ts").alias("__from"), F.col("__want").alias("held"))
    book = rows.join(days.select("ts", "__from"), "ts").join(held, ["symbol", "__from"], "left").withColumn("held", F.coalesce("held", F.lit(0.0)))
    book = book.withColumn("__turn", F.abs(F.col("held") - F.coalesce(W.lag("held", 1, w), F.lit(0.0))))
    out = book.groupBy("ts").agg(F.sum(F.col("held") * F.col("__r")).alias("__p"), F.sum("__turn").alias("turnover"), F.sum(F.abs("held")).alias("gross"))
    out = out.withColumn("ret", F.col("__p") - F.col("turnover") * ((fee_bps + slippage_bps) / 1e4))
    return out.withColumn("equity", F.product(1 + F.col("ret")).over(before) * capital).select("ts", "ret", "turnover", "gross", "equity")


def sharpe(ret: str = "ret", periods: float = 252.0, ddof: int = 1, eps: float = 0.0) -> Column:
    """Mean over deviation, annualised; 0 without deviation."""
    sd = F.stddev_samp(ret) if ddof else F.stddev_pop(ret)
    return F.when(F.coalesce(sd, F.lit(0.0)) + eps == 0, 0.0).otherwise(F.avg(ret) / F.nullif(F.coalesce(sd, F.lit(0.0)) + eps, F.lit(0.0)) * math.sqrt(periods))


def cagr(equity: str = "equity", periods: float = 252.0, order: str = "ts") -> Column:
    """(last / first) ** (periods / points) - 1; 0 below two points or from nothing."""
    first, last, n = F.min_by(equity, order), F.max_by(equity, order), F.count(equity)
    return F.when((n < 2) | (first <= 0), 0.0).otherwise(F.pow(F.try_divide(last, first), periods / n.cast("double")) - 1)


def summary(curve: DataFrame, by: Sequence[str] = ("symbol",), periods: float = 252.0, capital: float = 1.0) -> DataFrame:
    """One row for each ``by``: total_return, cagr, sharpe, max_drawdown, trades, win_rate, final_equity of a ``long_only`` curve."""
    w = W.ordered(tuple(by))
    rows = curve.withColumns({"__dd": W.drawdown("equity", W.expanding(tuple(by))), "__d": F.abs(F.coalesce(F.col("position") - W.lag("position", 1, w), F.col("position"))), "__on": F.abs("position") > 1e-12})
    last = F.max_by("equity", "ts")
    return rows.groupBy(*by).agg(
        (last / capital - 1).alias("total_return"), cagr("equity", periods).alias("cagr"), sharpe("ret", periods).alias("sharpe"), F.min("__dd").alias("max_drawdown"),
        F.sum((F.col("__d") > 1e-12).cast("long")).alias("trades"), F.coalesce(F.avg(F.when(F.col("__on"), (F.col("ret") > 0).cast("double"))), F.lit(0.0)).alias("win_rate"), last.alias("final_equity"),
    )


def performance(equity: DataFrame, by: Sequence[str] = ("symbol",), periods: float = 252.0) -> DataFrame:
    """Start, end, points, total return, CAGR, volatility, Sharpe, Sortino, drawdown, Calmar and share of gains of an equity curve."""
    rows = equity.withColumns({"__r": F.try_divide(F.col("equity"), W.lag("equity", 1, W.ordered(tuple(by)))) - 1, "__dd": W.drawdown("equity", W.expanding(tuple(by)))})
    down = F.sqrt(F.avg(F.when(F.col("__r").isNotNull(), F.least(F.col("__r"), F.lit(0.0)) ** 2)))
    out = rows.groupBy(*by).agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("points"), (F.try_divide(F.max_by("equity", "ts"), F.min_by("equity", "ts")) - 1).alias("total_return"), cagr("equity", periods).alias("cagr"),
        (F.stddev_samp("__r") * math.sqrt(periods)).alias("volatility"), sharpe("__r", periods).alias("sharpe"), F.try_divide(F.avg("__r") * math.sqrt(periods), F.nullif(down, F.lit(0.0))).alias("sortino"),
        F.min("__dd").alias("max_drawdown"), F.avg((F.col("__r") > 1e-12).cast("double")).alias("win_rate"),
    )
    return out.withColumn("calmar", F.try_divide(F.col("cagr"), F.nullif(F.abs("max_drawdown"), F.lit(0.0))))


def metrics_table(returns: DataFrame, by: Sequence[str] = ("symbol",), benchmark: DataFrame | None = None, periods: float = 252.0) -> DataFrame:
    """(by, cagr, sharpe, max_drawdown, volatility, sortino, calmar, win_rate, beta, alpha) of returns (by, ts, ret).

    ``cagr`` is the annualised mean, as in the published table without its optional package. ``benchmark``: (ts, ret), 0 where it is missing;
    beta is the covariance over the benchmark's variance, alpha what is left of the mean, annualised. Without one both are null.
    """
    known = returns.where(F.col("ret").isNotNull())
    known = known.withColumn("__eq", W.compounded("ret", W.expanding(tuple(by)))).withColumn("__dd", W.drawdown("__eq", W.expanding(tuple(by))))
    known = known.join(benchmark.select("ts", F.col("ret").alias("__b")), "ts", "left").withColumn("__b", F.coalesce("__b", F.lit(0.0))) if benchmark is not None else known.withColumn("__b", F.lit(None).cast("double"))
    r, year = F.col("ret"), math.sqrt(periods)
    down = F.sqrt(F.avg(F.least(r, F.lit(0.0)) ** 2))
    out = known.groupBy(*by).agg(
        (F.avg(r) * periods).alias("cagr"), sharpe("ret", periods).alias("sharpe"), F.min("__dd").alias("max_drawdown"), (F.stddev_samp(r) * year).alias("volatility"), F.try_divide(F.avg(r) * year, F.nullif(down, F.lit(0.0))).alias("sortino"),
        F.avg((r > 0).cast("double")).alias("win_rate"), F.try_divide(F.covar_samp(r, "__b"), F.nullif(F.var_samp("__b"), F.lit(0.0))).alias("beta"), F.avg(r).alias("__m"), F.avg("__b").alias("__mb"),
    )
    out = out.withColumns({"calmar": F.try_divide(F.col("cagr"), F.nullif(F.abs("max_drawdown"), F.lit(0.0))), "alpha": (F.col("__m") - F.col("beta") * F.col("__mb")) * periods})
    return out.select(*by, "cagr", "sharpe", "max_drawdown", "volatility", "sortino", "calmar", "win_rate", "beta", "alpha")


def trailing_returns(returns: DataFrame, by: Sequence[str] = ("symbol",), lengths: dict[str, int] | None = None) -> DataFrame:
    """(by, ret_1m, ret_3m): what the last 21 and 63 returns compound to; null where there are fewer."""
    lengths = {"ret_1m": 21, "ret_3m": 63} if lengths is None else lengths
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("ts")))
    rows = returns.where(F.col("ret").isNotNull()).withColumn("__k", place).where(F.col("__k") <= max(lengths.values()))
    last = lambda n: F.when(F.count(F.when(F.col("__k") <= n, 1)) == n, F.product(F.when(F.col("__k") <= n, 1 + F.col("ret"))) - 1)
    return rows.groupBy(*by).agg(*[last(n).alias(name) for name, n in lengths.items()])


def trade_stats(fills: DataFrame) -> DataFrame:
    """One row over fills (symbol, side, qty, price, fee): counts, notional of either side, fees, symbols."""
    money, buy = F.col("qty") * F.col("price"), F.col("side") == "buy"
    return fills.agg(
        F.count(F.lit(1)).alias("n_fills"), F.coalesce(F.sum(buy.cast("long")), F.lit(0)).alias("n_buys"), F.coalesce(F.sum((~buy).cast("long")), F.lit(0)).alias("n_sells"),
        F.coalesce(F.sum(F.when(buy, money)), F.lit(0.0)).alias("buy_notional"), F.coalesce(F.sum(F.when(~buy, money)), F.lit(0.0)).alias("sell_notional"), F.coalesce(F.sum("fee"), F.lit(0.0)).alias("fees"), F.countDistinct("symbol").alias("n_symbols"),
    )


def annual_turnover(fills: DataFrame, equity: DataFrame) -> DataFrame:
    """Traded notional over mean equity and years; null where the curve spans under 28 days."""
    traded = fills.agg(F.sum(F.abs(F.col("qty") * F.col("price"))).alias("traded"))
    span = equity.agg(F.avg("equity").alias("mean"), F.datediff(F.max("ts"), F.min("ts")).alias("days"))
    return traded.crossJoin(span).select(F.when(F.col("days") >= 28, F.try_divide(F.coalesce("traded", F.lit(0.0)), F.col("mean") * F.col("days") / 365.25)).alias("turnover_annual"))


def sweep(bars: DataFrame, grid: DataFrame, kind: str = "dual_ma", fee_bps: float = 5.0, periods: float = 365.0) -> DataFrame:
    """A backtest for every parameter row: ``grid`` has fast and slow (dual_ma) or lookback (tsmom). Windows of each length are computed once on the bars, not once a row of the grid."""
    names = ("fast", "slow") if kind == "dual_ma" else ("lookback",)
    values = sorted({v for r in grid.select(*names).distinct().collect() for v in r})  # the grid is a parameter list
    if kind == "dual_ma":
        rows = bars.withColumn("__m", F.create_map(*[x for n in values for x in (F.lit(n), W.mean("close", n, n))]))
        rows = rows.crossJoin(F.broadcast(grid)).withColumn("signal", F.when(F.col("__m")[F.col("fast")] > F.col("__m")[F.col("slow")], 1.0).when(F.col("__m")[F.col("fast")] < F.col("__m")[F.col("slow")], -1.0).otherwise(0.0))
    else:
        rows = bars.withColumn("__m", F.create_map(*[x for n in values for x in (F.lit(n), F.try_divide(F.col("close"), W.lag("close", n)) - 1)]))
        rows = rows.crossJoin(F.broadcast(grid)).withColumn("signal", F.coalesce(F.signum(F.col("__m")[F.col("lookback")]), F.lit(0.0)))
    by = ("symbol", *names)
    return summary(long_only(rows.drop("__m"), by=by, fee_bps=fee_bps), by, periods)


def chain_folds(curves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, fold, idx, equity): out-of-sample curves (by, fold, idx, equity) joined by compounding each one's own ratios, without a jump between levels."""
    w = Window.partitionBy(*by, "fold").orderBy("idx")
    ratio = F.coalesce(F.try_divide(F.col("equity"), F.lag("equity").over(w)), F.lit(1.0))
    run = Window.partitionBy(*(by or [F.lit(0)])).orderBy("fold", "idx").rowsBetween(Window.unboundedPreceding, 0)
    return curves.withColumn("__x", ratio).select(*by, "fold", "idx", F.product("__x").over(run).alias("equity"))
