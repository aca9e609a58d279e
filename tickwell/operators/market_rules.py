"""Rules of a market with daily price limits, suspensions and sell-side tax; quality rules of bars; routing of symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwell.functions import windows as W

#: Daily price limit of each board.
LIMITS = {"st": 0.05, "growth": 0.20, "star": 0.20, "main": 0.10}


def board(symbol: Column, name: Column | None = None) -> Column:
    """st for names with ST, growth for codes 300 and 301, star for 688, else main."""
    code = F.regexp_extract(symbol, r"(\d{6})", 1)
    st = F.coalesce(F.upper(name).contains("ST"), F.lit(False)) if name is not None else F.lit(False)
    return F.when(st, "st").when(code.startswith("300") | code.startswith("301"), "growth").when(code.startswith("688"), "star").otherwise("main")


def limit_share(of_board: Column) -> Column:
    return F.create_map(*[x for k, v in LIMITS.items() for x in (F.lit(k), F.lit(v))])[of_board]


def round_half_even(x: Column, places: int = 2) -> Column:
    return F.rint(x * 10**places) / float(10**places)


def limit_flags(bars: DataFrame, on: str = "main", tol: float = 0.002) -> DataFrame:
    """Adds prev_close, limit_up, limit_down, is_limit_up, is_limit_down: a close at the limit, or an extreme at it and a close near it."""
    p, before = LIMITS[on], W.lag("close")
    up, down = round_half_even(before * (1 + p)), round_half_even(before * (1 - p))
    c, h, low = F.col("close"), F.col("high"), F.col("low")
    at_up = (c >= up * (1 - tol)) | ((h >= up * (1 - tol)) & (c >= up * (1 - 2 * tol)))
    at_down = (c <= down * (1 + tol)) | ((low <= down * (1 + tol)) & (c <= down * (1 + 2 * tol)))
    return bars.withColumns({"prev_close": before, "limit_up": up, "limit_down": down, "is_limit_up": F.coalesce(at_up, F.lit(False)), "is_limit_down": F.coalesce(at_down, F.lit(False))})


def suspended(min_volume: float = 1.0) -> Column:
    return F.coalesce(F.col("volume"), F.lit(0.0)) < min_volume


def annotate(bars: DataFrame, on: str = "main") -> DataFrame:
    """Limit flags, is_suspended, can_buy, can_sell and tradeable (both)."""
    out = limit_flags(bars, on).withColumn("is_suspended", suspended())
    buy, sell = ~F.col("is_suspended") & ~F.col("is_limit_up"), ~F.col("is_suspended") & ~F.col("is_limit_down")
    return out.withColumns({"can_buy": buy, "can_sell": sell, "tradeable": buy & sell})


def suspicious_adjustment(df: DataFrame, raw: str = "raw_close", adjusted: str = "adj_close", jump: float = 0.25) -> DataFrame:
    """Adds both returns and whether the adjusted one jumps where the raw one does not."""
    r, a = (F.try_divide(F.col(c), W.lag(c)) - 1 for c in (raw, adjusted))
    return df.withColumns({"raw_ret": r, "adj_ret": a, "adj_jump_suspicious": F.coalesce((F.abs(a) > jump) & (F.abs(r) < jump / 2), F.lit(False))})


def fee_bps(side: str = "roundtrip", commission: float = 2.5, stamp: float = 5.0) -> float:
    return {"buy": commission, "sell": commission + stamp, "roundtrip": 2 * commission + stamp}[side]


def row_reasons() -> Column:
    """Sorted codes of what is wrong with a bar; geometry is judged only where nothing else is."""
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    any_of = lambda tests: __import__("functools").reduce(lambda a, b: a | b, tests)
    broken = any_of([bad(c) for c in (*prices, F.col("volume"))])
    low = F.coalesce(any_of([c <= 0 for c in prices]), F.lit(False))
    volume = F.coalesce(F.col("volume") < 0, F.lit(False))
    o, h, l, c = prices
    shape = F.coalesce((h < F.greatest(o, c, l)) | (l > F.least(o, c, h)), F.lit(False))
    return F.array_sort(F.array_compact(F.array(F.when(broken, F.lit("non_finite_value")), F.when(low, F.lit("non_positive_price")), F.when(volume, F.lit("negative_volume")), F.when(~broken & ~low & ~volume & shape, F.lit("invalid_geometry")))))


def provider(symbol: Column, market: Column) -> Column:
    """Which source serves a symbol: crypto pairs, Hong Kong codes, Beijing codes, other mainland codes, everything else."""
    s = F.upper(symbol)
    code = F.regexp_extract(s, r"^(\d+)", 1)
    crypto = (market == "crypto") | s.contains("/") | s.endswith("USDT")
    hong_kong = (market == "hk") | s.endswith(".HK") | s.rlike(r"^\d{4,5}$")
    beijing = code.rlike(r"^(4|8|92)\d*$") & (F.length(code) == 6)
    mainland = (market == "cn") | s.rlike(r"^\d{6}(\.(SS|SZ|SH|BJ))?$")
    return F.when(crypto, "ccxt").when(hong_kong, "yahoo").when(mainland & beijing, "akshare").when(mainland, "baostock").otherwise("yahoo")


def exchange_symbol(symbol: Column) -> Column:
    """600519.SS -> sh.600519: codes of 5, 6 and 9 are Shanghai's, others Shenzhen's; null where there is no six-digit code or it is Beijing's."""
    code = F.regexp_extract(symbol, r"(\d{6})", 1)
    return F.when((code == "") | code.rlike(r"^(4|8|92)"), None).when(code.rlike(r"^[569]"), F.concat(F.lit("sh."), code)).otherwise(F.concat(F.lit("sz."), code))
