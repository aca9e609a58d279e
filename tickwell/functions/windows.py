"""Trailing-window columns over bars: every helper is a Column expression, partitioned by symbol and ordered by time.

Windows count rows. ``least`` is the number of non-null values below which the result is null.
All expressions over one frame share one sort and one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

BY = ("symbol",)
ORDER = ("ts",)


def ordered(by: tuple[str, ...] = BY, order: tuple[str, ...] = ORDER) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def trailing(n: int, by: tuple[str, ...] = BY, order: tuple[str, ...] = ORDER) -> WindowSpec:
    return ordered(by, order).rowsBetween(-(n - 1), 0)


def expanding(by: tuple[str, ...] = BY, order: tuple[str, ...] = ORDER) -> WindowSpec:
    return ordered(by, order).rowsBetween(Window.unboundedPreceding, 0)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def guarded(c: Column, w: WindowSpec, least: int, value: Column) -> Column:
    return F.when(F.count(c).over(w) >= least, value)


def lag(c: Column | str, n: int = 1, w: WindowSpec | None = None) -> Column:
    return F.lag(col(c), n).over(w or ordered())


def lead(c: Column | str, n: int = 1, w: WindowSpec | None = None) -> Column:
    return F.lead(col(c), n).over(w or ordered())


def mean(c: Column | str, n: int, least: int = 1, w: WindowSpec | None = None) -> Column:
    c, w = col(c), w or trailing(n)
    return guarded(c, w, least, F.avg(c).over(w))


def std(c: Column | str, n: int, least: int = 2, w: WindowSpec | None = None) -> Column:
    """Sample deviation; null below two values."""
    c, w = col(c), w or trailing(n)
    return guarded(c, w, least, F.stddev_samp(c).over(w))


def total(c: Column | str, n: int, least: int = 1, w: WindowSpec | None = None) -> Column:
    c, w = col(c), w or trailing(n)
    return guarded(c, w, least, F.sum(c).over(w))


def highest(c: Column | str, n: int, w: WindowSpec | None = None) -> Column:
    return F.max(col(c)).over(w or trailing(n))


def lowest(c: Column | str, n: int, w: WindowSpec | None = None) -> Column:
    return F.min(col(c)).over(w or trailing(n))


def quantile(c: Column | str, q: float, n: int, least: int = 1, w: WindowSpec | None = None) -> Column:
    """Linear interpolation between order statistics."""
    c, w = col(c), w or trailing(n)
    return guarded(c, w, least, F.percentile(c, F.lit(q)).over(w))


def zscore(c: Column | str, n: int = 60, least: int | None = None) -> Column:
    """(x - mean) / sample deviation; null on a flat window. ``least`` defaults to max(10, n // 3)."""
    c, k = col(c), max(10, n // 3) if least is None else least
    return F.try_divide(c - mean(c, n, k), F.nullif(std(c, n, k), F.lit(0.0)))


def ols(c: Column | str, position: Column | str, n: int) -> tuple[Column, Column, Column]:
    """Slope, R squared and newest residual of c on its position; null where the newest value is null or fewer than two are known."""
    y, x, w = col(c), col(position), trailing(n)
    known = y.isNotNull() & (F.count(y).over(w) >= 2)
    slope, intercept = F.regr_slope(y, x).over(w), F.regr_intercept(y, x).over(w)
    return F.when(known, slope), F.when(known, F.regr_r2(y, x).over(w)), F.when(known, y - (intercept + slope * x))


def correlation(a: Column | str, b: Column | str, n: int, flat: float = 2e-5, w: WindowSpec | None = None) -> Column:
    """Pearson correlation of the rows where both are known; null where either is flat (deviation up to ``flat``)."""
    w = w or trailing(n)
    x, y = F.when(col(b).isNotNull(), col(a)), F.when(col(a).isNotNull(), col(b))
    both = (F.stddev_samp(x).over(w) > flat) & (F.stddev_samp(y).over(w) > flat)
    return F.when(both, F.try_divide(F.covar_pop(x, y).over(w), F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w)))


def place_of_extreme(c: Column | str, n: int, largest: bool = True) -> Column:
    """1-based place in the window of its largest (or smallest) value; the first of equals."""
    seen = F.collect_list(col(c)).over(trailing(n))
    return F.array_position(seen, F.array_max(seen) if largest else F.array_min(seen)).cast("double")


def percent_rank_of_last(c: Column | str, n: int) -> Column:
    """Average rank of the newest value over the number of values."""
    c = col(c)
    seen = F.collect_list(c).over(trailing(n))
    below, equal = F.size(F.filter(seen, lambda x: x < c)), F.size(F.filter(seen, lambda x: x == c))
    return F.when(c.isNotNull(), (below + (equal + 1) / 2.0) / F.size(seen))


def skew(c: Column | str, n: int, least: int | None = None) -> Column:
    """Bias-corrected skewness; null below three values or on a flat window. ``least`` defaults to max(5, n // 3)."""
    c, w = col(c), trailing(n)
    k = F.count(c).over(w).cast("double")
    g1 = F.when(F.stddev_pop(c).over(w) > 0, F.skewness(c).over(w))
    return F.when(k >= max(3, max(5, n // 3) if least is None else least), g1 * F.sqrt(k * (k - 1)) / (k - 2))


def kurtosis(c: Column | str, n: int, least: int | None = None) -> Column:
    """Bias-corrected excess kurtosis; null below four values or on a flat window. ``least`` defaults to max(5, n // 3)."""
    c, w = col(c), trailing(n)
    k = F.count(c).over(w).cast("double")
    g2 = F.when(F.stddev_pop(c).over(w) > 0, F.kurtosis(c).over(w))
    return F.when(k >= max(4, max(5, n // 3) if least is None else least), (k - 1) / ((k - 2) * (k - 3)) * ((k + 1) * g2 + 6))


def filled(c: Column | str, w: WindowSpec | None = None) -> Column:
    """The last known value up to here."""
    return F.last(col(c), ignorenulls=True).over(w or expanding())


def compounded(returns: Column | str, w: WindowSpec | None = None) -> Column:
    """Running product of 1 + r."""
    return F.product(1 + F.coalesce(col(returns), F.lit(0.0))).over(w or expanding())


def drawdown(equity: Column | str, w: WindowSpec | None = None) -> Column:
    e = col(equity)
    return e / F.max(e).over(w or expanding()) - 1
