"""Cross-sectional operators: windows over one date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at(*by: str):  # noqa: ANN201
    return Window.partitionBy(*(by or ("ts",)))


def winsorize_mad(df: DataFrame, column: str, k: float = 5.0, by: str = "ts") -> DataFrame:
    """Clip to median +- k times the median absolute deviation of the date; nulls stay."""
    x = F.col(column)
    df = df.withColumn("__med", F.median(x).over(at(by)))
    df = df.withColumn("__mad", F.median(F.abs(x - F.col("__med"))).over(at(by)))
    low, high = F.col("__med") - k * F.col("__mad"), F.col("__med") + k * F.col("__mad")
    return df.withColumn(column, F.when(x.isNotNull(), F.greatest(low, F.least(high, x)))).drop("__med", "__mad")


def fill(df: DataFrame, column: str, industry: str | None = None, by: str = "ts") -> DataFrame:
    """Nulls take the mean of their industry on the date, then the date's median."""
    x = F.col(column)
    steps = [F.avg(x).over(at(by, industry))] if industry else []
    return df.withColumn(column, F.coalesce(x, *steps, F.median(x).over(at(by))))


def neutralize(df: DataFrame, column: str, industry: str | None = None, size: str | None = None, by: str = "ts") -> DataFrame:
    """Residual of the date's regression on an intercept, ln(size) and industry dummies.

    Partialling the dummies out leaves one slope: both sides are taken relative to their (date,
    industry) mean. Rows without an industry or a size take no part and become null; so does a date with no more rows than
    parameters.
    """
    y = F.col(column)
    ok = y.isNotNull()
    if industry:
        ok = ok & F.col(industry).isNotNull()
    if size:
        ok = ok & (F.col(size) > 0)
    df = df.withColumns({"__y": F.when(ok, y), "__x": F.when(ok, F.log(F.col(size))) if size else F.lit(None).cast("double")})
    group = at(by, industry) if industry else at(by)
    df = df.withColumns({"__yd": F.col("__y") - F.avg("__y").over(group), "__xd": F.col("__x") - F.avg("__x").over(group)})
    slope = F.coalesce(F.try_divide(F.sum(F.col("__xd") * F.col("__yd")).over(at(by)), F.nullif(F.sum(F.col("__xd") ** 2).over(at(by)), F.lit(0.0))), F.lit(0.0))
    groups = F.size(F.collect_set(F.when(F.col("__y").isNotNull(), F.col(industry))).over(at(by))) if industry else F.lit(1)
    enough = F.count("__y").over(at(by)) > groups + (1 if size else 0)
    rest = F.col("__yd") - (slope * F.col("__xd") if size else F.lit(0.0))
    return df.withColumn(column, F.when(enough, rest)).drop("__y", "__x", "__yd", "__xd")


def zscore(column: str | Column, by: str = "ts", ddof: int = 1, clip: float | None = None, missing: float | None = None) -> Column:
    """Standardised within the date; 0 where the deviation is zero or undefined. ``clip`` bounds it, ``missing`` replaces nulls."""
    x = F.col(column) if isinstance(column, str) else column
    sd = (F.stddev_samp(x) if ddof else F.stddev_pop(x)).over(at(by))
    z = F.when(x.isNull(), None).when(F.coalesce(sd, F.lit(0.0)) == 0, 0.0).otherwise((x - F.avg(x).over(at(by))) / F.nullif(sd, F.lit(0.0)))
    if clip is not None:
        z = F.when(z.isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), z)))
    return z if missing is None else F.coalesce(z, F.lit(missing))


def preprocess(df: DataFrame, columns: Sequence[str], industry: str | None = None, size: str | None = None, k: float = 5.0, by: str = "ts") -> DataFrame:
    """Winsorise, fill, neutralise and standardise each column within its date."""
    for c in columns:
        df = fill(winsorize_mad(df, c, k, by), c, industry, by)
        if industry or size:
            df = neutralize(df, c, industry, size, by)
        x = F.col(c)
        sd = F.stddev_samp(x).over(at(by))
        df = df.withColumn(c, F.when(F.coalesce(sd, F.lit(0.0)) == 0, 0.0).otherwise((x - F.avg(x).over(at(by))) / F.nullif(sd, F.lit(0.0))))
    return df


def zscore_fit(train: DataFrame, columns: Sequence[str], *others: DataFrame, clip: float = 3.0) -> list[DataFrame]:
    """Standardise ``train`` and ``others`` by the train rows' mean and deviation (one row, broadcast); clipped, nulls 0."""
    stats = train.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    out = []
    for df in (train, *others):
        df = df.crossJoin(F.broadcast(stats))
        z = {c: F.coalesce(F.greatest(F.lit(-clip), F.least(F.lit(clip), F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.nullif(F.col(f"__s_{c}"), F.lit(0.0))))), F.lit(0.0)) for c in columns}
        z = {c: F.when(F.col(c).isNull(), 0.0).otherwise(x) for c, x in z.items()}
        out.append(df.withColumns(z).drop(*stats.columns))
    return out


def _ranked(df: DataFrame, column: str, keys: Sequence[str], name: str) -> DataFrame:
    ties = Window.partitionBy(*keys, column)
    return df.withColumn(name, F.rank().over(Window.partitionBy(*keys).orderBy(column)) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def _pearson(x: str, y: str) -> Column:
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def daily_ic(df: DataFrame, factor: str, label: str, by: str = "ts", least: int = 5) -> DataFrame:
    """(date, ic, rank_ic, n) for dates with ``least`` pairs and two distinct values on both sides."""
    rows = df.select(by, F.col(factor).cast("double").alias("x"), F.col(label).cast("double").alias("y")).dropna()
    rows = _ranked(_ranked(rows, "x", [by], "rx"), "y", [by], "ry")
    out = rows.groupBy(by).agg(_pearson("x", "y").alias("ic"), _pearson("rx", "ry").alias("rank_ic"), F.count(F.lit(1)).alias("n"), F.min("x").alias("__a"), F.max("x").alias("__b"), F.min("y").alias("__c"), F.max("y").alias("__d"))
    return out.where((F.col("n") >= least) & (F.col("__a") < F.col("__b")) & (F.col("__c") < F.col("__d"))).select(by, "ic", "rank_ic", "n")


def ic_summary(ic: DataFrame) -> DataFrame:
    """Mean, deviation and ratio of daily ICs."""
    return ic.agg(F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std_ic"), F.try_divide(F.avg("ic"), F.nullif(F.stddev_samp("ic"), F.lit(0.0))).alias("icir"), F.avg("rank_ic").alias("mean_rank_ic"), F.count(F.lit(1)).alias("n_dates"))


def _dealt(rows: DataFrame, blocks: int, order: Sequence[str]) -> DataFrame:
    """Adds ``block``: the rows of each factor in ``blocks`` runs of equal length (earlier ones longer by one), in order.

    Only counts by date are put in a row of a whole factor; rows are numbered within their date.
    """
    first, *rest = order
    dates = rows.groupBy("factor", first).agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy("factor")
    dates = dates.withColumns({"__before": F.sum("__n").over(whole.orderBy(first)) - F.col("__n"), "__all": F.sum("__n").over(whole)}).drop("__n")
    place = F.row_number().over(Window.partitionBy("factor", first).orderBy(*(rest or ["x", "y"])))
    at, size, more = F.col("__before") + F.col("__place") - 1, F.floor(F.col("__all") / blocks), F.col("__all") % blocks
    longer = more * (size + 1)
    block = F.when(at < longer, F.floor(at / (size + 1))).otherwise(more + F.floor((at - longer) / F.greatest(size, F.lit(1)))) + 1
    return rows.withColumn("__place", place).join(dates, ["factor", first]).withColumn("block", block.cast("int")).drop("__place", "__before", "__all")


def factor_ic_table(df: DataFrame, factors: Sequence[str], label: str, order: Sequence[str] = ("ts",), blocks: int = 10, least: int = 20) -> DataFrame:
    """(factor, ic_mean, ic_std, ic_ir, rank_ic_mean, n_obs) over contiguous blocks of each factor's known pairs; short or constant blocks do not count."""
    long = df.unpivot([*order, label], list(factors), "factor", "x").select(*order, "factor", F.col("x").cast("double").alias("x"), F.col(label).cast("double").alias("y")).dropna()
    long = _dealt(long, blocks, order)
    keys = ["factor", "block"]
    long = _ranked(_ranked(long, "x", keys, "rx"), "y", keys, "ry")
    per = long.groupBy(*keys).agg(_pearson("x", "y").alias("ic"), _pearson("rx", "ry").alias("ric"), F.count(F.lit(1)).alias("n"))
    good = (F.col("n") >= least) & F.col("ic").isNotNull()
    out = per.groupBy("factor").agg(F.avg(F.when(good, F.col("ic"))).alias("ic_mean"), F.stddev_samp(F.when(good, F.col("ic"))).alias("ic_std"), F.avg(F.when(good, F.col("ric"))).alias("rank_ic_mean"), F.sum("n").alias("n_obs"))
    return out.withColumn("ic_ir", F.try_divide(F.col("ic_mean"), F.nullif(F.col("ic_std"), F.lit(0.0)))).orderBy(F.desc(F.abs("ic_mean")))


def signal_to_weights(df: DataFrame, signal: str, long_only: bool = True, max_weight: float | None = None, neutral: bool = False, by: str = "ts") -> DataFrame:
    """Adds ``weight``: the signal cut at 0 (or demeaned) over the sum of its sizes; a cap is applied and the row normed once more, so it can be exceeded."""
    s = F.coalesce(F.col(signal), F.lit(0.0))
    s = F.greatest(s, F.lit(0.0)) if long_only else s
    df = df.withColumn("__s", s)
    if neutral and not long_only:
        df = df.withColumn("__s", F.col("__s") - F.avg("__s").over(at(by)))
    norm = lambda c: F.coalesce(F.try_divide(F.col(c), F.nullif(F.sum(F.abs(F.col(c))).over(at(by)), F.lit(0.0))), F.lit(0.0))
    df = df.withColumn("__w", norm("__s"))
    if max_weight is not None:
        df = df.withColumn("__w", F.greatest(F.lit(-max_weight), F.least(F.lit(max_weight), F.col("__w")))).withColumn("__w", norm("__w"))
    return df.withColumn("weight", F.col("__w")).drop("__s", "__w")


def equal_weights(df: DataFrame, mask: str | None = None, by: str = "ts") -> DataFrame:
    """Adds ``weight``: 1 / n over the date's rows, or over those that the mask allows."""
    ok = F.coalesce(F.col(mask), F.lit(False)) if mask else F.lit(True)
    n = F.sum(ok.cast("int")).over(at(by))
    return df.withColumn("weight", F.when(ok, F.try_divide(F.lit(1.0), n)).otherwise(0.0))


def top_n(df: DataFrame, score: str, n: int, tie: str = "symbol", by: str | None = None, scheme: str = "equal", max_weight: float | None = None) -> DataFrame:
    """The n best rows (of each ``by``), ties to the smaller ``tie``, with ``rank`` and ``weight`` (equal, or by positive score)."""
    w = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy(F.desc_nulls_last(score), tie)
    best = df.where(F.col(score).isNotNull())
    best = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n) if by else best.orderBy(F.desc(score), tie).limit(n).withColumn("rank", F.row_number().over(w))
    all_of = Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))
    raw = F.lit(1.0) if scheme == "equal" else F.greatest(F.col(score), F.lit(0.0))
    best = best.withColumn("__r", raw).withColumn("weight", F.coalesce(F.try_divide(F.col("__r"), F.nullif(F.sum("__r").over(all_of), F.lit(0.0))), F.lit(1.0) / F.count(F.lit(1)).over(all_of)))
    if max_weight is not None:
        best = best.withColumn("weight", F.least(F.col("weight"), F.lit(max_weight))).withColumn("weight", F.col("weight") / F.sum("weight").over(all_of))
    return best.drop("__r")


def contribution(df: DataFrame, weight: str = "weight", ret: str = "ret", symbol: str = "symbol") -> DataFrame:
    """(symbol, contribution): last bar's weight times this bar's return, summed."""
    w = Window.partitionBy(symbol).orderBy("ts")
    return df.withColumn("__c", F.coalesce(F.lag(weight).over(w), F.lit(0.0)) * F.coalesce(F.col(ret), F.lit(0.0))).groupBy(symbol).agg(F.sum("__c").alias("contribution")).orderBy(F.desc("contribution"), symbol)


def attribution(weights: DataFrame, benchmark: DataFrame, exposures: DataFrame, factor_returns: DataFrame, asset_returns: DataFrame) -> DataFrame:
    """(t, source, value): active weights through exposures and factor returns, one row a factor, and what they leave as ``residual``.

    ``weights`` and ``benchmark``: (t, asset, weight); ``exposures``: (t, asset, factor, exposure); ``factor_returns``: (t, factor, ret); ``asset_returns``: (t, asset, ret).
    """
    active = weights.withColumnRenamed("weight", "w").join(benchmark.withColumnRenamed("weight", "b"), ["t", "asset"], "full").select("t", "asset", (F.coalesce("w", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))).alias("active"))
    parts = active.join(exposures, ["t", "asset"]).groupBy("t", "factor").agg(F.sum(F.col("active") * F.col("exposure")).alias("x")).join(factor_returns, ["t", "factor"]).select("t", F.col("factor").alias("source"), (F.col("x") * F.col("ret")).alias("value"))
    total = active.join(asset_returns, ["t", "asset"]).groupBy("t").agg(F.sum(F.col("active") * F.col("ret")).alias("total"))
    rest = total.join(parts.groupBy("t").agg(F.sum("value").alias("explained")), "t", "left").select("t", F.lit("residual").alias("source"), (F.col("total") - F.coalesce("explained", F.lit(0.0))).alias("value"))
    return parts.unionByName(rest)
