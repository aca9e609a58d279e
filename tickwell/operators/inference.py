"""Sharpe inference under many trials, overfitting probability, multiple testing, bootstrap."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NORMAL = NormalDist()
EULER = 0.5772156649015329


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, in columns: the density times the series of z^(2k+1) / (1 3 5 ... (2k+1)), all of one sign, beside a half; beyond 8 deviations 0 or 1."""
    inside = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    start = F.struct(inside.alias("t"), inside.alias("s"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(160)), start, lambda a, k: F.struct((a["t"] * inside * inside / (2 * k + 1)).alias("t"), (a["s"] + a["t"] * inside * inside / (2 * k + 1)).alias("s")), lambda a: a["s"])
    value = 0.5 + F.exp(-inside * inside / 2) / math.sqrt(2 * math.pi) * total
    return F.when(z.isNotNull(), F.when(z >= 8, 1.0).when(z <= -8, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))))


def moments(df: DataFrame, ret: str, by: Sequence[str]) -> DataFrame:
    """n, mean, sd (ddof 1), skew and kurt (Pearson) of known returns, the last two from z-scores with that deviation; 0 and 3 without one or below three values."""
    r = F.col(ret)
    first = df.where(r.isNotNull()).groupBy(*by).agg(F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"), F.avg(r**2).alias("__2"), F.avg(r**3).alias("__3"), F.avg(r**4).alias("__4"))
    m, s = F.col("mean"), F.nullif(F.col("sd"), F.lit(0.0))
    third = F.col("__3") - 3 * m * F.col("__2") + 2 * m**3
    fourth = F.col("__4") - 4 * m * F.col("__3") + 6 * m**2 * F.col("__2") - 3 * m**4
    ok = F.col("n") >= 3
    return first.withColumns({"skew": F.coalesce(F.when(ok, third / s**3), F.lit(0.0)), "kurt": F.coalesce(F.when(ok, fourth / s**4), F.lit(3.0))}).drop("__2", "__3", "__4")


def psr_z(sr: Column, benchmark: Column | float, n: Column, skew: Column, kurt: Column) -> Column:
    """Argument of the normal distribution whose value is the probability that the true Sharpe ratio exceeds the benchmark."""
    spread = F.sqrt(F.greatest(F.lit(1e-12), 1 - skew * sr + (kurt - 1) / 4 * sr**2))
    return (sr - benchmark) * F.sqrt(F.greatest(F.lit(1.0), n - 1.0)) / spread


def expected_max_sharpe(trials: int, sr_std: float) -> float:
    """Of ``trials`` ratios without skill."""
    if trials < 1:
        raise ValueError("at least one trial")
    if trials == 1:
        return 0.0
    return sr_std * ((1 - EULER) * _NORMAL.inv_cdf(1 - 1 / trials) + EULER * _NORMAL.inv_cdf(1 - 1 / (trials * math.e)))


def deflated_sharpe(df: DataFrame, ret: str, by: Sequence[str], trials: int, sr_std: float) -> DataFrame:
    """Moments, sr (per period), psr (against 0) and dsr (against the expected best of the trials); 0 without deviation."""
    m = moments(df, ret, by).withColumn("sr", F.try_divide(F.col("mean"), F.nullif(F.col("sd"), F.lit(0.0))))
    best = expected_max_sharpe(trials, sr_std) if sr_std > 0 else 0.0
    z = lambda b: psr_z(F.col("sr"), b, F.col("n").cast("double"), F.col("skew"), F.col("kurt"))
    return m.withColumns({"psr": F.coalesce(normal_cdf(z(0.0)), F.lit(0.0)), "dsr": F.coalesce(normal_cdf(z(best)), F.lit(0.0))})


def min_track_record(sr: Column, skew: Column, kurt: Column, benchmark: float = 0.0, alpha: float = 0.05) -> Column:
    """Observations until the ratio beats the benchmark with probability 1 - alpha; null if it does not."""
    z = _NORMAL.inv_cdf(1 - alpha)
    return F.when(sr > benchmark, 1 + (1 - skew * sr + (kurt - 1) / 4 * sr**2) * (z / (sr - benchmark)) ** 2)


def pbo(returns: DataFrame, blocks: int = 16, time: str = "t", variant: str = "variant", ret: str = "ret") -> DataFrame:
    """(pbo, n_splits) by combinatorially symmetric cross-validation over a long table.

    Time is cut into ``blocks`` of equal length (surplus rows at the end are left out, nulls are 0).
    Each half of the blocks in turn is the training set: its best variant (first of equals, by
    name) is ranked among all in the other half. The result is the share of splits in which it is in the
    lower half there. Sums and squares of a block are a partial aggregate of Sharpe ratios, so each split adds up
    blocks, not rows; splits are bit masks.
    """
    if blocks % 2 or blocks > 20:
        raise ValueError("an even number of blocks, at most 20")
    times = returns.select(time).distinct()
    at = Window.partitionBy(F.lit(0)).orderBy(time)
    times = times.withColumns({"__i": F.row_number().over(at) - 1, "__n": F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))})
    size = F.floor(F.col("__n") / blocks)
    times = times.withColumn("block", F.floor(F.try_divide(F.col("__i"), size)).cast("int")).where(F.col("block") < blocks).select(time, "block")
    r = F.coalesce(F.col(ret), F.lit(0.0))
    sums = returns.join(times, time).groupBy("block", variant).agg(F.count(F.lit(1)).alias("n"), F.sum(r).alias("s"), F.sum(r * r).alias("q"))
    masks = returns.sparkSession.range(2**blocks).where(F.bit_count("id") == blocks // 2).select(F.col("id").alias("mask"))
    side = F.col("mask").bitwiseAND(F.pow(F.lit(2), F.col("block")).cast("long")) > 0
    all_of = masks.crossJoin(sums).withColumn("train", side)
    part = all_of.groupBy("mask", variant, "train").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    sd = F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.col("n") * mean**2) / (F.col("n") - 1)))
    part = part.withColumn("sr", F.coalesce(F.try_divide(mean, F.nullif(sd, F.lit(0.0))), F.lit(0.0)))
    train, test = part.where("train"), part.where("NOT train")
    best = train.groupBy("mask").agg(F.max("sr").alias("__m")).join(train.select("mask", variant, "sr"), "mask").where("sr = __m").groupBy("mask").agg(F.min(variant).alias("best"))
    own = best.join(test.select("mask", F.col(variant).alias("best"), F.col("sr").alias("own")), ["mask", "best"])
    rank = test.join(own, "mask").groupBy("mask").agg(F.sum((F.col("sr") > F.col("own") + 1e-12).cast("int")).alias("better"), F.count(F.lit(1)).alias("variants"))
    return rank.agg(F.avg(((F.col("better") + 1) / (F.col("variants") + 1) >= 0.5).cast("double")).alias("pbo"), F.count(F.lit(1)).alias("n_splits"))


def block_count(rows: int, most: int = 16) -> int:
    """The largest even number of blocks up to ``most`` that leaves two rows in each; raises where two blocks do not."""
    for n in range(most - most % 2, 1, -2):
        if rows // n >= 2:
            return n
    raise ValueError(f"{rows} rows are too few for two blocks of two")


def oos_statistics(returns: DataFrame, blocks: int = 16, periods: float = 1.0, least: int = 3) -> DataFrame:
    """One row on out-of-sample returns (window, t, ret) of several windows: n_windows, oos_obs, n_blocks_used, sharpe_per_bar, oos_sharpe (annualised), dsr, dsr_pass, pbo, pbo_flag.

    Unknown returns are left out, windows of fewer than ``least`` do not count. The ratio of all returns is deflated by the spread of the windows' ratios; for
    the overfitting test windows are variants, aligned by the position of their returns, 0 past their end. Under two windows, or four positions, raises.
    """
    known = returns.where(F.col("ret").isNotNull() & ~F.isnan("ret"))
    own = moments(known, "ret", ["window"]).where(F.col("n") >= least).withColumn("sr", F.coalesce(F.try_divide(F.col("mean"), F.nullif(F.col("sd"), F.lit(0.0))), F.lit(0.0)))
    of = own.agg(F.count(F.lit(1)).alias("k"), F.stddev_samp("sr").alias("spread"), F.max("n").alias("most")).first()
    if of.k < 2:
        raise ValueError(f"two windows of {least} returns are needed, there are {of.k}")
    used = block_count(int(of.most), blocks)
    rows = known.join(own.select("window"), "window", "left_semi")
    total = deflated_sharpe(rows, "ret", [], int(of.k), float(of.spread or 0.0)).select(F.col("n").alias("oos_obs"), F.coalesce("sr", F.lit(0.0)).alias("sharpe_per_bar"), "dsr")
    placed = rows.select("window", "ret", (F.row_number().over(Window.partitionBy("window").orderBy("t")) - 1).alias("t"))
    grid = own.select("window").crossJoin(returns.sparkSession.range(int(of.most)).select(F.col("id").cast("int").alias("t")))  # the matrix of the test itself
    dense = grid.join(placed, ["window", "t"], "left").select("t", F.col("window").alias("variant"), F.coalesce("ret", F.lit(0.0)).alias("ret"))
    out = total.crossJoin(pbo(dense, used).select("pbo"))
    return out.select(
        F.lit(of.k).alias("n_windows"), "oos_obs", F.lit(used).alias("n_blocks_used"), "sharpe_per_bar", (F.col("sharpe_per_bar") * math.sqrt(max(1.0, periods))).alias("oos_sharpe"), "dsr", (F.col("dsr") > 0).alias("dsr_pass"), "pbo", (F.col("pbo") > 0.5).alias("pbo_flag"),
    )


def benjamini_hochberg(df: DataFrame, p: str = "p", ranges: int = 256) -> DataFrame:
    """Adds ``q_value``: the smallest p * m / rank from this value up, at most 1, where the rank of equal p is that of the last of them; null for a null p.

    Distinct values are counted first and cut into ranges by approximate quantiles. Ranks and minima run within a range;
    over the ranges themselves, which are few, run their counts and minima. So no task holds a family.
    """
    values = df.where(F.col(p).isNotNull()).groupBy(F.col(p).cast("double").alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    cuts = values.agg(F.percentile_approx("__p", [i / ranges for i in range(1, ranges)])).first()[0] or []
    splits = [-math.inf, *sorted({0.0, *cuts}), math.inf]
    values = Bucketizer(splits=splits, inputCol="__p", outputCol="__r", handleInvalid="keep").transform(values)
    counts = values.groupBy("__r").agg(F.sum("__n").alias("__size"))
    whole = Window.partitionBy(F.lit(0))
    counts = counts.withColumns({"__before": F.sum("__size").over(whole.orderBy("__r")) - F.col("__size"), "__m": F.sum("__size").over(whole)})
    up = Window.partitionBy("__r").orderBy("__p")
    values = values.join(counts.select("__r", "__before", "__m"), "__r").withColumn("__k", F.col("__before") + F.sum("__n").over(up))
    values = values.withColumn("__q", F.min(F.col("__p") * F.col("__m") / F.col("__k")).over(up.rowsBetween(0, Window.unboundedFollowing)))
    later = values.groupBy("__r").agg(F.min("__q").alias("__least")).withColumn("__later", F.min("__least").over(whole.orderBy("__r").rowsBetween(1, Window.unboundedFollowing))).select("__r", "__later")
    values = values.join(later, "__r").select("__p", F.least(F.lit(1.0), "__q", "__later").alias("q_value"))
    return df.withColumn("__p", F.col(p).cast("double")).join(values, "__p", "left").drop("__p")


def block_bootstrap(series: DataFrame, draws: int, block: int, stat: Callable[[np.ndarray], float], seed: int = 0, stationary: bool = True, value: str = "value", order: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    """(by, draw, value): a statistic over resampled blocks of each series, ``draws`` times.

    A series (of one ``by``, or the whole table) is bounded by its bars; it goes, in order, to as many rows as there
    are runs of 64 draws. Each draw has its own seed, so results do not depend on partitioning. Unknown values are left out.
    """
    known = series.where(F.col(value).isNotNull())
    whole = known.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))), lambda x: x["v"]).alias("__x"))
    runs = whole.where(F.size("__x") > 0).withColumn("__run", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // 64)))).repartition("__run", *by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                x, n, out = np.asarray(row["__x"], float), len(row["__x"]), []
                own = range(64 * row["__run"], min(draws, 64 * (row["__run"] + 1)))
                for d in own:
                    rng = np.random.default_rng(np.random.SeedSequence(seed, spawn_key=(d,)))
                    if stationary:
                        fresh = rng.random(n) < 1 / block
                        fresh[0] = True
                        starts = rng.integers(0, n, n)
                        run_from = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
                        pick = (starts[run_from] + np.arange(n) - run_from) % n
                    else:
                        pick = (rng.integers(0, n, -(-n // block))[:, None] + np.arange(block)).ravel()[:n] % n
                    out.append(float(stat(x[pick])))
                yield pd.DataFrame({k: [row[k]] * len(out) for k in by} | {"draw": list(own), "value": out})

    fields = [f for f in whole.schema.fields if f.name in by]
    return runs.mapInPandas(run, T.StructType([*fields, T.StructField("draw", T.LongType()), T.StructField("value", T.DoubleType())]))


def bootstrap_interval(draws: DataFrame, alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    return draws.groupBy(*by).agg(F.percentile("value", F.lit(alpha / 2)).alias("low"), F.percentile("value", F.lit(1 - alpha / 2)).alias("high"))
