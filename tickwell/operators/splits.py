"""Train and test splits as long tables (fold, row, role)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def purged_kfold(rows: DataFrame, folds: int = 5, embargo: float = 0.0, order: str = "t0", end: str | None = None) -> DataFrame:
    """(fold, pos, role): contiguous test blocks over ``order``; train rows whose [order, end] overlaps the block's are purged, and of those after it the first int(n * embargo) left are dropped.

    The block table has one row a fold and is broadcast.
    """
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    base = rows.select(F.col(order).alias("t0"), F.col(end or order).alias("t1"))
    base = base.withColumns({"pos": F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("t0")) - 1, "block": F.ntile(folds).over(Window.partitionBy(F.lit(0)).orderBy("t0")) - 1})
    del w
    blocks = base.groupBy("block").agg(F.min_by("t0", "pos").alias("b0"), F.max_by("t1", "pos").alias("b1"), F.max("pos").alias("last")).withColumnRenamed("block", "fold")
    n = base.count()
    all_of = base.crossJoin(F.broadcast(blocks))
    test = all_of.where("block = fold").select("fold", "pos", F.lit("test").alias("role"))
    train = all_of.where("block <> fold AND NOT (t1 >= b0 AND t0 <= b1)")
    if (skip := int(n * embargo)) > 0:
        after = F.col("pos") > F.col("last")
        nth = F.row_number().over(Window.partitionBy("fold", after).orderBy("pos"))
        train = train.withColumn("__n", nth).where(~after | (F.col("__n") > skip))
    return train.select("fold", "pos", F.lit("train").alias("role")).unionByName(test)


def walk_forward_months(rows: DataFrame, splits: int = 5, test_months: int = 1, train_months: int | None = None, purge: int = 0, order: str = "ts") -> DataFrame:
    """(fold, pos, role) by calendar months: train on all earlier months, or on the last ``train_months``, less the newest ``purge`` rows."""
    base = rows.select(F.col(order).alias("ts")).withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ts")) - 1)
    base = base.withColumn("month", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(F.date_trunc("month", "ts"))) - 1)
    months = base.agg(F.max("month")).first()[0]
    months = 0 if months is None else months + 1
    first = months - splits * test_months if train_months is None else train_months
    if first < 1:
        raise ValueError(f"{months} months are too few for {splits} splits of {test_months}")
    splits = splits if train_months is None else max(0, (months - first) // test_months)
    spark = rows.sparkSession
    folds = spark.createDataFrame([(k, first + k * test_months, 0 if train_months is None else first + k * test_months - train_months) for k in range(splits)], "fold int, test_from int, train_from int")
    all_of = base.crossJoin(F.broadcast(folds))
    test = all_of.where(f"month >= test_from AND month < test_from + {test_months}").select("fold", "pos", F.lit("test").alias("role"))
    train = all_of.where("month >= train_from AND month < test_from")
    if purge:
        train = train.withColumn("__n", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("pos")))).where(f"__n > {purge}")
    train = train.select("fold", "pos", F.lit("train").alias("role"))
    both = train.select("fold").distinct().join(test.select("fold").distinct(), "fold")
    return train.unionByName(test).join(both, "fold", "left_semi")


def walk_forward_bars(n: int, folds: int = 4, min_train: int = 120, test_size: int | None = None, purge: int = 0) -> list[tuple[int, int, int, int]]:
    """(fold, train_end, test_start, test_end) bounds over n bars. Tests tile what follows ``min_train``, of at least 20 bars by default and five in any case; a fold whose train part is under 20 bars is passed over."""
    if n < min_train + 10 or folds < 1:
        raise ValueError(f"{n} bars are too few for {folds} folds after {min_train}")
    size = max(20, (n - min_train) // folds) if test_size is None else test_size
    bounds = [(k, min_train + k * size - max(0, purge), min_train + k * size, min(n, min_train + (k + 1) * size)) for k in range(folds)]
    whole = [b for b in bounds if b[3] - b[2] >= 5]
    return [b for b in whole if b[1] >= 20]


def with_warmup(bars: DataFrame, bounds: Sequence[tuple[int, int, int, int]], halo: int) -> DataFrame:
    """Bars of every fold's test, with ``halo`` bars before it: adds fold, bar_idx and in_test."""
    rows = bars.withColumn("bar_idx", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1)
    folds = bars.sparkSession.createDataFrame([(k, a, b) for k, _, a, b in bounds], "fold int, test_start int, test_end int")
    hit = (F.col("bar_idx") >= F.col("test_start") - halo) & (F.col("bar_idx") < F.col("test_end"))
    return rows.join(F.broadcast(folds), hit).withColumn("in_test", F.col("bar_idx") >= F.col("test_start")).drop("test_start", "test_end")


def three_way(rows: DataFrame, train: float = 0.6, valid: float = 0.2, gap: int = 5, horizon: int = 5, order: str = "ts") -> DataFrame:
    """Adds ``role`` by blocks of distinct dates: train, gap, valid, gap, test. A gap shorter than the label's horizon is refused."""
    if gap < horizon:
        raise ValueError("the gap must cover the label's horizon")
    dates = rows.select(order).distinct()
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    dates = dates.withColumns({"__d": F.row_number().over(w) - 1, "__n": F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))})
    a, b = F.floor(F.col("__n") * train), F.floor(F.col("__n") * (train + valid))
    role = F.when(F.col("__d") < a, "train").when(F.col("__d") < a + gap, "gap").when(F.col("__d") < b, "valid").when(F.col("__d") < b + gap, "gap").otherwise("test")
    return rows.join(dates.select(order, role.alias("role")), order)
