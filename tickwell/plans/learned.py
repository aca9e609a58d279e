"""Queries over learned models: rankers over folds and seeds, mined factors. No SQL: tests hold them against plain fits and planted factors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickwell.operators import mining, ranker
from tickwell.sources.bars import ship_panel

QUERIES: dict = {}
SQL: dict[str, str] = {}
FEATURES = ["level", "step", "units", "units_step", "size"]


def panel(spark: SparkSession, d: str) -> DataFrame:
    """(ts, asset, FEATURES, label): monthly prices and units of suppliers against their own past, and the change of the next month, standardised by month."""
    w = Window.partitionBy("asset").orderBy("ts")
    past = w.rowsBetween(-6, -1)
    rows = ship_panel(spark, d).withColumns({
        "level": F.try_divide("price", F.avg("price").over(past)) - 1, "step": F.try_divide("price", F.lag("price").over(w)) - 1, "units_step": F.try_divide("units", F.avg("units").over(past)) - 1,
        "size": F.log("mktcap"), "ahead": F.try_divide(F.lead("price").over(w), F.col("price")) - 1,
    })
    month = Window.partitionBy("ts")
    label = F.try_divide(F.col("ahead") - F.avg("ahead").over(month), F.nullif(F.stddev_samp("ahead").over(month), F.lit(0.0)))
    return rows.withColumn("label", label).select("ts", "asset", *FEATURES, "label")


def _walk_forward(spark: SparkSession, d: str) -> DataFrame:
    got = ranker.walk_forward(panel(spark, d), FEATURES, "label", n_splits=3, test_months=6, purge=1, seeds=(42, 43), settings=ranker.Settings(trees=4, depth=3, rate=0.2, bins=16))
    return got.folds.select("fold", F.date_format("test_start", "yyyy-MM-dd").alias("test_start"), F.date_format("test_end", "yyyy-MM-dd").alias("test_end"), "n_test", F.round("ic", 6).alias("ic"), F.round("rank_ic", 6).alias("rank_ic"))


QUERIES["ranker_walk_forward"] = _walk_forward


def _mined(spark: SparkSession, d: str) -> DataFrame:
    found = mining.mine(panel(spark, d), FEATURES, "label", population=40, generations=2, tournament=8, parsimony=0.002, n_factors=3, by="ts")
    return found.table(spark).select("factor", "formula", "size", F.round("score", 6).alias("score"))


QUERIES["mined_factors"] = _mined
