"""Bars: the common table (symbol, ts, open, high, low, close, volume), normalisation, and recipes from event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickwell.functions import windows as W

BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
#: Column names of data providers and what they stand for.
ALIASES = {
    "date": "ts", "datetime": "ts", "timestamp": "ts", "time": "ts", "open_time": "ts", "日期": "ts",
    "open": "open", "开盘": "open", "high": "high", "最高": "high", "low": "low", "最低": "low",
    "close": "close", "收盘": "close", "volume": "volume", "成交量": "volume", "vol": "volume",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scrub(c: Column) -> Column:
    """NaN and infinities become null, once, where data come in."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def normalize(raw: DataFrame, symbol: str | None = None, order: str | None = None) -> DataFrame:
    """Rename known aliases, cast, drop rows without a close, and keep the last row of each (symbol, ts).

    ``order`` names the column that says which row came last; without it ties fall to the largest
    close, so the result does not depend on partitioning. Rows without a time are dropped. Missing price columns come back null.
    """
    names: dict[str, str] = {}
    for c in raw.columns:
        names.setdefault(ALIASES.get(c.strip().lower(), c), c)
    if "ts" not in names or "close" not in names:
        raise ValueError("bars need a time and a close column")
    value = lambda c: scrub(F.col(f"`{names[c]}`").cast("double")) if c in names else F.lit(None).cast("double")
    name = F.lit(symbol) if symbol is not None else F.col(f"`{names.get('symbol', 'symbol')}`").cast("string")
    rows = raw.select(name.alias("symbol"), F.col(f"`{names['ts']}`").cast("timestamp_ntz").alias("ts"), *[value(c).alias(c) for c in ("open", "high", "low", "close", "volume")], (F.col(order) if order else value("close")).alias("__last"))
    rows = rows.where("ts IS NOT NULL")
    latest = F.row_number().over(Window.partitionBy("symbol", "ts").orderBy(F.desc_nulls_last("__last")))
    return rows.withColumn("__n", latest).where("__n = 1 AND close IS NOT NULL").drop("__n", "__last")


def dense_panel(bars: DataFrame, field: str = "close") -> DataFrame:
    """(symbol, ts, value) for every symbol at every time that any symbol has, the last known value carried on."""
    grid = bars.select("ts").distinct().crossJoin(bars.select("symbol").distinct())
    return grid.join(bars.select("symbol", "ts", field), ["symbol", "ts"], "left").select("symbol", "ts", W.filled(field).alias(field))


def common_dates(bars: DataFrame) -> DataFrame:
    """Only the times at which every symbol has a bar."""
    n = bars.select("symbol").distinct().agg(F.count(F.lit(1)).alias("n"))
    full = bars.groupBy("ts").agg(F.countDistinct("symbol").alias("k")).crossJoin(F.broadcast(n)).where("k = n").select("ts")
    return bars.join(full, "ts", "left_semi")


def latest(bars: DataFrame, field: str = "close") -> DataFrame:
    return bars.groupBy("symbol").agg(F.max_by(field, "ts").alias(field))


def walks(series: DataFrame, n: int = 120, keys: tuple[str, ...] = ("symbol",), least: float = 1.0) -> DataFrame:
    """Hourly bars of the published deterministic walk for each row (keys, start, seed): a drift that turns half-way, a wave, a noise of a linear congruence.

    The close is held at ``least``: a walk that is reflected there is its running sum plus the running maximum of what that falls short of ``least``.
    """
    i, w = F.col("i"), Window.partitionBy(*keys).orderBy("i")
    noise = F.pmod(F.col("seed").cast("long") * 1103515245 + i * 12345, F.lit(1000)) / F.lit(1000.0) - 0.5
    drift = F.when(i < n // 2, 80.0 + 15.0 * F.sin(i / 3.0)).otherwise(-90.0 + 10.0 * F.sin(i / 4.0))
    rows = series.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).withColumn("noise", noise).withColumn("sum", F.col("start") + F.sum(drift + F.col("noise") * 40.0).over(w))
    rows = rows.withColumn("close", F.col("sum") + F.greatest(F.lit(0.0), F.max(least - F.col("sum")).over(w)))
    rows = rows.withColumn("open", F.coalesce(F.lag("close").over(w), F.col("start"))).withColumn("ts", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(hours=i.cast("int")))
    return rows.select(*keys, "ts", "open", (F.greatest("open", "close") + F.abs("noise") * 20.0).alias("high"), (F.least("open", "close") - F.abs("noise") * 20.0).alias("low"), "close", (100.0 + (i % 17) * 3.0).alias("volume"))


def synthetic(spark: SparkSession, n: int = 120, start: float = 40_000.0, seed: int = 42, symbol: str = "SYN") -> DataFrame:
    """The published series of bars of one symbol."""
    return walks(spark.createDataFrame([(symbol, float(start), int(seed))], "symbol string, start double, seed long"), n)


def event_bars_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of ``events``: one symbol for each event type, prices from positive values."""
    e = table(spark, sf_dir, "events").where("value > 0").select("event_type", "ts", "event_id", "value")
    at = F.struct("ts", "event_id")
    return e.groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    ).withColumnRenamed("hour", "ts")


EVENT_BARS_1H = """bars AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, first(value ORDER BY e.ts, event_id) AS open, max(value) AS high, min(value) AS low,
    last(value ORDER BY e.ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events e WHERE value > 0 GROUP BY event_type, date_trunc('hour', e.ts))"""


def order_bars_1w(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of ``orders``: one symbol for each priority, the close is the week's mean order price."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderdate", "o_orderkey", "o_totalprice")
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    return o.groupBy(F.col("o_orderpriority").alias("symbol"), F.date_trunc("week", "o_orderdate").cast("timestamp_ntz").alias("ts")).agg(
        F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.avg(price).alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )


ORDER_BARS_1W = """bars AS (
  SELECT o_orderpriority AS symbol, CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS ts, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
    min(o_totalprice) AS low, avg(o_totalprice) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM orders GROUP BY o_orderpriority, date_trunc('week', o_orderdate))"""


def ship_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly cross-sections of suppliers: price, units, industry (nation) and size (account balance, at least 1)."""
    item = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    month = item.groupBy(F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("ts"), F.col("l_suppkey").alias("asset")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.sum("l_quantity").alias("units"))
    who = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("asset"), F.col("s_nationkey").alias("industry"), F.greatest(F.col("s_acctbal"), F.lit(1.0)).alias("mktcap"))
    return month.join(who, "asset").select("ts", "asset", "price", "units", "industry", "mktcap")


SHIP_PANEL = """panel AS (
  SELECT m.*, s_nationkey AS industry, greatest(s_acctbal, 1.0) AS mktcap FROM (
    SELECT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS ts, l_suppkey AS asset, avg(l_extendedprice / l_quantity) AS price, sum(l_quantity) AS units
    FROM lineitem GROUP BY ALL) m JOIN supplier ON s_suppkey = asset)"""
