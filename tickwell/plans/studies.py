"""Queries over lead-lag studies, volatility scores, constrained signals and turnover."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickwell.operators import backtest as B
from tickwell.operators import conformal as C
from tickwell.operators import indicators as I
from tickwell.operators import leadlag as L
from tickwell.operators import signals as T
from tickwell.plans.common import KEY, r, shown, w
from tickwell.sources.bars import ORDER_BARS_1W, order_bars_1w, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

_LOG = {"gap": "open / lag(close) OVER (PARTITION BY symbol ORDER BY ts)", "intraday": "close / open", "total": "close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)"}
QUERIES["consensus_returns"] = lambda spark, d: shown(L.consensus_returns(order_bars_1w(spark, d)), ("symbol", "ts"), ["gap", "intraday", "total"])
SQL["consensus_returns"] = f"WITH {ORDER_BARS_1W} SELECT symbol, {KEY}, {', '.join(r(f'ln({e})', n) for n, e in _LOG.items())} FROM bars"

QUERIES["standardized_scores"] = lambda spark, d: shown(C.standardized_scores(order_bars_1w(spark, d).select("symbol", "ts", I.change("close").alias("residual")), "residual"), ("symbol", "ts"), ["residual", "sigma", "score"])
SQL["standardized_scores"] = f"""WITH {ORDER_BARS_1W}, v AS (SELECT symbol, ts, close / nullif(lag(close) OVER {w()}, 0) - 1 AS x, row_number() OVER {w()} AS i FROM bars),
s AS (SELECT a.symbol, a.i, count(b.x) AS n, sum(pow(0.5, (a.i - 1 - b.i) / 20.0)) FILTER (b.x IS NOT NULL) AS w, sum(pow(0.5, 2 * (a.i - 1 - b.i) / 20.0)) FILTER (b.x IS NOT NULL) AS w2, sum(pow(0.5, (a.i - 1 - b.i) / 20.0) * b.x) AS wx, sum(pow(0.5, (a.i - 1 - b.i) / 20.0) * b.x * b.x) AS wxx
  FROM v a LEFT JOIN v b ON a.symbol = b.symbol AND b.i < a.i GROUP BY a.symbol, a.i),
y AS (SELECT symbol, i, CASE WHEN n >= 5 THEN sqrt(greatest(0, wxx / w - (wx / w) * (wx / w)) / (1 - w2 / (w * w))) END AS raw FROM s),
z AS (SELECT v.*, greatest(coalesce(raw, first_value(raw IGNORE NULLS) OVER (PARTITION BY v.symbol ORDER BY v.i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), 1e-8) AS sigma FROM v JOIN y ON y.symbol = v.symbol AND y.i = v.i)
SELECT symbol, {KEY}, {r('x', 'residual')}, {r('sigma', 'sigma')}, {r('abs(x) / sigma', 'score')} FROM z"""


def _design(spark, d):  # noqa: ANN001, ANN202
    rows = L.consensus_returns(order_bars_1w(spark, d)).where("gap IS NOT NULL").withColumn("session", F.date_format("ts", "yyyy-MM-dd"))
    one = lambda s: rows.where(F.col("symbol") == s)
    week = order_bars_1w(spark, d).select(F.date_format("ts", "yyyy-MM-dd").alias("target_session")).distinct()
    links = week.select("target_session", F.lag("target_session").over(Window.orderBy("target_session")).alias("source_session")).where("source_session IS NOT NULL")  # a row a week
    driver, control = one("1-URGENT").select("session", F.col("total").alias("value")), one("2-HIGH").where(F.month("ts") != 8).select("session", F.col("total").alias("value"))
    return L.designs(one("3-MEDIUM").select("session", "gap", "intraday"), links, driver, control)


QUERIES["lead_lag_design"] = lambda spark, d: shown(_design(spark, d).withColumns({"x1": F.col("x")[1], "x2": F.col("x")[2], "x3": F.col("x")[3]}), ("window", "horizon", "outcome", "pos", "end_pos"), ["y", "x1", "x2", "x3"])
SQL["lead_lag_design"] = f"""WITH {ORDER_BARS_1W}, v AS (SELECT symbol, ts, {', '.join(f'ln({e}) AS {n}' for n, e in _LOG.items())} FROM bars), k AS (SELECT DISTINCT ts FROM bars), links AS (SELECT ts, lag(ts) OVER (ORDER BY ts) AS source FROM k),
t AS (SELECT ts, gap, intraday, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () - 1 AS last, lag(gap + intraday) OVER (ORDER BY ts) AS own FROM v WHERE symbol = '3-MEDIUM' AND gap IS NOT NULL),
y AS (SELECT a.pos, h AS horizon, o AS outcome, sum(CASE o WHEN 'gap' THEN b.gap WHEN 'intraday' THEN b.intraday ELSE b.gap + b.intraday END) AS y FROM t a, range(1, 6) AS hs(h), (VALUES ('gap'), ('intraday'), ('total')) AS os(o), t b WHERE b.pos BETWEEN a.pos AND a.pos + h - 1 GROUP BY ALL HAVING count(*) = h)
SELECT w AS window, horizon, outcome, pos, pos + horizon - 1 AS end_pos, {r('y', 'y')}, {r('d.total', 'x1')}, {r('c.total', 'x2')}, {r('own', 'x3')}
FROM y JOIN t USING (pos) JOIN links USING (ts) JOIN v d ON d.symbol = '1-URGENT' AND d.ts = source AND d.gap IS NOT NULL JOIN v c ON c.symbol = '2-HIGH' AND c.ts = source AND c.gap IS NOT NULL AND month(c.ts) <> 8, (VALUES (63), (126), (252)) AS ws(w)
WHERE own IS NOT NULL AND pos > last - w"""


def _constrained(spark, d):  # noqa: ANN001, ANN202
    bars = order_bars_1w(spark, d).withColumn("signal", (F.weekofyear("ts") % 5) / 3.0 - 0.2)
    return T.constrained(bars.withColumn("volume", F.when(F.weekofyear("ts") % 7 == 0, 0.0).otherwise(F.col("volume"))))


QUERIES["constrained_signal"] = lambda spark, d: shown(_constrained(spark, d), ("symbol", "ts"), ["signal", "signal_ok"])
SQL["constrained_signal"] = f"""WITH RECURSIVE {ORDER_BARS_1W}, b AS (SELECT symbol, ts, close, high, low, CASE WHEN week(ts) % 7 = 0 THEN 0 ELSE volume END AS volume, week(ts) % 5 / 3.0 - 0.2 AS signal, lag(close) OVER {w()} AS p, row_number() OVER {w()} AS i FROM bars),
l AS (SELECT *, round_even(p * 1.1, 2) AS up, round_even(p * 0.9, 2) AS dn FROM b),
f AS (SELECT *, coalesce(close >= up * 0.998 OR (high >= up * 0.998 AND close >= up * 0.996), false) AS fu, coalesce(close <= dn * 1.002 OR (low <= dn * 1.002 AND close <= dn * 1.004), false) AS fd, volume < 1 AS halted, CAST(greatest(0, least(1, signal)) AS DOUBLE) AS want FROM l),
h AS (SELECT symbol, 0::BIGINT AS i, 0.0::DOUBLE AS held FROM (SELECT DISTINCT symbol FROM b)
  UNION ALL SELECT f.symbol, f.i, CASE WHEN NOT halted AND (abs(want - held) <= 1e-12 OR CASE WHEN want > held THEN NOT fu ELSE NOT fd END) THEN want ELSE held END FROM h JOIN f ON f.symbol = h.symbol AND f.i = h.i + 1)
SELECT f.symbol, {KEY}, {r('signal', 'signal')}, {r('held', 'signal_ok')} FROM f JOIN h ON h.symbol = f.symbol AND h.i = f.i"""


def _turnover(spark, d):  # noqa: ANN001, ANN202
    fills = table(spark, d, "lineitem").where("l_linestatus = 'O'").select(F.col("l_quantity").alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    equity = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("equity"))
    return B.annual_turnover(fills, equity)


QUERIES["annual_turnover"] = lambda spark, d: shown(_turnover(spark, d), (), ["turnover_annual"])
SQL["annual_turnover"] = f"""WITH f AS (SELECT sum(abs(l_quantity * (l_extendedprice / l_quantity))) AS traded FROM lineitem WHERE l_linestatus = 'O'), e AS (SELECT CAST(o_orderdate AS DATE) AS ts, sum(o_totalprice) AS equity FROM orders GROUP BY 1),
s AS (SELECT avg(equity) AS mean, date_diff('day', min(ts), max(ts)) AS days FROM e) SELECT {r('CASE WHEN days >= 28 THEN traded / (mean * days / 365.25) END', 'turnover_annual')} FROM f, s"""
