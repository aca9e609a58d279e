"""Queries over sources, rules and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickwell.functions import windows as W
from tickwell.operators import backtest as B
from tickwell.operators import cross_section as X
from tickwell.operators import factors as A
from tickwell.operators import indicators as I
from tickwell.operators import leadlag as L
from tickwell.operators import market_rules as M
from tickwell.operators import parity
from tickwell.operators import research as R
from tickwell.operators import signals as T
from tickwell.plans.common import KEY, least, over, r, shown, w
from tickwell.sources import bars as S
from tickwell.sources.bars import EVENT_BARS_1H, ORDER_BARS_1W, event_bars_1h, order_bars_1w, table

KEYS = ("symbol", "ts")
QUERIES: dict = {}
SQL: dict[str, str] = {}


def _codes(spark, d):  # noqa: ANN001, ANN202
    k = F.col("p_partkey")
    code = F.lpad((k * 7919 % 999983).cast("string"), 6, "0")
    name = F.when(k % 5 == 0, F.concat(code, F.lit("USDT"))).when(k % 5 == 1, F.concat(F.substring(code, 1, 4), F.lit(".HK"))).when(k % 5 == 2, F.concat(code, F.lit(".SS"))).when(k % 5 == 3, code).otherwise(F.concat(F.lit("AB"), F.substring(code, 1, 2)))
    return table(spark, d, "part").select(k, name.alias("symbol"))


_CODES = """c AS (SELECT p_partkey, lpad(CAST(p_partkey * 7919 % 999983 AS VARCHAR), 6, '0') AS code FROM part),
s AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN code || 'USDT' WHEN 1 THEN code[1:4] || '.HK' WHEN 2 THEN code || '.SS' WHEN 3 THEN code ELSE 'AB' || code[1:2] END AS symbol FROM c)"""
QUERIES["provider_routing"] = lambda spark, d: _codes(spark, d).select("p_partkey", "symbol", M.provider(F.col("symbol"), F.lit("auto")).alias("provider"), M.exchange_symbol(F.col("symbol")).alias("exchange_symbol"), M.board(F.col("symbol")).alias("board"))
SQL["provider_routing"] = f"""WITH {_CODES} SELECT p_partkey, symbol, CASE WHEN symbol LIKE '%USDT' THEN 'ccxt' WHEN symbol LIKE '%.HK' THEN 'yahoo' WHEN regexp_matches(symbol, '^(4|8|92)') AND regexp_matches(symbol, '^[0-9]{{6}}') THEN 'akshare' WHEN regexp_matches(symbol, '^[0-9]{{6}}') THEN 'baostock' ELSE 'yahoo' END AS provider,
CASE WHEN NOT regexp_matches(symbol, '[0-9]{{6}}') OR regexp_matches(symbol, '^(4|8|92)') THEN NULL WHEN regexp_matches(symbol, '^[569]') THEN 'sh.' || symbol[1:6] ELSE 'sz.' || symbol[1:6] END AS exchange_symbol,
CASE WHEN regexp_matches(symbol, '^30[01][0-9]{{3}}') THEN 'growth' WHEN regexp_matches(symbol, '^688[0-9]{{3}}') THEN 'star' ELSE 'main' END AS board FROM s"""


def _dirty(spark, d):  # noqa: ANN001, ANN202
    k = F.col("l_orderkey") + F.col("l_linenumber")
    p = F.col("l_extendedprice")
    item = table(spark, d, "lineitem")
    return item.select("l_orderkey", "l_linenumber", F.when(k % 11 != 0, p).otherwise(-p).alias("open"), (p * 1.1).alias("high"), F.when(k % 7 == 0, p * 2).otherwise(p * 0.9).alias("low"), F.when(k % 13 == 0, None).otherwise(p).alias("close"), F.when(k % 17 == 0, -1.0).otherwise(F.col("l_quantity")).alias("volume"))


QUERIES["row_reasons"] = lambda spark, d: _dirty(spark, d).select(F.concat_ws(",", M.row_reasons()).alias("reasons")).groupBy("reasons").count()
SQL["row_reasons"] = """WITH b AS (SELECT l_orderkey + l_linenumber AS k, l_extendedprice AS p, l_quantity AS q FROM lineitem),
x AS (SELECT k % 13 = 0 AS a, k % 11 = 0 AS n, k % 17 = 0 AS v, k % 7 = 0 AS g FROM b)
SELECT reasons, count(*) AS count FROM (SELECT concat_ws(',', CASE WHEN g AND NOT a AND NOT n AND NOT v THEN 'invalid_geometry' END, CASE WHEN v THEN 'negative_volume' END, CASE WHEN a THEN 'non_finite_value' END, CASE WHEN n THEN 'non_positive_price' END) AS reasons FROM x) GROUP BY reasons"""

QUERIES["suspicious_adjustment"] = lambda spark, d: shown(M.suspicious_adjustment(order_bars_1w(spark, d).withColumns({"raw_close": F.col("close"), "adj_close": F.col("close") * F.when(F.month("ts") > 6, 0.5).otherwise(1.0)})), KEYS, ["raw_ret", "adj_ret", "adj_jump_suspicious"])
SQL["suspicious_adjustment"] = f"""WITH {ORDER_BARS_1W}, a AS (SELECT *, close * CASE WHEN month(ts) > 6 THEN 0.5 ELSE 1.0 END AS adj FROM bars), x AS (SELECT symbol, ts, close / nullif(lag(close) OVER {w()}, 0) - 1 AS rr, adj / nullif(lag(adj) OVER {w()}, 0) - 1 AS ar FROM a)
SELECT symbol, {KEY}, {r('rr', 'raw_ret')}, {r('ar', 'adj_ret')}, coalesce(abs(ar) > 0.25 AND abs(rr) < 0.125, false) AS adj_jump_suspicious FROM x"""

QUERIES["rebalance_mask"] = lambda spark, d: shown(order_bars_1w(spark, d), KEYS, {"month_end": B.rebalance_mask("M", W.ordered()), "quarter_end": B.rebalance_mask("Q", W.ordered())})
SQL["rebalance_mask"] = f"WITH {ORDER_BARS_1W} SELECT symbol, {KEY}, coalesce(date_trunc('month', ts) <> lead(date_trunc('month', ts)) OVER {w()}, true) AS month_end, coalesce(date_trunc('quarter', ts) <> lead(date_trunc('quarter', ts)) OVER {w()}, true) AS quarter_end FROM bars"

QUERIES["signal_panels"] = lambda spark, d: shown(A.momentum_panel(event_bars_1h(spark, d), 20).withColumnRenamed("signal", "momentum").join(A.dual_ma_panel(event_bars_1h(spark, d), 5, 20), ["symbol", "ts"]), KEYS, ["momentum", "signal"])
SQL["signal_panels"] = f"WITH {EVENT_BARS_1H} SELECT symbol, {KEY}, {r(f'close / nullif(lag(close, 20) OVER {w()}, 0) - 1', 'momentum')}, CAST(coalesce({least('close', 5, 'avg(close)', 5)} > {least('close', 20, 'avg(close)', 20)}, false) AS DOUBLE) AS signal FROM bars"


def _z(x: str) -> str:
    return f"({x} - ({least(x, 20, f'avg({x})', 60)})) / nullif({least(x, 20, f'stddev_samp({x})', 60)}, 0)"


QUERIES["combine_factors"] = lambda spark, d: shown(A.combine(event_bars_1h(spark, d).withColumns({"mom": I.change("close", 5), "vol": W.std("close", 20, 20)}), ["mom", "vol"]), KEYS, ["factor_score"])
SQL["combine_factors"] = f"""WITH {EVENT_BARS_1H}, b AS (SELECT *, close / nullif(lag(close, 5) OVER {w()}, 0) - 1 AS mom, {least('close', 20, 'stddev_samp(close)', 20)} AS vol FROM bars), z AS (SELECT symbol, ts, {_z('mom')} AS a, {_z('vol')} AS b FROM b)
SELECT symbol, {KEY}, {r('(coalesce(a, 0) + coalesce(b, 0)) / nullif(CAST(a IS NOT NULL AS INT) + CAST(b IS NOT NULL AS INT), 0)', 'factor_score')} FROM z"""


def _zfit(spark, d):  # noqa: ANN001, ANN202
    b = event_bars_1h(spark, d)
    return X.zscore_fit(b.where("ts < '2024-01-15'"), ["close", "volume"], b.where("ts >= '2024-01-15'"))[1]


QUERIES["zscore_train_fit"] = lambda spark, d: shown(_zfit(spark, d), KEYS, ["close", "volume"])
SQL["zscore_train_fit"] = f"""WITH {EVENT_BARS_1H}, s AS (SELECT avg(close) AS mc, stddev_samp(close) AS sc, avg(volume) AS mv, stddev_samp(volume) AS sv FROM bars WHERE ts < TIMESTAMP '2024-01-15')
SELECT symbol, {KEY}, {r('greatest(-3, least(3, (close - mc) / nullif(sc, 0)))', 'close')}, {r('greatest(-3, least(3, (volume - mv) / nullif(sv, 0)))', 'volume')} FROM bars, s WHERE ts >= TIMESTAMP '2024-01-15'"""

_RSI = f"""n AS (SELECT *, row_number() OVER {w()} AS n FROM bars), d AS (SELECT symbol, ts, n, close - lag(close) OVER {w()} AS x FROM n),
e(symbol, ts, n, u, v) AS (SELECT symbol, ts, n, greatest(x, 0), greatest(-x, 0) FROM d WHERE n = 2
  UNION ALL SELECT d.symbol, d.ts, d.n, u + (greatest(x, 0) - u) / 14, v + (greatest(-x, 0) - v) / 14 FROM e JOIN d ON d.symbol = e.symbol AND d.n = e.n + 1),
f AS (SELECT d.symbol, d.ts, CASE WHEN d.n >= 15 AND v <> 0 THEN 100 - 100 / (1 + u / v) END AS i FROM d LEFT JOIN e ON e.symbol = d.symbol AND e.n = d.n)"""
QUERIES["rsi_reversion"] = lambda spark, d: shown(T.rsi_reversion(event_bars_1h(spark, d), low=47.0, high=53.0), KEYS, ["signal"])
SQL["rsi_reversion"] = f"""WITH RECURSIVE {EVENT_BARS_1H}, {_RSI}, g AS (SELECT *, CASE WHEN i < 47 THEN 1.0 WHEN i > 53 THEN 0.0 END AS s FROM f)
SELECT symbol, {KEY}, CAST(coalesce(last_value(s IGNORE NULLS) OVER {over()}, 0) AS DOUBLE) AS signal FROM g"""

QUERIES["dense_panel"] = lambda spark, d: shown(S.dense_panel(event_bars_1h(spark, d)), KEYS, ["close"])
SQL["dense_panel"] = f"""WITH {EVENT_BARS_1H}, g AS (SELECT * FROM (SELECT DISTINCT ts FROM bars), (SELECT DISTINCT symbol FROM bars)), j AS (SELECT g.symbol, g.ts, b.close FROM g LEFT JOIN bars b USING (symbol, ts))
SELECT symbol, {KEY}, {r(f'last_value(close IGNORE NULLS) OVER {over()}', 'close')} FROM j"""

QUERIES["common_dates"] = lambda spark, d: shown(S.common_dates(event_bars_1h(spark, d)), KEYS, ["close"])
SQL["common_dates"] = f"""WITH {EVENT_BARS_1H} SELECT symbol, {KEY}, {r('close', 'close')} FROM bars WHERE ts IN (SELECT ts FROM bars GROUP BY ts HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars))"""

QUERIES["latest_prices"] = lambda spark, d: shown(S.latest(event_bars_1h(spark, d)), ("symbol",), ["close"])
SQL["latest_prices"] = f"WITH {EVENT_BARS_1H} SELECT symbol, {r('arg_max(close, ts)', 'close')} FROM bars GROUP BY symbol"

QUERIES["top_n_by_score"] = lambda spark, d: shown(X.top_n(table(spark, d, "part").select(F.col("p_partkey").alias("symbol"), "p_retailprice"), "p_retailprice", 20, "symbol", scheme="score", max_weight=0.1), ("symbol",), ["rank", "weight"])
SQL["top_n_by_score"] = f"""WITH t AS (SELECT p_partkey AS symbol, p_retailprice AS s FROM part ORDER BY s DESC, symbol LIMIT 20), a AS (SELECT *, CAST(row_number() OVER (ORDER BY s DESC, symbol) AS INTEGER) AS rank, least(0.1, s / sum(s) OVER ()) AS w0 FROM t)
SELECT symbol, rank, {r('w0 / sum(w0) OVER ()', 'weight')} FROM a"""


def _two_runs(spark, d):  # noqa: ANN001, ANN202
    b = order_bars_1w(spark, d)
    one = B.long_only(b.withColumn("signal", T.dual_ma(4, 12)))
    two = B.long_only(b.withColumn("signal", T.dual_ma(4, 12)).where("ts > '1995-03-01'"), fee_bps=10.0)
    return one, two


QUERIES["parity_differences"] = lambda spark, d: shown(parity.differences(*_two_runs(spark, d), KEYS, ["position", "turnover"]), ("value",), ["n_both", "n_left", "n_right", "max_abs"])
SQL["parity_differences"] = f"""WITH {ORDER_BARS_1W}, s AS (SELECT symbol, ts, CAST(coalesce({least('close', 4, 'avg(close)', 4)} > {least('close', 12, 'avg(close)', 12)}, false) AS DOUBLE) AS sig FROM bars),
a0 AS (SELECT symbol, ts, coalesce(lag(sig) OVER {w()}, 0) AS position FROM s), a AS (SELECT *, coalesce(abs(position - lag(position) OVER {w()}), abs(position)) AS turnover FROM a0),
b0 AS (SELECT symbol, ts, coalesce(lag(sig) OVER {w()}, 0) AS position FROM s WHERE ts > TIMESTAMP '1995-03-01'), b AS (SELECT *, coalesce(abs(position - lag(position) OVER {w()}), abs(position)) AS turnover FROM b0),
j AS (SELECT a.symbol AS l, b.symbol AS r, abs(a.position - b.position) AS p, abs(a.turnover - b.turnover) AS t FROM a FULL JOIN b ON a.symbol = b.symbol AND a.ts = b.ts)
SELECT v AS value, count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) AS n_both, count(*) FILTER (r IS NULL) AS n_left, count(*) FILTER (l IS NULL) AS n_right, {r("max(CASE v WHEN 'position' THEN p ELSE t END)", "max_abs")} FROM j, (SELECT unnest(['position', 'turnover']) AS v) GROUP BY v"""


def _crossing(spark, d):  # noqa: ANN001, ANN202
    b = order_bars_1w(spark, d)
    a = b.withColumn("halt", W.drawdown("close") < -0.3)
    c = b.withColumn("halt", W.drawdown("close") < -0.35)
    return parity.first_parting(a, c, ("ts",), "halt", ("symbol",))


QUERIES["boundary_crossing"] = lambda spark, d: shown(_crossing(spark, d), ("symbol", "ts"), ["left_flag", "right_flag"])
SQL["boundary_crossing"] = f"""WITH {ORDER_BARS_1W}, x AS (SELECT symbol, ts, close / max(close) OVER {over()} - 1 AS dd FROM bars), y AS (SELECT symbol, min(ts) AS ts FROM x WHERE (dd < -0.3) <> (dd < -0.35) GROUP BY symbol)
SELECT symbol, {KEY}, true AS left_flag, false AS right_flag FROM y"""


def _responses(spark, d):  # noqa: ANN001, ANN202
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(F.floor(k / 5).cast("int").alias("window"), F.lit("gap").alias("outcome"), (k % 5 + 1).cast("int").alias("horizon"), (1 - F.pow(F.lit(0.4) + F.floor(k / 5) * 0.1, (k % 5 + 1).cast("double"))).alias("coefficient"))


QUERIES["effect_half_life"] = lambda spark, d: shown(L.half_life(_responses(spark, d)), ("window", "outcome"), ["half_life"])
SQL["effect_half_life"] = f"""WITH c AS (SELECT CAST(n_nationkey // 5 AS INTEGER) AS window_, n_nationkey % 5 + 1 AS h, 1 - pow(0.4 + (n_nationkey // 5) * 0.1, n_nationkey % 5 + 1) AS b FROM nation),
m AS (SELECT window_, h, abs(b - coalesce(lag(b) OVER (PARTITION BY window_ ORDER BY h), 0)) AS m FROM c), f AS (SELECT *, ln(m / first_value(m) OVER (PARTITION BY window_ ORDER BY h)) AS y FROM m)
SELECT window_ AS window, 'gap' AS outcome, {r('ln(2) / -regr_slope(y, h - 1)', 'half_life')} FROM f GROUP BY window_"""


def _statements(spark, d):  # noqa: ANN001, ANN202
    o = table(spark, d, "orders")
    year = o.groupBy(F.col("o_orderpriority").alias("entity"), F.year("o_orderdate").cast("string").alias("period_end")).agg(F.sum("o_totalprice").alias("revenue"), F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0)).alias("cost_of_revenue"))
    part = lambda x: F.col("revenue") * x
    return year.withColumns({"operating_expenses": part(0.1), "operating_income": F.col("revenue") * 0.9 - F.col("cost_of_revenue"), "net_income": part(0.05), "cash_from_operations": part(0.2), "capital_expenditure": part(0.08), "total_assets": part(2.0), "total_liabilities": part(1.2), "total_equity": part(0.8), "cash": part(0.1), "debt": part(0.3)})


QUERIES["statement_trends"] = lambda spark, d: shown(R.statements(_statements(spark, d)), ("entity", "period_end"), ["gross_margin", "operating_margin", "fcf_margin", "revenue_growth", "margin_change", "balance_residual"])
SQL["statement_trends"] = f"""WITH y AS (SELECT o_orderpriority AS entity, CAST(year(o_orderdate) AS VARCHAR) AS period_end, sum(o_totalprice) AS rev, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) AS cost FROM orders GROUP BY ALL)
SELECT entity, period_end, {r('(rev - cost) / rev', 'gross_margin')}, {r('(rev * 0.9 - cost) / rev', 'operating_margin')}, {r('(rev * 0.2 - rev * 0.08) / rev', 'fcf_margin')}, {r('rev / lag(rev) OVER (PARTITION BY entity ORDER BY period_end) - 1', 'revenue_growth')},
  {r('(rev * 0.9 - cost) / rev - lag((rev * 0.9 - cost) / rev) OVER (PARTITION BY entity ORDER BY period_end)', 'margin_change')}, {r('abs(rev * 2.0 - (rev * 1.2 + rev * 0.8)) / greatest(abs(rev * 2.0), 1.0)', 'balance_residual')} FROM y"""
