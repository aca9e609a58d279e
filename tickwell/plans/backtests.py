"""Queries over backtests, splits, inference and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickwell.functions import windows as W
from tickwell.operators import asof as J
from tickwell.operators import backtest as B
from tickwell.operators import conformal as C
from tickwell.operators import cross_section as X
from tickwell.operators import consensus as V
from tickwell.operators import inference as N
from tickwell.operators import ledger as L
from tickwell.operators import research as R
from tickwell.operators import signals as T
from tickwell.operators import splits as P
from tickwell.operators import indicators as I
from tickwell.plans.common import KEY, least, over, r, shown, w
from tickwell.sources.bars import EVENT_BARS_1H, ORDER_BARS_1W, event_bars_1h, order_bars_1w, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
_RET = f"close / nullif(lag(close) OVER {w()}, 0) - 1"


def _curve(spark, d, **costs):  # noqa: ANN001, ANN202
    return B.long_only(order_bars_1w(spark, d).withColumn("signal", T.dual_ma(4, 12)), **costs)


def _curve_sql(rate: str) -> str:
    return f"""s AS (SELECT *, CAST(coalesce({least('close', 4, 'avg(close)', 4)} > {least('close', 12, 'avg(close)', 12)}, false) AS DOUBLE) AS sig, coalesce({_RET}, 0) AS ar FROM bars),
p AS (SELECT *, coalesce(lag(sig) OVER {w()}, 0) AS position FROM s), t AS (SELECT *, coalesce(abs(position - lag(position) OVER {w()}), abs(position)) AS turnover FROM p),
u AS (SELECT *, position * ar - turnover * {rate} AS ret FROM t), curve AS (SELECT *, product(1 + ret) OVER {over()} AS equity FROM u)"""


QUERIES["run_long_only"] = lambda spark, d: shown(_curve(spark, d), ("symbol", "ts"), ["position", "turnover", "ret", "equity"])
SQL["run_long_only"] = f"WITH {ORDER_BARS_1W}, {_curve_sql('0.0005')} SELECT symbol, {KEY}, {', '.join(r(c, c) for c in ('position', 'turnover', 'ret', 'equity'))} FROM curve"

_SUMMARY = f"""x AS (SELECT *, equity / max(equity) OVER {over()} - 1 AS dd, abs(coalesce(position - lag(position) OVER {w()}, position)) AS dp FROM curve)
SELECT symbol, {r('arg_max(equity, ts) - 1', 'total_return')}, {r('CASE WHEN count(*) < 2 THEN 0 ELSE pow(arg_max(equity, ts) / arg_min(equity, ts), 52.0 / count(*)) - 1 END', 'cagr')}, {r('CASE WHEN coalesce(stddev_samp(ret), 0) = 0 THEN 0 ELSE avg(ret) / stddev_samp(ret) * sqrt(52) END', 'sharpe')},
  {r('min(dd)', 'max_drawdown')}, CAST(sum(CAST(dp > 1e-12 AS INT)) AS BIGINT) AS trades, {r('coalesce(avg(CAST(ret > 0 AS INT)) FILTER (abs(position) > 1e-12), 0)', 'win_rate')}, {r('arg_max(equity, ts)', 'final_equity')} FROM x GROUP BY symbol"""
QUERIES["dual_ma_summary"] = lambda spark, d: shown(B.summary(_curve(spark, d), periods=52.0), ("symbol",), ["total_return", "cagr", "sharpe", "max_drawdown", "trades", "win_rate", "final_equity"])
SQL["dual_ma_summary"] = f"WITH {ORDER_BARS_1W}, {_curve_sql('0.0005')}, {_SUMMARY}"

QUERIES["cost_tiers"] = lambda spark, d: shown(B.summary(_curve(spark, d, tier="mid", cancel_fee=5.0), periods=52.0), ("symbol",), ["total_return", "cagr", "sharpe", "max_drawdown", "trades", "win_rate", "final_equity"])
SQL["cost_tiers"] = f"WITH {ORDER_BARS_1W}, {_curve_sql('0.00205')}, {_SUMMARY}"


def _portfolio(spark, d):  # noqa: ANN001, ANN202
    bars = order_bars_1w(spark, d)
    n = F.count(F.lit(1)).over(X.at("ts"))
    return B.portfolio(bars, bars.withColumn("weight", 1.0 / n), "Q")


QUERIES["portfolio_quarterly"] = lambda spark, d: shown(_portfolio(spark, d), ("ts",), ["ret", "turnover", "gross", "equity"])
SQL["portfolio_quarterly"] = f"""WITH {ORDER_BARS_1W}, wt AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY ts) AS weight, coalesce({_RET}, 0) AS ar FROM bars),
q AS (SELECT *, coalesce(lag(weight) OVER {w()}, 0) AS want FROM wt), days AS (SELECT ts, sum(abs(want)) AS g FROM q GROUP BY ts),
m AS (SELECT *, coalesce(date_trunc('quarter', ts) <> lead(date_trunc('quarter', ts)) OVER (ORDER BY ts), true) AS mask FROM days),
seg AS (SELECT *, sum(CAST(mask AS INT)) OVER (ORDER BY ts) AS seg FROM m), fr AS (SELECT ts, coalesce(min(CASE WHEN g >= 1e-15 THEN ts END) OVER (PARTITION BY seg ORDER BY ts), ts) AS since FROM seg),
h AS (SELECT q.symbol, q.ts, q.ar, coalesce(o.want, 0) AS held FROM q JOIN fr USING (ts) LEFT JOIN q o ON o.symbol = q.symbol AND o.ts = fr.since),
b AS (SELECT *, abs(held - coalesce(lag(held) OVER {w()}, 0)) AS turn FROM h), z AS (SELECT ts, sum(held * ar) - sum(turn) * 0.0005 AS ret, sum(turn) AS turnover, sum(abs(held)) AS gross FROM b GROUP BY ts)
SELECT {KEY}, {r('ret', 'ret')}, {r('turnover', 'turnover')}, {r('gross', 'gross')}, {r('product(1 + ret) OVER (ORDER BY ts)', 'equity')} FROM z"""



def _masked(spark, d):  # noqa: ANN001, ANN202
    bars = order_bars_1w(spark, d)
    free = bars.select("symbol", "ts", ((F.weekofyear("ts") + F.ascii("symbol")) % 4 != 0).alias("tradeable")).where(F.weekofyear("ts") % 13 != 0)
    tilt = F.when(F.month("ts") % 3 == 0, -0.3).otherwise((F.ascii("symbol") - 48) / 15.0)
    return B.portfolio(bars, bars.withColumn("weight", F.when(F.col("symbol") != "5-LOW", tilt)), "M", tradeable=free)


QUERIES["portfolio_masked"] = lambda spark, d: shown(_masked(spark, d), ("ts",), ["ret", "turnover", "gross", "equity"])
SQL["portfolio_masked"] = f"""WITH {ORDER_BARS_1W}, w0 AS (SELECT *, coalesce({_RET}, 0) AS ar, CASE WHEN week(ts) % 13 <> 0 AND (week(ts) + ascii(symbol)) % 4 <> 0 AND symbol <> '5-LOW' THEN CASE WHEN month(ts) % 3 = 0 THEN -0.3 ELSE (ascii(symbol) - 48) / 15.0 END ELSE 0 END AS free FROM bars),
w1 AS (SELECT *, sum(greatest(free, 0)) OVER (PARTITION BY ts) AS long FROM w0), wt AS (SELECT *, CASE WHEN long > 0 THEN greatest(free, 0) / long ELSE free END AS weight FROM w1),
q AS (SELECT *, coalesce(lag(weight) OVER {w()}, 0) AS want FROM wt), days AS (SELECT ts, sum(abs(want)) AS g FROM q GROUP BY ts),
m AS (SELECT *, coalesce(date_trunc('month', ts) <> lead(date_trunc('month', ts)) OVER (ORDER BY ts), true) AS mask FROM days),
seg AS (SELECT *, sum(CAST(mask AS INT)) OVER (ORDER BY ts) AS seg FROM m), fr AS (SELECT ts, coalesce(min(CASE WHEN g >= 1e-15 THEN ts END) OVER (PARTITION BY seg ORDER BY ts), ts) AS since FROM seg),
h AS (SELECT q.symbol, q.ts, q.ar, coalesce(o.want, 0) AS held FROM q JOIN fr USING (ts) LEFT JOIN q o ON o.symbol = q.symbol AND o.ts = fr.since),
b AS (SELECT *, abs(held - coalesce(lag(held) OVER {w()}, 0)) AS turn FROM h), z AS (SELECT ts, sum(held * ar) - sum(turn) * 0.0005 AS ret, sum(turn) AS turnover, sum(abs(held)) AS gross FROM b GROUP BY ts)
SELECT {KEY}, {r('ret', 'ret')}, {r('turnover', 'turnover')}, {r('gross', 'gross')}, {r('product(1 + ret) OVER (ORDER BY ts)', 'equity')} FROM z"""


def _benchmarked(spark, d):  # noqa: ANN001, ANN202
    rets = order_bars_1w(spark, d).select("symbol", "ts", I.change("close").alias("ret"))
    bench = rets.groupBy("ts").agg(F.avg("ret").alias("ret")).where(F.month("ts") != 5)
    return B.metrics_table(rets, benchmark=bench, periods=52.0).join(B.trailing_returns(rets), "symbol")


_METRICS = ["cagr", "sharpe", "max_drawdown", "volatility", "sortino", "calmar", "win_rate", "beta", "alpha", "ret_1m", "ret_3m"]
QUERIES["metrics_table"] = lambda spark, d: shown(_benchmarked(spark, d), ("symbol",), _METRICS)
SQL["metrics_table"] = f"""WITH {ORDER_BARS_1W}, v AS (SELECT symbol, ts, {_RET} AS ret FROM bars), m AS (SELECT ts, avg(ret) AS b FROM v WHERE month(ts) <> 5 GROUP BY ts),
x AS (SELECT v.symbol, v.ts, ret, coalesce(b, 0) AS b, product(1 + ret) OVER (PARTITION BY v.symbol ORDER BY v.ts) AS eq, row_number() OVER (PARTITION BY v.symbol ORDER BY v.ts DESC) AS k FROM v LEFT JOIN m USING (ts) WHERE ret IS NOT NULL),
y AS (SELECT *, eq / max(eq) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS dd FROM x),
a AS (SELECT symbol, avg(ret) * 52 AS cagr, avg(ret) / stddev_samp(ret) * sqrt(52) AS sharpe, min(dd) AS max_drawdown, stddev_samp(ret) * sqrt(52) AS volatility, avg(ret) * sqrt(52) / sqrt(avg(least(ret, 0) * least(ret, 0))) AS sortino, avg(CAST(ret > 0 AS INT)) AS win_rate,
  covar_samp(ret, b) / var_samp(b) AS beta, avg(ret) AS mr, avg(b) AS mb, product(1 + ret) FILTER (WHERE k <= 21) - 1 AS ret_1m, product(1 + ret) FILTER (WHERE k <= 63) - 1 AS ret_3m FROM y GROUP BY symbol),
z AS (SELECT *, cagr / abs(max_drawdown) AS calmar, (mr - beta * mb) * 52 AS alpha FROM a) SELECT symbol, {', '.join(r(c, c) for c in _METRICS)} FROM z"""

QUERIES["tsmom_sweep"] = lambda spark, d: shown(B.sweep(order_bars_1w(spark, d), spark.createDataFrame([(4,), (12,), (26,)], "lookback int"), "tsmom", periods=52.0), ("symbol", "lookback"), ["total_return", "sharpe", "max_drawdown", "trades"])
SQL["tsmom_sweep"] = f"""WITH {ORDER_BARS_1W}, g AS (SELECT unnest([4, 12, 26]) AS lookback), s AS (SELECT *, coalesce({_RET}, 0) AS ar, coalesce(sign(close / nullif(lag(close, 4) OVER {w()}, 0) - 1), 0) AS s4, coalesce(sign(close / nullif(lag(close, 12) OVER {w()}, 0) - 1), 0) AS s12,
  coalesce(sign(close / nullif(lag(close, 26) OVER {w()}, 0) - 1), 0) AS s26 FROM bars), x AS (SELECT s.*, lookback, CASE lookback WHEN 4 THEN s4 WHEN 12 THEN s12 ELSE s26 END AS sig FROM s, g),
p AS (SELECT *, coalesce(lag(sig) OVER {w('symbol, lookback')}, 0) AS position FROM x), t AS (SELECT *, coalesce(abs(position - lag(position) OVER {w('symbol, lookback')}), abs(position)) AS turn FROM p),
u AS (SELECT *, position * ar - turn * 0.0005 AS ret FROM t), c AS (SELECT *, product(1 + ret) OVER {over(None, 'symbol, lookback')} AS equity FROM u), y AS (SELECT *, equity / max(equity) OVER {over(None, 'symbol, lookback')} - 1 AS dd FROM c)
SELECT symbol, lookback, {r('arg_max(equity, ts) - 1', 'total_return')}, {r('CASE WHEN coalesce(stddev_samp(ret), 0) = 0 THEN 0 ELSE avg(ret) / stddev_samp(ret) * sqrt(52) END', 'sharpe')}, {r('min(dd)', 'max_drawdown')}, CAST(sum(CAST(turn > 1e-12 AS INT)) AS BIGINT) AS trades FROM y GROUP BY ALL"""

QUERIES["performance"] = lambda spark, d: shown(B.performance(_curve(spark, d), periods=52.0), ("symbol",), ["points", "total_return", "cagr", "volatility", "sharpe", "max_drawdown", "win_rate", "sortino", "calmar"])
SQL["performance"] = f"""WITH {ORDER_BARS_1W}, {_curve_sql('0.0005')}, e AS (SELECT symbol, ts, equity, equity / nullif(lag(equity) OVER {w()}, 0) - 1 AS x, equity / max(equity) OVER {over()} - 1 AS dd FROM curve),
a AS (SELECT symbol, count(*) AS points, arg_max(equity, ts) / arg_min(equity, ts) - 1 AS tr, pow(arg_max(equity, ts) / arg_min(equity, ts), 52.0 / count(*)) - 1 AS cagr, stddev_samp(x) AS sd, avg(x) AS m, sqrt(avg(CASE WHEN x IS NOT NULL THEN pow(least(x, 0), 2) END)) AS down, min(dd) AS mdd, avg(CAST(x > 1e-12 AS INT)) AS wr FROM e GROUP BY symbol)
SELECT symbol, points, {r('tr', 'total_return')}, {r('cagr', 'cagr')}, {r('sd * sqrt(52)', 'volatility')}, {r('CASE WHEN coalesce(sd, 0) = 0 THEN 0 ELSE m / sd * sqrt(52) END', 'sharpe')}, {r('mdd', 'max_drawdown')}, {r('wr', 'win_rate')}, {r('m * sqrt(52) / nullif(down, 0)', 'sortino')}, {r('cagr / nullif(abs(mdd), 0)', 'calmar')} FROM a"""


def _fills(spark, d):  # noqa: ANN001, ANN202
    item = table(spark, d, "lineitem")
    return item.select(F.col("l_returnflag").alias("symbol"), F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("side"), F.col("l_quantity").alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), (F.col("l_extendedprice") * F.col("l_tax")).alias("fee"))


QUERIES["trade_stats"] = lambda spark, d: B.trade_stats(_fills(spark, d)).withColumns({c: F.round(c, 2) for c in ("buy_notional", "sell_notional", "fees")})
SQL["trade_stats"] = """SELECT count(*) AS n_fills, CAST(sum(CAST(l_linestatus = 'O' AS INT)) AS BIGINT) AS n_buys, CAST(sum(CAST(l_linestatus <> 'O' AS INT)) AS BIGINT) AS n_sells, round(sum(l_quantity * (l_extendedprice / l_quantity)) FILTER (l_linestatus = 'O'), 2) AS buy_notional,
  round(sum(l_quantity * (l_extendedprice / l_quantity)) FILTER (l_linestatus <> 'O'), 2) AS sell_notional, round(sum(l_extendedprice * l_tax), 2) AS fees, count(DISTINCT l_returnflag) AS n_symbols FROM lineitem"""


def _folds(spark, d):  # noqa: ANN001, ANN202
    b = order_bars_1w(spark, d).withColumn("idx", F.row_number().over(W.ordered()))
    return b.select("symbol", F.floor(F.col("idx") / 90).cast("int").alias("fold"), "idx", F.col("close").alias("equity"))


QUERIES["chain_oos"] = lambda spark, d: shown(B.chain_folds(_folds(spark, d), ("symbol",)), ("symbol", "fold", "idx"), ["equity"])
SQL["chain_oos"] = f"""WITH {ORDER_BARS_1W}, f AS (SELECT symbol, CAST(floor(n / 90) AS INTEGER) AS fold, CAST(n AS INTEGER) AS idx, close AS equity FROM (SELECT symbol, row_number() OVER {w()} AS n, close FROM bars)),
x AS (SELECT *, coalesce(equity / lag(equity) OVER (PARTITION BY symbol, fold ORDER BY idx), 1) AS q FROM f) SELECT symbol, fold, idx, {r('product(q) OVER (PARTITION BY symbol ORDER BY fold, idx)', 'equity')} FROM x"""


def _dates(spark, d):  # noqa: ANN001, ANN202
    return order_bars_1w(spark, d).select("ts").distinct().withColumn("t1", F.col("ts") + F.expr("INTERVAL 21 DAYS"))


QUERIES["purged_kfold"] = lambda spark, d: P.purged_kfold(_dates(spark, d), 5, 0.02, "ts", "t1").select("fold", F.col("pos").cast("long"), "role")
SQL["purged_kfold"] = f"""WITH {ORDER_BARS_1W}, b AS (SELECT ts AS t0, ts + INTERVAL 21 DAY AS t1, row_number() OVER (ORDER BY ts) - 1 AS pos, ntile(5) OVER (ORDER BY ts) - 1 AS block FROM (SELECT DISTINCT ts FROM bars)),
k AS (SELECT block AS fold, arg_min(t0, pos) AS b0, arg_max(t1, pos) AS b1, max(pos) AS last FROM b GROUP BY block), n AS (SELECT CAST(floor(count(*) * 0.02) AS INT) AS e FROM b),
t AS (SELECT fold, pos, pos > last AS after FROM b, k WHERE block <> fold AND NOT (t1 >= b0 AND t0 <= b1)), u AS (SELECT *, row_number() OVER (PARTITION BY fold, after ORDER BY pos) AS n FROM t)
SELECT CAST(fold AS INTEGER) AS fold, pos, 'train' AS role FROM u, n WHERE NOT after OR u.n > e UNION ALL SELECT CAST(fold AS INTEGER), pos, 'test' FROM b JOIN k ON block = fold"""

QUERIES["walk_forward_months"] = lambda spark, d: P.walk_forward_months(_dates(spark, d), 4, 6, None, 3).select("fold", F.col("pos").cast("long"), "role")
SQL["walk_forward_months"] = f"""WITH {ORDER_BARS_1W}, b AS (SELECT row_number() OVER (ORDER BY ts) - 1 AS pos, dense_rank() OVER (ORDER BY date_trunc('month', ts)) - 1 AS m FROM (SELECT DISTINCT ts FROM bars)),
k AS (SELECT CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS fold), f AS (SELECT fold, (SELECT max(m) + 1 FROM b) - 24 + fold * 6 AS s FROM k),
t AS (SELECT fold, pos, row_number() OVER (PARTITION BY fold ORDER BY pos DESC) AS n FROM b, f WHERE m < s)
SELECT fold, pos, 'train' AS role FROM t WHERE n > 3 UNION ALL SELECT fold, pos, 'test' FROM b, f WHERE m >= s AND m < s + 6"""

QUERIES["three_way_split"] = lambda spark, d: P.three_way(_dates(spark, d), 0.6, 0.2, 5, 5).groupBy("role").count()
SQL["three_way_split"] = f"""WITH {ORDER_BARS_1W}, b AS (SELECT row_number() OVER (ORDER BY ts) - 1 AS d, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM bars)),
x AS (SELECT CASE WHEN d < floor(n * 0.6) THEN 'train' WHEN d < floor(n * 0.6) + 5 THEN 'gap' WHEN d < floor(n * 0.8) THEN 'valid' WHEN d < floor(n * 0.8) + 5 THEN 'gap' ELSE 'test' END AS role FROM b) SELECT role, count(*) AS count FROM x GROUP BY role"""


def _variants(spark, d):  # noqa: ANN001, ANN202
    return order_bars_1w(spark, d).select(F.col("ts").alias("t"), F.col("symbol").alias("variant"), I.change("close").alias("ret"))


QUERIES["pbo_cscv"] = lambda spark, d: shown(N.pbo(_variants(spark, d), 8), (), ["pbo", "n_splits"])
SQL["pbo_cscv"] = f"""WITH {ORDER_BARS_1W}, v AS (SELECT ts AS t, symbol AS variant, coalesce({_RET}, 0) AS ret FROM bars), k AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT t FROM v)),
b AS (SELECT t, CAST(i // (n // 8) AS INT) AS block FROM k WHERE i // (n // 8) < 8), s AS (SELECT block, variant, count(*) AS n, sum(ret) AS s, sum(ret * ret) AS q FROM v JOIN b USING (t) GROUP BY ALL),
m AS (SELECT range AS mask FROM range(256) WHERE bit_count(range) = 4), a AS (SELECT mask, variant, (mask >> block) & 1 = 1 AS train, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM m, s GROUP BY ALL),
z AS (SELECT mask, variant, train, coalesce((s / n) / nullif(sqrt(greatest(0, (q - n * (s / n) * (s / n)) / (n - 1))), 0), 0) AS sr FROM a),
f AS (SELECT mask, variant FROM (SELECT mask, variant, row_number() OVER (PARTITION BY mask ORDER BY sr DESC, variant) AS k FROM z WHERE train) WHERE k = 1),
o AS (SELECT f.mask, z.sr AS own FROM f JOIN z ON z.mask = f.mask AND z.variant = f.variant AND NOT z.train), c AS (SELECT mask, sum(CAST(sr > own + 1e-12 AS INT)) AS better, count(*) AS v FROM z JOIN o USING (mask) WHERE NOT train GROUP BY mask)
SELECT {r('avg(CAST((better + 1) / (v + 1) >= 0.5 AS INT))', 'pbo')}, count(*) AS n_splits FROM c"""


def _psr(spark, d):  # noqa: ANN001, ANN202
    m = N.moments(_variants(spark, d), "ret", ("variant",)).withColumn("sr", F.col("mean") / F.col("sd"))
    return shown(m.withColumns({"z": N.psr_z(F.col("sr"), 0.0, F.col("n").cast("double"), F.col("skew"), F.col("kurt")), "min_trl": N.min_track_record(F.col("sr"), F.col("skew"), F.col("kurt"))}), ("variant",), ["n", "mean", "sd", "skew", "kurt", "sr", "z", "min_trl"])


QUERIES["psr_moments"] = _psr
SQL["psr_moments"] = f"""WITH {ORDER_BARS_1W}, v AS (SELECT symbol AS variant, {_RET} AS ret FROM bars), a AS (SELECT variant, count(ret) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd FROM v GROUP BY variant),
m AS (SELECT a.*, k.skew, k.kurt, mean / sd AS sr FROM a JOIN (SELECT variant, avg(pow((ret - mean) / sd, 3)) AS skew, avg(pow((ret - mean) / sd, 4)) AS kurt FROM v JOIN a USING (variant) WHERE ret IS NOT NULL GROUP BY variant) k USING (variant))
SELECT variant, n, {r('mean', 'mean')}, {r('sd', 'sd')}, {r('skew', 'skew')}, {r('kurt', 'kurt')}, {r('sr', 'sr')}, {r('sr * sqrt(greatest(1.0, n - 1.0)) / sqrt(greatest(1e-12, 1 - skew * sr + (kurt - 1) / 4 * sr * sr))', 'z')},
  {r('CASE WHEN sr > 0 THEN 1 + (1 - skew * sr + (kurt - 1) / 4 * sr * sr) * pow(1.6448536269514722 / sr, 2) END', 'min_trl')} FROM m"""

QUERIES["deflated_sharpe"] = lambda spark, d: shown(N.deflated_sharpe(_variants(spark, d), "ret", ("variant",), 20, 0.05), ("variant",), ["psr", "dsr"])

#: The normal distribution function by its series, through the logarithm of the gamma function.
_CDF = "greatest(0.0, least(1.0, 0.5 + sign({z}) * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 170), lambda k: exp((2 * k + 1) * ln(greatest(abs({z}), 1e-300)) - lgamma(2 * k + 2) + k * ln(2.0) + lgamma(k + 1))))))"
_MOMENTS = """m AS (SELECT {by}, n, mean, sd, CASE WHEN n >= 3 THEN (m3 - 3 * mean * m2 + 2 * pow(mean, 3)) / pow(sd, 3) ELSE 0 END AS skew, CASE WHEN n >= 3 THEN (m4 - 4 * mean * m3 + 6 * pow(mean, 2) * m2 - 3 * pow(mean, 4)) / pow(sd, 4) ELSE 3 END AS kurt, mean / sd AS sr
  FROM (SELECT {by}, count(ret) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd, avg(ret * ret) AS m2, avg(pow(ret, 3)) AS m3, avg(pow(ret, 4)) AS m4 FROM v GROUP BY ALL))"""
_Z = "(sr - {best}) * sqrt(greatest(1.0, n - 1.0)) / sqrt(greatest(1e-12, 1 - skew * sr + (kurt - 1) / 4 * sr * sr))"
SQL["deflated_sharpe"] = f"""WITH {ORDER_BARS_1W}, v AS (SELECT symbol AS variant, {_RET} AS ret FROM bars), {_MOMENTS.format(by='variant')},
z AS (SELECT variant, {_Z.format(best='0.0')} AS z0, {_Z.format(best=repr(N.expected_max_sharpe(20, 0.05)))} AS z1 FROM m) SELECT variant, {r(_CDF.format(z='z0'), 'psr')}, {r(_CDF.format(z='z1'), 'dsr')} FROM z"""


def _oos(spark, d):  # noqa: ANN001, ANN202
    later = F.row_number().over(W.ordered()) > (F.ascii("symbol") - 48) * 10
    rows = order_bars_1w(spark, d).select("symbol", "ts", I.change("close").alias("ret"), later.alias("use")).where("use")
    return N.oos_statistics(rows.select(F.col("symbol").alias("window"), F.col("ts").alias("t"), "ret"), 8, 52.0)


QUERIES["oos_statistics"] = lambda spark, d: shown(_oos(spark, d), ("n_windows", "oos_obs", "n_blocks_used"), ["sharpe_per_bar", "oos_sharpe", "dsr", "dsr_pass", "pbo", "pbo_flag"])
SQL["oos_statistics"] = f"""WITH {ORDER_BARS_1W}, v0 AS (SELECT symbol, ts, {_RET} AS ret, row_number() OVER {w()} AS k FROM bars), v1 AS (SELECT symbol, ts, ret FROM v0 WHERE k > (ascii(symbol) - 48) * 10 AND ret IS NOT NULL),
p AS (SELECT symbol AS variant, ret, row_number() OVER {w()} - 1 AS i FROM v1), v AS (SELECT 1 AS one, ret FROM p), {_MOMENTS.format(by='one')},
ws AS (SELECT stddev_samp(s) AS spread FROM (SELECT avg(ret) / stddev_samp(ret) AS s FROM p GROUP BY variant)),
tot AS (SELECT n AS oos_obs, sr, {_Z.format(best=f'spread * {N.expected_max_sharpe(5, 1.0)!r}')} AS z FROM m, ws), dense AS (SELECT variant, i, coalesce(ret, 0) AS ret, n FROM (SELECT DISTINCT variant FROM p) CROSS JOIN (SELECT unnest(range(max(i) + 1)) AS i, max(i) + 1 AS n FROM p) LEFT JOIN p USING (variant, i)),
s AS (SELECT CAST(i // (n // 8) AS INT) AS block, variant, count(*) AS n, sum(ret) AS s, sum(ret * ret) AS q FROM dense WHERE i // (n // 8) < 8 GROUP BY ALL),
k AS (SELECT range AS mask FROM range(256) WHERE bit_count(range) = 4), a AS (SELECT mask, variant, (mask >> block) & 1 = 1 AS train, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM k, s GROUP BY ALL),
z AS (SELECT mask, variant, train, coalesce((s / n) / nullif(sqrt(greatest(0, (q - n * (s / n) * (s / n)) / (n - 1))), 0), 0) AS sr FROM a),
f AS (SELECT mask, variant FROM (SELECT mask, variant, row_number() OVER (PARTITION BY mask ORDER BY sr DESC, variant) AS k FROM z WHERE train) WHERE k = 1),
o AS (SELECT f.mask, z.sr AS own FROM f JOIN z ON z.mask = f.mask AND z.variant = f.variant AND NOT z.train), c AS (SELECT mask, sum(CAST(sr > own + 1e-12 AS INT)) AS better, count(*) AS v FROM z JOIN o USING (mask) WHERE NOT train GROUP BY mask),
pb AS (SELECT avg(CAST((better + 1) / (v + 1) >= 0.5 AS INT)) AS pbo FROM c), fin AS (SELECT oos_obs, sr, {_CDF.format(z='z')} AS dsr, pbo FROM tot, pb)
SELECT 5 AS n_windows, oos_obs, 8 AS n_blocks_used, {r('sr', 'sharpe_per_bar')}, {r('sr * sqrt(52)', 'oos_sharpe')}, {r('dsr', 'dsr')}, dsr > 0 AS dsr_pass, {r('pbo', 'pbo')}, pbo > 0.5 AS pbo_flag FROM fin"""



def _hypotheses(spark, d):  # noqa: ANN001, ANN202
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.pmod(F.col("p_partkey") * 7919, F.lit(10007)) / 10007.0).alias("p"))


QUERIES["bh_adjust"] = lambda spark, d: shown(N.benjamini_hochberg(_hypotheses(spark, d)), ("id",), ["p", "q_value"])
SQL["bh_adjust"] = f"""WITH h AS (SELECT p_partkey AS id, (p_partkey * 7919) % 10007 / 10007.0::DOUBLE AS p FROM part), k AS (SELECT *, row_number() OVER (ORDER BY p, id) AS k, count(*) OVER () AS m FROM h)
SELECT id, {r('p', 'p')}, {r('least(1.0, min(p * m / k) OVER (ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))', 'q_value')} FROM k"""

QUERIES["conformal_quantile"] = lambda spark, d: shown(C.quantile(event_bars_1h(spark, d).withColumn("score", F.abs(I.change("close"))), "score", 0.1, ("symbol",)), ("symbol",), ["n", "quantile"])
SQL["conformal_quantile"] = f"""WITH {EVENT_BARS_1H}, s AS (SELECT symbol, abs({_RET}) AS score FROM bars), k AS (SELECT symbol, score, row_number() OVER (PARTITION BY symbol ORDER BY score) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM s WHERE score IS NOT NULL)
SELECT symbol, n, {r('score', 'quantile')} FROM k WHERE i = ceil(round(least(1.0, ceil(round((n + 1) * 0.9, 9)) / n) * (n - 1), 9)) + 1"""


def _misses(spark, d):  # noqa: ANN001, ANN202
    return event_bars_1h(spark, d).select("symbol", "ts", (F.abs(I.change("close")) > 2).cast("int").alias("miss")).where("miss IS NOT NULL")


_ACI = f"WITH RECURSIVE {EVENT_BARS_1H}, m AS (SELECT symbol, ts, CAST(abs({_RET}) > 2 AS INT) AS miss FROM bars), k AS (SELECT *, row_number() OVER {w()} AS n FROM m WHERE miss IS NOT NULL)"
QUERIES["aci_path"] = lambda spark, d: shown(C.aci_path(_misses(spark, d)), ("symbol", "ts"), ["miss", "alpha"])
SQL["aci_path"] = f"""{_ACI}, e(symbol, ts, n, miss, alpha) AS (SELECT symbol, ts, n, miss, least(greatest(0.1 + 0.01 * (0.1 - miss), 1e-4), 1 - 1e-4)::DOUBLE FROM k WHERE n = 1
  UNION ALL SELECT k.symbol, k.ts, k.n, k.miss, least(greatest(alpha + 0.01 * (0.1 - k.miss), 1e-4), 1 - 1e-4)::DOUBLE FROM e JOIN k ON k.symbol = e.symbol AND k.n = e.n + 1) SELECT symbol, {KEY}, miss, {r('alpha', 'alpha')} FROM e"""
QUERIES["dtaci_path"] = lambda spark, d: shown(C.dtaci_path(_misses(spark, d)), ("symbol", "ts"), ["miss", "alpha"])
SQL["dtaci_path"] = f"""{_ACI}, e(symbol, ts, n, miss, a, c) AS (
  SELECT symbol, ts, n, miss, list_transform([0.001, 0.005, 0.01, 0.05, 0.1]::DOUBLE[], lambda g: least(greatest(0.1 + g * (0.1 - miss), 1e-4), 1 - 1e-4)::DOUBLE), list_transform([1, 1, 1, 1, 1]::DOUBLE[], lambda g: (0.1 * (1 - miss - 0.1) - least(0, 1 - miss - 0.1))::DOUBLE) FROM k WHERE n = 1
  UNION ALL SELECT k.symbol, k.ts, k.n, k.miss, list_transform(list_zip(a, [0.001, 0.005, 0.01, 0.05, 0.1]::DOUBLE[]), lambda z: least(greatest(z[1] + z[2] * (0.1 - k.miss), 1e-4), 1 - 1e-4)::DOUBLE),
    list_transform(list_zip(c, a), lambda z: z[1] + 0.1 * (1 - k.miss - z[2]) - least(0, 1 - k.miss - z[2])) FROM e JOIN k ON k.symbol = e.symbol AND k.n = e.n + 1)
SELECT symbol, {KEY}, miss, {r('list_sum(list_transform(list_zip(a, c), lambda z: z[1] * exp(-0.1 * (z[2] - list_min(c))))) / list_sum(list_transform(c, lambda x: exp(-0.1 * (x - list_min(c)))))', 'alpha')} FROM e"""


def _sessions(spark, d):  # noqa: ANN001, ANN202
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("session")).distinct()
    at = lambda h: (F.col("session").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(h)))
    source = o.where("dayofweek(session) BETWEEN 2 AND 6").select("session", at(13).alias("open_at"), at(20).alias("close_at"))
    target = o.where("dayofweek(session) BETWEEN 2 AND 6 AND day(session) % 7 <> 0").select("session", at(1).alias("open_at"), at(7).alias("close_at"))
    return J.session_map(source, target)


QUERIES["asof_session_map"] = lambda spark, d: _sessions(spark, d).select(F.col("source_session").cast("string"), F.col("target_session").cast("string"))
SQL["asof_session_map"] = """WITH o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS session FROM orders), s AS (SELECT session, session + INTERVAL 20 HOUR AS close_at FROM o WHERE dayofweek(session) BETWEEN 1 AND 5),
t AS (SELECT session, session + INTERVAL 1 HOUR AS open_at FROM o WHERE dayofweek(session) BETWEEN 1 AND 5 AND day(session) % 7 <> 0), m AS (SELECT s.session AS source_session, close_at, (SELECT min(open_at) FROM t WHERE open_at > close_at) AS o FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY close_at DESC) AS n FROM m WHERE o IS NOT NULL) SELECT CAST(source_session AS VARCHAR) AS source_session, CAST(CAST(o AS DATE) AS VARCHAR) AS target_session FROM k WHERE n = 1"""


def _backward(spark, d):  # noqa: ANN001, ANN202
    b = event_bars_1h(spark, d)
    q = table(spark, d, "events").select(F.col("event_type").alias("symbol"), "ts", "event_id")
    return J.backward(q, b.select("symbol", "ts", "close"), ("symbol",), "close")


QUERIES["asof_backward"] = lambda spark, d: shown(_backward(spark, d), ("event_id",), ["close"])
SQL["asof_backward"] = f"WITH {EVENT_BARS_1H} SELECT event_id, {r('b.close', 'close')} FROM events e ASOF LEFT JOIN bars b ON b.symbol = e.event_type AND e.ts >= b.ts"


def _captures(spark, d):  # noqa: ANN001, ANN202
    base = order_bars_1w(spark, d)
    parts = []
    for i, (name, shift) in enumerate((("a", 0.0), ("b", 0.001), ("c", 0.004))):
        day = F.unix_timestamp(F.col("ts").cast("timestamp")) / 604800
        f = 1 + shift * F.pmod(F.floor(day).cast("long") + i, F.lit(7))
        parts.append(base.select(F.lit(f"p{name}").alias("provider"), F.lit(name).alias("grp"), F.concat_ws(" ", "symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("session"), *[(F.col(c) * f).alias(c) for c in ("open", "high", "low", "close")], "volume"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES["consensus_votes"] = lambda spark, d: shown(V.session_votes(_captures(spark, d)), ("session",), {"status": F.col("status"), "n_groups": F.col("n_groups"), "n_agree": F.col("n_agree"), "close": F.round(F.col("close") + 1e-9, 3), "close_spread": F.round(F.col("close_spread") + 1e-9, 4)})
SQL["consensus_votes"] = f"""WITH {ORDER_BARS_1W}, base AS (SELECT symbol, ts, open, high, low, close, CAST(floor(epoch(ts) / 604800) AS BIGINT) AS k FROM bars),
c AS (SELECT symbol, ts, close, open > 0 AND low > 0 AND close > 0 AND high >= greatest(open, close, low) AND low <= least(open, close, high) AS ok, [1.0::DOUBLE, 1 + 0.001 * ((k + 1) % 7), 1 + 0.004 * ((k + 2) % 7)] AS f FROM base),
d AS (SELECT *, abs(f[1] - f[2]) <= 0.005 * greatest(f[1], f[2]) AS ab, abs(f[1] - f[3]) <= 0.005 * greatest(f[1], f[3]) AS ac, abs(f[2] - f[3]) <= 0.005 * greatest(f[2], f[3]) AS bc FROM c),
g AS (SELECT *, list_filter([CASE WHEN ab OR ac THEN f[1] END, CASE WHEN ab OR bc THEN f[2] END, CASE WHEN ac OR bc THEN f[3] END], lambda x: x IS NOT NULL) AS v, CAST(ab AS INT) + CAST(ac AS INT) + CAST(bc AS INT) AS links FROM d),
s AS (SELECT *, ok AND len(v) >= 2 AND (len(v) = 2 OR links = 3) AS good, 1 - list_min(f) / list_max(f) AS spread FROM g)
SELECT symbol || ' ' || strftime(ts, '%Y-%m-%d %H:%M:%S') AS session, CASE WHEN NOT ok THEN 'missing' WHEN good AND spread <= 0.02 THEN 'accepted' WHEN good THEN 'accepted_with_warning' ELSE 'quarantined' END AS status, CASE WHEN ok THEN 3 ELSE 0 END AS n_groups, CASE WHEN ok THEN CAST(len(v) AS INTEGER) ELSE 0 END AS n_agree,
  {r('round(CASE WHEN good THEN close * list_median(v) END + 1e-9, 3)', 'close')}, {r('round(CASE WHEN ok THEN spread END + 1e-9, 4)', 'close_spread')} FROM s"""


def _forecast(spark, d):  # noqa: ANN001, ANN202
    n = table(spark, d, "nation")
    return n.select(F.col("n_nationkey").alias("period"), (100.0 + F.col("n_nationkey") * 10).alias("fcf"), (F.col("n_nationkey") + 1).cast("double").alias("t"))


def _dcf(spark, d):  # noqa: ANN001, ANN202
    grid = R.dcf_grid(_forecast(spark, d), spark.createDataFrame([(0.08,), (0.09,), (0.1,)], "wacc double"), spark.createDataFrame([(0.02,), (0.025,), (0.09,)], "g double"), net_debt=33.0, shares=10.0)
    return shown(grid, ("wacc", "g", "status"), ["enterprise_value", "equity_value", "per_share", "terminal_share"])


QUERIES["dcf_grid"] = _dcf
SQL["dcf_grid"] = f"""WITH f AS (SELECT 100.0::DOUBLE + n_nationkey * 10 AS fcf, (n_nationkey + 1)::DOUBLE AS t FROM nation), c AS (SELECT a.w AS wacc, b.g FROM (SELECT unnest([0.08, 0.09, 0.1]::DOUBLE[]) AS w) a, (SELECT unnest([0.02, 0.025, 0.09]::DOUBLE[]) AS g) b),
v AS (SELECT wacc, g, sum(fcf / pow(1 + wacc, t)) AS pv, CASE WHEN g < wacc THEN arg_max(fcf, t) * (1 + g) / nullif(wacc - g, 0) / pow(1 + wacc, max(t)) END AS tv FROM f, c GROUP BY wacc, g)
SELECT wacc, g, CASE WHEN tv IS NULL THEN 'invalid' ELSE 'ok' END AS status, {r('pv + tv', 'enterprise_value')}, {r('pv + tv - 33', 'equity_value')}, {r('(pv + tv - 33) / 10', 'per_share')}, {r('tv / (pv + tv)', 'terminal_share')} FROM v"""

QUERIES["comps_quantiles"] = lambda spark, d: shown(R.comps(table(spark, d, "part").select(F.lit(True).alias("included"), F.col("p_retailprice").alias("numerator"), F.col("p_size").cast("double").alias("denominator")), 120.0, 33.0, 10.0), (), ["n_peers", "p25", "median", "p75", "per_share_median"])
SQL["comps_quantiles"] = f"""WITH m AS (SELECT p_retailprice / p_size::DOUBLE AS x FROM part WHERE p_size > 0), q AS (SELECT count(*) AS n, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.5) AS b, quantile_cont(x, 0.75) AS c FROM m)
SELECT n AS n_peers, {r('a', 'p25')}, {r('b', 'median')}, {r('c', 'p75')}, {r('(b * 120 - 33) / 10', 'per_share_median')} FROM q"""


def _metrics(spark, d):  # noqa: ANN001, ANN202
    names = sorted({m for _, m, _, _ in R.GATES})
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("run_id"), "c_acctbal")
    long = c.select("run_id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(float(i)).alias("i")) for i, m in enumerate(names)])).alias("x"), "c_acctbal")
    return long.select("run_id", "x.metric", (F.col("c_acctbal") / 1000 * (F.col("x.i") + 1) / 40).alias("value")).where("NOT (metric = 'pbo' AND run_id % 3 = 0)")


QUERIES["gate_rules"] = lambda spark, d: R.gates(_metrics(spark, d)).select("run_id", "gate", "passed", F.size("failures").cast("long").alias("n_failures"), F.concat_ws(",", "missing").alias("missing"))
_RULES = ", ".join(f"('{g}', '{m}', '{o}', {t}::DOUBLE)" for g, m, o, t in R.GATES)
_NAMES = sorted({m for _, m, _, _ in R.GATES})
SQL["gate_rules"] = f"""WITH rules(gate, metric, op, threshold) AS (VALUES {_RULES}), n AS (SELECT unnest({_NAMES}) AS metric, unnest(range({len(_NAMES)})) AS i),
m AS (SELECT c_custkey AS run_id, metric, c_acctbal / 1000 * (i + 1) / 40 AS value FROM customer, n WHERE NOT (metric = 'pbo' AND c_custkey % 3 = 0)), k AS (SELECT DISTINCT run_id FROM m),
x AS (SELECT k.run_id, gate, rules.metric, value, CASE WHEN op = '>=' THEN value >= threshold ELSE value <= threshold END AS ok FROM k CROSS JOIN rules LEFT JOIN m ON m.run_id = k.run_id AND m.metric = rules.metric)
SELECT run_id, gate, bool_and(coalesce(ok, false)) AS passed, count(*) FILTER (value IS NOT NULL AND NOT ok) AS n_failures, coalesce(string_agg(DISTINCT metric, ',' ORDER BY metric) FILTER (value IS NULL), '') AS missing FROM x GROUP BY run_id, gate"""


def _edges(spark, d):  # noqa: ANN001, ANN202
    return table(spark, d, "part").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") * 2).alias("dst")).unionByName(table(spark, d, "part").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") * 2 + 1).alias("dst")))


QUERIES["graph_reachability"] = lambda spark, d: R.reachable(_edges(spark, d), spark.createDataFrame([(3,), (50,)], "node long"))
SQL["graph_reachability"] = """WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey * 2 AS dst FROM part UNION ALL SELECT p_partkey, p_partkey * 2 + 1 FROM part),
g(root, node, depth) AS (SELECT * FROM (VALUES (3::BIGINT, 3::BIGINT, 0), (50, 50, 0)) UNION SELECT root, dst, depth + 1 FROM g JOIN e ON src = node) SELECT root, node, min(depth) AS depth FROM g GROUP BY root, node"""


def _futures(spark, d):  # noqa: ANN001, ANN202
    bars = order_bars_1w(spark, d).withColumn("target", T.tsmom_targets(12, 1.5))
    return shown(L.run_sessions(bars, capital=10_000.0, limits=L.RiskLimits(hysteresis=100.0), funding_rate=1e-4), ("symbol", "ts", "reason", "phase"), ["allowed", "equity", "n_fills", "n_rejects"])


QUERIES["futures_sessions"] = _futures


def _equity_book(spark, d):  # noqa: ANN001, ANN202
    bars = order_bars_1w(spark, d).withColumn("run_id", F.lit("equal"))
    last = F.coalesce(F.date_trunc("month", "ts") != F.lead(F.date_trunc("month", "ts")).over(W.ordered()), F.lit(True))
    return shown(L.run_equity(bars.withColumn("weight", F.when(last, 0.2))), ("run_id", "ts"), ["cash", "equity", "gross", "n_positions", "n_fills"])


QUERIES["equity_book"] = _equity_book
QUERIES["weight_policy"] = lambda spark, d: shown(C.weight_policy(order_bars_1w(spark, d).withColumns({"weight": F.lit(0.2), "ret": F.coalesce(I.change("close"), F.lit(0.0))})), ("symbol", "ts"), ["scale", "scaled_weight"])


def _bootstrap(spark, d):  # noqa: ANN001, ANN202
    returns = order_bars_1w(spark, d).select("symbol", "ts", I.change("close").alias("value"))
    return shown(N.bootstrap_interval(N.block_bootstrap(returns, 200, 10, lambda x: float(x.mean()), 7, by=("symbol",)), by=("symbol",)), ("symbol",), ["low", "high"])


QUERIES["block_bootstrap"] = _bootstrap
