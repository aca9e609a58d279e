"""Queries over cross-sections: preprocessing, information coefficients, selection, weights, attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickwell.functions import windows as W
from tickwell.operators import cross_section as X
from tickwell.operators import indicators as I
from tickwell.operators import market_rules as M
from tickwell.operators import selection as S
from tickwell.plans.common import KEY, over, r, shown, w
from tickwell.sources.bars import EVENT_BARS_1H, ORDER_BARS_1W, SHIP_PANEL, event_bars_1h, order_bars_1w, ship_panel, table

KEYS = ("ts", "asset")
QUERIES: dict = {}
SQL: dict[str, str] = {}
_D = "OVER (PARTITION BY ts)"

QUERIES["mad_winsor"] = lambda spark, d: shown(X.winsorize_mad(ship_panel(spark, d), "price", 2.0), KEYS, {"price": F.round(F.col("price") + 1e-9, 4)})
SQL["mad_winsor"] = f"""WITH {SHIP_PANEL}, m AS (SELECT *, median(price) {_D} AS med FROM panel), a AS (SELECT *, median(abs(price - med)) {_D} AS mad FROM m)
SELECT {KEY}, asset, {r("round(greatest(med - 2 * mad, least(med + 2 * mad, price)) + 1e-9, 4)", "price")} FROM a"""


def _holes(spark, d):  # noqa: ANN001, ANN202
    return ship_panel(spark, d).withColumn("price", F.when(F.col("asset") % 7 != 0, F.col("price")))


QUERIES["industry_fill"] = lambda spark, d: shown(X.fill(_holes(spark, d), "price", "industry"), KEYS, {"price": F.round(F.col("price") + 1e-9, 4)})
SQL["industry_fill"] = f"""WITH {SHIP_PANEL}, h AS (SELECT ts, asset, industry, CASE WHEN asset % 7 <> 0 THEN price END AS price FROM panel)
SELECT {KEY}, asset, {r(f"round(coalesce(price, avg(price) OVER (PARTITION BY ts, industry), median(price) {_D}) + 1e-9, 4)", "price")} FROM h"""

QUERIES["neutralize_fwl"] = lambda spark, d: shown(X.neutralize(ship_panel(spark, d), "price", "industry", "mktcap"), KEYS, ["price"])
_FWL = f"""a AS (SELECT ts, asset, industry, price AS y, ln(mktcap) AS x FROM panel WHERE price IS NOT NULL AND industry IS NOT NULL AND mktcap > 0),
b AS (SELECT *, y - avg(y) OVER (PARTITION BY ts, industry) AS yd, x - avg(x) OVER (PARTITION BY ts, industry) AS xd FROM a),
s AS (SELECT ts, coalesce(sum(xd * yd) / nullif(sum(xd * xd), 0), 0) AS beta, count(*) AS n, count(DISTINCT industry) AS k FROM b GROUP BY ts),
resid AS (SELECT b.ts, b.asset, CASE WHEN n > k + 1 THEN yd - beta * xd END AS price FROM b JOIN s USING (ts))"""
SQL["neutralize_fwl"] = f"WITH {SHIP_PANEL}, {_FWL} SELECT {KEY}, asset, {r('price', 'price')} FROM resid"

QUERIES["xsection_zscore"] = lambda spark, d: shown(ship_panel(spark, d).withColumn("z", X.zscore("price", clip=3.0, missing=0.0)), KEYS, ["z"])
SQL["xsection_zscore"] = f"""WITH {SHIP_PANEL} SELECT {KEY}, asset, {r(f"CASE WHEN coalesce(stddev_samp(price) {_D}, 0) = 0 THEN 0 ELSE greatest(-3, least(3, (price - avg(price) {_D}) / nullif(stddev_samp(price) {_D}, 0))) END", "z")} FROM panel"""

QUERIES["preprocess_cross_section"] = lambda spark, d: shown(X.preprocess(_holes(spark, d), ["price"], "industry", "mktcap"), KEYS, ["price"])
SQL["preprocess_cross_section"] = f"""WITH {SHIP_PANEL.replace("panel AS", "panel0 AS")}, h AS (SELECT * REPLACE (CASE WHEN asset % 7 <> 0 THEN price END AS price) FROM panel0),
m AS (SELECT *, median(price) {_D} AS med FROM h), c AS (SELECT *, median(abs(price - med)) {_D} AS mad FROM m),
v AS (SELECT ts, asset, industry, mktcap, CASE WHEN price IS NOT NULL THEN greatest(med - 5 * mad, least(med + 5 * mad, price)) END AS price FROM c),
panel AS (SELECT ts, asset, industry, mktcap, coalesce(price, avg(price) OVER (PARTITION BY ts, industry), median(price) {_D}) AS price FROM v), {_FWL}
SELECT {KEY}, asset, {r(f"CASE WHEN coalesce(stddev_samp(price) {_D}, 0) = 0 THEN 0 ELSE (price - avg(price) {_D}) / nullif(stddev_samp(price) {_D}, 0) END", "price")} FROM resid"""


def _factor_panel(spark, d):  # noqa: ANN001, ANN202
    p = ship_panel(spark, d)
    by = W.ordered(("asset",))
    return p.withColumn("label", F.try_divide(W.lead("price", 1, by), F.col("price")) - 1).withColumn("f", F.try_divide(F.col("price"), W.lag("price", 1, by)) - 1)


_PANEL_F = f"{SHIP_PANEL}, p AS (SELECT *, lead(price) OVER {w('asset')} / nullif(price, 0) - 1 AS label, price / nullif(lag(price) OVER {w('asset')}, 0) - 1 AS f FROM panel)"
QUERIES["daily_ic"] = lambda spark, d: shown(X.daily_ic(_factor_panel(spark, d), "f", "label"), ("ts",), ["ic", "rank_ic", "n"])
SQL["daily_ic"] = f"""WITH {_PANEL_F}, x AS (SELECT ts, f, label FROM p WHERE f IS NOT NULL AND label IS NOT NULL),
k AS (SELECT *, rank() OVER (PARTITION BY ts ORDER BY f) + (count(*) OVER (PARTITION BY ts, f) - 1) / 2.0 AS rf, rank() OVER (PARTITION BY ts ORDER BY label) + (count(*) OVER (PARTITION BY ts, label) - 1) / 2.0 AS rl FROM x)
SELECT {KEY}, {r("corr(f, label)", "ic")}, {r("corr(rf, rl)", "rank_ic")}, count(*) AS n FROM k GROUP BY ts HAVING count(*) >= 5 AND min(f) < max(f) AND min(label) < max(label)"""

QUERIES["ic_summary"] = lambda spark, d: shown(X.ic_summary(X.daily_ic(_factor_panel(spark, d), "f", "label")), (), ["mean_ic", "std_ic", "icir", "mean_rank_ic", "n_dates"])
SQL["ic_summary"] = f"""WITH {_PANEL_F}, x AS (SELECT ts, f, label FROM p WHERE f IS NOT NULL AND label IS NOT NULL),
k AS (SELECT *, rank() OVER (PARTITION BY ts ORDER BY f) + (count(*) OVER (PARTITION BY ts, f) - 1) / 2.0 AS rf, rank() OVER (PARTITION BY ts ORDER BY label) + (count(*) OVER (PARTITION BY ts, label) - 1) / 2.0 AS rl FROM x),
d AS (SELECT corr(f, label) AS ic, corr(rf, rl) AS ric FROM k GROUP BY ts HAVING count(*) >= 5 AND min(f) < max(f) AND min(label) < max(label))
SELECT {r("avg(ic)", "mean_ic")}, {r("stddev_samp(ic)", "std_ic")}, {r("avg(ic) / nullif(stddev_samp(ic), 0)", "icir")}, {r("avg(ric)", "mean_rank_ic")}, count(*) AS n_dates FROM d"""


def _one(spark, d):  # noqa: ANN001, ANN202
    b = event_bars_1h(spark, d).withColumns({"mom": I.change("close", 5), "vol": W.std("close", 20, 20), "fwd": I.forward_return("close", 1)})
    return b


QUERIES["factor_ic_table"] = lambda spark, d: shown(X.factor_ic_table(_one(spark, d), ["mom", "vol"], "fwd", ("ts", "symbol")), ("factor",), ["ic_mean", "ic_std", "ic_ir", "rank_ic_mean", "n_obs"])
SQL["factor_ic_table"] = f"""WITH {EVENT_BARS_1H}, b AS (SELECT symbol, ts, close / nullif(lag(close, 5) OVER {w()}, 0) - 1 AS mom, CASE WHEN count(close) OVER {over(20)} >= 20 THEN stddev_samp(close) OVER {over(20)} END AS vol, lead(close) OVER {w()} / nullif(close, 0) - 1 AS fwd FROM bars),
l AS (SELECT 'mom' AS factor, symbol, ts, mom AS x, fwd AS y FROM b UNION ALL SELECT 'vol', symbol, ts, vol, fwd FROM b),
t AS (SELECT *, ntile(10) OVER (PARTITION BY factor ORDER BY ts, symbol) AS block FROM l WHERE x IS NOT NULL AND y IS NOT NULL),
k AS (SELECT *, rank() OVER (PARTITION BY factor, block ORDER BY x) + (count(*) OVER (PARTITION BY factor, block, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY factor, block ORDER BY y) + (count(*) OVER (PARTITION BY factor, block, y) - 1) / 2.0 AS ry FROM t),
c AS (SELECT factor, block, corr(x, y) AS ic, corr(rx, ry) AS ric, count(*) AS n FROM k GROUP BY ALL)
SELECT factor, {r("avg(ic)", "ic_mean")}, {r("stddev_samp(ic)", "ic_std")}, {r("avg(ic) / nullif(stddev_samp(ic), 0)", "ic_ir")}, {r("avg(ric)", "rank_ic_mean")}, CAST(sum(n) AS BIGINT) AS n_obs FROM c GROUP BY factor"""


def _weights(spark, d):  # noqa: ANN001, ANN202
    b = order_bars_1w(spark, d).withColumn("signal", I.change("close", 4))
    return X.signal_to_weights(b, "signal", long_only=True, max_weight=0.4)


QUERIES["signal_to_weights"] = lambda spark, d: shown(_weights(spark, d), ("symbol", "ts"), ["weight"])
_SW = f"""s AS (SELECT *, greatest(coalesce(close / nullif(lag(close, 4) OVER {w()}, 0) - 1, 0), 0) AS s FROM bars), n AS (SELECT *, coalesce(s / nullif(sum(abs(s)) {_D}, 0), 0) AS w0 FROM s),
c AS (SELECT *, greatest(-0.4, least(0.4, w0)) AS w1 FROM n), wts AS (SELECT *, coalesce(w1 / nullif(sum(abs(w1)) {_D}, 0), 0) AS weight FROM c)"""
SQL["signal_to_weights"] = f"WITH {ORDER_BARS_1W}, {_SW} SELECT symbol, {KEY}, {r('weight', 'weight')} FROM wts"

QUERIES["contribution"] = lambda spark, d: shown(X.contribution(_weights(spark, d).withColumn("ret", I.change("close"))), ("symbol",), ["contribution"])
SQL["contribution"] = f"""WITH {ORDER_BARS_1W}, {_SW}, x AS (SELECT symbol, coalesce(lag(weight) OVER {w()}, 0) * coalesce(close / nullif(lag(close) OVER {w()}, 0) - 1, 0) AS c FROM wts)
SELECT symbol, {r("sum(c)", "contribution")} FROM x GROUP BY symbol"""

QUERIES["equal_weights"] = lambda spark, d: shown(X.equal_weights(order_bars_1w(spark, d).withColumn("ok", F.col("volume") > 30), "ok"), ("symbol", "ts"), ["weight"])
SQL["equal_weights"] = f"""WITH {ORDER_BARS_1W} SELECT symbol, {KEY}, {r(f"CASE WHEN volume > 30 THEN 1.0 / nullif(sum(CAST(volume > 30 AS INT)) {_D}, 0) ELSE 0 END", "weight")} FROM bars"""

QUERIES["top_n_by_date"] = lambda spark, d: shown(X.top_n(ship_panel(spark, d), "price", 3, "asset", by="ts"), KEYS, ["rank", "weight"])
SQL["top_n_by_date"] = f"""WITH {SHIP_PANEL}, k AS (SELECT ts, asset, CAST(row_number() OVER (PARTITION BY ts ORDER BY price DESC, asset) AS INTEGER) AS rank FROM panel WHERE price IS NOT NULL)
SELECT {KEY}, asset, rank, {r(f"1.0 / count(*) {_D}", "weight")} FROM k WHERE rank <= 3"""

QUERIES["score_universe"] = lambda spark, d: shown(S.score_universe(event_bars_1h(spark, d), "momentum"), ("symbol",), ["close", "ret_20", "ret_60", "vol_ann", "dist_sma50", "trend_bull", "score", "rank"])
SQL["score_universe"] = f"""WITH {EVENT_BARS_1H}, p AS (SELECT *, close / nullif({f"lag(close) OVER {w()}"}, 0) - 1 AS ret FROM bars),
f AS (SELECT symbol, ts, close, close / nullif(lag(close, 20) OVER {w()}, 0) - 1 AS ret_20, close / nullif(lag(close, 60) OVER {w()}, 0) - 1 AS ret_60, CASE WHEN count(ret) OVER {over(20)} >= 19 THEN stddev_samp(ret) OVER {over(20)} END * sqrt(252) AS vol_ann,
  avg(close) OVER {over(50)} AS m50, avg(close) OVER {over(20)} AS m20, row_number() OVER {w()} AS n, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM p),
l AS (SELECT *, close / nullif(m50, 0) - 1 AS dist_sma50, CAST(m20 > m50 AS DOUBLE) AS trend_bull, CASE WHEN vol_ann > 1e-8 THEN ret_60 / vol_ann END AS q FROM f WHERE k = 1 AND n >= 65),
z AS (SELECT *, 0.7 * (ret_60 - avg(ret_60) OVER ()) / nullif(stddev_pop(ret_60) OVER (), 0) + 0.3 * (q - avg(q) OVER ()) / nullif(stddev_pop(q) OVER (), 0) AS score FROM l)
SELECT symbol, {", ".join(r(c, c) for c in ("close", "ret_20", "ret_60", "vol_ann", "dist_sma50", "trend_bull", "score"))}, CAST(row_number() OVER (ORDER BY score DESC, symbol) AS INTEGER) AS rank FROM z"""

QUERIES["apply_filters"] = lambda spark, d: S.filters(S.score_universe(event_bars_1h(spark, d), "momentum"), min_price=20.0, max_vol=30.0, uptrend=True).select("symbol", "reject_reason")
SQL["apply_filters"] = SQL["score_universe"].split("SELECT symbol, round")[0] + "SELECT symbol, CASE WHEN close < 20 THEN 'price<20.0' WHEN vol_ann > 30 THEN 'vol>30.0' WHEN trend_bull < 0.5 THEN 'not_uptrend' END AS reject_reason FROM z"

QUERIES["run_selection"] = lambda spark, d: shown(S.select(event_bars_1h(spark, d), 2, "momentum", min_price=None, max_vol=None), ("symbol",), ["target_weight"])
SQL["run_selection"] = SQL["score_universe"].split("SELECT symbol, round")[0] + f"SELECT symbol, {r('CASE WHEN row_number() OVER (ORDER BY score DESC, symbol) <= 2 THEN 0.5 ELSE 0 END', 'target_weight')} FROM z"

QUERIES["limit_flags"] = lambda spark, d: shown(M.limit_flags(order_bars_1w(spark, d)), ("symbol", "ts"), ["limit_up", "limit_down", "is_limit_up", "is_limit_down"])
_LIM = f"""a AS (SELECT *, lag(close) OVER {w()} AS p FROM bars), l AS (SELECT *, round_even(p * 1.1, 2) AS up, round_even(p * 0.9, 2) AS dn FROM a),
f AS (SELECT *, coalesce(close >= up * 0.998 OR (high >= up * 0.998 AND close >= up * 0.996), false) AS fu, coalesce(close <= dn * 1.002 OR (low <= dn * 1.002 AND close <= dn * 1.004), false) AS fd FROM l)"""
SQL["limit_flags"] = f"WITH {ORDER_BARS_1W}, {_LIM} SELECT symbol, {KEY}, {r('up', 'limit_up')}, {r('dn', 'limit_down')}, fu AS is_limit_up, fd AS is_limit_down FROM f"

QUERIES["tradeable_mask"] = lambda spark, d: shown(M.annotate(order_bars_1w(spark, d)), ("symbol", "ts"), ["is_suspended", "can_buy", "can_sell", "tradeable"])
SQL["tradeable_mask"] = f"""WITH {ORDER_BARS_1W}, {_LIM} SELECT symbol, {KEY}, coalesce(volume, 0) < 1 AS is_suspended, NOT coalesce(volume, 0) < 1 AND NOT fu AS can_buy, NOT coalesce(volume, 0) < 1 AND NOT fd AS can_sell,
  NOT coalesce(volume, 0) < 1 AND NOT fu AND NOT fd AS tradeable FROM f"""

QUERIES["keyword_sentiment"] = lambda spark, d: shown(S.sentiment_factor(table(spark, d, "documents").select(F.col("source").alias("symbol"), "text")), ("symbol",), ["sentiment"])
_HITS = lambda words: " + ".join(f"CAST(contains(t, '{x}') AS INT)" for x in words)
SQL["keyword_sentiment"] = f"""WITH d AS (SELECT source, lower(coalesce(text, '')) AS t FROM documents), h AS (SELECT source, {_HITS(S.POSITIVE)} AS g, {_HITS(S.NEGATIVE)} AS b FROM d)
SELECT source AS symbol, {r("avg(coalesce((g - b) / nullif(g + b, 0)::DOUBLE, 0))", "sentiment")} FROM h GROUP BY source"""


def _attribution(spark, d):  # noqa: ANN001, ANN202
    p = _factor_panel(spark, d).where("label IS NOT NULL").withColumn("t", F.col("ts"))
    n = F.count(F.lit(1)).over(X.at("t"))
    p = p.withColumns({"b": 1.0 / n, "w": F.col("units") / F.sum("units").over(X.at("t"))})
    expo = p.select("t", "asset", F.lit("size").alias("factor"), F.log("mktcap").alias("exposure")).unionByName(p.select("t", "asset", F.lit("price").alias("factor"), F.col("price").alias("exposure")))
    rets = p.groupBy("t").agg(F.avg("label").alias("m"))
    fr = rets.select("t", F.lit("size").alias("factor"), (F.col("m") / 10).alias("ret")).unionByName(rets.select("t", F.lit("price").alias("factor"), (F.col("m") / 1000).alias("ret")))
    out = X.attribution(p.select("t", "asset", F.col("w").alias("weight")), p.select("t", "asset", F.col("b").alias("weight")), expo, fr, p.select("t", "asset", F.col("label").alias("ret")))
    return shown(out, ("t", "source"), ["value"])


QUERIES["alpha_attribution"] = _attribution
SQL["alpha_attribution"] = f"""WITH {_PANEL_F}, q AS (SELECT ts AS t, asset, price, mktcap, label, units / sum(units) {_D} - 1.0 / count(*) {_D} AS a FROM p WHERE label IS NOT NULL),
m AS (SELECT t, avg(label) AS m, sum(a * label) AS total, sum(a * ln(mktcap)) AS xs, sum(a * price) AS xp FROM q GROUP BY t)
SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS t, 'size' AS source, {r("xs * m / 10", "value")} FROM m UNION ALL SELECT strftime(t, '%Y-%m-%d %H:%M:%S'), 'price', {r("xp * m / 1000", "value")} FROM m
UNION ALL SELECT strftime(t, '%Y-%m-%d %H:%M:%S'), 'residual', {r("total - xs * m / 10 - xp * m / 1000", "value")} FROM m"""
