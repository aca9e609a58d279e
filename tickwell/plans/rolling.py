"""Queries over bars: indicators, factor sets, signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickwell.functions import windows as W
from tickwell.operators import factors as A
from tickwell.operators import indicators as I
from tickwell.operators import signals as T
from tickwell.plans.common import KEY, least, over, r, shown, w
from tickwell.sources.bars import EVENT_BARS_1H, ORDER_BARS_1W, event_bars_1h, order_bars_1w

KEYS = ("symbol", "ts")


def _bars(columns, source=event_bars_1h):  # noqa: ANN001, ANN202
    return lambda spark, d: shown(source(spark, d), KEYS, columns())


def _sql(body: str, bars: str = EVENT_BARS_1H, more: str = "") -> str:
    return f"WITH {bars}{more} SELECT symbol, {KEY}, {body} FROM bars"


QUERIES: dict = {}
SQL: dict[str, str] = {}

QUERIES["bars_1h"] = _bars(lambda: {c: F.col(c) for c in ("open", "high", "low", "close", "volume")})
SQL["bars_1h"] = _sql(", ".join(r(c, c) for c in ("open", "high", "low", "close", "volume")))

QUERIES["returns"] = _bars(lambda: {"ret": I.change("close"), "log_ret": I.log_return("close"), "fwd_ret_5": I.forward_return("close", 5)})
_LAG = f"lag(close) OVER {w()}"
SQL["returns"] = _sql(f"{r(f'close / nullif({_LAG}, 0) - 1', 'ret')}, {r(f'CASE WHEN close / nullif({_LAG}, 0) > 0 THEN ln(close / nullif({_LAG}, 0)) END', 'log_ret')}, {r(f'lead(close, 5) OVER {w()} / nullif(close, 0) - 1', 'fwd_ret_5')}")

QUERIES["sma"] = _bars(lambda: {f"sma_{n}": I.sma("close", n) for n in (5, 20, 50)})
SQL["sma"] = _sql(", ".join(r(least("close", n, "avg(close)", n), f"sma_{n}") for n in (5, 20, 50)))

QUERIES["bollinger"] = _bars(lambda: dict(zip(("bb_mid", "bb_upper", "bb_lower"), I.bollinger(), strict=True)))
_MID, _DEV = least("close", 20, "avg(close)", 20), least("close", 20, "stddev_samp(close)", 20)
SQL["bollinger"] = _sql(f"{r(_MID, 'bb_mid')}, {r(f'{_MID} + 2 * ({_DEV})', 'bb_upper')}, {r(f'{_MID} - 2 * ({_DEV})', 'bb_lower')}")

QUERIES["atr"] = lambda spark, d: shown(I.atr(event_bars_1h(spark, d)), KEYS, ["atr"])
SQL["atr"] = _sql(
    r(least("tr", 14, "avg(tr)", 14), "atr"), more=f", t AS (SELECT *, greatest(abs(high - low), abs(high - {_LAG}), abs(low - {_LAG})) AS tr FROM bars)"
).replace("FROM bars)", "FROM bars)").removesuffix("bars") + "t"

QUERIES["zscore_60"] = _bars(lambda: {"z": W.zscore("close", 60)})
SQL["zscore_60"] = _sql(r(f"(close - ({least('close', 20, 'avg(close)', 60)})) / nullif({least('close', 20, 'stddev_samp(close)', 60)}, 0)", "z"))


def _ols(spark, d):  # noqa: ANN001, ANN202
    rows = event_bars_1h(spark, d).withColumn("i", F.row_number().over(W.ordered()).cast("double"))
    return shown(rows, KEYS, dict(zip(("slope", "rsq", "resi"), W.ols("close", "i", 20), strict=True)))


QUERIES["rolling_ols"] = _ols
SQL["rolling_ols"] = f"""WITH {EVENT_BARS_1H}, i AS (SELECT *, CAST(row_number() OVER {w()} AS DOUBLE) AS i FROM bars),
f AS (SELECT symbol, ts, close, i, count(close) OVER {over(20)} AS n, regr_slope(close, i) OVER {over(20)} AS s, regr_r2(close, i) OVER {over(20)} AS q, regr_intercept(close, i) OVER {over(20)} AS a FROM i)
SELECT symbol, {KEY}, {r('CASE WHEN n >= 2 THEN s END', 'slope')}, {r('CASE WHEN n >= 2 THEN q END', 'rsq')}, {r('CASE WHEN n >= 2 THEN close - (a + s * i) END', 'resi')} FROM f"""

QUERIES["rolling_quantile"] = _bars(lambda: {"q80": W.quantile("close", 0.8, 20), "q20": W.quantile("close", 0.2, 20)})
SQL["rolling_quantile"] = _sql(f"{r(f'quantile_cont(close, 0.8) OVER {over(20)}', 'q80')}, {r(f'quantile_cont(close, 0.2) OVER {over(20)}', 'q20')}")

QUERIES["rolling_rank_pct"] = _bars(lambda: {"rank_pct": W.percent_rank_of_last("close", 20)})
SQL["rolling_rank_pct"] = f"""WITH {EVENT_BARS_1H}, l AS (SELECT symbol, ts, close, list(close) OVER {over(20)} AS xs FROM bars)
SELECT symbol, {KEY}, {r("(len(list_filter(xs, lambda x: x < close)) + (len(list_filter(xs, lambda x: x = close)) + 1) / 2.0) / len(xs)", "rank_pct")} FROM l"""

QUERIES["rolling_argmax"] = _bars(lambda: {"imax": W.place_of_extreme("high", 20), "imin": W.place_of_extreme("low", 20, False)})
SQL["rolling_argmax"] = f"""WITH {EVENT_BARS_1H}, l AS (SELECT symbol, ts, list(high) OVER {over(20)} AS h, list(low) OVER {over(20)} AS l FROM bars)
SELECT symbol, {KEY}, CAST(list_position(h, list_max(h)) AS DOUBLE) AS imax, CAST(list_position(l, list_min(l)) AS DOUBLE) AS imin FROM l"""

QUERIES["rolling_corr"] = _bars(lambda: {"corr": W.correlation("close", F.log(F.col("volume") + 1), 20)})
SQL["rolling_corr"] = f"""WITH {EVENT_BARS_1H}, l AS (SELECT *, ln(volume + 1) AS v FROM bars)
SELECT symbol, {KEY}, {r(f"CASE WHEN stddev_samp(close) OVER {over(20)} > 2e-5 AND stddev_samp(v) OVER {over(20)} > 2e-5 THEN covar_pop(close, v) OVER {over(20)} / (stddev_pop(close) OVER {over(20)} * stddev_pop(v) OVER {over(20)}) END", "corr")} FROM l"""

QUERIES["rolling_skew_kurt"] = _bars(lambda: {"skew": W.skew("close", 30), "kurt": W.kurtosis("close", 30)})
_M = {k: f"avg(pow(close - m, {k})) " for k in (2, 3, 4)}
SQL["rolling_skew_kurt"] = f"""WITH {EVENT_BARS_1H}, l AS (SELECT symbol, ts, list(close) OVER {over(30)} AS xs FROM bars),
c AS (SELECT symbol, ts, CAST(len(xs) AS DOUBLE) AS k, list_avg(xs) AS m, xs FROM l),
s AS (SELECT symbol, ts, k, list_avg(list_transform(xs, lambda x: pow(x - m, 2))) AS m2, list_avg(list_transform(xs, lambda x: pow(x - m, 3))) AS m3, list_avg(list_transform(xs, lambda x: pow(x - m, 4))) AS m4 FROM c)
SELECT symbol, {KEY}, {r("CASE WHEN k >= 10 AND m2 > 0 THEN m3 / pow(m2, 1.5) * sqrt(k * (k - 1)) / (k - 2) END", "skew")},
  {r("CASE WHEN k >= 10 AND m2 > 0 THEN (k - 1) / ((k - 2) * (k - 3)) * ((k + 1) * (m4 / (m2 * m2) - 3) + 6) END", "kurt")} FROM s"""

_N = f"n AS (SELECT *, row_number() OVER {w()} AS n FROM bars)"
QUERIES["ema"] = lambda spark, d: shown(I.exponential(event_bars_1h(spark, d)), KEYS, ["ema_12", "ema_26"])
SQL["ema"] = f"""WITH RECURSIVE {EVENT_BARS_1H}, {_N},
e(symbol, ts, n, a, b) AS (SELECT symbol, ts, n, close, close FROM n WHERE n = 1
  UNION ALL SELECT n.symbol, n.ts, n.n, a + 2.0 / 13 * (close - a), b + 2.0 / 27 * (close - b) FROM e JOIN n ON n.symbol = e.symbol AND n.n = e.n + 1)
SELECT symbol, {KEY}, {r("a", "ema_12")}, {r("b", "ema_26")} FROM e"""

QUERIES["macd"] = lambda spark, d: shown(I.exponential(event_bars_1h(spark, d)), KEYS, ["macd", "macd_signal", "macd_hist"])
SQL["macd"] = f"""WITH RECURSIVE {EVENT_BARS_1H}, {_N},
e(symbol, ts, n, a, b, s) AS (SELECT symbol, ts, n, close, close, CAST(0 AS DOUBLE) FROM n WHERE n = 1
  UNION ALL SELECT n.symbol, n.ts, n.n, a + 2.0 / 13 * (close - a), b + 2.0 / 27 * (close - b), s + 0.2 * ((a + 2.0 / 13 * (close - a)) - (b + 2.0 / 27 * (close - b)) - s) FROM e JOIN n ON n.symbol = e.symbol AND n.n = e.n + 1)
SELECT symbol, {KEY}, {r("a - b", "macd")}, {r("s", "macd_signal")}, {r("a - b - s", "macd_hist")} FROM e"""

QUERIES["rsi"] = lambda spark, d: shown(I.exponential(event_bars_1h(spark, d)), KEYS, ["rsi_14"])
SQL["rsi"] = f"""WITH RECURSIVE {EVENT_BARS_1H}, {_N}, d AS (SELECT symbol, ts, n, close - lag(close) OVER {w()} AS x FROM n),
e(symbol, ts, n, u, v) AS (SELECT symbol, ts, n, greatest(x, 0), greatest(-x, 0) FROM d WHERE n = 2
  UNION ALL SELECT d.symbol, d.ts, d.n, u + (greatest(x, 0) - u) / 14, v + (greatest(-x, 0) - v) / 14 FROM e JOIN d ON d.symbol = e.symbol AND d.n = e.n + 1)
SELECT d.symbol, strftime(d.ts, '%Y-%m-%d %H:%M:%S') AS ts, {r("CASE WHEN d.n >= 15 AND v <> 0 THEN 100 - 100 / (1 + u / v) END", "rsi_14")} FROM d LEFT JOIN e ON e.symbol = d.symbol AND e.n = d.n"""

_KBAR = {
    "KMID": "(close - open) / nullif(open, 0)", "KLEN": "(high - low) / nullif(open, 0)", "KMID2": "(close - open) / (high - low + 1e-12)", "KUP": "(high - greatest(open, close)) / nullif(open, 0)",
    "KUP2": "(high - greatest(open, close)) / (high - low + 1e-12)", "KLOW": "(least(open, close) - low) / nullif(open, 0)", "KLOW2": "(least(open, close) - low) / (high - low + 1e-12)",
    "KSFT": "(2 * close - high - low) / nullif(open, 0)", "KSFT2": "(2 * close - high - low) / (high - low + 1e-12)",
}
QUERIES["alpha158_kbar"] = _bars(A.kbar)
SQL["alpha158_kbar"] = _sql(", ".join(r(e, n) for n, e in _KBAR.items()))

_FIVE = ("ROC", "MA", "STD", "MAX", "MIN", "QTLU", "QTLD", "RSV", "CNTP", "CNTN", "CNTD", "SUMP", "SUMN", "SUMD", "VMA", "VSTD", "VSUMP", "VSUMN", "VSUMD", "WVMA", "CORR", "BETA", "RSQR", "RANK", "IMAX", "IMIN", "IMXD", "RESI", "CORD")
QUERIES["alpha158_rolling_5"] = lambda spark, d: shown(A.alpha158(event_bars_1h(spark, d), spans=(5,)), KEYS, [f"{n}5" for n in _FIVE if n not in ("RSQR", "CORD", "WVMA", "RESI")])
_O = over(5)
SQL["alpha158_rolling_5"] = f"""WITH {EVENT_BARS_1H}, p AS (SELECT *, CAST(row_number() OVER {w()} AS DOUBLE) AS i, close - {_LAG} AS dc, volume - lag(volume) OVER {w()} AS dv, ln(volume + 1) AS lv,
  CAST(coalesce(close > {_LAG}, false) AS INT) AS up, CAST(coalesce(close < {_LAG}, false) AS INT) AS dn FROM bars),
x AS (SELECT *, CASE WHEN dc IS NOT NULL THEN greatest(dc, 0) END AS gc, CASE WHEN dc IS NOT NULL THEN greatest(-dc, 0) END AS lc, CASE WHEN dv IS NOT NULL THEN greatest(dv, 0) END AS gv, CASE WHEN dv IS NOT NULL THEN greatest(-dv, 0) END AS lo, list(close) OVER {_O} AS xs, list(high) OVER {_O} AS hs, list(low) OVER {_O} AS ls FROM p),
s AS (SELECT *, regr_slope(close, i) OVER {_O} AS b, regr_intercept(close, i) OVER {_O} AS a, count(close) OVER {_O} AS n, list_position(hs, list_max(hs)) AS ix, list_position(ls, list_min(ls)) AS im FROM x)
SELECT symbol, {KEY}, {r(f"lag(close, 5) OVER {w()} / nullif(close, 0)", "ROC5")}, {r(f"avg(close) OVER {_O} / nullif(close, 0)", "MA5")}, {r(f"CASE WHEN n >= 2 THEN stddev_samp(close) OVER {_O} END / nullif(close, 0)", "STD5")},
 {r(f"max(high) OVER {_O} / nullif(close, 0)", "MAX5")}, {r(f"min(low) OVER {_O} / nullif(close, 0)", "MIN5")}, {r(f"quantile_cont(close, 0.8) OVER {_O} / nullif(close, 0)", "QTLU5")}, {r(f"quantile_cont(close, 0.2) OVER {_O} / nullif(close, 0)", "QTLD5")},
 {r(f"(close - min(low) OVER {_O}) / (max(high) OVER {_O} - min(low) OVER {_O} + 1e-12)", "RSV5")}, {r(f"avg(up) OVER {_O}", "CNTP5")}, {r(f"avg(dn) OVER {_O}", "CNTN5")}, {r(f"avg(up) OVER {_O} - avg(dn) OVER {_O}", "CNTD5")},
 {r(f"sum(gc) OVER {_O} / (sum(abs(dc)) OVER {_O} + 1e-12)", "SUMP5")}, {r(f"sum(lc) OVER {_O} / (sum(abs(dc)) OVER {_O} + 1e-12)", "SUMN5")}, {r(f"(sum(gc) OVER {_O} - sum(lc) OVER {_O}) / (sum(abs(dc)) OVER {_O} + 1e-12)", "SUMD5")},
 {r(f"avg(volume) OVER {_O} / (volume + 1e-12)", "VMA5")}, {r(f"CASE WHEN n >= 2 THEN stddev_samp(volume) OVER {_O} END / (volume + 1e-12)", "VSTD5")},
 {r(f"sum(gv) OVER {_O} / (sum(abs(dv)) OVER {_O} + 1e-12)", "VSUMP5")}, {r(f"sum(lo) OVER {_O} / (sum(abs(dv)) OVER {_O} + 1e-12)", "VSUMN5")}, {r(f"(sum(gv) OVER {_O} - sum(lo) OVER {_O}) / (sum(abs(dv)) OVER {_O} + 1e-12)", "VSUMD5")},
 {r(f"CASE WHEN stddev_samp(close) OVER {_O} > 2e-5 AND stddev_samp(lv) OVER {_O} > 2e-5 THEN covar_pop(close, lv) OVER {_O} / (stddev_pop(close) OVER {_O} * stddev_pop(lv) OVER {_O}) END", "CORR5")},
 {r("CASE WHEN n >= 2 THEN b END / nullif(close, 0)", "BETA5")}, {r("(len(list_filter(xs, lambda v: v < close)) + (len(list_filter(xs, lambda v: v = close)) + 1) / 2.0) / len(xs)", "RANK5")},
 {r("ix / 5.0", "IMAX5")}, {r("im / 5.0", "IMIN5")}, {r("(ix - im) / 5.0", "IMXD5")} FROM s"""

#: Places of wide factor sets, as sums over 60 bars in another order differ beyond them; a little is added so that no ratio of round prices lies half-way between two of them.
_FEW, _OFF = 4, 3e-8


def _short(expression: str, name: str) -> str:
    return f'round({expression} + {_OFF}, {_FEW}) + 0.0 AS "{name}"'


def _wide(factors):  # noqa: ANN001, ANN202
    names = [c for c in factors.columns if c not in KEYS]
    return shown(factors, KEYS, {c: F.round(F.col(c) + _OFF, _FEW) + 0.0 for c in names})


def _span(n: int) -> dict[str, str]:
    """SQL of the rolling operators over n bars, after the names in the factor set."""
    o = over(n)
    flat = lambda a, b: f"stddev_samp(CASE WHEN {b} IS NOT NULL THEN {a} END) OVER {o} > 2e-5 AND stddev_samp(CASE WHEN {a} IS NOT NULL THEN {b} END) OVER {o} > 2e-5"
    both = lambda a, b: f"CASE WHEN {flat(a, b)} THEN covar_pop({a}, {b}) OVER {o} / (stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END) OVER {o} * stddev_pop(CASE WHEN {a} IS NOT NULL THEN {b} END) OVER {o}) END"
    moved = lambda gain, loss, size: {"P": f"sum({gain}) OVER {o} / (sum(abs({size})) OVER {o} + 1e-12)", "N": f"sum({loss}) OVER {o} / (sum(abs({size})) OVER {o} + 1e-12)", "D": f"(sum({gain}) OVER {o} - sum({loss}) OVER {o}) / (sum(abs({size})) OVER {o} + 1e-12)"}
    enough = lambda x, e: f"CASE WHEN count({x}) OVER {o} >= 2 THEN {e} END"
    highs, lows, closes = (f"list({c}) OVER {o}" for c in ("high", "low", "close"))
    top, bottom = f"list_position({highs}, max(high) OVER {o})", f"list_position({lows}, min(low) OVER {o})"
    out = {
        "ROC": f"lag(close, {n}) OVER {w()} / nullif(close, 0)", "MA": f"avg(close) OVER {o} / nullif(close, 0)", "STD": f"{enough('close', f'stddev_samp(close) OVER {o}')} / nullif(close, 0)",
        "BETA": f"{enough('close', f'regr_slope(close, i) OVER {o}')} / nullif(close, 0)", "RSQR": f"CASE WHEN NOT coalesce(stddev_samp(close) OVER {o} <= 2e-5, false) THEN {enough('close', f'regr_r2(close, i) OVER {o}')} END",
        "RESI": f"{enough('close', f'close - (regr_intercept(close, i) OVER {o} + regr_slope(close, i) OVER {o} * i)')} / nullif(close, 0)",
        "MAX": f"max(high) OVER {o} / nullif(close, 0)", "MIN": f"min(low) OVER {o} / nullif(close, 0)", "QTLU": f"quantile_cont(close, 0.8) OVER {o} / nullif(close, 0)", "QTLD": f"quantile_cont(close, 0.2) OVER {o} / nullif(close, 0)",
        "RANK": f"(len(list_filter({closes}, lambda v: v < close)) + (len(list_filter({closes}, lambda v: v = close)) + 1) / 2.0) / len({closes})", "RSV": f"(close - min(low) OVER {o}) / (max(high) OVER {o} - min(low) OVER {o} + 1e-12)",
        "IMAX": f"{top} / {n}.0", "IMIN": f"{bottom} / {n}.0", "IMXD": f"({top} - {bottom}) / {n}.0", "CORR": both("close", "lv"), "CORD": both("rc", "rv"),
        "CNTP": f"avg(up) OVER {o}", "CNTN": f"avg(dn) OVER {o}", "CNTD": f"avg(up) OVER {o} - avg(dn) OVER {o}", "VMA": f"avg(volume) OVER {o} / (volume + 1e-12)", "VSTD": f"{enough('volume', f'stddev_samp(volume) OVER {o}')} / (volume + 1e-12)",
        "WVMA": f"{enough('wv', f'stddev_samp(wv) OVER {o}')} / (avg(wv) OVER {o} + 1e-12)",
    }
    out |= {f"SUM{k}": e for k, e in moved("gc", "lc", "dc").items()} | {f"VSUM{k}": e for k, e in moved("gv", "lo", "dv").items()}
    return {f"{k}{n}": e for k, e in out.items()}


_PREPARED = f"""p AS (SELECT *, CAST(row_number() OVER {w()} AS DOUBLE) AS i, close - {_LAG} AS dc, volume - lag(volume) OVER {w()} AS dv, ln(volume + 1) AS lv, close / nullif({_LAG}, 0) AS rc, volume / nullif(lag(volume) OVER {w()}, 0) AS vr,
  CAST(coalesce(close > {_LAG}, false) AS INT) AS up, CAST(coalesce(close < {_LAG}, false) AS INT) AS dn FROM bars),
x AS (SELECT *, CASE WHEN dc IS NOT NULL THEN greatest(dc, 0) END AS gc, CASE WHEN dc IS NOT NULL THEN greatest(-dc, 0) END AS lc, CASE WHEN dv IS NOT NULL THEN greatest(dv, 0) END AS gv, CASE WHEN dv IS NOT NULL THEN greatest(-dv, 0) END AS lo,
  abs(rc - 1) * volume AS wv, CASE WHEN vr > -1 THEN ln(vr + 1) END AS rv FROM p)"""
_ALL = dict(_KBAR) | {"OPEN0": "open / nullif(close, 0)", "HIGH0": "high / nullif(close, 0)", "LOW0": "low / nullif(close, 0)", "VWAP0": "(high + low + close) / 3 / nullif(close, 0)"}
for _n in A.SPANS:
    _ALL |= _span(_n)
QUERIES["alpha158"] = lambda spark, d: _wide(A.alpha158(event_bars_1h(spark, d)))
SQL["alpha158"] = f"WITH {EVENT_BARS_1H}, {_PREPARED} SELECT symbol, {KEY}, {', '.join(_short(e, k) for k, e in _ALL.items())} FROM x"


def _moments(n: int) -> str:
    """SQL of a step that adds count and central moments of the last n returns."""
    xs, prior = f"xs{n}", A.SPANS.index(n)
    before = f"m{A.SPANS[prior - 1]}" if prior else "q"
    power = lambda k: f"list_avg(list_transform({xs}, lambda x: pow(x - list_avg({xs}), {k})))"
    return f"l{n} AS (SELECT *, list_filter(list(ret) OVER {over(n)}, lambda x: x IS NOT NULL) AS {xs} FROM {before}), m{n} AS (SELECT * EXCLUDE ({xs}), CAST(len({xs}) AS DOUBLE) AS k{n}, {power(2)} AS s{n}, {power(3)} AS t{n}, {power(4)} AS f{n} FROM l{n})"


def _alpha62() -> dict[str, str]:
    third = lambda n, k: max(k, n // 3)
    known = lambda x, n, k, e: f"CASE WHEN count({x}) OVER {over(n)} >= {k} THEN {e} OVER {over(n)} END"
    out = {k: _KBAR[v] for k, v in {"KMID": "KMID", "KLEN": "KLEN", "KSFT": "KMID2", "KUP": "KUP", "KLOW": "KLOW", "KSHUP": "KUP2", "KSHDN": "KLOW2"}.items()}
    out |= {f"ROC_{n}": f"lag(close, {n}) OVER {w()} / nullif(close, 0) - 1" for n in (1, 2, 3, 5, 10, 20, 30, 60)}
    for n in A.SPANS:
        ma, k = known("close", n, third(n, 3), "avg(close)"), f"k{n}"
        out |= {f"MA_{n}": ma, f"MADEV_{n}": f"(close - ({ma})) / nullif({ma}, 0)", f"VOL_{n}": known("lr", n, third(n, 3), "stddev_samp(lr)")}
        out[f"SKEW_{n}"] = f"CASE WHEN {k} >= {max(3, 5, n // 3)} AND s{n} > 0 THEN t{n} / pow(s{n}, 1.5) * sqrt({k} * ({k} - 1)) / ({k} - 2) END"
        out[f"KURT_{n}"] = f"CASE WHEN {k} >= {max(4, 5, n // 3)} AND s{n} > 0 THEN ({k} - 1) / (({k} - 2) * ({k} - 3)) * (({k} + 1) * (f{n} / (s{n} * s{n}) - 3) + 6) END"
    for n in (5, 10, 20):
        o, c = over(n), "CASE WHEN v IS NOT NULL THEN close END"
        out[f"CORR_VOL_{n}"] = f"CASE WHEN count(v) OVER {o} >= {third(n, 3)} AND stddev_samp({c}) OVER {o} > 0 AND stddev_samp(v) OVER {o} > 0 THEN covar_pop({c}, v) OVER {o} / (stddev_pop({c}) OVER {o} * stddev_pop(v) OVER {o}) END"
        out[f"VOL_RATIO_{n}"] = f"v / nullif({known('v', n, third(n, 3), 'avg(v)')}, 0)"
    out |= {f"RSI_{n}": f"CASE WHEN n > {n} AND d{n} <> 0 THEN 100 - 100 / (1 + u{n} / d{n}) END" for n in (6, 14, 24)}
    out |= {"MACD": "a - b", "MACD_SIGNAL": "sg", "MACD_HIST": "a - b - sg"}
    mid, dev = known("close", 20, 20, "avg(close)"), known("close", 20, 20, "stddev_samp(close)")
    out |= {"BB_UPPER_20": f"({mid} + 2 * ({dev}) - close) / nullif(close, 0)", "BB_LOWER_20": f"(close - ({mid}) + 2 * ({dev})) / nullif(close, 0)", "BB_WIDTH_20": f"4 * ({dev}) / nullif({mid}, 0)"}
    out |= {f"ATR_{n}": f"{known('tr', n, n, 'avg(tr)')} / nullif(close, 0)" for n in (14, 24)}
    return out | {"VOL_CHANGE": f"v / nullif(lag(v) OVER {w()}, 0) - 1", "VOL_MA5_RATIO": f"v / nullif({known('v', 5, 3, 'avg(v)')}, 0)", "VOL_MA20_RATIO": f"v / nullif({known('v', 20, 5, 'avg(v)')}, 0)", "RANGE": "rng", "RANGE_MA5": known("rng", 5, 3, "avg(rng)")}


_WILDER = (6, 14, 24)
_FAST, _SLOW = "a + 2.0 / 13 * (close - a)", "b + 2.0 / 27 * (close - b)"
QUERIES["alpha62"] = lambda spark, d: _wide(A.alpha62(event_bars_1h(spark, d)))
SQL["alpha62"] = f"""WITH RECURSIVE {EVENT_BARS_1H}, n AS (SELECT *, row_number() OVER {w()} AS n, close - {_LAG} AS x FROM bars),
e(symbol, n, a, b, sg, {', '.join(f'u{n}, d{n}' for n in _WILDER)}) AS (SELECT symbol, n, close, close, 0::DOUBLE, {', '.join('NULL::DOUBLE, NULL::DOUBLE' for _ in _WILDER)} FROM n WHERE n = 1
  UNION ALL SELECT n.symbol, n.n, {_FAST}, {_SLOW}, sg + 0.2 * (({_FAST}) - ({_SLOW}) - sg), {', '.join(f'coalesce(u{k} + (greatest(x, 0) - u{k}) / {k}, greatest(x, 0)), coalesce(d{k} + (greatest(-x, 0) - d{k}) / {k}, greatest(-x, 0))' for k in _WILDER)} FROM e JOIN n ON n.symbol = e.symbol AND n.n = e.n + 1),
q AS (SELECT n.*, e.* EXCLUDE (symbol, n), nullif(volume, 0) AS v, CASE WHEN close / nullif({_LAG.replace('symbol', 'n.symbol')}, 0) > 0 THEN ln(close / nullif({_LAG.replace('symbol', 'n.symbol')}, 0)) END AS lr, close / nullif({_LAG.replace('symbol', 'n.symbol')}, 0) - 1 AS ret,
  greatest(abs(high - low), abs(high - {_LAG.replace('symbol', 'n.symbol')}), abs(low - {_LAG.replace('symbol', 'n.symbol')})) AS tr, (high - low) / nullif(close, 0) AS rng FROM n JOIN e ON e.symbol = n.symbol AND e.n = n.n),
{', '.join(_moments(n) for n in A.SPANS)} SELECT symbol, {KEY}, {', '.join(_short(e, k) for k, e in _alpha62().items())} FROM m60"""

QUERIES["style_factors"] = lambda spark, d: shown(A.style(event_bars_1h(spark, d)), KEYS, ["value", "quality", "size", "low_vol", "liquidity"])


def _z(x: str) -> str:
    return f"({x} - ({least(x, 20, f'avg({x})', 60)})) / nullif({least(x, 20, f'stddev_samp({x})', 60)}, 0)"


SQL["style_factors"] = f"""WITH {EVENT_BARS_1H}, p AS (SELECT *, close / nullif({_LAG}, 0) - 1 AS ret, close * volume AS money FROM bars),
f AS (SELECT symbol, ts, -(close / nullif(lag(close, 60) OVER {w()}, 0) - 1) AS value, -({least('ret', 20, 'stddev_samp(ret)', 60)}) AS quality, ln(greatest({least('money', 20, 'avg(money)', 60)}, 1.0)) AS size0, {least('money', 20, 'avg(money)', 60)} AS s1,
  -({least('ret', 10, 'stddev_samp(ret)', 20)}) AS low_vol, ln(greatest({least('money', 10, 'avg(money)', 20)}, 1.0)) AS liq0, {least('money', 10, 'avg(money)', 20)} AS l1 FROM p),
g AS (SELECT symbol, ts, value, quality, low_vol, CASE WHEN s1 IS NOT NULL THEN size0 END AS size, CASE WHEN l1 IS NOT NULL THEN liq0 END AS liquidity FROM f)
SELECT symbol, {KEY}, {", ".join(r(_z(c), c) for c in ("value", "quality", "size", "low_vol", "liquidity"))} FROM g"""

QUERIES["expanding_signal"] = lambda spark, d: shown(A.expanding_signal(event_bars_1h(spark, d), "close", long_only=False), KEYS, ["signal"])
SQL["expanding_signal"] = _sql(f"CASE WHEN close >= ({least('close', 40, 'quantile_cont(close, 0.7)', None)}) THEN 1.0 WHEN close <= ({least('close', 40, 'quantile_cont(close, 0.3)', None)}) THEN -1.0 ELSE 0.0 END::DOUBLE AS signal")

QUERIES["strategy_targets"] = _bars(lambda: {"dual_ma": T.dual_ma_targets(8, 21, 2.0), "tsmom": T.tsmom_targets(48, 1.5), "bollinger": T.bollinger_targets()})
_A, _B = least("close", 8, "avg(close)", 8), least("close", 21, "avg(close)", 21)
_R48 = f"(close / nullif(lag(close, 48) OVER {w()}, 0) - 1)"
SQL["strategy_targets"] = _sql(f"""(CASE WHEN {_A} > {_B} THEN 2.0 WHEN {_A} < {_B} THEN -2.0 ELSE 0.0 END)::DOUBLE AS dual_ma, (CASE WHEN {_R48} > 0 THEN 1.5 WHEN {_R48} < 0 THEN -1.5 ELSE 0.0 END)::DOUBLE AS tsmom,
  (CASE WHEN close > {_MID} + 2 * ({_DEV}) THEN 1.5 WHEN close < {_MID} - 2 * ({_DEV}) THEN -1.5 ELSE 0.0 END)::DOUBLE AS bollinger""")

QUERIES["drawdown"] = _bars(lambda: {"dd": W.drawdown("close")}, order_bars_1w)
SQL["drawdown"] = _sql(r(f"close / max(close) OVER {over()} - 1", "dd"), ORDER_BARS_1W)
