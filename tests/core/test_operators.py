"""Fixed cases and invariants of operators that SQL does not cover."""

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickwell.operators import asof, backtest, conformal, consensus, factors, inference, leadlag, ledger, market_rules, optimize, research, selection, signals, splits
from tickwell.sources import bars as bars_source
from tickwell.sources import connectors
from tickwell.streaming import stateful

T0 = datetime(2024, 1, 1)
BARS = bars_source.BARS


def series(spark, closes, symbol="A", volume=1e6, spread=0.0):
    return spark.createDataFrame([(symbol, T0 + timedelta(days=i), float(c), float(c) + spread, float(c) - spread, float(c), float(v)) for i, (c, v) in enumerate(zip(closes, volume if isinstance(volume, list) else [volume] * len(closes), strict=True))], BARS)


def walk(spark, n=300, seed=7, symbol="A"):
    rng = np.random.default_rng(seed)
    c = 100 * np.exp(np.cumsum(rng.normal(0.0005, 0.02, n)))
    o = c * (1 + rng.normal(0, 0.005, n))
    rows = [(symbol, T0 + timedelta(days=i), float(o[i]), float(max(o[i], c[i]) * 1.004), float(min(o[i], c[i]) * 0.996), float(c[i]), float(rng.uniform(1e6, 2e6))) for i in range(n)]
    return spark.createDataFrame(rows, BARS)


def test_factor_sets_have_their_names(spark):
    b = walk(spark, 120)
    a = factors.alpha158(b)
    assert len(a.columns) == 2 + 158 and a.columns[2:11] == ["KMID", "KLEN", "KMID2", "KUP", "KUP2", "KLOW", "KLOW2", "KSFT", "KSFT2"] and a.columns[11:15] == ["OPEN0", "HIGH0", "LOW0", "VWAP0"]
    assert len(factors.alpha62(b).columns) == 2 + 62
    last = a.orderBy(F.desc("ts")).first()
    pdf = b.orderBy("ts").toPandas()
    assert math.isclose(last["MA20"], pdf.close.tail(20).mean() / pdf.close.iloc[-1], rel_tol=1e-9) and math.isclose(last["STD60"], pdf.close.tail(60).std() / pdf.close.iloc[-1], rel_tol=1e-9)
    assert math.isclose(last["RANK10"], pdf.close.tail(10).rank(pct=True).iloc[-1]) and math.isclose(last["CORR30"], pdf.close.tail(30).corr(np.log(pdf.volume.tail(30) + 1)), rel_tol=1e-7)


def test_factors_do_not_look_ahead_or_depend_on_partitions(spark):
    b = walk(spark, 90)
    early = factors.alpha158(b.where("ts < '2024-03-01'"), spans=(5, 20)).toPandas().sort_values("ts").reset_index(drop=True)
    late = factors.alpha158(b.repartition(7), spans=(5, 20)).where("ts < '2024-03-01'").toPandas().sort_values("ts").reset_index(drop=True)
    pd.testing.assert_frame_equal(early, late)


def test_backtest_costs(spark):
    b = series(spark, [100] * 5).withColumn("signal", F.when(F.dayofmonth("ts").isin(2, 3), 1.0).otherwise(0.0))
    got = backtest.long_only(b, tier="low").toPandas()
    assert math.isclose(got.ret.sum(), -0.002) and math.isclose(got.sort_values("ts").equity.iloc[-1], (1 - 0.001) ** 2)
    with pytest.raises(ValueError):
        backtest.cost_bps(tier="low", two_sided_bps=3)


def test_market_rules_on_a_fixed_week(spark):
    closes, volume = [10.0, 11.0, 11.0, 10.45, 10.45, 10.66], [1e6, 1e6, 1e6, 0.0, 1e6, 1e6]
    got = market_rules.annotate(series(spark, closes, volume=volume)).orderBy("ts").toPandas()
    assert not got.can_buy[1] and not got.tradeable[3] and got.can_buy[4] and got.can_buy[5]
    ok = signals.constrained(series(spark, closes, volume=volume).withColumn("signal", F.lit(1.0))).orderBy("ts").toPandas().signal_ok.tolist()
    assert ok[0] == 1.0
    late = signals.constrained(series(spark, closes, volume=volume).withColumn("signal", F.when(F.dayofmonth("ts") > 1, 1.0).otherwise(0.0))).orderBy("ts").toPandas().signal_ok.tolist()
    assert late == [0.0, 0.0, 1.0, 1.0, 1.0, 1.0]
    row = spark.createDataFrame([("ST foo", "600000.SS"), (None, "300123.SZ"), (None, "688001"), (None, "600519")], "name string, s string").select(market_rules.board(F.col("s"), F.col("name")).alias("b")).collect()
    assert [r.b for r in row] == ["st", "growth", "star", "main"]


def test_row_reasons(spark):
    rows = [(1.0, 2.0, 0.5, 1.5, 1.0), (float("nan"), 2.0, 0.5, 1.5, 1.0), (-1.0, 2.0, 0.5, 1.5, 1.0), (1.0, 2.0, 0.5, 1.5, -1.0), (1.0, 1.2, 0.5, 1.5, 1.0)]
    got = spark.createDataFrame(rows, "open double, high double, low double, close double, volume double").select(market_rules.row_reasons().alias("r")).collect()
    assert [r.r for r in got] == [[], ["non_finite_value"], ["non_positive_price"], ["negative_volume"], ["invalid_geometry"]]


def test_consensus_cases(spark):
    def capture(closes, session="s"):
        return [(f"p{i}", f"g{i}", session, c - 1.0, c + 1.0, c - 2.0, c, 1000.0) for i, c in enumerate(closes)]

    rows = capture([100.0, 100.1, 99.9], "clean") + capture([100.0, 130.0], "apart") + capture([100.0, 100.4, 100.8], "bridge") + capture([100.0], "alone") + capture([-5.0, 100.0, 100.1], "bad")
    df = spark.createDataFrame(rows, "provider string, grp string, session string, open double, high double, low double, close double, volume double")
    got = {r.session: r for r in consensus.session_votes(df).collect()}
    assert got["clean"].status == "accepted" and got["clean"].close == 100.0
    assert got["apart"].status == "quarantined" and "no_agreement" in got["apart"].reasons
    assert got["bridge"].status == "quarantined" and got["bridge"].reasons == ["bridge_only"]
    assert got["alone"].reasons == ["too_few_groups"] and got["bad"].status == "accepted" and got["bad"].row_reasons == ["non_positive_price"]
    again = {r.session: r for r in consensus.session_votes(df.orderBy(F.desc("close")).repartition(5)).collect()}
    assert again == got
    calendar = spark.createDataFrame([("clean",), ("none",)], "session string")
    known = {r.session: r.status for r in consensus.session_votes(df, calendar).collect()}
    assert known["none"] == "missing" and known["bad"] == "quarantined"


def test_overfitting_probability(spark):
    rng = np.random.default_rng(1)

    def table(m):
        return spark.createDataFrame([(i, f"v{j}", float(m[i, j])) for i in range(len(m)) for j in range(m.shape[1])], "t int, variant string, ret double")

    noise, skilled = rng.normal(0, 0.01, (96, 8)), rng.normal(0, 0.01, (96, 8))
    skilled[:, 3] += 0.02
    a = inference.pbo(table(noise), 8).first()
    assert a.n_splits == 70 and a.pbo > 0.2
    assert inference.pbo(table(skilled), 8).first().pbo < 0.05
    same = inference.pbo(table(np.repeat(noise[:, :1], 4, axis=1)), 8).first()
    assert same.pbo == 0


def test_deflated_sharpe_and_splits(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([("a", float(x)) for x in rng.normal(0.002, 0.01, 250)] + [("flat", 0.01)] * 5, "variant string, ret double")
    got = {r.variant: r for r in inference.deflated_sharpe(df, "ret", ("variant",), 50, 0.05).collect()}
    assert 0 < got["a"].dsr < got["a"].psr <= 1 and got["flat"].psr == 0
    assert splits.walk_forward_bars(500, 4, 120) == [(k, 120 + 95 * k, 120 + 95 * k, 215 + 95 * k) for k in range(4)]
    with pytest.raises(ValueError):
        splits.three_way(df, gap=1, horizon=5)


def test_conformal(spark):
    s = spark.createDataFrame([(float(i),) for i in range(1, 11)], "score double")
    assert conformal.quantile(s, "score", 0.1).first()["quantile"] == 10.0
    up, down = conformal.Levels(0.1, (0.05,)).feed([True, False])
    assert up < 0.1 < down + 0.05
    rng = np.random.default_rng(1)
    misses = rng.random(60) < 0.2
    whole, parts = conformal.Levels().feed(misses), conformal.Levels()
    assert np.allclose(whole, np.concatenate([parts.feed(misses[:7]), parts.feed([]), parts.feed(misses[7:])]))
    level, loss, want = [0.1] * 5, [0.0] * 5, []
    for m in misses:  # by the definition, one expert at a time
        loss = [x + (0.9 * a if m else 0.1 * (1 - a)) for x, a in zip(loss, level, strict=True)]
        level = [min(max(a + g * (0.1 - m), 1e-4), 1 - 1e-4) for a, g in zip(level, conformal.GAMMAS, strict=True)]
        share = [np.exp(-0.1 * x) for x in loss]
        want.append(sum(x * a for x, a in zip(share, level, strict=True)) / sum(share))
    assert np.allclose(whole, want)
    x = rng.normal(0, 0.01, 90)
    x[[3, 40]] = np.nan
    assert np.allclose(conformal.lagged_volatility(x), pd.Series(x).ewm(halflife=20, min_periods=5).std().shift(1).bfill().clip(lower=1e-8))
    assert np.isnan(conformal.lagged_volatility(np.full(3, 1.0))).all()
    rng = np.random.default_rng(2)
    rows = [(n, T0 + timedelta(days=i), float(rng.normal(0, sd))) for n, sd in (("wild", 0.05), ("calm", 0.002)) for i in range(80)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, ret double").withColumn("weight", F.lit(0.5))
    both, alone = conformal.weight_policy(df), conformal.weight_policy(df.where("symbol = 'wild'"))
    assert both.where("symbol = 'wild'").orderBy("ts").toPandas().scale.tolist() == alone.orderBy("ts").toPandas().scale.tolist()
    assert both.orderBy("ts").first().scale == 1.0


def test_futures_book_on_fixed_paths():
    book = ledger.FuturesBook(leverage=2.0, fee_bps=0.0)
    book.order(0, 1.0, 100.0)
    assert book.margin(100.0) == 50.0 and book.equity(110.0) == 10_010.0
    book.order(1, -1.0, 110.0)
    assert book.qty == 0 and book.wallet == 10_010.0 and book.fills[-1][5] == 10.0
    book.order(2, -2.0, 200.0)
    assert book.equity(180.0) == 10_050.0
    funded = ledger.FuturesBook(funding_rate=0.01)
    funded.order(0, 1.0, 100.0)
    before = funded.wallet
    funded.settle(100.0)
    assert math.isclose(before - funded.wallet, 1.0)
    thin = ledger.FuturesBook(wallet=10.0, leverage=5.0, fee_bps=0.0)
    thin.order(0, 100.0, 1.0)
    assert math.isclose(thin.qty, 50.0)
    thin.check(1, 0.79)
    assert thin.liquidated and thin.qty == 0


def test_gate_phases_and_liquidation_end(spark):
    gate = ledger.RiskGate(ledger.RiskLimits(hysteresis=100.0), 10_000.0)
    gate.update(9_400.0)
    assert gate.phase() == "LOSS_HALTED" and gate.cut(1.0, 10.0, 9_400.0, 5.0, 3.0) == (True, 0.0, "loss_halted")
    gate.update(9_550.0)
    assert gate.halted
    gate.update(9_650.0)
    assert gate.phase() == "ACTIVE"
    gate.update(8_000.0)
    assert gate.phase() == "INVALIDATED"
    crash = series(spark, [100.0, 99.0, 40.0, 39.0]).withColumn("target", F.lit(5.0))
    limits = ledger.RiskLimits(order_notional=1e9, position_notional=1e9, daily_loss=1e9, drawdown=0.0)
    assert ledger.run_sessions(crash, limits=limits, leverage=5.0).count() == 3


def test_equity_book_keeps_cash(spark):
    plan = spark.createDataFrame([("r", T0 + timedelta(days=i), s, 10.0 + i, 0.5 if i % 2 == 0 else None) for i in range(6) for s in ("a", "b")], "run_id string, ts timestamp_ntz, symbol string, close double, weight double")
    got = ledger.run_equity(plan, capital=1000.0).orderBy("ts").toPandas()
    assert (got.cash > -1e-9).all() and got.n_positions.iloc[-1] == 2 and got.equity.iloc[-1] > 1000


def test_streams_agree_with_batch(spark, tmp_path):
    b = walk(spark, 60, 3).unionByName(walk(spark, 60, 4, "B")).withColumn("target", signals.tsmom_targets(10, 1.5)).select("symbol", "ts", "close", "target")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(b.schema).parquet(f"{tmp_path}/in")
    query = stateful.sessions(stream).writeStream.format("memory").queryName("curves").outputMode("append").start()
    for a, z in (("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-30"), ("2024-01-30", "2024-06-01")):
        b.where(f"ts >= '{a}' AND ts < '{z}'").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query.processAllAvailable()
    query.stop()
    want = ledger.run_sessions(b).orderBy("symbol", "ts").toPandas()
    got = spark.table("curves").orderBy("symbol", "ts").toPandas()
    assert len(got) > 60 and got.merge(want, on=["symbol", "ts"])["equity_x"].sub(got.merge(want, on=["symbol", "ts"])["equity_y"]).abs().max() < 1e-9


def test_one_cycle(spark, tmp_path):
    events = spark.createDataFrame([("a", T0 + timedelta(minutes=20 * i), i, 1.0 + i) for i in range(30)], "event_type string, ts timestamp_ntz, event_id int, value double")
    events.write.parquet(f"{tmp_path}/in")
    seen = []
    stream = stateful.bars(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), late="0 minutes")
    assert stateful.cycle(stream, lambda df, n: seen.append(df.count()), f"{tmp_path}/cp") is not None and sum(seen) == 9
    (tmp_path / "HALT").touch()
    assert stateful.cycle(stream, lambda df, n: None, f"{tmp_path}/cp2", str(tmp_path / "HALT")) is None


def pages(symbol, interval, start, limit):
    every = [[i * 1000, 1, 2, 0.5, 1.5, 10] for i in range(25)]
    return [r for r in every if r[0] >= start][:limit]


def test_sources(spark, tmp_path):
    got = connectors.fetch(spark, "tests.core.test_operators:pages", ["X", "Y"], limit="10")
    assert got.count() == 50 and got.select("symbol", "ts").distinct().count() == 50
    connectors.save_cache(got, f"{tmp_path}/cache", "p", "1s")
    assert connectors.load_cache(spark, f"{tmp_path}/cache", "p", "1s", ["X"]).count() == 25
    assert connectors.load_cache(spark, f"{tmp_path}/none", "p", "1s") is None and connectors.load_cache(spark, f"{tmp_path}/cache", "p", "1s", ["X"], 26) is None
    _, used, note = connectors.load_bars(spark, "auto", {"rest": lambda: None, "cache": lambda: got})
    assert used == "cache" and "rest" in note and connectors.sample_kind("fixture") == "synthetic_fixture"
    with pytest.raises(ValueError):
        connectors.load_bars(spark, "venue", {})
    lines = spark.createDataFrame([("2024-01-02,1,2,3,0.5,100",), ("bad",)], "value string")
    assert [r.high for r in connectors.quote_lines(lines, "Q").collect()] == [3.0]
    k = spark.createDataFrame([("[[0,\"1\",\"2\",\"0.5\",\"1.5\",\"9\"]]",)], "value string")
    assert connectors.klines(spark, k, "K").first().close == 1.5
    raw = spark.createDataFrame([("2024-01-01", "1", 1), ("2024-01-01", "2", 2), ("2024-01-02", "nan", 3)], "Date string, `收盘` string, pos int")
    assert [(r.symbol, r.close) for r in bars_source.normalize(raw, "S", "pos").collect()] == [("S", 2.0)]
    report = connectors.html_report(spark.createDataFrame([("<a>", 1.5)], "name string, v double"), "T")
    assert "&lt;a&gt;" in report and "1.5000" in report
    assert connectors.load_bars(spark, "fixture", {})[1] == "fixture"


def test_shrinkage_and_weights():
    rng = np.random.default_rng(0)
    f = rng.normal(0, 0.01, (150, 3))
    x = f @ rng.normal(0, 1, (3, 20)) + rng.normal(0, 0.005, (150, 20))
    for method in ("constant_correlation", "diagonal"):
        cov, alpha = optimize.shrink(x, method)
        assert 0 <= alpha <= 1 and np.linalg.eigvalsh(cov).min() > 0 and np.allclose(np.diag(cov), x.var(axis=0))
    b, s, ind, size = np.full(20, 0.05), rng.normal(size=20), np.repeat([0, 1, 2, 3], 5), rng.normal(10, 1, 20)
    w = optimize.enhanced_weights(s, b, cov, ind, size, te=0.004, industry_cap=0.05, size_cap=0.05, turnover=0.15)
    z = (size - size.mean()) / size.std()
    assert math.isclose(w.sum(), 1, abs_tol=1e-9) and w.min() >= -1e-12 and s @ w > s @ b
    assert np.sqrt((w - b) @ cov @ (w - b)) <= 0.004 + 1e-6 and abs(z @ (w - b)) <= 0.05 + 1e-6 and np.abs(w - b).sum() / 2 <= 0.15 + 1e-6
    assert max(abs((w - b)[ind == g].sum()) for g in range(4)) <= 0.05 + 1e-6


def test_lead_lag_finds_a_planted_effect(spark):
    rng = np.random.default_rng(5)
    n = 270
    d = rng.normal(0, 0.012, n)
    gap, intra = 0.3 * d + rng.normal(0, 0.003, n), 0.15 * d + rng.normal(0, 0.004, n)
    target = spark.createDataFrame([(i, float(gap[i]), float(intra[i])) for i in range(n)], "session int, gap double, intraday double")
    links = spark.createDataFrame([(i, i) for i in range(n)], "source_session int, target_session int")
    driver = spark.createDataFrame([(i, float(d[i])) for i in range(n)], "session int, value double")
    rows = leadlag.designs(target, links, driver)
    out = leadlag.gates(leadlag.family(leadlag.estimate(rows, draws=99))).toPandas()
    assert len(out) == 45 and out.id.tolist() == sorted(out.id.tolist()) or len(out) == 45
    one = out[(out.window == 252) & (out.horizon == 1)].set_index("outcome")
    assert abs(one.coefficient["gap"] - 0.3) < 0.03 and abs(one.coefficient["gap"] + one.coefficient["intraday"] - one.coefficient["total"]) < 1e-9
    assert one.status["gap"] == "IDENTIFIED" and one.p["gap"] == 0.01
    decay = spark.createDataFrame([(63, "gap", h, sum(0.5**k for k in range(h))) for h in range(1, 6)], "window int, outcome string, horizon int, coefficient double")
    assert math.isclose(leadlag.half_life(decay).first().half_life, 1.0, rel_tol=1e-6)


def test_graph_problems(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    nodes = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), ("d", "5"), ("e", "6")], "id string, hash string")
    edges = spark.createDataFrame([("a", "b", "2"), ("b", "c", "9"), ("c", "b", "2"), ("a", "zz", "0")], "src string, dst string, hash string")
    got = {(r.problem, r.node) for r in research.graph_problems(nodes, edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {("duplicate_id", "d"), ("dangling_reference", "a"), ("hash_mismatch", "b"), ("cycle", "b"), ("cycle", "c"), ("unreachable", "d"), ("unreachable", "e")}
    assert research.digest({"b": 1, "a": [1.5, "é"]}) == research.digest({"a": [1.5, "é"], "b": 1}) != research.digest({"a": 1}, "x")


def test_statements_and_sentiment(spark):
    rows = spark.createDataFrame([("e", "2023-12-31", 100.0, 40.0, 30.0, 30.0, 20.0, 25.0, 5.0, 200.0, 120.0, 80.0, 10.0, 50.0), ("e", "2024-12-31", 120.0, 48.0, 36.0, 36.0, 24.0, 30.0, 6.0, 220.0, 130.0, 90.0, 12.0, 50.0)], "entity string, period_end string, revenue double, cost_of_revenue double, operating_expenses double, operating_income double, net_income double, cash_from_operations double, capital_expenditure double, total_assets double, total_liabilities double, total_equity double, cash double, debt double")
    got = research.statements(rows).orderBy("period_end").collect()
    assert math.isclose(got[1].revenue_growth, 0.2) and got[0].free_cash_flow == 20.0 and got[1].balance_residual == 0 and got[1].net_debt == 38.0
    texts = spark.createDataFrame([("Strong beat, buy",), ("downgrade: weak",), ("nothing",), (None,), ("利好消息",)], "t string").select(selection.sentiment(F.col("t")).alias("s")).collect()
    assert [r.s for r in texts] == [1.0, -1.0, 0.0, 0.0, 1.0]


def test_models(spark):
    from tickwell.operators import models

    rng = np.random.default_rng(3)
    rows = [(T0 + timedelta(days=i), f"a{j}", float(x := rng.normal()), float(rng.normal()), float(0.5 * x + rng.normal(0, 0.3))) for i in range(60) for j in range(8)]
    panel = spark.createDataFrame(rows, "ts timestamp_ntz, asset string, f1 double, f2 double, label double")
    best = models.train(panel, ["f1", "f2"], "label")
    assert best.ic > 0.5 and models.passes(best, None) and not models.passes(models.Trained("x", None, 0.1, 0.1), best)
    assert models.predict(best.model, panel.drop("f2"), ["f1", "f2"], ["ts", "asset"]).count() == len(rows)
    with pytest.raises(ValueError):
        models.predict(best.model, panel.drop("f1", "f2"), ["f1", "f2"], ["ts"])
    assert models.should_retrain(None, 0.0) and not models.should_retrain(0.0, 86400.0)


def test_filings(spark, tmp_path):
    import hashlib
    import json

    from tickwell.operators import filings

    fact = {"end": "2024-12-31", "val": 5.0, "accn": "a1", "fy": 2024, "fp": "FY", "form": "10-K", "filed": "2025-02-01"}
    doc = {"facts": {"us-gaap": {"Assets": {"units": {"USD": [fact, fact | {"accn": "a2"}]}}, "Twice/x": {"units": {"USD": [fact, fact]}}}}}
    sub = {"filings": {"recent": {"accessionNumber": ["a1", "a2"], "acceptanceDateTime": ["2025-02-01T10:00:00Z", "2025-06-01T10:00:00Z"]}}}
    of = filings.facts(spark.createDataFrame([("e", json.dumps(doc)), ("e", "no json")], "entity string, value string"))
    known = filings.accepted(spark.createDataFrame([("e", json.dumps(sub))], "entity string, value string"))
    base = ("us-gaap", "USD", "10-K", 2024, "FY", "2024-12-31", None)
    rows = [("x", "e", base[0], "Assets", base[1], "a1", *base[2:], 1000.0, True), ("late", "e", base[0], "Assets", base[1], "a2", *base[2:], None, None), ("two", "e", base[0], "Twice/x", base[1], "a1", *base[2:], None, None), ("none", "e", base[0], "Cash", base[1], "a1", *base[2:], None, None)]
    want = spark.createDataFrame(rows, "name string, entity string, taxonomy string, concept string, unit string, accn string, form string, fy int, fp string, end string, start string, scale double, negate boolean")
    got = {r.name: r for r in filings.select_facts(of, known, want, "2025-03-01").collect()}
    assert {n: r.status for n, r in got.items()} == {"x": "ok", "late": "late", "two": "ambiguous", "none": "missing"}
    assert got["x"].value == -5000.0 and got["x"].pointer == "/facts/us-gaap/Assets/units/USD/0" and got["two"].pointer == "/facts/us-gaap/Twice~1x/units/USD/0"
    (tmp_path / "f.txt").write_text("abc")
    wanted = spark.createDataFrame([("f.txt", hashlib.sha256(b"abc").hexdigest()), ("g.txt", "0")], "path string, sha256 string")
    assert {r.path: r.status for r in filings.snapshots(spark, str(tmp_path), wanted).collect()} == {"f.txt": "ok", "g.txt": "missing"}
    assert spark.createDataFrame([("1h",), ("?",)], "i string").select(filings.periods_per_year(F.col("i")).alias("n")).collect()[0].n == 8760


def test_quantile_of_large_groups_is_exact(spark, monkeypatch):
    monkeypatch.setattr(conformal, "_WHOLE", 50)
    rng = np.random.default_rng(3)
    rows = [("a", float(x)) for x in rng.normal(size=4000)] + [("ties", float(x)) for x in rng.integers(0, 4, 3000)] + [("few", 1.0), ("few", 2.0), ("none", None)]
    got = {r["g"]: r for r in conformal.quantile(spark.createDataFrame(rows, "g string, score double"), "score", 0.1, ("g",)).collect()}
    assert set(got) == {"a", "ties", "few"}
    for g, r in got.items():
        x = sorted(v for k, v in rows if k == g)
        level = min(1.0, math.ceil(round((len(x) + 1) * 0.9, 9)) / len(x))
        assert r["n"] == len(x) and r["quantile"] == x[math.ceil(round(level * (len(x) - 1), 9))]


def test_step_up_adjustment_by_ranges(spark):
    rng = np.random.default_rng(4)
    p = np.concatenate((rng.random(300), np.full(150, 0.5), rng.random(50) / 1000))
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)] + [(900, None)], "id long, p double")
    rank = np.array([(p <= x).sum() for x in p])
    want = [min(1.0, min(p[j] * len(p) / rank[j] for j in np.flatnonzero(p >= x))) for x in p]
    for ranges in (1, 7, 256):
        got = {r["id"]: r["q_value"] for r in inference.benjamini_hochberg(df, ranges=ranges).collect()}
        assert got[900] is None and np.allclose([got[i] for i in range(len(p))], want)
    assert inference.benjamini_hochberg(df.where("p > 2")).count() == 0


def test_asof_joins_over_many_slices(spark):
    rng = np.random.default_rng(5)
    time = lambda: T0 + timedelta(hours=int(rng.integers(0, 24 * 60)))
    left = [("ab"[i % 2], time(), i) for i in range(80)] + [("c", T0, 900), (None, T0, 901)]
    right = {("ab"[i % 2], time()): float(i) for i in range(60)} | {(None, T0 - timedelta(days=9)): -1.0}
    a = spark.createDataFrame(left, "symbol string, ts timestamp_ntz, id long")
    b = spark.createDataFrame([(*k, v) for k, v in right.items()], "symbol string, ts timestamp_ntz, v double")
    for unit in ("hour", "day", "year"):
        back = {r["id"]: r["v"] for r in asof.backward(a, b, ("symbol",), "v", unit=unit).collect()}
        ahead = {r["id"]: (r["v"], r["at"]) for r in asof.forward(a, b.withColumnRenamed("ts", "at"), ("symbol",), "ts", "at", "v", unit=unit).collect()}
        for s, t, i in left:
            before = max(((x[1], v) for x, v in right.items() if x[0] == s and x[1] <= t), default=(None, None))
            after = min(((x[1], v) for x, v in right.items() if x[0] == s and x[1] > t), default=(None, None))
            assert back[i] == before[1] and ahead[i] == after[::-1]


def test_block_bootstrap_of_a_table(spark):
    df = spark.createDataFrame([(s, T0 + timedelta(days=i), float(i % 7) if s == "a" else 2.0) for s in "ab" for i in range(50)] + [("a", T0, None)], "symbol string, ts timestamp_ntz, value double")
    draws = inference.block_bootstrap(df, 130, 5, lambda x: float(x.mean()), 3, by=("symbol",))
    got = draws.toPandas()
    assert len(got) == 260 and got[got.symbol == "b"].value.eq(2.0).all() and got[got.symbol == "a"].value.between(1.5, 4.5).all()
    again = inference.block_bootstrap(df.repartition(3), 130, 5, lambda x: float(x.mean()), 3, by=("symbol",)).toPandas()
    key = ["symbol", "draw"]
    assert got.sort_values(key).value.tolist() == again.sort_values(key).value.tolist()
    assert inference.block_bootstrap(df.where("false"), 5, 2, lambda x: 0.0).count() == 0
