"""Rankers over folds and seeds, model versions, factor mining."""

import datetime

import numpy as np
import pytest

from tickwell.operators import mining as M
from tickwell.operators import ranker as R
from tickwell.operators import versions as V
from tickwell.operators.models import Trained


def panel(spark, dates=180, assets=12, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(dates):
        a, b, noise = rng.normal(size=assets), rng.normal(size=assets), rng.normal(size=assets)
        y = a + 0.3 * np.sign(b) + 0.3 * rng.normal(size=assets)
        rows += [(datetime.datetime(2020, 1, 1) + datetime.timedelta(days=4 * t), f"s{i}", float(a[i]), float(b[i]), float(noise[i]), float(y[i])) for i in range(assets)]
    rows.append((datetime.datetime(2020, 1, 2), "s0", None, 1.0, 1.0, 1.0))
    return spark.createDataFrame(rows, "ts timestamp, asset string, a double, b double, noise double, y double")


def test_ranker_finds_the_planted_factor_in_every_fold(spark):
    got = R.walk_forward(panel(spark), ["noise", "a", "b"], "y", n_splits=2, test_months=4, purge=2, seeds=(1, 2), settings=R.Settings(trees=9, depth=2, rate=0.4, bins=16))
    used = [(r.feature, r.splits) for r in got.importance.collect()]
    assert used[0][0] == "a" and [n for _, n in used] == sorted((n for _, n in used), reverse=True) and len(used) == 3
    folds, seeds = got.folds.orderBy("fold").collect(), got.seeds.collect()
    assert [r.fold for r in folds] == [0, 1] and all(r.ic > 0.8 and r.rank_ic > 0.7 for r in folds) and len(seeds) == 4
    assert folds[0].test_end < folds[1].test_start
    summary = got.summary.first()
    assert summary.n_folds == 2 and abs(summary.ic_mean - np.mean([r.ic for r in folds])) < 1e-12
    assert got.predictions.groupBy("ts", "asset").count().where("count > 1").count() == 0


def test_trees_are_those_of_a_plain_fit(spark):
    frame, s = panel(spark, 40, 8), R.Settings(trees=2, depth=2, rate=0.5, bins=8, least=5)
    roles = frame.select("ts").distinct().selectExpr("ts", "0 AS fold", "'train' AS role")
    rows, cuts, n = R.prepared(frame, ["a", "b"], "y", roles, s)
    grid = R.fit(rows, ["a", "b"], cuts, n, (3,), s)
    local = rows.toPandas()
    keys, bins, y = local["key"].to_numpy().view(np.uint64), np.stack(local["bins"].to_numpy()), local["y"].to_numpy()
    score = np.full(len(y), y.mean())
    for t in range(s.trees):
        use = R._drawn(keys, R.SUBSAMPLE, 3, t)
        features = np.flatnonzero(R._drawn(np.arange(2, dtype=np.uint64), R.COLSAMPLE, 3, t, 1))

        def grow(rows_in, level):
            rest = (y - score)[rows_in & use]
            best = max(((sum(h.sum() ** 2 / (len(h) + s.ridge) for h in (rest[x <= c], rest[x > c])) - rest.sum() ** 2 / (len(rest) + s.ridge), -f, -c) for f in features for x in [bins[rows_in & use, f]] for c in range(s.bins) if min((x <= c).sum(), (x > c).sum()) >= s.least), default=None)
            if best is None or best[0] <= 1e-12:
                out[rows_in] = s.rate * rest.sum() / (len(rest) + s.ridge)
                return
            f, c = -best[1], -best[2]
            for side in (bins[:, f] <= c, bins[:, f] > c):
                inside = rows_in & side
                rest = (y - score)[inside & use]
                if level + 1 == s.depth:
                    out[inside] = s.rate * rest.sum() / (len(rest) + s.ridge)
                else:
                    grow(inside, level + 1)

        out = np.zeros(len(y))
        grow(np.ones(len(y), bool), 0)
        score += out
    got = R._score(bins, np.full((len(y), 1), grid.start[0]), grid.trees, s.depth)[:, 0]
    assert np.allclose(got, score, atol=1e-9)


def test_holdout_trains_on_the_first_dates_only(spark):
    got = R.holdout(panel(spark, 60, 6), ["a", "noise"], "y", settings=R.Settings(trees=3, depth=2, rate=0.5, bins=8))
    row = got.folds.first()
    assert 108 <= row.n_test <= 0.3 * 361 + 6 and row.ic > 0.6
    assert R.holdout(panel(spark, 5, 6), ["a"], "y") is None
    with pytest.raises(ValueError):
        R.walk_forward(panel(spark, 4, 3), ["a"], "y", n_splits=9)


def test_mining_finds_a_planted_product(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i % 20), *map(float, x), float(x[0] * x[2] + 0.05 * rng.normal())) for i, x in enumerate(rng.normal(size=(400, 3)))]
    frame = spark.createDataFrame([*rows, (1, None, 1.0, 1.0, 1.0)], "ts int, a double, b double, c double, y double")
    got = M.mine(frame, ["a", "b", "c"], "y", population=80, generations=4, tournament=10, parsimony=0.002, n_factors=3, seed=1)
    assert got.scores[0] > 0.98 and len(got.formulas) == 3
    few = [M.mine(frame, ["a", "b"], "y", population=12, generations=2, tournament=4, n_factors=2, seed=1).formulas for _ in range(2)]
    assert few[0] == few[1] and got.table(spark).count() == 3
    assert "gp_factor_2" in got.transform(frame).columns


def test_formulas_compile_to_what_they_say(spark):
    frame = spark.createDataFrame([(2.0, -3.0, 1.0), (0.0, 0.0005, 2.0), (-4.0, 8.0, 0.0), (1.0, 5.0, 7.0)], "a double, b double, y double")
    trees = ["a", ("neg", "b"), ("div", "a", "b"), ("sqrt", "a"), ("log", ("abs", "b")), ("sub", ("mul", "a", "b"), ("add", "a", "a"))]
    plain = {"neg": lambda a: -a, "abs": abs, "sqrt": lambda a: abs(a) ** 0.5, "log": lambda a: np.log(abs(a)) if abs(a) > 1e-3 else 0.0, "div": lambda a, b: a / b if abs(b) > 1e-3 else 1.0, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "add": lambda a, b: a + b}
    value = lambda t, r: r[t] if isinstance(t, str) else plain[t[0]](*(value(x, r) for x in t[1:]))
    rows = frame.collect()
    got = frame.select(*[M.column(t).alias(f"f{i}") for i, t in enumerate(trees)]).collect()
    assert all(abs(g[f"f{i}"] - value(t, r)) < 1e-12 for r, g in zip(rows, got) for i, t in enumerate(trees))
    found = M.scores(frame, [*trees, ("sub", "a", "a")], "y")
    assert found[("sub", "a", "a")] == 0.0
    for t in trees:
        assert abs(found[t] - abs(np.corrcoef([value(t, r) for r in rows], [r.y for r in rows])[0, 1])) < 1e-9


def test_a_stream_of_trainings_with_one_refused_and_one_rolled_back(spark, tmp_path):
    rows = [(datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d), float(d)) for d in (0, 3, 8, 16, 25)]
    for k, (ts, v) in enumerate(rows):
        spark.createDataFrame([(ts, v + i) for i in range(10 if k != 4 else 2)], "ts timestamp, v double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/k={k}")
    store = V.Versions(spark, f"{tmp_path}/store", kept=2)
    assert store.incumbent() is None and store.table().count() == 0
    told = {0.0: (0.05, 0.5), 8.0: (0.06, 0.3), 16.0: (0.07, 0.45)}
    trainer = V.Retrainer(store, lambda df: Trained("fake", None, *told[df.agg({"v": "min"}).first()[0]]), min_samples=5)
    for k in range(5):
        trainer.on_batch(spark.read.parquet(f"{tmp_path}/in/k={k}"), k)
    events = store.events().orderBy("seq").collect()
    assert [(e.version, e.accepted, e.reason, e.incumbent) for e in events] == [(1, True, None, 1), (2, False, "degraded", 1), (3, True, None, 3)]
    trainer.on_batch(spark.read.parquet(f"{tmp_path}/in/k=3"), 3)
    assert store.events().count() == 3
    assert store.roll_back(rows[-1][0]) == 1 and store.incumbent().version == 1
    assert [(r.version, r.in_use) for r in store.table().collect()] == [(3, False), (2, False), (1, True)]
    assert store.roll_back(rows[-1][0], 3) == 3 and [r.version for r in store.expired().collect()] == [1]
    with pytest.raises(ValueError):
        V.Versions(spark, f"{tmp_path}/none").roll_back(rows[0][0])


def test_versions_in_a_stream(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(datetime.datetime(2024, 1, 1 + 9 * k), float(i % 7), 2.0 * (i % 7)) for i in range(30)], "ts timestamp, x double, y double").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    ics = iter([(0.1, 1.0), (-0.1, 1.0), (0.2, 1.2)])
    fit = lambda df: Trained("line", Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="v"), LinearRegression(featuresCol="v", labelCol="y")]).fit(df), *next(ics))
    store = V.Versions(spark, f"{tmp_path}/store")
    stream = spark.readStream.schema("ts timestamp, x double, y double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    run = stream.writeStream.foreachBatch(V.Retrainer(store, fit, min_samples=10, every_hours=1).on_batch).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert [(e.accepted, e.incumbent) for e in store.events().orderBy("seq").collect()] == [(True, 1), (False, 1), (True, 3)]
    got = store.load().transform(spark.createDataFrame([(3.0,)], "x double")).first().prediction
    assert abs(got - 6.0) < 1e-6


@pytest.mark.parametrize(("new", "old", "why"), [((0.0, 1.0), None, "ic_not_positive"), ((None, None), None, "ic_not_positive"), ((0.1, 0.0), None, "icir_not_positive"), ((0.1, float("nan")), (0.1, None), ""), ((0.07, None), (0.1, None), "degraded"), ((0.1, 0.4), (0.1, 0.5), "")])
def test_gate_of_versions(new, old, why):
    assert V.gate(*new, old) == why
