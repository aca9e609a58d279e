"""Boosted rankers over folds and seeds, all grown together: a level of every tree is one pass and one aggregate.

Rows stay where they are. A task adds up gradients by (model, node, feature, bin) for its rows, Spark sums the parts and picks the split of each node,
and only splits come to the driver: models x nodes of them, whatever the number of rows. Labels are regressed on, as standardised returns of
the next periods should be; models differ by fold and by seed, which draws the rows and the features of each tree by hashes, so
results do not depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickwell.operators import cross_section as X
from tickwell.operators import splits
from tickwell.sources.shared import stored

#: Fixed values of the published fits: rows and features drawn for a tree.
SUBSAMPLE, COLSAMPLE = 0.9, 0.9
_WRITE_EVERY = 8  # trees between two writes of the predictions so far
_U = np.uint64


@dataclass(frozen=True)
class Settings:
    trees: int = 80
    depth: int = 4
    rate: float = 0.05
    bins: int = 32
    least: int = 20
    ridge: float = 1.0


@dataclass
class Grid:
    """Trees of each model. A tree is (feature, cut) of its inner nodes, level by level, and the values of its leaves; feature -1: all go left."""

    features: list[str]
    cuts: list[list[float]]
    models: list[tuple[int, int]]
    settings: Settings
    start: list[float] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    splits: list[tuple[int, int, str, float]] = field(default_factory=list)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _drawn(keys: np.ndarray, share: float, *parts: int) -> np.ndarray:
    """Which keys are drawn, by a hash of them and of ``parts``."""
    salt = _U(0)
    for p in parts:
        salt = _mix(np.array([salt ^ _U(p & 0xFFFFFFFF)], np.uint64) + _U(0x9E3779B97F4A7C15))[0]
    return _mix(keys ^ salt) < _U(int(share * (2**64 - 1)))


def _leaves(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """Which node of the level ``depth`` each row is in, for one tree."""
    node = np.zeros(len(bins), np.int64)
    for level in range(depth):
        at = node + (1 << level) - 1
        f = feature[at]
        right = (f >= 0) & (bins[np.arange(len(bins)), np.maximum(f, 0)] > cut[at])
        node = 2 * node + right
    return node


def _arrays(batch: pa.RecordBatch, features: int, models: int) -> tuple[np.ndarray, ...]:
    n = batch.num_rows
    bins = batch.column("bins").flatten().to_numpy(zero_copy_only=False).reshape(n, features)
    score = batch.column("score").flatten().to_numpy(zero_copy_only=False).reshape(n, models)
    return batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64), bins, batch.column("y").to_numpy(zero_copy_only=False), batch.column("train").to_numpy(zero_copy_only=False), score


def prepared(panel: DataFrame, features: Sequence[str], label: str, roles: DataFrame, settings: Settings, keys: Sequence[str] = ("ts", "asset")) -> tuple[DataFrame, list[list[float]], int]:
    """Rows (keys, key, bins, y, train, test) with all features and the label, the cut points of each feature, and the number of folds.

    ``roles``: (ts, fold, role), role train or test, fold below 62. Cut points are quantiles of the first fold's training rows, so no bin knows later rows.
    """
    bit = F.expr("shiftleft(1L, fold)")
    mask = lambda role: F.coalesce(F.sum(F.when(F.col("role") == role, bit)), F.lit(0).cast("long")).alias(role)
    by_date = roles.groupBy("ts").agg(mask("train"), mask("test"))
    rows = panel.dropna(subset=[*features, label]).join(F.broadcast(by_date), "ts")  # a row a date
    steps = [i / settings.bins for i in range(1, settings.bins)]
    first = rows.where(F.col("train").bitwiseAND(F.lit(1)) != 0).agg(*[F.percentile_approx(f, steps, 10_000).alias(f"q{i}") for i, f in enumerate(features)]).first()
    cuts = [sorted(set(first[f"q{i}"] or [])) for i in range(len(features))]
    n = (roles.agg(F.max("fold")).first()[0] or 0) + 1
    below = lambda f: lambda v: v < F.col(f)
    place = [F.size(F.filter(F.array(*map(F.lit, c)), below(f))) if c else F.lit(0) for f, c in zip(features, cuts, strict=True)]
    key = F.xxhash64(*[F.col(k).cast("string") for k in keys])
    out = rows.select(*keys, key.alias("key"), F.array(*[p.cast("short") for p in place]).alias("bins"), F.col(label).cast("double").alias("y"), "train", "test")
    return stored(out, "ranker"), cuts, n


def fit(rows: DataFrame, features: Sequence[str], cuts: list[list[float]], folds: int, seeds: Sequence[int], settings: Settings = Settings()) -> Grid:
    """Trees of folds x seeds, grown on ``rows`` of ``prepared``. A split needs ``least`` rows on either side and a gain above zero."""
    grid = Grid(list(features), cuts, [(k, s) for k in range(folds) for s in seeds], settings)
    m, p = len(grid.models), len(features)
    columns = ["key", "bins", "y", "train", "score"]
    mean = rows.select(*[F.avg(F.when(F.col("train").bitwiseAND(F.lit(1 << k)) != 0, F.col("y"))).alias(str(k)) for k in range(folds)]).first()
    start = [float(mean[k] or 0.0) for k, _ in grid.models]
    grid.start = start
    state, since = rows.select("key", "bins", "y", "train", F.array(*map(F.lit, start)).alias("score")), []
    for t in range(settings.trees):
        inner = (1 << settings.depth) - 1
        feature, cut, leaf = np.full((m, inner), -1), np.zeros((m, inner), np.int64), np.zeros((m, inner + 1))
        for level in range(settings.depth):
            for r in _best(_histograms(state, since, (feature, cut), level, t, grid), settings):
                at = r.node + (1 << level) - 1
                low, high = (r.gl / (r.nl + settings.ridge), r.gr / (r.nr + settings.ridge)) if r.feature >= 0 else (r.g / (r.n + settings.ridge),) * 2
                width = 1 << (settings.depth - level - 1)
                leaf[r.model, 2 * r.node * width : (2 * r.node + 1) * width] = settings.rate * low
                leaf[r.model, (2 * r.node + 1) * width : (2 * r.node + 2) * width] = settings.rate * high
                if r.feature >= 0:
                    feature[r.model, at], cut[r.model, at] = r.feature, r.bin
                    grid.splits.append((*grid.models[r.model], grid.features[r.feature], float(r.gain)))
        grid.trees.append((feature, cut, leaf))
        since.append(grid.trees[-1])
        if len(since) == _WRITE_EVERY and t + 1 < settings.trees:
            state, since = stored(_added(state, since, settings, p, m).select(*columns), "ranker-scores"), []
    return grid


def _score(bins: np.ndarray, score: np.ndarray, trees: list, depth: int) -> np.ndarray:
    score = score.copy()
    for feature, cut, leaf in trees:
        for j in range(score.shape[1]):
            score[:, j] += leaf[j][_leaves(bins, feature[j], cut[j], depth)]
    return score


def _added(state: DataFrame, trees: list, settings: Settings, p: int, m: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, bins, _, _, score = _arrays(batch, p, m)
                new = pa.array(list(_score(bins, score, trees, settings.depth)), pa.list_(pa.float64()))
                yield batch.set_column(batch.schema.get_field_index("score"), "score", new)

    return state.mapInArrow(run, state.schema)


def _histograms(state: DataFrame, since: list, tree: tuple[np.ndarray, np.ndarray], level: int, t: int, grid: Grid) -> DataFrame:
    """(model, node, feature, bin, g, n): sums of residuals and counts, one row a task and cell, then over tasks."""
    models, s, p, m = grid.models, grid.settings, len(grid.features), len(grid.models)
    width, nodes = s.bins + 1, 1 << level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((m, p, nodes * width)), np.zeros((m, p, nodes * width))
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, bins, y, train, score = _arrays(batch, p, m)
            score = _score(bins, score, since, s.depth)
            for j, (fold, seed) in enumerate(models):
                use = ((train >> fold) & 1 == 1) & _drawn(keys, SUBSAMPLE, seed, t)
                own = bins[use]
                node, rest = _leaves(own, tree[0][j], tree[1][j], level), (y - score[:, j])[use]
                for f in np.flatnonzero(_drawn(np.arange(p, dtype=np.uint64), COLSAMPLE, seed, t, 1)) if p > 1 else range(p):
                    cell = node * width + own[:, f]
                    sums[j, f] += np.bincount(cell, rest, nodes * width)
                    counts[j, f] += np.bincount(cell, minlength=nodes * width)
        j, f, cell = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (j.astype(np.int32), (cell // width).astype(np.int32), f.astype(np.int32), (cell % width).astype(np.int32), sums[j, f, cell], counts[j, f, cell])], ["model", "node", "feature", "bin", "g", "n"])

    parts = state.mapInArrow(run, "model int, node int, feature int, bin int, g double, n double")
    return parts.groupBy("model", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))


def _best(cells: DataFrame, s: Settings) -> list:
    """The best split of each (model, node): feature -1 where none gains."""
    w = Window.partitionBy("model", "node", "feature")
    c = cells.withColumns({"gl": F.sum("g").over(w.orderBy("bin")), "nl": F.sum("n").over(w.orderBy("bin")), "ga": F.sum("g").over(w), "na": F.sum("n").over(w)})
    c = c.withColumns({"gr": F.col("ga") - F.col("gl"), "nr": F.col("na") - F.col("nl")})
    of = lambda g, n: F.pow(F.col(g), 2) / (F.col(n) + s.ridge)
    gain = of("gl", "nl") + of("gr", "nr") - of("ga", "na")
    ok = (F.col("nl") >= s.least) & (F.col("nr") >= s.least) & (gain > 1e-12)
    split = F.struct(F.when(ok, gain).otherwise(0.0).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "gl", "nl", "gr", "nr", "ga", "na")
    top = c.groupBy("model", "node").agg(F.max(split).alias("s"))
    found = F.col("s.gain") > 0
    return top.select("model", "node", F.when(found, -F.col("s.f")).otherwise(-1).alias("feature"), (-F.col("s.b")).alias("bin"), "s.gain", "s.gl", "s.nl", "s.gr", "s.nr", F.col("s.ga").alias("g"), F.col("s.na").alias("n")).collect()


def predict(rows: DataFrame, grid: Grid, keys: Sequence[str] = ("ts", "asset"), role: str = "test") -> DataFrame:
    """(keys, fold, seed, prediction, y): each row by the models of the folds in which it has ``role``."""
    models, trees, depth, p = grid.models, grid.trees, grid.settings.depth, len(grid.features)
    start = np.array(grid.start)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    names = [*keys, "fold", "seed", "prediction", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            bins = batch.column("bins").flatten().to_numpy(zero_copy_only=False).reshape(n, p)
            has = batch.column(role).to_numpy(zero_copy_only=False)
            score = _score(bins, np.tile(start, (n, 1)), trees, depth)
            at, j = np.nonzero((has[:, None] >> np.array([k for k, _ in models])[None, :]) & 1)
            pick = pa.array(at)
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pick) for k in keys], pa.array(np.array([models[x][0] for x in j], np.int32)), pa.array(np.array([models[x][1] for x in j], np.int32)), pa.array(score[at, j]), batch.column("y").take(pick)], names)

    return rows.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "fold int, seed int, prediction double, y double"]))


@dataclass
class Ranked:
    predictions: DataFrame  # (ts, asset, fold, prediction, y): equal weights of the seeds
    folds: DataFrame  # (fold, test_start, test_end, n_test, ic, rank_ic)
    seeds: DataFrame  # (fold, seed, ic, rank_ic)
    summary: DataFrame  # one row
    importance: DataFrame  # (feature, splits, gain), the most used first
    grid: Grid


def _ics(rows: DataFrame, by: Sequence[str], least: int) -> DataFrame:
    """(by, ic, rank_ic): means over dates."""
    keyed = rows.withColumn("__at", F.struct(*by, "ts")).drop("ts").withColumnRenamed("__at", "ts")
    daily = X.daily_ic(keyed, "prediction", "y", least=least).select(*[F.col(f"ts.{b}").alias(b) for b in by], "ic", "rank_ic")
    return daily.groupBy(*by).agg(F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic"))


def importance(grid: Grid, spark) -> DataFrame:  # noqa: ANN001
    """(feature, splits, gain) over all models; features that were never used have zeros."""
    used = spark.createDataFrame(grid.splits, "fold int, seed int, feature string, gain double")
    every = spark.createDataFrame([(f,) for f in grid.features], "feature string")
    got = every.join(used, "feature", "left").groupBy("feature").agg(F.count("gain").alias("splits"), F.coalesce(F.sum("gain"), F.lit(0.0)).alias("gain"))
    return got.orderBy(F.desc("splits"), F.desc("gain"), "feature")


def walk_forward(panel: DataFrame, features: Sequence[str], label: str, n_splits: int = 4, test_months: int = 6, purge: int = 5, seeds: Sequence[int] = tuple(range(42, 52)), settings: Settings = Settings(trees=100), least: int = 5) -> Ranked:
    """Expanding training dates, the last ``n_splits`` blocks of months as tests, ``purge`` dates dropped before each. ``panel``: (ts, asset, features, label).
    Rows that lack a feature or the label do not count; no fold at all raises. The rows that count and their dates are written once, as they are read several times."""
    panel = stored(panel.dropna(subset=[*features, label]), "ranker-panel")
    dates = stored(panel.select("ts").distinct(), "ranker-dates")
    at = dates.withColumn("pos", F.row_number().over(Window.orderBy("ts")) - 1)  # a row a date
    roles = splits.walk_forward_months(dates, n_splits, test_months, None, purge).join(at, "pos").select("ts", "fold", "role")
    return _ranked(panel, features, label, roles, seeds, settings, least)


def holdout(panel: DataFrame, features: Sequence[str], label: str, share: float = 0.7, seed: int = 42, settings: Settings = Settings(), least: int = 5, min_train: int = 120) -> Ranked | None:
    """One model on the dates that hold the first ``share`` of the rows, tested on the later ones; None below ``min_train`` rows."""
    panel = stored(panel.dropna(subset=[*features, label]), "ranker-panel")
    per = panel.groupBy("ts").count()
    w = Window.orderBy("ts")  # a row a date
    counted = per.withColumns({"upto": F.sum("count").over(w), "all": F.sum("count").over(Window.partitionBy(F.lit(0)))})
    total = counted.agg(F.max("all")).first()[0] or 0
    if total < min_train:
        return None
    roles = counted.select("ts", F.lit(0).alias("fold"), F.when(F.col("upto") <= share * F.col("all"), "train").otherwise("test").alias("role"))
    return _ranked(panel, features, label, roles, (seed,), settings, least)


def _ranked(panel: DataFrame, features: Sequence[str], label: str, roles: DataFrame, seeds: Sequence[int], settings: Settings, least: int) -> Ranked:
    rows, cuts, folds = prepared(panel, features, label, roles, settings)
    if rows.where("test <> 0").isEmpty():
        raise ValueError("no fold has rows to test on")
    grid = fit(rows, features, cuts, folds, seeds, settings)
    each = stored(predict(rows, grid), "ranker-predictions")
    ensemble = each.groupBy("ts", "asset", "fold").agg(F.avg("prediction").alias("prediction"), F.first("y").alias("y"))
    span = ensemble.groupBy("fold").agg(F.min("ts").alias("test_start"), F.max("ts").alias("test_end"), F.count(F.lit(1)).alias("n_test"))
    by_fold = span.join(_ics(ensemble, ("fold",), least), "fold", "left")
    by_seed = _ics(each, ("fold", "seed"), least)
    spread = by_seed.groupBy("seed").agg(F.stddev_samp("rank_ic").alias("s")).agg(F.avg("s").alias("single_seed_rank_ic_std_mean"))
    summary = by_fold.agg(F.count(F.lit(1)).alias("n_folds"), F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.avg("rank_ic").alias("rank_ic_mean"), F.stddev_samp("rank_ic").alias("rank_ic_std"))
    summary = summary.withColumn("rank_ic_ir", F.try_divide("rank_ic_mean", F.when(F.col("rank_ic_std") > 0, F.col("rank_ic_std")))).crossJoin(spread)
    return Ranked(ensemble, by_fold, by_seed, summary, importance(grid, panel.sparkSession), grid)
