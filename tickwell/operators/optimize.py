"""Shrunk covariances and benchmark-relative weights: small dense problems, one group each, many side by side."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwell.sources.shared import stored


def shrink(returns: np.ndarray, method: str = "constant_correlation") -> tuple[np.ndarray, float]:
    """Covariance (1/T) drawn towards equal correlations, or towards its diagonal, as far as its estimation error asks for; and that intensity. Flat series keep a zero row."""
    x = np.asarray(returns, float)
    if x.ndim != 2 or len(x) < 2 or not np.isfinite(x).all():
        raise ValueError("a T x N matrix of finite returns is needed")
    x = x - x.mean(axis=0)
    t, n = x.shape
    s = x.T @ x / t
    var = np.diag(s)
    dev = np.sqrt(np.maximum(var, 1e-30))
    error = (x**2).T @ x**2 / t - s**2
    eye = np.eye(n, dtype=bool)
    if method == "diagonal":
        target, shared = np.where(eye, s, 0.0), np.trace(error)
    elif method == "constant_correlation":
        mean = 0.0 if n == 1 else float(np.clip((s / np.outer(dev, dev))[~eye].mean(), -1, 1))
        target = np.where(eye, s, mean * np.outer(dev, dev))
        cross = (x**3).T @ x / t - var[:, None] * s
        tilt = cross * dev[None, :] / dev[:, None]
        shared = np.trace(error) + mean / 2 * (tilt + tilt.T)[~eye].sum()
    else:
        raise ValueError(f"unknown method {method!r}")
    gap = ((target - s) ** 2).sum()
    alpha = float(np.clip((error.sum() - shared) / gap, 0, 1)) if gap > 0 else 1.0
    out = alpha * target + (1 - alpha) * s
    out = (out + out.T) / 2
    low = np.linalg.eigvalsh(out).min()
    return (out + (1e-15 - low) * np.eye(n) if low < 1e-15 else out), alpha


#: Assets of a block, about: a task holds the series of two blocks and matrices of their pairs.
BLOCK = 512
_MOMENTS = ("s", "p", "a", "b", "vi", "vj")


def _series(returns: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, asset, x, block, blocks): an asset's returns in the order of time, at the times at which no asset of the group is missing. Assets are dealt to blocks by hash."""
    known = stored(returns.where("ret IS NOT NULL").select(*keys, "t", "asset", F.col("ret").cast("double").alias("ret")), "returns")
    n = known.select(*keys, "asset").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    full = known.groupBy(*keys, "t").agg(F.count(F.lit(1)).alias("__k"))
    full = (full.join(n, keys) if keys else full.crossJoin(n)).where("__k = __n").select(*keys, "t")
    per = known.join(full, [*keys, "t"], "left_semi").where("asset IS NOT NULL").groupBy(*keys, "asset").agg(F.array_sort(F.collect_list(F.struct("t", "ret"))).alias("x"))
    per = per.join(n, keys) if keys else per.crossJoin(n)
    blocks = F.ceil(F.col("__n") / BLOCK).cast("int")
    return stored(per.select(*keys, "asset", F.col("x.ret").alias("x"), F.pmod(F.xxhash64("asset"), blocks).cast("int").alias("block"), blocks.alias("blocks")), "series")


def _by_blocks(series: DataFrame, keys: list[str], columns: str, make: Callable[[pd.Series, dict], pd.DataFrame]) -> DataFrame:
    """(keys, columns): ``make`` of a row of the group and of the moments of all pairs i <= j of two blocks, for every two blocks of a group. A series is sent once a block; pairs are not."""
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least("block", b).alias("left"), F.greatest("block", b).alias("right")))
    rows = series.withColumn("__p", F.explode(pairs)).select(*series.columns, "__p.*")

    def run(one: pd.DataFrame) -> pd.DataFrame:
        first, one = one.iloc[0], one.sort_values("asset")
        one_block = first["left"] == first["right"]
        sides = [one[one["block"] == first[side]] for side in ("left", "right")]
        if any(side.empty for side in sides):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        (i, u), (j, v) = ((side["asset"].to_numpy(), np.stack(side["x"].to_numpy()).astype(float)) for side in sides)
        u, v = u - u.mean(axis=1, keepdims=True), v - v.mean(axis=1, keepdims=True)
        t = u.shape[1]
        at, to = np.triu_indices(len(i)) if one_block else np.indices((len(i), len(j))).reshape(2, -1)
        s, p2, a3, b3 = ((x @ y.T / t)[at, to] for x, y in ((u, v), (u**2, v**2), (u**3, v), (u, v**3)))
        vi, vj, i, j = (u**2).mean(axis=1)[at], (v**2).mean(axis=1)[to], i[at], j[to]
        m = {"i": i, "j": j, "s": s, "p": p2 - s * s, "a": a3 - vi * s, "b": b3 - vj * s, "vi": vi, "vj": vj}
        back = i > j
        for x, y in (("i", "j"), ("a", "b"), ("vi", "vj")):
            m[x], m[y] = np.where(back, m[y], m[x]), np.where(back, m[x], m[y])
        out = make(first, m)
        for k in reversed(keys):
            out.insert(0, k, first[k])
        return out

    kinds = {f.name: f.dataType.simpleString() for f in series.schema.fields}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), columns.format(kinds["asset"])])
    return rows.groupBy(*keys, "left", "right").applyInPandas(run, schema)


def moments(returns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, i, j, s, p, a, b, vi, vj), i <= j: means over time of x_i x_j, of its squared error, of the third-order terms x_i^3 x_j and x_i x_j^3 less their products, and the two variances.

    ``returns``: (by, t, asset, ret), once each. Times at which an asset of the group is missing do not count. No panel is gathered: a task multiplies two
    blocks of series.
    """
    keys = list(by)
    return _by_blocks(_series(returns, keys), keys, f"i {{0}}, j {{0}}, {', '.join(f'{m} double' for m in _MOMENTS)}", lambda _, m: pd.DataFrame(m))


def _scales(m: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.sqrt(np.maximum(m["vi"], 1e-30)), np.sqrt(np.maximum(m["vj"], 1e-30))


def _sums(_: pd.Series, m: dict) -> pd.DataFrame:
    """What a shrinkage needs of the pairs of two blocks: one row."""
    off, (di, dj), s = m["i"] != m["j"], _scales(m), m["s"]
    whole = lambda x: float(x[off].sum())
    return pd.DataFrame({
        "n": [int(off.sum())], "corr": whole(s / (di * dj)), "error": float((np.where(off, 2.0, 1.0) * m["p"]).sum()), "own": float(m["p"][~off].sum()), "tilt": whole(dj / di * m["a"] + di / dj * m["b"]),
        "ss": whole(s * s), "sd": whole(s * di * dj), "dd": whole(m["vi"] * m["vj"]),
    })


def _drawn(first: pd.Series, m: dict) -> pd.DataFrame:
    """Covariances of the pairs of two blocks, drawn towards the target of their group."""
    (di, dj), alpha, r = _scales(m), first["alpha"], first["mean_corr"]
    target = np.where(m["i"] != m["j"], r * di * dj, m["s"])
    return pd.DataFrame({"i": m["i"], "j": m["j"], "cov": alpha * target + (1 - alpha) * m["s"], "alpha": alpha, "mean_corr": r})


def shrunk(returns: DataFrame, by: Sequence[str] = (), method: str = "constant_correlation") -> DataFrame:
    """(by, i, j, cov, alpha, mean_corr), i <= j: ``shrink`` of each group from its moments, for any number of assets.

    Moments are made twice, block by block, for the sums that give the intensity and for the covariances: that costs less than to keep them.
    The matrix is not shifted where its least eigenvalue is zero, which it is only if the intensity is zero or a series is flat.
    """
    if method not in ("constant_correlation", "diagonal"):
        raise ValueError(f"unknown method {method!r}")
    keys, c = list(by), F.col
    names = ("corr", "error", "own", "tilt", "ss", "sd", "dd")
    series = _series(returns, keys)
    terms = _by_blocks(series, keys, f"n long, {', '.join(f'{x} double' for x in names)}", _sums).groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names])
    mean = F.when(c("n") > 0, c("corr") / F.nullif(c("n"), F.lit(0).cast("long"))).otherwise(0.0)
    r = F.lit(0.0) if method == "diagonal" else F.greatest(F.lit(-1.0), F.least(F.lit(1.0), mean))
    gap = 2 * (c("ss") - 2 * r * c("sd") + r * r * c("dd"))
    alpha = F.when(gap <= 1e-300, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c("error") - c("own") - r * c("tilt")) / gap)))
    terms = terms.select(*keys, r.alias("mean_corr"), alpha.alias("alpha"))
    return _by_blocks(series.join(terms, keys) if keys else series.crossJoin(terms), keys, "i {0}, j {0}, cov double, alpha double, mean_corr double", _drawn)


def covariances(returns: DataFrame, by: Sequence[str] = (), method: str = "constant_correlation") -> DataFrame:
    """(by, i, j, cov, alpha) of long returns (by, t, asset, ret): each group's assets as a matrix over the times at which all are known. A group is one task: its assets are a universe of some hundreds."""
    rows = returns if by else returns.withColumn("__all", F.lit(0))
    keys = list(by) or ["__all"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"i {kinds['asset']}, j {kinds['asset']}, cov double, alpha double"])

    def run(key: tuple, one: pd.DataFrame) -> pd.DataFrame:
        wide = one.pivot_table(index="t", columns="asset", values="ret").sort_index().dropna()
        cov, alpha = shrink(wide.to_numpy(), method)
        n, names = len(cov), wide.columns.to_numpy()
        out = pd.DataFrame({"i": np.repeat(names, n), "j": np.tile(names, n), "cov": cov.ravel(), "alpha": alpha})
        for k, v in zip(keys, key, strict=True):
            out.insert(0, k, v)
        return out[[c.split()[0] for c in schema.split(", ")]]

    out = rows.groupBy(*keys).applyInPandas(run, schema)
    return out if by else out.drop("__all")


def enhanced_weights(scores: np.ndarray, benchmark: np.ndarray, cov: np.ndarray, industry: np.ndarray | None = None, size: np.ndarray | None = None, te: float = 0.05, industry_cap: float = 0.05, size_cap: float = 0.05, turnover: float | None = None, previous: np.ndarray | None = None, cost: float = 0.0, rounds: int = 150) -> np.ndarray:
    """Weights of the highest score within limits on tracking error, industry and size deviations and turnover, long only, fully invested.

    Steps along the score (less the cost of trading) are followed by alternating projections on the limits; at
    the end what is still over a limit is drawn towards the benchmark (or, for turnover, the previous weights), which keeps every other limit.
    """
    s, b = np.asarray(scores, float), np.asarray(benchmark, float)
    n = len(s)
    if not (np.isfinite(s).all() and np.isfinite(b).all() and np.isfinite(cov).all() and abs(b.sum() - 1) < 1e-6):
        raise ValueError("scores, benchmark and covariance must be finite and the benchmark whole")
    rows = [np.asarray(industry) == g for g in np.unique(industry)] if industry is not None else []
    slabs = [(r.astype(float), industry_cap) for r in rows]
    if size is not None:
        z = (size - size.mean()) / (size.std() or 1.0)
        slabs.append((z, size_cap))
    root = np.linalg.cholesky(cov + 1e-12 * np.eye(n)).T
    start = b if previous is None else np.asarray(previous, float)

    def inside(w: np.ndarray) -> np.ndarray:
        for _ in range(60):
            old = w
            for a, cap in slabs:
                d = a @ (w - b)
                if abs(d) > cap:
                    w = w - a * (d - np.sign(d) * cap) / (a @ a)
            far = np.linalg.norm(root @ (w - b))
            if far > te:
                w = b + (w - b) * te / far
            if turnover is not None and (moved := np.abs(w - start).sum() / 2) > turnover:
                w = start + (w - start) * turnover / moved
            w = np.maximum(w, 0)
            w = w + (1 - w.sum()) / n
            if np.abs(w - old).max() < 1e-10:
                break
        return np.maximum(w, 0) / np.maximum(w, 0).sum()

    w = inside(start.copy())
    scale = 1 / (np.abs(s - s.mean()).max() or 1.0)
    best, value = w, s @ w - cost * np.abs(w - start).sum() / 2
    for k in range(rounds):
        w = inside(w + 0.2 / np.sqrt(k + 1) * scale * (s - cost / 2 * np.sign(w - start)) / n)
        if (now := s @ w - cost * np.abs(w - start).sum() / 2) > value + 1e-12 and _over(w, b, root, slabs, te) < 1e-6:
            best, value = w, now
    over = _over(best, b, root, slabs, te)
    return best if over < 1e-9 else b + (best - b) / (1 + over)


def _over(w: np.ndarray, b: np.ndarray, root: np.ndarray, slabs: list, te: float) -> float:
    """By what share the worst limit is exceeded."""
    used = [np.linalg.norm(root @ (w - b)) / te, *(abs(a @ (w - b)) / cap for a, cap in slabs)]
    return max(0.0, max(used) - 1)


def rolling_weights(panel: DataFrame, returns: DataFrame, by: str = "t", **limits: float) -> DataFrame:
    """(t, asset, weight): ``enhanced_weights`` for every date of ``panel`` (t, asset, score, benchmark, industry, size), each with the shrunk covariance of its own return rows (t, asset, obs, ret). One date is one task."""
    kinds = {f.name: f.dataType.simpleString() for f in panel.schema.fields}

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({by: [], "asset": [], "weight": []})
        left = left.sort_values("asset")
        wide = right.pivot_table(index="obs", columns="asset", values="ret").reindex(columns=left["asset"]).dropna()
        cov, _ = shrink(wide.to_numpy())
        w = enhanced_weights(left["score"].to_numpy(), left["benchmark"].to_numpy(), cov, left["industry"].to_numpy(), left["size"].to_numpy(), **limits)
        return pd.DataFrame({by: left[by], "asset": left["asset"], "weight": w})

    return panel.groupBy(by).cogroup(returns.groupBy(by)).applyInPandas(run, f"{by} {kinds[by]}, asset {kinds['asset']}, weight double")


def cost_sweep(periods: DataFrame, costs: Sequence[float], cov: np.ndarray, benchmark: np.ndarray, **limits: float) -> DataFrame:
    """(cost, t, ret, turnover) over (t, asset, score, ret): each cost is a run of its own, in which weights follow on from the last ones. Runs are side by side."""
    spark = periods.sparkSession
    grid = spark.createDataFrame([(float(c),) for c in costs], "cost double")
    kinds = {f.name: f.dataType.simpleString() for f in periods.schema.fields}

    def run(key: tuple, one: pd.DataFrame) -> pd.DataFrame:
        last, out = benchmark, []
        for t, day in one.sort_values(["t", "asset"]).groupby("t", sort=True):
            w = enhanced_weights(day["score"].to_numpy(), benchmark, cov, previous=last, cost=key[0], **limits)
            moved = float(np.abs(w - last).sum() / 2)
            out.append((key[0], t, float(w @ day["ret"].to_numpy()) - key[0] * moved, moved))
            last = w
        return pd.DataFrame(out, columns=["cost", "t", "ret", "turnover"])

    return periods.crossJoin(grid).groupBy("cost").applyInPandas(run, f"cost double, t {kinds['t']}, ret double, turnover double")
