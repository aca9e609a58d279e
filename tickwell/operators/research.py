"""Fundamental valuation, statement analysis, decision gates, evidence graphs, canonical digests."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwell.sources.shared import checkpoints


def dcf(forecasts: DataFrame, wacc: Column | float, growth: Column | float, net_debt: float = 0.0, shares: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Present value of forecasts (period, fcf, t) and of a growing perpetuity after the last one; null where the growth reaches the rate."""
    r, g = (x if isinstance(x, Column) else F.lit(float(x)) for x in (wacc, growth))
    rows = forecasts.withColumns({"__pv": F.col("fcf") / F.pow(1 + r, F.col("t")), "__r": r, "__g": g})
    grouped = rows.groupBy(*by) if by else rows.groupBy(F.lit(0).alias("__all"))
    last, t, r1, g1 = F.max_by("fcf", "t"), F.max("t"), F.first("__r"), F.first("__g")
    terminal = F.when(g1 < r1, F.try_divide(last * (1 + g1), r1 - g1) / F.pow(1 + r1, t))
    out = grouped.agg(F.sum("__pv").alias("pv_forecast"), terminal.alias("pv_terminal"))
    out = out.withColumn("enterprise_value", F.col("pv_forecast") + F.col("pv_terminal")).withColumn("equity_value", F.col("enterprise_value") - net_debt)
    out = out.withColumn("per_share", F.col("equity_value") / shares if shares else F.lit(None).cast("double")).withColumn("terminal_share", F.try_divide(F.col("pv_terminal"), F.col("enterprise_value")))
    return out if by else out.drop("__all")


def dcf_grid(forecasts: DataFrame, rates: DataFrame, growths: DataFrame, **kw: float) -> DataFrame:
    """A valuation for every pair of ``rates`` (wacc) and ``growths`` (g); pairs without a value keep their row, status ``invalid``."""
    cells = rates.crossJoin(F.broadcast(growths))
    out = dcf(forecasts.crossJoin(F.broadcast(cells)), F.col("wacc"), F.col("g"), by=("wacc", "g"), **kw)
    return out.withColumn("status", F.when(F.col("enterprise_value").isNull(), "invalid").otherwise("ok"))


def comps(peers: DataFrame, metric: float, net_debt: float = 0.0, shares: float | None = None) -> DataFrame:
    """Quartiles of included peers' multiples (numerator / denominator > 0), and the value they give; below three peers no values."""
    m = peers.where("included AND denominator > 0 AND numerator IS NOT NULL").select((F.col("numerator") / F.col("denominator")).alias("multiple"))
    out = m.agg(F.count(F.lit(1)).alias("n_peers"), *[F.percentile("multiple", F.lit(q)).alias(n) for n, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))])
    names = ("p25", "median", "p75")
    out = out.withColumns({n: F.when(F.col("n_peers") >= 3, F.col(n)) for n in names})
    out = out.withColumns({f"ev_{n}": F.col(n) * metric for n in names} | {f"equity_{n}": F.col(n) * metric - net_debt for n in names})
    return out.withColumns({f"per_share_{n}": F.col(f"equity_{n}") / shares for n in names}) if shares else out


def statements(rows: DataFrame, by: tuple[str, ...] = ("entity",)) -> DataFrame:
    """Margins, free cash flow, balance residuals and growth against the period before."""
    c, w = F.col, Window.partitionBy(*by).orderBy("period_end")
    of = F.try_divide
    near = lambda a, b: F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
    out = rows.withColumns({
        "gross_profit": c("revenue") - c("cost_of_revenue"), "gross_margin": of(c("revenue") - c("cost_of_revenue"), c("revenue")), "operating_margin": of(c("operating_income"), c("revenue")), "net_margin": of(c("net_income"), c("revenue")),
        "free_cash_flow": c("cash_from_operations") - c("capital_expenditure"), "net_debt": c("debt") - c("cash"), "balance_residual": near(c("total_assets"), c("total_liabilities") + c("total_equity")),
        "operating_residual": near(c("operating_income"), c("revenue") - c("cost_of_revenue") - c("operating_expenses")), "revenue_growth": of(c("revenue"), F.lag("revenue").over(w)) - 1,
    })
    return out.withColumns({"fcf_margin": of(c("free_cash_flow"), c("revenue")), "margin_change": c("operating_margin") - F.lag("operating_margin").over(w)})


#: Gate, metric, comparison, threshold. A window is two rules.
GATES = (
    ("gate0_main_path", "turnover_annual", "<=", 30.0), ("gate0_main_path", "aum_scale", "<=", 5e6), ("gate0_main_path", "friction_cost", ">=", 0.002), ("gate0_main_path", "friction_cost", "<=", 0.005),
    ("gate1_contamination", "pc", "<=", 0.50), ("gate1_contamination", "isolation_days", ">=", 365.0),
    ("gate2_statistics", "dsr", ">=", 0.95), ("gate2_statistics", "pbo", "<=", 0.05), ("gate2_statistics", "zero_shot_r2", ">=", 0.02), ("gate2_statistics", "ebh_fdr", "<=", 0.05),
    ("gate3_capacity", "n_seeds", ">=", 20.0), ("gate3_capacity", "worst_path_alpha", ">=", 0.0), ("gate3_capacity", "pov", "<=", 0.10),
    ("gate4_crowding", "z_comp", "<=", 2.0), ("gate4_crowding", "basis_pct", ">=", 0.10), ("gate4_crowding", "calib_window", ">=", 60.0), ("gate4_crowding", "calib_window", "<=", 120.0),
    ("gate5_paper", "paper_months", ">=", 6.0), ("gate5_paper", "paper_trades", ">=", 60.0), ("gate5_paper", "deviation", "<=", 0.15), ("gate5_paper", "win_rate", ">=", 0.54),
    ("gate6_live", "live_months", ">=", 3.0), ("gate6_live", "sharpe_decay", "<=", 0.20), ("gate6_live", "daily_orders", "<=", 18000.0),
)


def gates(metrics: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """(by, gate, passed, failures, missing) over long metrics (by, metric, value): a missing or null metric fails its gate."""
    spark = metrics.sparkSession
    rules = spark.createDataFrame(list(GATES), "gate string, metric string, op string, threshold double")
    need = metrics.select(*by).distinct().crossJoin(F.broadcast(rules))
    rows = need.join(metrics.hint("merge"), [*by, "metric"], "left")  # never sent whole: the size of exploded metrics is not known beforehand
    ok = F.when(F.col("op") == ">=", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    told = F.concat_ws(" ", "metric", "op", F.col("threshold").cast("string"))
    return rows.groupBy(*by, "gate").agg(
        F.every(F.coalesce(ok, F.lit(False))).alias("passed"), F.array_sort(F.collect_list(F.when(F.col("value").isNotNull() & ~ok, told))).alias("failures"), F.array_sort(F.collect_set(F.when(F.col("value").isNull(), F.col("metric")))).alias("missing"),
    )


def verdict(of_gates: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    return of_gates.groupBy(*by).agg(F.when(F.every("passed"), "GO").otherwise("NO_GO").alias("verdict"), F.sum(F.col("passed").cast("int")).alias("n_passed"), F.count(F.lit(1)).alias("n_gates"))


def reachable(edges: DataFrame, roots: DataFrame, most: int = 64) -> DataFrame:
    """(root, node, depth): nodes reachable from each root over edges (src, dst), at their least depth. Each round joins only what the last one found, by shuffles: neither the edges nor what is known go through the driver. Paths longer than ``most`` raise."""
    checkpoints(edges.sparkSession)
    frontier = roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth")).distinct()
    seen = frontier
    for depth in range(1, most + 1):
        step = frontier.join(edges.select(F.col("src").alias("node"), "dst").hint("merge"), "node").select("root", F.col("dst").alias("node"), F.lit(depth).alias("depth")).distinct()
        frontier = step.join(seen.select("root", "node").hint("merge"), ["root", "node"], "left_anti").checkpoint()
        if not frontier.limit(1).count():
            return seen
        seen = seen.unionByName(frontier)
    raise ValueError(f"a path is longer than {most} edges")


def graph_problems(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(problem, node): repeated ids, edges to unknown nodes or with another hash than the node's, nodes on a cycle, nodes that no root reaches. ``nodes``: (id, hash); ``edges``: (src, dst, hash)."""
    repeated = nodes.groupBy("id").count().where("count > 1").select(F.lit("duplicate_id").alias("problem"), F.col("id").alias("node"))
    held = edges.join(nodes.select(F.col("id").alias("dst"), F.col("hash").alias("own")), "dst", "left")
    dangling = held.where("own IS NULL").select(F.lit("dangling_reference").alias("problem"), F.col("src").alias("node"))
    differs = held.where("own <> hash").select(F.lit("hash_mismatch").alias("problem"), F.col("src").alias("node"))
    every = reachable(edges, edges.select(F.col("src").alias("node")).distinct())
    back = every.join(edges, (F.col("node") == F.col("src")) & (F.col("dst") == F.col("root"))).select(F.lit("cycle").alias("problem"), F.col("root").alias("node"))
    orphans = nodes.join(reachable(edges, roots).select(F.col("node").alias("id")).distinct(), "id", "left_anti").select(F.lit("unreachable").alias("problem"), F.col("id").alias("node"))
    return repeated.unionByName(dangling).unionByName(differs).unionByName(back).unionByName(orphans).distinct()


def canonical(value: object) -> bytes:
    """JSON with sorted keys, no blanks, UTF-8, without NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode("utf-8")


def digest(value: object, domain: str = "") -> str:
    """SHA-256 of the canonical form, after the domain's name and a zero byte."""
    return hashlib.sha256((domain.encode() + b"\0" if domain else b"") + canonical(value)).hexdigest()
