"""Queries over covariances, digests of tables and the published walk."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickwell.operators import optimize as O
from tickwell.plans.common import r
from tickwell.sources import bars as S
from tickwell.sources import digests as G
from tickwell.sources.bars import SHIP_PANEL, ship_panel, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _returns(spark, d):  # noqa: ANN001, ANN202
    rows = ship_panel(spark, d).withColumn("ret", F.try_divide("price", F.lag("price").over(Window.partitionBy("asset").orderBy("ts"))) - 1)
    return rows.select("industry", F.col("ts").alias("t"), "asset", "ret").where("ret IS NOT NULL")


def _shrunk(method: str):  # noqa: ANN202
    def run(spark, d):  # noqa: ANN001, ANN202
        out = O.shrunk(_returns(spark, d), ("industry",), method)
        return out.select("industry", "i", "j", *[(F.round(c, 8) + 0.0).alias(c) for c in ("cov", "alpha", "mean_corr")])

    return run


def _shrunk_sql(method: str) -> str:
    mean = "greatest(-1.0, least(1.0, mc))" if method == "constant_correlation" else "0.0"
    return f"""
WITH {SHIP_PANEL}, x0 AS (SELECT industry AS g, ts AS t, asset, price / lag(price) OVER (PARTITION BY asset ORDER BY ts) - 1 AS ret FROM panel), x1 AS (SELECT * FROM x0 WHERE ret IS NOT NULL),
n AS (SELECT g, count(DISTINCT asset) AS n FROM x1 GROUP BY g), f AS (SELECT g, t FROM x1 JOIN n USING (g) GROUP BY g, t, n HAVING count(*) = n),
x AS (SELECT g, t, asset, ret - avg(ret) OVER (PARTITION BY g, asset) AS x FROM x1 JOIN f USING (g, t)),
m AS (SELECT a.g, a.asset AS i, b.asset AS j, avg(a.x * b.x) AS s, avg(a.x * a.x * b.x * b.x) AS p2, avg(a.x * a.x * a.x * b.x) AS a3, avg(a.x * b.x * b.x * b.x) AS b3 FROM x a JOIN x b ON a.g = b.g AND a.t = b.t GROUP BY ALL),
v AS (SELECT g, i, s AS v, sqrt(greatest(s, 1e-30)) AS d FROM m WHERE i = j),
w AS (SELECT m.*, p2 - s * s AS p, a3 - vi.v * s AS a, b3 - vj.v * s AS b, vi.d AS di, vj.d AS dj FROM m JOIN v vi ON vi.g = m.g AND vi.i = m.i JOIN v vj ON vj.g = m.g AND vj.i = m.j),
c AS (SELECT g, coalesce(avg(s / (di * dj)) FILTER (WHERE i <> j), 0) AS mc FROM w GROUP BY g), k AS (SELECT g, {mean} AS r FROM c),
t AS (SELECT w.*, r, CASE WHEN i = j THEN s ELSE r * di * dj END AS target, CASE WHEN i = j THEN p ELSE r / 2 * (dj / di * a + di / dj * b) END AS rho FROM w JOIN k USING (g)),
q AS (SELECT g, CASE WHEN sum((target - s) * (target - s)) <= 1e-300 THEN 1.0 ELSE greatest(0.0, least(1.0, (sum(p) - sum(rho)) / sum((target - s) * (target - s)))) END AS alpha FROM t GROUP BY g)
SELECT g AS industry, i, j, round(alpha * target + (1 - alpha) * s, 8) + 0.0 AS cov, round(alpha, 8) + 0.0 AS alpha, round(r, 8) + 0.0 AS mean_corr FROM t JOIN q USING (g) WHERE i <= j"""


for _method, _name in (("constant_correlation", "shrunk_covariance"), ("diagonal", "shrunk_covariance_diagonal")):
    QUERIES[_name], SQL[_name] = _shrunk(_method), _shrunk_sql(_method)


def _items(spark, d):  # noqa: ANN001, ANN202
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return table(spark, d, "lineitem").select(k.cast("long").alias("position"), "l_returnflag", "l_orderkey", "l_quantity", F.when(F.col("l_orderkey") % 9 != 0, F.col("l_extendedprice")).alias("price"), F.to_date("l_shipdate").alias("day"), "l_linestatus")


QUERIES["table_digests"] = lambda spark, d: G.digest(_items(spark, d), "position", ("l_returnflag",))
SQL["table_digests"] = f"""
WITH x AS (SELECT l_returnflag, l_orderkey * 8 + l_linenumber AS at0, sha256('bigint=' || l_orderkey || ';' || 'double=' || CAST(l_quantity AS VARCHAR) || ';' || 'double=' || CASE WHEN l_orderkey % 9 <> 0 THEN CAST(l_extendedprice AS VARCHAR) ELSE 'null' END || ';'
  || 'date=' || CAST(CAST(l_shipdate AS DATE) AS VARCHAR) || ';' || 'string=' || length(l_linestatus) || ':' || l_linestatus || ';') AS digest FROM lineitem),
a AS (SELECT l_returnflag, at0 // {G.RANGE} AS at1, sha256(string_agg(digest, '' ORDER BY at0, digest)) AS digest FROM x GROUP BY ALL),
b AS (SELECT l_returnflag, at1 // {G.RANGE} AS at2, sha256(string_agg(digest, '' ORDER BY at1)) AS digest FROM a GROUP BY ALL),
c AS (SELECT l_returnflag, at2 // {G.RANGE} AS at3, sha256(string_agg(digest, '' ORDER BY at2)) AS digest FROM b GROUP BY ALL)
SELECT l_returnflag, sha256('table' || chr(0) || '10:l_orderkey=bigint;10:l_quantity=double;5:price=double;3:day=date;12:l_linestatus=string' || chr(0) || digest) AS digest FROM c"""

QUERIES["published_walks"] = lambda spark, d: S.walks(table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"), (F.col("s_suppkey") % 9 * 1000.0 + 50).alias("start"), F.col("s_nationkey").alias("seed"))).select(
    "symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), *[(F.round(c, 6) + 0.0).alias(c) for c in ("open", "high", "low", "close", "volume")]
)
SQL["published_walks"] = f"""
WITH RECURSIVE s AS (SELECT s_suppkey AS symbol, s_suppkey % 9 * 1000.0 + 50 AS start, s_nationkey AS seed FROM supplier),
n AS (SELECT symbol, start, i, ((CAST(seed AS BIGINT) * 1103515245 + i * 12345) % 1000) / 1000.0 - 0.5 AS noise FROM s, range(120) AS t(i)),
e AS (SELECT *, CAST(CASE WHEN i < 60 THEN 80 + 15 * sin(i / 3.0) ELSE -90 + 10 * sin(i / 4.0) END + noise * 40 AS DOUBLE) AS step FROM n),
b AS (SELECT symbol, i, noise, CAST(start AS DOUBLE) AS open, greatest(1.0, CAST(start AS DOUBLE) + step) AS close FROM e WHERE i = 0
  UNION ALL SELECT e.symbol, e.i, e.noise, b.close, greatest(1.0, b.close + e.step) FROM b JOIN e ON e.symbol = b.symbol AND e.i = b.i + 1)
SELECT symbol, strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(i AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS ts, {r('open', 'open')}, {r('greatest(open, close) + abs(noise) * 20', 'high')}, {r('least(open, close) - abs(noise) * 20', 'low')}, {r('close', 'close')}, {r('100.0 + i % 17 * 3.0', 'volume')} FROM b"""
