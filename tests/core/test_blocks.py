"""Shrunk covariances by blocks of assets: any number of blocks gives the matrix of one."""

import numpy as np
from pyspark.sql import functions as F

from tickwell.operators import optimize as O


def test_blocks_of_assets_give_the_whole_matrix_and_no_rows_of_pairs_are_shuffled(spark, monkeypatch, capsys):
    monkeypatch.setattr(O, "BLOCK", 4)
    rows = spark.range(2 * 11 * 30).selectExpr("id % 2 AS g", "cast(id / 2 AS long) % 11 AS asset", "cast(id / 22 AS long) AS t").withColumn("ret", F.sin(F.col("asset") * 7.0 + F.col("t") * (F.col("asset") + 1.3) + F.col("g")))
    wide = {g: one.pivot(index="t", columns="asset", values="ret").sort_index().to_numpy() for g, one in rows.toPandas().groupby("g")}
    for method in ("constant_correlation", "diagonal"):
        out = O.shrunk(rows, ("g",), method)
        out.explain()
        assert "Join [i" not in (told := capsys.readouterr().out) and "j#" not in "".join(x for x in told.splitlines() if "Exchange" in x)
        got = out.collect()
        assert len(got) == 2 * 66
        for g in (0, 1):
            cov, alpha = O.shrink(wide[g], method)
            mine = {(r.i, r.j): r for r in got if r.g == g}
            assert all(np.isclose(mine[i, j].cov, cov[i, j], rtol=1e-9, atol=1e-12) and np.isclose(mine[i, j].alpha, alpha) for i in range(11) for j in range(i, 11))
