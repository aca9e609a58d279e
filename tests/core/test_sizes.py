"""Tables that grow stay out of the driver: joins with them merge, whatever Spark takes their size for."""

from pyspark.sql import functions as F

from tickwell.operators import intervals as V
from tickwell.operators import research as R


def plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_active_flags_are_counted_by_cell_and_not_broadcast(spark, capsys):
    studies = spark.range(60).selectExpr("id AS study", "id % 2 AS driver", "id % 3 AS target", "cast(id % 20 AS int) AS evaluation", "'accepted' AS primary")
    flags = spark.range(50).selectExpr("id % 2 AS driver", "id % 3 AS target", "if(id % 7 = 0, NULL, concat('c', id % 4)) AS code", "cast(id % 15 AS int) AS effective", "if(id % 5 = 0, NULL, cast(id % 15 + id % 6 AS int)) AS resolved")
    told = spark.range(60).selectExpr("id AS study", "'f' AS family", "if(id % 4 = 0, 'falsifies', 'supports') AS status", "cast(id % 25 AS int) AS as_of")
    out = V.point_in_time(studies, flags, told)
    assert "Broadcast" not in plan(out, capsys)
    f = flags.collect()
    for r in out.join(studies.select("study", "driver", "target", "evaluation"), "study").collect():
        hit = [x for x in f if (x.driver, x.target) == (r.driver, r.target) and x.effective <= r.evaluation and (x.resolved is None or r.evaluation < x.resolved)]
        assert r.active == len(hit) and r.codes == sorted({x.code for x in hit if x.code}) and r.falsified == (r.study % 4 == 0 and r.study % 25 <= r.evaluation)
        assert r.statistical == ("invalidated" if hit else "descriptive_only" if r.falsified else "accepted")


def test_metrics_of_gates_are_not_broadcast(spark, capsys):
    metrics = spark.range(30).select(F.col("id").alias("run_id"), F.explode(F.expr("array('pc', 'pbo', 'pbo')")).alias("metric"), F.lit(0.01).alias("value"))
    out = R.gates(metrics)
    assert plan(out, capsys).count("BroadcastExchange") == 1  # the rules
    assert out.where("gate = 'gate1_contamination'").select("passed", "missing").distinct().collect() == [(False, ["isolation_days"])]


def test_edges_and_what_is_known_are_not_broadcast(spark, capsys, monkeypatch):
    seen = []
    edges = spark.range(1, 40).selectExpr("id AS src", "explode(array(2 * id, 2 * id + 1)) AS dst")
    whole = type(edges).checkpoint
    monkeypatch.setattr(type(edges), "checkpoint", lambda df, *a: (seen.append(plan(df, capsys)), whole(df, *a))[1])
    got = {r.node: r.depth for r in R.reachable(edges, spark.range(3, 4).selectExpr("id AS node")).collect()}
    assert seen and not any("Broadcast" in p for p in seen)
    assert got == {n: n.bit_length() - 2 for n in range(3, 80) if bin(n)[2:4] == "11"}
