"""Connected components of a link table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwell.llm.work import stored


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``vertex`` and ``root`` (the smallest vertex of its component) for every vertex of ``edges``.

    Each round a vertex takes the smallest label among its own and its neighbours' and then that
    label's own label (so paths shorten by doubling); it ends with a round that changes nothing.
    Labels are written to the shared folder each round. Loops and repeated links do no harm; rows
    with a null end are left out; no edges give no rows.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = stored(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u", "v").agg(F.lit(1).alias("one")).drop("one"), "links")
    labels = stored(e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("label")), "labels")
    while True:
        near = e.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("m"))
        best = labels.join(near, "u").select("u", F.col("label").alias("old"), F.least("label", "m").alias("best"))
        jump = labels.select(F.col("u").alias("best"), F.col("label").alias("further"))
        step = stored(best.join(jump, "best").select("u", F.col("further").alias("label"), (F.col("further") != F.col("old")).alias("moved")), "labels")
        labels = step.select("u", "label")
        if not step.where("moved").limit(1).count():
            return labels.select(F.col("u").alias("vertex"), F.col("label").alias("root"))
