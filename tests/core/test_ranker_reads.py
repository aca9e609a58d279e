"""A ranker makes its panel once."""

from pyspark.sql import functions as F

from tickwell.operators import ranker


def test_the_panel_is_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.range(12 * 30).selectExpr("add_months(date'2020-01-01', cast(id % 12 AS int)) AS ts", "id AS asset").withColumns({"f": F.rand(1), "label": F.rand(2)})
    panel = rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")).mapInArrow(count, "ts timestamp_ntz, asset long, f double, label double")
    got = ranker.walk_forward(panel, ["f"], "label", n_splits=2, test_months=3, purge=1, seeds=(1,), settings=ranker.Settings(trees=1, depth=1, bins=4))
    assert got.folds.count() == 2 and made.value == 360
