"""Rankers of factor panels on spark.ml: purged three-way fits, candidates compared by information coefficient, a gate before a model is replaced."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwell.operators import cross_section as X
from tickwell.operators import splits


@dataclass
class Trained:
    name: str
    model: PipelineModel
    ic: float
    icir: float


def candidates(features: Sequence[str], label: str, seed: int = 7) -> dict[str, Pipeline]:
    """Boosted trees and a ridge line over imputed features."""
    clean = [f"__{f}" for f in features]
    before = [Imputer(inputCols=list(features), outputCols=clean, strategy="median"), VectorAssembler(inputCols=clean, outputCol="__raw"), StandardScaler(inputCol="__raw", outputCol="__x", withMean=True)]
    return {
        "gbt": Pipeline(stages=[*before, GBTRegressor(featuresCol="__x", labelCol=label, maxIter=20, maxDepth=4, seed=seed, subsamplingRate=0.8)]),
        "ridge": Pipeline(stages=[*before, LinearRegression(featuresCol="__x", labelCol=label, regParam=0.1, elasticNetParam=0.0)]),
    }


def _ic(rows: DataFrame, label: str, least: int) -> tuple[float, float]:
    got = X.ic_summary(X.daily_ic(rows, "prediction", label, least=least)).first()
    return float(got["mean_ic"] or 0.0), float(got["icir"] or 0.0)


def train(panel: DataFrame, features: Sequence[str], label: str, gap: int = 5, horizon: int = 5, least: int = 5) -> Trained:
    """The candidate of the best mean daily IC on the validation block; the blocks are apart by ``gap`` dates. Features of which half is missing for a row are imputed; rows without a label do not count."""
    rows = splits.three_way(panel.where(F.col(label).isNotNull()), gap=gap, horizon=horizon)
    fit, check = rows.where("role = 'train'"), rows.where("role = 'valid'")
    made = []
    for name, pipeline in candidates(features, label).items():
        model = pipeline.fit(fit)
        made.append(Trained(name, model, *_ic(model.transform(check), label, least)))
    return max(made, key=lambda m: m.ic)


def predict(model: PipelineModel, panel: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep, prediction); at least half of the features must be columns of the panel, the others are taken as missing."""
    have = [f for f in features if f in panel.columns]
    if 2 * len(have) < len(features):
        raise ValueError(f"only {len(have)} of {len(features)} features are there")
    panel = panel.withColumns({f: F.lit(None).cast("double") for f in features if f not in have})
    return model.transform(panel).select(*keep, "prediction")


def passes(new: Trained, old: Trained | None, share: float = 0.8) -> bool:
    """A model may go in if its IC and ratio are positive and its IC is at least ``share`` of the one it replaces."""
    return new.ic > 0 and new.icir > 0 and (old is None or new.ic >= share * old.ic)


def should_retrain(last: float | None, now: float, every_days: float = 7.0) -> bool:
    return last is None or now - last >= every_days * 86400
