"""Versions of a model: a table of events that only grows, whose last row points to the version in use; a gate before it moves; retraining from a stream."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwell.operators.models import Trained

EVENTS = "seq long, event string, version long, name string, path string, ic double, icir double, accepted boolean, reason string, incumbent long, batch long, at timestamp"
#: Share of the incumbent's ratio that a new model must reach; versions kept; hours between trainings; rows that a training needs.
KEEP_RATIO, KEPT, EVERY_HOURS, MIN_SAMPLES = 0.8, 20, 168.0, 200


def _known(x: float | None) -> bool:
    return x is not None and math.isfinite(x)


def gate(ic: float | None, icir: float | None, old: tuple[float | None, float | None] | None, keep_ratio: float = KEEP_RATIO) -> str:
    """Why a model may not go in, or an empty text. ``old``: IC and ratio of the incumbent. Where a ratio is not defined, the IC stands for it."""
    if not _known(ic) or ic <= 0:
        return "ic_not_positive"
    if _known(icir) and icir <= 0:
        return "icir_not_positive"
    if old is not None:
        own, other = (icir if _known(icir) else ic), (old[1] if _known(old[1]) else old[0])
        if _known(other) and own < other * keep_ratio:
            return "degraded"
    return ""


@dataclass
class Versions:
    """Events in ``folder``, written one file at a time by one driver; a stream that repeats a batch finds it there and writes nothing."""

    spark: SparkSession
    folder: str
    kept: int = KEPT

    def events(self) -> DataFrame:
        try:
            return self.spark.read.schema(EVENTS).parquet(f"{self.folder.rstrip('/')}/events")
        except AnalysisException:
            return self.spark.createDataFrame([], EVENTS)

    def last(self):  # noqa: ANN201
        """The newest event, or None."""
        return self.events().orderBy(F.desc("seq")).first()

    def incumbent(self):  # noqa: ANN201
        """The event that made the version in use, or None."""
        last = self.last()
        if last is None or last.incumbent is None:
            return None
        return self.events().where((F.col("version") == last.incumbent) & (F.col("event") == "trained")).first()

    def _append(self, **row) -> None:  # noqa: ANN003
        last = self.last()
        row = {"seq": 1 if last is None else last.seq + 1} | row
        names = [c.split()[0] for c in EVENTS.split(", ")]
        self.spark.createDataFrame([tuple(row.get(n) for n in names)], EVENTS).coalesce(1).write.mode("append").parquet(f"{self.folder.rstrip('/')}/events")

    def offer(self, new: Trained, at, batch: int | None = None, keep_ratio: float = KEEP_RATIO) -> str:  # noqa: ANN001
        """Write a trained model and its event; it comes into use if it passes the gate. The reason of a refusal, or an empty text."""
        last, old = self.last(), self.incumbent()
        version = 1 + (self.events().agg(F.max("version")).first()[0] or 0)
        path = f"{self.folder.rstrip('/')}/models/{version}"
        if new.model is not None:
            new.model.write().overwrite().save(path)
        reason = gate(new.ic, new.icir, None if old is None else (old.ic, old.icir), keep_ratio)
        before = None if last is None else last.incumbent
        self._append(event="trained", version=version, name=new.name, path=path, ic=new.ic, icir=new.icir, accepted=not reason, reason=reason or None, incumbent=before if reason else version, batch=batch, at=at)
        return reason

    def roll_back(self, at, version: int | None = None) -> int:  # noqa: ANN001
        """Use an earlier accepted version again, by default the newest one before the incumbent. Raises where there is none."""
        now = self.last()
        have = self.events().where("event = 'trained' AND accepted")
        have = have.where(F.col("version") == version) if version is not None else have.where(F.col("version") < (now.incumbent if now is not None and now.incumbent is not None else 0))
        to = have.agg(F.max("version")).first()[0]
        if to is None:
            raise ValueError("there is no version to go back to")
        self._append(event="rolled_back", version=to, incumbent=to, at=at)
        return to

    def table(self) -> DataFrame:
        """The newest ``kept`` versions and the incumbent, newest first, with ``in_use``."""
        last = self.last()
        use = F.col("version") == F.lit(None if last is None else last.incumbent)
        rows = self.events().where("event = 'trained'").withColumn("in_use", F.coalesce(use, F.lit(False)))
        newest = rows.orderBy(F.desc("version")).limit(self.kept).select("version")
        return rows.join(newest.withColumn("__kept", F.lit(True)), "version", "left").where("__kept OR in_use").drop("__kept").orderBy(F.desc("version"))

    def expired(self) -> DataFrame:
        """(version, path) of models that ``table`` no longer has, for whoever owns the folder to remove."""
        return self.events().where("event = 'trained'").join(self.table().select("version"), "version", "left_anti").select("version", "path")

    def load(self) -> PipelineModel:
        row = self.incumbent()
        if row is None:
            raise ValueError("no version is in use")
        return PipelineModel.load(row.path)


@dataclass
class Retrainer:
    """Trains on batches of a stream when it is time: give ``on_batch`` to ``foreachBatch``.

    A batch is due if ``every_hours`` of event time have passed since the last training (refused ones included) and it has ``min_samples`` rows; ``train`` makes the model.
    """

    versions: Versions
    train: Callable[[DataFrame], Trained]
    every_hours: float = EVERY_HOURS
    min_samples: int = MIN_SAMPLES
    order: str = "ts"

    def on_batch(self, rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        try:
            have = rows.agg(F.count(F.lit(1)).alias("n"), F.max(self.order).alias("at")).first()
            trained = self.versions.events().where("event = 'trained'").agg(F.max("at").alias("at"), F.max("batch").alias("batch")).first()
            if have.n < self.min_samples or (trained.batch is not None and trained.batch >= batch):
                return
            if trained.at is None or (have.at - trained.at).total_seconds() >= self.every_hours * 3600:
                self.versions.offer(self.train(rows), have.at, batch)
        finally:
            rows.unpersist()
