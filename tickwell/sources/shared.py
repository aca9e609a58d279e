"""The folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where that setting is missing and all runs on one machine, as in tests, a new folder of that
    machine is set for the session; on a cluster there is none to fall back on, and an error is raised.
    """
    if not spark.conf.get(KEY, None):
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"{KEY} is not set: a folder that all executors share is needed")
        spark.conf.set(KEY, f"file://{tempfile.mkdtemp(prefix='shared-')}")
    return spark.conf.get(KEY)


def checkpoints(spark: SparkSession) -> None:
    """Let ``DataFrame.checkpoint`` write to that folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to that folder and read again: a lineage that ends at files, for tables that are read several times."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
