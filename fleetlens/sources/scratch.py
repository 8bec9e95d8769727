"""Shared working folder for written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that may name the folder, the first that is set counts.
FOLDER_SETTINGS = ("spark.checkpoint.dir", "spark.fleetlens.scratch.dir")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the folder that the session names, which all executors must share."""
    base = next(filter(None, (spark.conf.get(s, None) for s in FOLDER_SETTINGS)), None)
    if not base:
        raise ValueError(f"set {FOLDER_SETTINGS[0]} to a folder all executors share")
    return f"{base.rstrip('/')}/fleetlens/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, for jobs that use it several times."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
