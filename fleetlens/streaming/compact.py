"""Compaction of the folders that a stream's batches write.

A table is ``batch=<id>`` folders and ``runs``: ``FAN`` folders of one level are merged into one of
the next, so a row is rewritten once a level. A manifest names the runs, and a run counts from the moment its
manifest is complete; readers take the newest manifest and the batches after its last run. What a
compaction replaces goes at the next one, so that a reader of the manifest before can finish. A
compaction that is repeated, or stopped anywhere, leaves a table with the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetlens.sources.folders import Folder, newest_manifest, write_manifest

FAN = 8
#: The newest batches stay as they are: a restart may write the last one again.
KEPT = 1


def _manifest(spark: SparkSession, out: str) -> tuple[int, dict]:
    """The number and content of the newest complete manifest; 0 and no runs without one."""
    number, content = newest_manifest(spark, out)
    return number, content or {"runs": []}


def _batches(spark: SparkSession, out: str, after: int) -> list[int]:
    folder = Folder(spark, out)
    ids = (int(n.removeprefix("batch=")) for n in folder.names() if n.startswith("batch="))
    return sorted(i for i in ids if i > after and folder.whole(f"batch={i}"))


def _last(runs: list[dict]) -> int:
    return max((r["high"] for r in runs), default=-1)


def _read(spark: SparkSession, out: str, runs: list[dict], batches: list[int], schema: StructType | None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    parts = []
    if runs:
        parts.append(reader.parquet(*[f"{out}/runs/{r['folder']}" for r in runs]).withColumn("batch", F.col("batch").cast("long")))
    if batches or not runs:
        paths = [f"{out}/batch={i}" for i in batches] or [out]
        parts.append(reader.option("basePath", out).parquet(*paths).withColumn("batch", F.col("batch").cast("long")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read_batches(spark: SparkSession, out: str, schema: StructType | None = None) -> DataFrame:
    """All rows of the table under ``out``, with ``batch``; ``schema`` includes it where it is given."""
    _, manifest = _manifest(spark, out)
    return _read(spark, out, manifest["runs"], _batches(spark, out, _last(manifest["runs"])), schema)


def compact(
    spark: SparkSession, out: str, merge: Callable[[DataFrame], DataFrame], schema: StructType | None = None, partition_by: tuple[str, ...] = (), fan: int = FAN
) -> None:
    """Merge full levels of the table under ``out``. ``merge`` must give rows that stand for those it is given, ``batch`` kept."""
    number, manifest = _manifest(spark, out)
    folder = Folder(spark, out)
    runs = list(manifest["runs"])
    waiting = _batches(spark, out, _last(runs))
    waiting = waiting[: len(waiting) - KEPT]

    def write(level: int, low: int, high: int, df: DataFrame) -> dict:
        name = f"{low}-{high}-{uuid.uuid4().hex[:8]}"
        merge(df).write.partitionBy(*partition_by).parquet(f"{out}/runs/{name}")
        return {"level": level, "low": low, "high": high, "folder": name}

    while len(waiting) >= fan:
        now, waiting = waiting[:fan], waiting[fan:]
        runs.append(write(1, now[0], now[-1], _read(spark, out, [], now, schema)))
    level = 1
    while full := [r for r in runs if r["level"] == level]:
        if len(full) >= fan:
            merged = write(level + 1, full[0]["low"], full[-1]["high"], _read(spark, out, full, [], schema))
            runs = sorted([r for r in runs if r not in full] + [merged], key=lambda r: r["low"])
        level += 1
    if runs == manifest["runs"]:
        return
    write_manifest(spark, out, number + 1, {"runs": runs})
    # Readers of this manifest or of the one before need neither the batches that the one before
    # had merged, nor runs that neither names.
    for batch in folder.names():
        if batch.startswith("batch=") and int(batch.removeprefix("batch=")) <= _last(manifest["runs"]):
            folder.delete(batch)
    named = {r["folder"] for r in [*manifest["runs"], *runs]}
    for name in folder.names("runs"):
        if name not in named:
            folder.delete("runs", name)
