"""Landed inventories that are updated in part.

Documents lie in buckets by a hash of their name. An update writes the buckets that hold a changed document
into a folder of its own, and a manifest then names the folder of every bucket: the files of all other buckets
stay as they are, a reader of the manifest before finds its files, and an update that is stopped anywhere, or
repeated, leaves a whole table. The folders that an update replaced go at the next one. One update at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetlens.operators.inventory import backfill_keys, needs_backfill
from fleetlens.sources.folders import Folder, newest_manifest, write_manifest
from fleetlens.sources.scratch import stored

#: The manifest and the driver hold one entry a bucket. A bucket is what an update rewrites at least.
BUCKETS = 256
BUCKET = "__bucket"
VERSIONS = "versions"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("inventory"), F.lit(buckets)).cast("int")


def _write(documents: DataFrame, path: str, buckets: int) -> dict[int, str]:
    """Documents into a new folder; of each bucket there, the folder. Large buckets become several files."""
    version = uuid.uuid4().hex
    placed = documents.withColumn(BUCKET, _bucket(buckets)).hint("rebalance", BUCKET)
    placed.write.partitionBy(BUCKET).parquet(f"{path}/{VERSIONS}/{version}")
    names = Folder(documents.sparkSession, path).names(VERSIONS, version)
    return {int(n.removeprefix(f"{BUCKET}=")): version for n in names if n.startswith(f"{BUCKET}=")}


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    number, content = newest_manifest(spark, path)
    if content is None:
        raise ValueError(f"no landed inventories in {path}")
    return number, content | {"folders": {int(b): v for b, v in content["folders"].items()}}


def _read(spark: SparkSession, path: str, content: dict, only: list[int] | None = None) -> DataFrame:
    folders = content["folders"]
    schema = StructType.fromJson(content["schema"])
    paths = [f"{path}/{VERSIONS}/{folders[b]}/{BUCKET}={b}" for b in sorted(folders if only is None else only) if b in folders]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def land_documents(documents: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Documents as Parquet under a new ``path``; a path that holds landed inventories is an error."""
    spark = documents.sparkSession
    if newest_manifest(spark, path)[1] is not None:
        raise ValueError(f"{path} holds landed inventories")
    folders = _write(documents, path, buckets)
    write_manifest(spark, path, 1, {"buckets": buckets, "schema": json.loads(documents.schema.json()), "folders": folders})


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """All documents as of the last update."""
    return _read(spark, path, _manifest(spark, path)[1])


def update_documents(changes: DataFrame, path: str) -> list[int]:
    """Put ``changes``, whole documents in the columns of the table, in the place of the documents of their name.

    A name that is not there yet is added; repeated rows of a name give way to the one changed row; a null name
    counts as a name. A name changed twice fails the update, and nothing is written. Returns the rewritten buckets.
    """
    spark = changes.sparkSession
    number, before = _manifest(spark, path)
    buckets = before["buckets"]
    # The changes often come from reading this table: they are fixed before anything is replaced.
    changed = stored(changes.select(*StructType.fromJson(before["schema"]).names), "changes")
    twice = changed.groupBy("inventory").count().where("count > 1").select("inventory").head(1)
    if twice:
        raise ValueError(f"changed twice: {twice[0][0]}")
    touched = sorted(r[0] for r in changed.select(_bucket(buckets)).distinct().collect())
    if not touched:
        return []
    there = _read(spark, path, before, touched)
    names = changed.select(F.col("inventory").alias("__name"))
    kept = there.join(names, F.col("inventory").eqNullSafe(F.col("__name")), "left_anti")
    folders = before["folders"] | _write(kept.unionByName(changed), path, buckets)
    write_manifest(spark, path, number + 1, before | {"folders": folders})
    _clean(spark, path, [before["folders"], folders])
    return touched


def _clean(spark: SparkSession, path: str, named: list[dict[int, str]]) -> None:
    """Delete the buckets that none of the manifests names."""
    folder = Folder(spark, path)
    wanted = {(version, f"{BUCKET}={b}") for folders in named for b, version in folders.items()}
    versions = {version for version, _ in wanted}
    for version in folder.names(VERSIONS):
        if version not in versions:
            folder.delete(VERSIONS, version)
            continue
        for name in folder.names(VERSIONS, version):
            if name.startswith(f"{BUCKET}=") and (version, name) not in wanted:
                folder.delete(VERSIONS, version, name)


def backfill_landed(spark: SparkSession, path: str, values: dict[str, str], only_missing: bool = False) -> list[int]:
    """``backfill_keys`` over landed inventories: only documents that wait for a value are put in anew."""
    waiting = read_documents(spark, path).where(needs_backfill())
    return update_documents(backfill_keys(waiting, values, only_missing=only_missing), path)
