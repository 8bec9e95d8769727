"""Folders on any file system that Spark knows, and manifests that say which of them count."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

MANIFESTS = "manifests"


class Folder:
    """A folder and what lies under it."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        at = self._root
        for part in parts:
            at = self._jvm.org.apache.hadoop.fs.Path(at, part)
        return at

    def names(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def whole(self, *parts: str) -> bool:
        return self._fs.exists(self._path(*parts, "_SUCCESS"))

    def delete(self, *parts: str) -> None:
        self._fs.delete(self._path(*parts), True)


def newest_manifest(spark: SparkSession, path: str) -> tuple[int, dict | None]:
    """The number and content of the newest complete manifest under ``path``; 0 and None without one."""
    folder = Folder(spark, path)
    complete = [n for n in folder.names(MANIFESTS) if folder.whole(MANIFESTS, n)]
    if not complete:
        return 0, None
    return int(complete[-1]), json.loads(spark.read.text(f"{path}/{MANIFESTS}/{complete[-1]}").first()[0])


def write_manifest(spark: SparkSession, path: str, number: int, content: dict) -> None:
    """A manifest counts once it is complete; readers take the newest. Of older ones the last stays."""
    text = spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1)
    text.write.mode("overwrite").text(f"{path}/{MANIFESTS}/{number:012d}")
    folder = Folder(spark, path)
    for name in folder.names(MANIFESTS)[:-2]:
        folder.delete(MANIFESTS, name)
