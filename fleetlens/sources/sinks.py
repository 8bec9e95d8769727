"""Writing rendered documents and log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens import constants as C


def write_documents(documents: DataFrame, path: str, files: int | None = None, by_host: bool = False) -> None:
    """One row per (host, unit) document, as Parquet.

    The default ranges the rows by host and unit, so a file covers few hosts and a lookup
    prunes by file statistics; a host with very many documents spans several files.
    ``by_host`` makes a folder per host instead, which suits small fleets only.
    """
    if by_host:
        documents.write.mode("errorifexists").partitionBy("hostname").parquet(path)
        return
    order = ["hostname", "unit", "inventory"]
    ranged = documents.repartitionByRange(files, *order) if files else documents.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.mode("errorifexists").parquet(path)


def route_log(lines: DataFrame, path: str) -> None:
    """INFO lines to ``sink=access``, ERROR lines to ``sink=error``.

    Needs ``level`` and ``line``; lines of no level are tool output and go to ``sink=access``.
    """
    sink = F.when(F.col("level") == "ERROR", C.LOG_SINKS["ERROR"]).otherwise(C.LOG_SINKS["INFO"])
    lines.select("line", sink.alias("sink")).write.mode("errorifexists").partitionBy("sink").text(path)
