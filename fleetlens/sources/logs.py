"""Reading run logs and service logs as splittable line files.

A run log may be of any size: it is never held as one value. ``part`` names the piece of a
file that one task reads (bounded by ``spark.sql.files.maxPartitionBytes``) and ``n`` orders
the lines inside it, so (``part``, ``n``) orders the lines of a run without any shuffle. The files of a run stand in the
order of their stamps, which an index of one row a file gives.

Where a file is cut can change from scan to scan, when executors come or go. The ordered
operators read their input twice, so run them over landed lines, where the place is data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions.text import present, run_time
from fleetlens.operators.runlog import parse_run_lines


def with_run(lines: DataFrame, run_pattern: str = C.RUN_FILE_PATTERN) -> DataFrame:
    """Add ``run`` and ``run_ts`` from the file path; a path without a run id is its own run."""
    run = F.coalesce(present(F.regexp_extract("file", run_pattern, 1)), F.col("file"))
    return lines.withColumn("run", run).withColumn("run_ts", run_time("run"))


def number_in_file(lines: DataFrame, keep_blank: bool = False) -> DataFrame:
    """``run, run_ts, part, n, line`` from a scan with ``file``, ``block``, ``line``."""
    ordered = lines.select(
        "run",
        "run_ts",
        F.struct("file", "block").alias("part"),
        F.monotonically_increasing_id().alias("n"),
        "line",
    )
    return ordered if keep_blank else ordered.where("line != ''")


def text_lines(reader, path) -> DataFrame:
    """``file, block, line`` of a batch or streaming text reader."""
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("line"),
    )


def stamp_of(line: Column) -> Column:
    """The time a line begins with, as ``[2026-01-02 03:04:05]``; null without one."""
    return F.when(line.startswith("["), F.regexp_extract(line, C.STAMP_PATTERN, 1)).try_cast("timestamp_ntz")


def natural_name(name: Column) -> Column:
    """``name`` with its numbers padded, so that piece-9 sorts before piece-10."""
    runs = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.lpad(r, 20, "0")).otherwise(r)), "")


def order_files(lines: DataFrame, ts: Column, until: Column | None = None) -> DataFrame:
    """Lines with ``place``, the place of their file in its run, put first in ``part``.

    ``lines`` has ``run`` and ``part`` (``file, block``). Files go by their first and last stamp (``ts``), then by
    name, numbers in names as numbers. A file without a stamp follows the file named before it. Rows that
    stand for several lines have the time of the earliest in ``ts`` and that of the latest in ``until``.
    """
    last = F.max(ts if until is None else until)
    spans = lines.groupBy("run", F.col("part.file").alias("file")).agg(F.min(ts).alias("first"), last.alias("last"))
    by_name = Window.partitionBy("run").orderBy("name").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Beside a file's own stamps come those of the last stamped file up to it in the order of names.
    spans = spans.withColumn("name", F.struct(natural_name(F.col("file")), F.col("file")))
    stamped = F.when(F.col("first").isNotNull(), F.struct("first", "last"))
    spans = spans.withColumn("at", F.last(stamped, ignorenulls=True).over(by_name))
    place = F.row_number().over(Window.partitionBy("run").orderBy("at.first", "at.last", "name"))
    index = spans.select(F.col("run").alias("__run"), "file", place.alias("place"))
    joined = lines.join(index, (F.col("run") == F.col("__run")) & (F.col("part.file") == F.col("file")))
    part = F.struct("place", F.col("part.file").alias("file"), F.col("part.block").alias("block"))
    return joined.select(*[part.alias(c) if c == "part" else c for c in lines.columns])


def read_run_logs(
    spark: SparkSession, path, run_pattern: str = C.RUN_FILE_PATTERN, keep_blank: bool = False
) -> DataFrame:
    """Lines of run logs: ``run, run_ts, part, n, line``. A run may lie in any number of files."""
    reader = spark.read.option("recursiveFileLookup", "true")
    numbered = number_in_file(with_run(text_lines(reader, path), run_pattern), keep_blank)
    return order_files(numbered, stamp_of(F.col("line")))


def land_run_logs(
    spark: SparkSession, path, out: str, run_pattern: str = C.RUN_FILE_PATTERN, mode: str = "errorifexists"
) -> DataFrame:
    """Read and parse run logs once, into a table by run date. Later jobs read it, not the texts.

    Lines are ranged by date and piece: a run with most lines spans many tasks.
    """
    lines = read_run_logs(spark, path, run_pattern).withColumn("run_date", F.col("run_ts").cast("date"))
    # Lines of a date come together before they are parsed, so a task writes few dates.
    dated = parse_run_lines(lines.repartitionByRange("run_date", "part"))
    dated.write.mode(mode).partitionBy("run_date").parquet(out)
    return spark.read.schema(dated.schema).parquet(out)


def read_service_logs(spark: SparkSession, path) -> DataFrame:
    """Lines of service logs: ``file, line``. Each line stands for itself."""
    reader = spark.read.option("recursiveFileLookup", "true")
    return text_lines(reader, path).drop("block").where("line != ''")
