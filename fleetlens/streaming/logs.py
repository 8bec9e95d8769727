"""Run logs and service logs as they arrive, with the rows the batch operators give.

Each micro-batch writes folders of its own and replaces them when it is repeated, so a
restart adds nothing twice and no state is held between batches but the tables themselves. The folders
of many batches are merged (``compact``), so their number stays small.

* Run logs are landed first: their lines have a fixed place before an ordered operator
  reads them. A batch then works out the attempts of its own lines, piece by piece of a file, and reads
  no lines of other batches, so all batches together read each line once. A run may come in any
  number of files, across any time: ``read_attempts`` puts the files of a run in order and joins
  the attempts that go on from piece to piece.
* Service lines are counted batch by batch; counts of batches add up. Late lines and lines
  without a stamp count like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from fleetlens import constants as C
from fleetlens.operators import runlog
from fleetlens.sources.logs import number_in_file, order_files, text_lines, with_run
from fleetlens.streaming.compact import FAN, compact, read_batches


def stream_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """``file, block, line`` of arriving files."""
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return text_lines(reader, path)


def _start(stream: DataFrame, write, checkpoint: str, drain: bool):
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer).start()


def write_attempts(
    stream: DataFrame, out: str, checkpoint: str, run_pattern: str = C.RUN_FILE_PATTERN, drain: bool = True, fan: int = FAN
):
    """Attempts in the pieces of each batch, as ``out/attempts/batch=<id>``; read them with ``read_attempts``.

    Parsed host lines are kept under ``out/lines``, by the date of the run. The work of a batch follows its own
    lines, however many its runs have had before. ``drain`` reads what is there and stops. Folders of ``fan`` batches are merged.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        parsed = runlog.host_lines(runlog.parse_run_lines(number_in_file(with_run(batch, run_pattern))))
        # A run without a host line has no attempts. A run whose name is no time has no date.
        dated = parsed.withColumn("run_date", F.coalesce(F.col("run_ts").cast("date").cast("string"), F.lit("none")))
        folder = f"{out}/lines/batch={batch_id}"
        dated.write.mode("overwrite").partitionBy("run_date").parquet(folder)
        landed = spark.read.schema(dated.schema).parquet(folder)
        runlog.piece_attempts(landed).write.mode("overwrite").parquet(f"{out}/attempts/batch={batch_id}")
        if batch_id % fan == fan - 1:
            schema = StructType([*dated.schema.fields, StructField("batch", LongType())])
            compact(spark, f"{out}/lines", lambda df: df, schema, ("run_date",), fan)
            compact(spark, f"{out}/attempts", lambda df: df, fan=fan)

    return _start(stream, write, checkpoint, drain)


def read_attempts(spark: SparkSession, out: str) -> DataFrame:
    """The attempts of all runs that have arrived, joined over the pieces of all batches."""
    found = read_batches(spark, f"{out}/attempts").drop("batch")
    return runlog.join_pieces(order_files(found, F.col("first"), F.col("until"))).drop("part", "n")


def write_level_counts(stream: DataFrame, out: str, checkpoint: str, drain: bool = True, fan: int = FAN):
    """Lines of each batch per file, level and minute, as ``out/batch=<id>``; read them with ``read_level_counts``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = runlog.parse_service_lines(batch.where("line != ''"))
        runlog.level_counts(parsed).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if batch_id % fan == fan - 1:
            compact(batch.sparkSession, out, _summed, fan=fan)

    return _start(stream, write, checkpoint, drain)


def read_level_counts(spark: SparkSession, out: str) -> DataFrame:
    """Lines per file, level and minute over all batches; unstamped lines have a null level and minute."""
    return _summed(read_batches(spark, out)).drop("batch")


def _summed(found: DataFrame) -> DataFrame:
    return found.groupBy("file", "level", "minute").agg(F.sum("lines").alias("lines"), F.max("batch").alias("batch"))
