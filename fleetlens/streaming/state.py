"""Streams whose state is bounded by event time: attempts per host, and service-log windows.

Both reduce the rows of a task first, so that a host or log with most of the lines is a few
rows a task, and keep one small value for each open host or window; open hosts lie together in buckets,
as a call of Python for each of them would take most of the time. A timer in event time
ends what the watermark has passed, and with it the state.

``transformWithState`` needs the RocksDB state store; the functions set it for the session.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetlens import constants as C
from fleetlens.functions import text as X
from fleetlens.operators import runlog
from fleetlens.sources.logs import natural_name, with_run

# Processors travel with the tasks: executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Timers stand half a second off the log's whole seconds, so that none meets the watermark.
HALF_SECOND = 500
#: Hosts are dealt to so many states. A stream that goes on from a checkpoint needs the number it began with.
BUCKETS = 1024
_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def milliseconds(interval: str) -> int:
    """``10 minutes`` as a number."""
    found = re.fullmatch(r"\s*(\d+)\s+(second|minute|hour|day)s?\s*", interval)
    if not found:
        raise ValueError(f"not a number of seconds, minutes, hours or days: {interval}")
    return int(found[1]) * _UNITS[found[2]] * 1000


def _start(stream: DataFrame, write, checkpoint: str, drain: bool):
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer).start()


# ---------------------------------------------------------------- attempts


def _ends_of_attempts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each host's lines in a piece of a file: the first of an attempt, its result, and the last."""
    n, piece, open_lines = 0, None, {}

    def left(out):
        out += [row for row in open_lines.values() if row is not None]
        open_lines.clear()

    for frame in frames:
        out: list[tuple] = []
        for run, name, block, host, status, reason, ts in zip(*(frame[c] for c in ("run", "name", "block", "host", "status", "reason", "ts")), strict=True):
            n += 1
            row = (run, host, name, block, n, status, reason, ts)
            if (run, name, block) != piece:
                left(out)
                piece = (run, name, block)
            if status is not None:
                out.append(row)
                open_lines.pop(host, None)
            elif host in open_lines:
                open_lines[host] = row
            else:
                out.append(row)
                open_lines[host] = None
        yield pd.DataFrame(out, columns=_LINE)
    out = []
    left(out)
    yield pd.DataFrame(out, columns=_LINE)


_LINE = ["run", "host", "name", "block", "n", "status", "reason", "ts"]
_LINE_TYPE = "run string, host string, name string, block long, n long, status string, reason string, ts timestamp"
_ATTEMPT = ["run", "host", "attempt", "started", "ended", "status", "reason"]
_ATTEMPT_TYPE = "run string, host string, attempt long, started long, ended long, status string, reason string"


#: What is kept of a host: results so far, when the open attempt started (or none), and the last line.
_OPEN = pa.schema([("run", pa.string()), ("host", pa.string()), ("done", pa.int64()), ("started", pa.int64()), ("last", pa.int64())])


def _pack(hosts: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _OPEN, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(pa.Table.from_pandas(hosts, _OPEN, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes | None) -> pd.DataFrame:
    table = pa.ipc.open_stream(data).read_all() if data else _OPEN.empty_table()
    types = {pa.int64(): pd.Int64Dtype()}
    return table.to_pandas(types_mapper=types.get).astype({"run": object, "host": object})


class Attempts(StatefulProcessor):
    """The open hosts of a bucket, each a (run, host): attempts done, and when the open one started.

    A host that is silent for ``patience`` is over. The hosts of a bucket are worked on together, and one timer
    stands at the end of the first of them.
    """

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "hosts binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        lines = pd.concat(list(rows), ignore_index=True)
        lines["ms"] = lines["ts"].astype("datetime64[ms]").astype("int64")
        lines = lines.sort_values(["run", "host", "ms", "name", "block", "n"], ignore_index=True)
        held = _unpack(bytes(self.now.get()[0]) if self.now.exists() else None)
        lines = lines.merge(held, on=["run", "host"], how="left", validate="many_to_one")
        is_result = lines["status"].notna()
        by_host = lines.groupby(["run", "host"], sort=False)
        results = is_result.astype("int64").groupby([lines["run"], lines["host"]], sort=False).cumsum()
        lines["above"] = results - is_result
        lines["total"] = lines["done"].fillna(0) + results
        # An attempt began with its first line here, or where it stood open before.
        began = lines.groupby(["run", "host", "above"], sort=False)["ms"].transform("first").astype("Int64")
        lines["began"] = lines["started"].where((lines["above"] == 0) & lines["started"].notna(), began)
        found = lines[is_result]
        out = pd.DataFrame({"run": found["run"], "host": found["host"], "attempt": found["total"], "started": found["began"]})
        out = out.assign(ended=found["ms"].astype("Int64"), status=found["status"], reason=found["reason"].astype(object).where(found["reason"].notna(), None))
        ends = lines.loc[~lines.duplicated(["run", "host"], keep="last"), ["run", "host", "total", "began", "status", "last"]]
        ends["latest"] = by_host["ms"].max().to_numpy()
        ends["last"] = ends[["last", "latest"]].max(axis=1)
        ends["started"] = ends["began"].where(ends["status"].isna())
        now = ends.rename(columns={"total": "done"})[_OPEN.names]
        seen = held.merge(now[["run", "host"]], on=["run", "host"], how="left", indicator=True)["_merge"] == "both"
        self._keep(pd.concat([held[~seen.to_numpy()], now], ignore_index=True))
        yield out[_ATTEMPT]

    def _keep(self, hosts: pd.DataFrame) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if hosts.empty:
            self.now.clear()
            return
        self.now.update((_pack(hosts),))
        self.handle.registerTimer(int(hosts["last"].min()) + self.patience + HALF_SECOND)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        hosts = _unpack(bytes(self.now.get()[0]))
        over = hosts["last"].astype("int64") + self.patience + HALF_SECOND <= timerValues.getCurrentWatermarkInMs()
        self._keep(hosts[~over])
        ended = hosts[over & hosts["started"].notna()]
        out = pd.DataFrame({"run": ended["run"], "host": ended["host"], "attempt": ended["done"] + 1, "started": ended["started"]})
        yield out.assign(ended=pd.array([None] * len(out), "Int64"), status="NO_RESULT", reason=None)[_ATTEMPT]

    def close(self) -> None:
        pass


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """Rows whose whole numbers may be null and stay whole numbers."""
    frame = pd.DataFrame(rows, columns=columns)
    for name in ("lines", "minute"):
        if name in columns:
            frame[name] = pd.array([None if v is None else int(v) for v in frame[name].astype(object).where(frame[name].notna(), None)], "Int64")
    return frame


def write_ended_attempts(
    stream: DataFrame, out: str, checkpoint: str, patience: str = "6 hours", delay: str = "10 minutes",
    run_pattern: str = C.RUN_FILE_PATTERN, drain: bool = True,
):
    """Each attempt once, when it has ended, as ``out/batch=<id>``; read them with ``read_ended_attempts``.

    ``stream``: ``file, block, line`` of arriving run logs. An attempt ends with its result, or without one (NO_RESULT)
    when the watermark is ``patience`` past its host's last line: then its state goes. The watermark is
    ``delay`` behind the latest line of earlier batches; lines behind it are dropped. A host that is silent for
    longer and goes on in the same run is counted from attempt 1 again.
    """
    stream.sparkSession.conf.set(STORE, ROCKSDB)
    lines = runlog.host_lines(runlog.parse_run_lines(with_run(stream, run_pattern), "timestamp"))
    ends = lines.select("run", natural_name(F.col("file")).alias("name"), "block", "host", "status", "reason", "ts")
    ends = ends.where("ts IS NOT NULL").mapInPandas(_ends_of_attempts, _LINE_TYPE).withWatermark("ts", delay)
    bucket = F.pmod(F.xxhash64("run", "host"), F.lit(BUCKETS)).cast("int")
    attempts = ends.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(
        Attempts(milliseconds(patience)), _ATTEMPT_TYPE, "Append", "eventTime"
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        at = {c: F.timestamp_millis(c).cast("timestamp_ntz") for c in ("started", "ended")}
        found = batch.withColumns(at).withColumn("seconds", X.seconds_between("started", "ended"))
        found.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _start(attempts, write, checkpoint, drain)


def read_ended_attempts(spark: SparkSession, out: str) -> DataFrame:
    """``run, host, attempt, started, ended, status, reason, seconds`` of all attempts that have ended."""
    return spark.read.parquet(out).select(*_ATTEMPT, "seconds")


# ---------------------------------------------------------------- service-log windows

MINUTE = 60_000
_COUNT = ["file", "level", "minute", "kind", "lines"]
_COUNT_TYPE = "file string, level string, minute long, kind string, lines long"


def _counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines a file, level and minute of one task's rows, with the latest stamp among them."""
    for frame in frames:
        yield frame.groupby(["file", "level", "minute"], dropna=False, as_index=False).agg(ts=("ts", "max"), lines=("ts", "size"))


class Windows(StatefulProcessor):
    """Lines a minute of one file and level, until the watermark is past the minute; what comes later is late."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "minute long", "lines long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() - MINUTE
        lines = pd.concat(list(rows))
        out = []
        unstamped = int(lines.loc[lines["minute"].isna(), "lines"].sum())
        if unstamped:
            out.append((*key, None, "unstamped", unstamped))
        opened = []
        for minute, found in lines.dropna(subset="minute").groupby("minute")["lines"].sum().items():
            minute, found = int(minute), int(found)
            if minute <= passed:
                out.append((*key, minute, "late", found))
                continue
            if self.open.containsKey((minute,)):
                found += self.open.getValue((minute,))[0]
            self.open.updateValue((minute,), (found,))
            opened.append(minute)
        self._wait_for(opened)
        yield _frame(out, _COUNT)

    def _wait_for(self, minutes: list[int]) -> None:
        """One timer: at the end of the earliest open minute."""
        waiting = list(self.handle.listTimers())
        if minutes and (not waiting or min(minutes) + MINUTE < min(waiting)):
            for timer in waiting:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(min(minutes) + MINUTE)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() - MINUTE
        out, left = [], []
        for (minute,), (found,) in list(self.open.iterator()):
            if minute <= passed:
                out.append((*key, minute, "final", found))
                self.open.removeKey((minute,))
            else:
                left.append(minute)
        if left:
            self.handle.registerTimer(min(left) + MINUTE)
        yield _frame(out, _COUNT)

    def close(self) -> None:
        pass


def write_level_windows(stream: DataFrame, out: str, checkpoint: str, delay: str = "10 minutes", drain: bool = True):
    """Lines per file, level and minute, each minute once, when the watermark has passed it: ``read_level_windows``.

    ``stream``: ``file, line`` of arriving service logs. The watermark is ``delay`` behind the latest line of
    earlier batches. Lines of a minute that it has passed are not dropped: they are counted beside the windows as
    ``late``, lines without a stamp as ``unstamped``. So final, late and unstamped lines, and those of minutes still
    open, are all lines.
    """
    stream.sparkSession.conf.set(STORE, ROCKSDB)
    parsed = runlog.parse_service_lines(stream.where("line != ''"), "timestamp")
    # The stamp is carried on under another name: no rows are to be dropped as late, they are counted.
    marked = parsed.select("file", "level", F.when(F.col("ts").isNotNull(), F.unix_millis(F.date_trunc("minute", "ts"))).alias("minute"), "ts")
    counted = marked.mapInPandas(_counts, "file string, level string, minute long, ts timestamp, lines long")
    windows = (
        counted.withWatermark("ts", delay)
        .select("file", "level", "minute", "lines")
        .groupBy("file", "level")
        .transformWithStateInPandas(Windows(), _COUNT_TYPE, "Append", "eventTime")
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        found = batch.withColumn("minute", F.timestamp_millis("minute").cast("timestamp_ntz"))
        found.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _start(windows, write, checkpoint, drain)


def read_level_windows(spark: SparkSession, out: str, kind: str = "final") -> DataFrame:
    """``file, level, minute, lines`` of one kind: ``final``, ``late`` or ``unstamped``."""
    found = spark.read.parquet(out).where(F.col("kind") == kind)
    return found.groupBy("file", "level", "minute").agg(F.sum("lines").alias("lines"))
