"""Log files that are still being written, as a streaming source.

An offset is how far each file has been read, in bytes, always up to a line end: the rest of a line
comes with a later batch. So each line is read once, whole, however often its file grows.

Files are opened with ``pyarrow.fs``: a path that all executors share, or a URI it knows. The
offset has an entry for each file in the folder; move finished files away to keep it small.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Iterator

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# The source travels with the tasks: executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "fleet_growing_logs"
#: Bytes that one task reads of a file, and bytes looked through at a time for a line end.
PIECE = 32 << 20
LOOK = 1 << 16


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def last_line_end(file, size: int) -> int:
    """Bytes of an open file up to its last line end."""
    at = size
    while at > 0:
        low = max(0, at - LOOK)
        file.seek(low)
        found = file.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return 0


class Piece(InputPartition):
    """Lines of ``file`` that begin in its bytes from ``low`` to ``high``; a line begins at ``start``."""

    def __init__(self, file: str, low: int, high: int, start: int, end: int):
        self.file, self.low, self.high, self.start, self.end = file, low, high, start, end


class GrowingReader(DataSourceStreamReader):
    def __init__(self, path: str, settled: float):
        self.path, self.settled = path, settled

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, folder = open_folder(self.path)
        offset = {}
        for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True)):
            name = info.base_name
            if not info.is_file or name.startswith((".", "_")):
                continue
            if info.mtime_ns is not None and time.time() - info.mtime_ns / 1e9 > self.settled:
                offset[info.path] = info.size
                continue
            with system.open_input_file(info.path) as file:
                offset[info.path] = last_line_end(file, info.size)
        return offset

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        pieces = []
        for file, high in end.items():
            low = start.get(file, 0)
            if high < low:
                raise ValueError(f"{file} was {low} bytes long and is shorter now: log files must only grow")
            pieces += [Piece(file, at, min(at + PIECE, high), low, high) for at in range(low, high, PIECE)]
        return pieces

    def read(self, piece: Piece) -> Iterator[tuple]:
        system, _ = open_folder(self.path)
        with system.open_input_file(piece.file) as file:
            at = piece.low
            # The line that goes on into this piece belongs to the piece before.
            skip = at > piece.start
            if skip:
                at -= 1
            for line in _lines(file, at, piece.end):
                begins, at = at, at + len(line)
                if skip:
                    skip = False
                    continue
                if begins >= piece.high:
                    break
                yield piece.file, piece.low, line.rstrip(b"\n").removesuffix(b"\r").decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        pass


def _lines(file, at: int, end: int) -> Iterator[bytes]:
    """Lines of an open file from ``at`` to ``end``, with their ends."""
    file.seek(at)
    held: list[bytes] = []
    while at < end:
        block = file.read(min(LOOK, end - at))
        if not block:
            break
        at += len(block)
        *whole, rest = block.split(b"\n")
        for line in whole:
            yield b"".join([*held, line, b"\n"])
            held = []
        held.append(rest)
    if any(held):
        yield b"".join(held)


class GrowingLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, block long, line string"

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options["path"], float(self.options.get("settled", "600")))


def stream_growing(spark: SparkSession, path: str, settled: float = 600) -> DataFrame:
    """``file, block, line`` of the files under ``path``, as far as their lines are whole.

    The last line of a file need not end: it is taken once the file is ``settled`` seconds old.
    """
    spark.dataSource.register(GrowingLogs)
    return spark.readStream.format(FORMAT).option("path", path).option("settled", settled).load()
