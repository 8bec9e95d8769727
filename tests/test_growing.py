"""Files that grow between batches, beside one read of the whole files."""

import io
import random

import pytest

from fleetlens.operators import runlog as R
from fleetlens.sources import growing
from fleetlens.sources.logs import land_run_logs
from fleetlens.streaming import logs as T
from tests.test_runlog import MIXED, TWICE_THEN_CUT

ATTEMPT = ("run", "host", "attempt", "started", "ended", "status", "reason", "seconds")
PATTERN = r"run=(\d{14})"


def rows(df, *columns):
    return sorted(tuple(map(str, r)) for r in df.select(*columns).collect())


def test_pieces_hold_each_line_once(monkeypatch, tmp_path):
    rng = random.Random(4)
    text = "".join("é" * rng.randrange(9) + rng.choice(["\n", "\r\n", "x\n", "\x0b\n"]) for _ in range(300)) + "no end"
    file = tmp_path / "a.log"
    file.write_bytes(text.encode())
    want = [line.removesuffix("\r") for line in text.split("\n")][:-1]
    for piece, look in ((1, 3), (7, 2), (64, 1000), (1 << 20, 5)):
        monkeypatch.setattr(growing, "PIECE", piece)
        monkeypatch.setattr(growing, "LOOK", look)
        reader = growing.GrowingReader(str(tmp_path), 1e9)
        end = reader.latestOffset()
        assert list(end.values()) == [len(text.encode()) - len("no end")]
        got = [row for p in reader.partitions({}, end) for row in reader.read(p)]
        assert [r[2] for r in got] == want and got == sorted(got, key=lambda r: r[1])
        # In two goes, cut anywhere, the lines are the same.
        cut = growing.last_line_end(io.BytesIO(text.encode()), len(text.encode()) // 2)
        middle = {str(file): cut}
        twice = [r[2] for s, e in (({}, middle), (middle, end)) for p in reader.partitions(s, e) for r in reader.read(p)]
        assert twice == want
    assert list(growing.GrowingReader(str(tmp_path), -1).latestOffset().values()) == [len(text.encode())]
    with pytest.raises(ValueError, match="only grow"):
        reader.partitions(end, middle)


def test_a_file_appended_to_gives_the_rows_of_one_read(spark, tmp_path):
    folder, out, progress = (tmp_path / n for n in ("in", "out", "progress"))
    texts = {"02012026100000": MIXED, "15012026080000": TWICE_THEN_CUT}
    for step in (0.3, 0.61, 1.0):
        for run, text in texts.items():
            place = folder / f"run={run}"
            place.mkdir(parents=True, exist_ok=True)
            # The cut falls into lines.
            (place / "deploy.log").write_text(text[: int(len(text) * step)])
        T.write_attempts(growing.stream_growing(spark, str(folder)), str(out), str(progress), PATTERN).awaitTermination()
    batch = R.host_attempts(land_run_logs(spark, str(folder), str(tmp_path / "landed"), PATTERN))
    assert rows(T.read_attempts(spark, str(out)), *ATTEMPT) == rows(batch, *ATTEMPT)
    assert spark.read.parquet(f"{out}/lines").where("batch = 2").count() > 0
