"""Streams over arriving files, beside the batch operators over the same files."""

import os

from fleetlens.operators import runlog as R
from fleetlens.plans import samples
from fleetlens.sources.logs import land_run_logs, read_service_logs
from fleetlens.streaming import logs as T
from tests.test_runlog import RUNS

ATTEMPT = ("run", "host", "attempt", "started", "ended", "status", "reason", "seconds")


def rows(df, *columns):
    return sorted((tuple(map(str, r)) for r in df.select(*columns).collect()))


def write_runs(folder, runs=RUNS):
    for run, text in runs.items():
        (folder / f"deploy.{run}.log").write_text(text)


def drain(spark, folder, out, progress, max_files=1, pattern=None):
    stream = T.stream_lines(spark, str(folder), max_files=max_files)
    T.write_attempts(stream, str(out), str(progress), *([pattern] if pattern else [])).awaitTermination()
    return rows(T.read_attempts(spark, str(out)), *ATTEMPT)


def batch_rows(spark, folder, landed, *pattern):
    return rows(R.host_attempts(land_run_logs(spark, str(folder), str(landed), *pattern)), *ATTEMPT)


def test_batches_of_files_equal_the_batch_result(spark, tmp_path):
    folder, out, progress = (tmp_path / n for n in ("in", "out", "progress"))
    folder.mkdir()
    write_runs(folder)
    batch = batch_rows(spark, folder, tmp_path / "landed")
    for _ in range(2):
        assert drain(spark, folder, out, progress) == batch, "a second start adds nothing"
    assert len(os.listdir(out / "attempts")) == 3
    write_runs(folder, {"03022026090000": RUNS["02022026090000"]})
    assert sum(r[0] == "03022026090000" for r in drain(spark, folder, out, progress)) == 2


PIECES = r"run=(\d{14})"
# A run across midnight, cut in the middle of attempts; two results in one second.
CUT = [
    "[2026-01-02 23:59:50] === h === ensuring remote directory exists\n[2026-01-02 23:59:55] === g === copying settings files\n",
    "[2026-01-03 00:00:05] === h: SUCCESS ===\n[2026-01-03 00:00:05] === h: FAILED (scp) -- see x ===\n",
    "[2026-01-03 00:00:05] === h === ensuring remote directory exists\nraw output\n",
    "[2026-01-03 00:09:00] === h: SUCCESS ===\n[2026-01-03 00:09:01] === g: SUCCESS ===\n",
]


def test_runs_in_several_files_equal_the_batch_result(spark, tmp_path):
    folder, out, progress = (tmp_path / n for n in ("in", "out", "progress"))
    (folder / "run=02012026235950").mkdir(parents=True)
    (folder / "run=05012026000000").mkdir()
    (folder / "run=05012026000000" / "0").write_text(CUT[0])
    for i, text in enumerate(CUT):
        (folder / "run=02012026235950" / str(i)).write_text(text)
        got = drain(spark, folder, out, progress, pattern=PIECES)
        assert got == batch_rows(spark, folder, tmp_path / f"landed{i}", PIECES)
    mine = [(r[1], r[2], r[5], r[7]) for r in got if r[0] == "02012026235950"]
    assert mine == [("g", "1", "SUCCESS", "546"), ("h", "1", "SUCCESS", "15"), ("h", "2", "FAILED", "0"), ("h", "3", "SUCCESS", "535")]


def test_a_batch_works_on_its_own_lines_only(spark, tmp_path):
    folder, out, progress = (tmp_path / n for n in ("in", "out", "progress"))
    (folder / "run=02012026235950").mkdir(parents=True)
    for i, text in enumerate(CUT):
        (folder / "run=02012026235950" / str(i)).write_text(text)
        got = drain(spark, folder, out, progress, pattern=PIECES)
    assert [spark.read.parquet(f"{out}/attempts/batch={i}").count() for i in range(len(CUT))] == [2, 2, 1, 2]
    assert len(got) == 4


def test_batches_grow_with_the_files_that_wait(spark, tmp_path):
    for count, want in ((3, 2), (12, 3)):
        folder = tmp_path / str(count)
        folder.mkdir()
        for i in range(count):
            (folder / str(i)).write_text("x\n")
        assert samples.files_a_batch(spark, str(folder), least=2, batches=4) == want


def test_files_of_a_run_go_by_their_stamps(spark, tmp_path):
    """File names say nothing of the order, or count without leading zeros."""
    want = None
    for case, names in enumerate((["piece-8", "piece-9", "piece-10", "piece-11"], ["z", "b", "c", "a"], ["4", "3", "30", "1"])):
        folder = tmp_path / str(case)
        (folder / "in" / "run=02012026235950").mkdir(parents=True)
        for name, text in zip(names, CUT, strict=True):
            (folder / "in" / "run=02012026235950" / name).write_text(text)
        batch = [r[1:] for r in batch_rows(spark, folder / "in", folder / "landed", PIECES)]
        stream = [r[1:] for r in drain(spark, folder / "in", folder / "out", folder / "progress", pattern=PIECES)]
        want = want or batch
        assert batch == stream == want
    assert ("h", "3", "2026-01-03 00:00:05", "2026-01-03 00:09:00", "SUCCESS", "None", "535") in want


def test_a_repeated_batch_replaces_its_rows(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    write_runs(folder)
    first = drain(spark, folder, out, tmp_path / "progress", max_files=10)
    # Without the progress of the first start the same files are batch 0 again.
    assert drain(spark, folder, out, tmp_path / "other", max_files=10) == first


def service_file(folder, name, *lines):
    (folder / name).write_text("".join(f"[2026-01-02 {t}] [{level}] x\n" if level else f"{t}\n" for t, level in lines))


def test_level_counts_equal_batch_with_late_and_unstamped_lines(spark, tmp_path):
    folder, out, progress = (tmp_path / n for n in ("in", "out", "progress"))
    folder.mkdir()
    files = [
        ("a", ("10:00:01", "INFO"), ("10:00:59", "INFO"), ("raw output", None), ("10:01:00", "ERROR")),
        ("b", ("12:00:00", "INFO"), ("more output", None), ("and more", None)),
        ("c", ("10:00:30", "INFO"), ("13:00:00", "INFO")),
    ]
    for name, *lines in files:
        service_file(folder, name, *lines)
        stream = T.stream_lines(spark, str(folder))
        T.write_level_counts(stream, str(out), str(progress)).awaitTermination()
        batch = R.level_counts(R.parse_service_lines(read_service_logs(spark, str(folder))))
        columns = ("file", "level", "minute", "lines")
        assert rows(T.read_level_counts(spark, str(out)), *columns) == rows(batch, *columns)
