"""Streams with state bounded by event time, beside the batch operators."""

import os

from fleetlens.operators import runlog as R
from fleetlens.sources.logs import land_run_logs, read_service_logs
from fleetlens.streaming import logs as T
from fleetlens.streaming import state as S

ATTEMPT = ("run", "host", "attempt", "started", "ended", "status", "reason", "seconds")


def rows(df, *columns):
    return sorted(tuple(map(str, r)) for r in df.select(*columns).collect())


def day_of_logs(day):
    """Ten hosts in turn: done, retried, cut in the middle, and one that never ends."""
    run = f"{day:02d}012026000000"
    out = []
    for h in range(10):
        at = f"2026-01-{day:02d} {h:02d}"
        out += [f"[{at}:00:00] === h{h} === ensuring remote directory exists", f"[{at}:00:01] === h{h} === copying settings files", "raw output"]
        if h % 5 == 3:
            out += [f"[{at}:01:00] === h{h}: FAILED (scp) -- see x ===", f"[{at}:01:00] === h{h} === ensuring remote directory exists"]
        if h != 7:
            out += [f"[{at}:02:00] === h{h}: SUCCESS ==="]
    return run, out


def test_ended_attempts(spark, tmp_path):
    folder, out, progress = (tmp_path / n for n in ("in", "out", "progress"))
    folder.mkdir()
    pattern, states = r"run=(\d{14})", []
    for day in range(1, 7):
        run, lines = day_of_logs(day)
        place = folder / f"run={run}"
        place.mkdir()
        # A run arrives in two files, cut within an attempt.
        for name, part in (("1", lines[:13]), ("2", lines[13:])):
            (place / name).write_text("\n".join(part) + "\n")
            os.utime(place / name, (day * 100 + int(name), day * 100 + int(name)))
    query = S.write_ended_attempts(T.stream_lines(spark, str(folder), max_files=1), str(out), str(progress), "3 hours", "1 minute", pattern)
    query.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    got = rows(S.read_ended_attempts(spark, str(out)), *ATTEMPT)
    batch = rows(R.host_attempts(land_run_logs(spark, str(folder), str(tmp_path / "landed"), pattern)), *ATTEMPT)
    assert len(batch) == 6 * 12 and sum(r[5] == "NO_RESULT" for r in batch) == 6
    # The last line is 09:02:00 of the sixth day: the open attempt of 07:00 has 58 minutes left.
    assert got == [r for r in batch if not (r[0].startswith("06") and r[5] == "NO_RESULT")]
    # State holds the hosts of a few hours, not those of all days: a value and a timer each.
    assert len(states) >= 12 and max(states) <= 12 * 5 and max(states[-4:]) <= max(states[:4]) + 10


def test_open_hosts_share_states(spark, tmp_path, monkeypatch):
    """Hosts that go on over two batches, many to a bucket: one state a bucket, the rows of the batch operator."""
    monkeypatch.setattr(S, "BUCKETS", 3)
    folder, out, progress = (tmp_path / n for n in ("in", "out", "progress"))
    place = folder / "run=02012026000000"
    place.mkdir(parents=True)
    opened = [f"[2026-01-02 10:00:{h % 60:02d}] === h{h} === ensuring remote directory exists" for h in range(200)]
    ended = [f"[2026-01-02 10:10:{h % 60:02d}] === h{h}: SUCCESS ===" for h in range(0, 200, 2)]
    for name, lines in (("1", opened), ("2", ended)):
        (place / name).write_text("\n".join(lines) + "\n")
        os.utime(place / name, (int(name), int(name)))
    query = S.write_ended_attempts(T.stream_lines(spark, str(folder), max_files=1), str(out), str(progress), "3 hours", "1 hour", r"run=(\d{14})")
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 3 * 4
    batch = rows(R.host_attempts(land_run_logs(spark, str(folder), str(tmp_path / "landed"), r"run=(\d{14})")), *ATTEMPT)
    assert rows(S.read_ended_attempts(spark, str(out)), *ATTEMPT) == [r for r in batch if r[5] == "SUCCESS"] and len(batch) == 200


def service_file(folder, name, at, *lines):
    (folder / name).write_text("".join(f"[2026-01-02 {t}] [{level}] x\n" if level else f"{t}\n" for t, level in lines))
    os.utime(folder / name, (at, at))


def test_windows_and_late_lines_are_all_lines(spark, tmp_path):
    folder, out, progress = (tmp_path / n for n in ("in", "out", "progress"))
    folder.mkdir()
    service_file(folder, "a", 1, ("10:00:01", "INFO"), ("10:00:59", "INFO"), ("raw output", None), ("10:01:00", "ERROR"))
    service_file(folder, "b", 2, ("12:00:00", "INFO"), ("more output", None), ("10:00:02", "ERROR"))
    # Late by now: the watermark of the batch before is at 11:59.
    service_file(folder, "c", 3, ("10:00:30", "INFO"), ("11:59:30", "INFO"), ("13:00:00", "INFO"))
    service_file(folder, "d", 4, ("23:00:00", "INFO"))
    S.write_level_windows(T.stream_lines(spark, str(folder), max_files=1), str(out), str(progress), "1 minute").awaitTermination()
    found = {kind: S.read_level_windows(spark, str(out), kind) for kind in ("final", "late", "unstamped")}
    late = [r[1:] for r in rows(found["late"], "file", "level", "minute", "lines")]
    assert late == [("INFO", "2026-01-02 10:00:00", "1")]
    # Lines of one batch are judged by the watermark before it.
    assert found["final"].where("minute = '2026-01-02 10:00:00' AND level = 'ERROR'").count() == 1
    assert found["unstamped"].agg({"lines": "sum"}).first()[0] == 2
    all_kinds = found["final"].unionByName(found["late"]).unionByName(found["unstamped"])
    batch = R.level_counts(R.parse_service_lines(read_service_logs(spark, str(folder)))).where("minute IS NULL OR minute < '2026-01-02 23:00:00'")
    columns = ("file", "level", "minute", "lines")
    assert rows(all_kinds, *columns) == rows(batch, *columns)


def test_intervals():
    assert S.milliseconds("10 minutes") == 600_000 and S.milliseconds("1 day") == 86_400_000
