"""Run logs: hand-written golden files."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import runlog as R
from fleetlens.operators.ordered import number_lines
from fleetlens.plans.fleet import step_report
from fleetlens.sources.logs import land_run_logs, read_run_logs, read_service_logs

MIXED = """\
[2026-01-02 10:00:00] === 10.0.0.1 (control server itself) === running locally
Executing: a_install
some tool output

Successfully executed: a_install
[2026-01-02 10:01:30] === 10.0.0.1: SUCCESS (local) ===
[2026-01-02 10:01:30] === 10.0.0.2 === ensuring remote directory exists
[2026-01-02 10:01:31] === 10.0.0.2 === copying settings files
[2026-01-02 10:01:31] === 10.0.0.2 === running installer remotely
Executing: b_install
Error executing: b_install
[2026-01-02 10:02:00] === 10.0.0.2: FAILED (remote install) -- see ./deploy.02012026100000.log ===
[2026-01-02 10:02:00] === 10.0.0.3 === ensuring remote directory exists
[2026-01-02 10:02:10] === 10.0.0.3: FAILED (SSH connect / mkdir) -- see ./deploy.02012026100000.log ===
[2026-01-02 10:02:10] Deployment finished with failures on: 10.0.0.2 10.0.0.3 (1/3 succeeded)
[2026-01-02 10:02:10] Full details in ./deploy.02012026100000.log
"""
ALL_OK = """\
[2026-02-02 09:00:00] keys are blank or placeholders -- generating them once
[2026-02-02 09:00:00] === 10.0.0.1 (control server itself) === running locally
[2026-02-02 09:00:05] === 10.0.0.1: SUCCESS (local) ===
[2026-02-02 09:00:05] === 10.0.0.2 === ensuring remote directory exists
[2026-02-02 09:00:06] === 10.0.0.2 === copying settings files
[2026-02-02 09:00:08] === 10.0.0.2 === running installer remotely
No install commands found for host 10.0.0.9 in the inventory
[2026-02-02 09:00:20] === 10.0.0.2: SUCCESS ===
[2026-02-02 09:00:20] Deployment complete: 2/2 hosts succeeded.
"""
TWICE_THEN_CUT = """\
[2026-01-15 08:00:00] === 10.0.0.4 === ensuring remote directory exists
[2026-01-15 08:00:07] === 10.0.0.4: FAILED (scp) -- see ./deploy.15012026080000.log ===
[2026-01-15 08:00:07] === 10.0.0.4 === ensuring remote directory exists
[2026-01-15 08:00:09] === 10.0.0.4: SUCCESS ===
[2026-01-15 08:00:09] === 10.0.0.5 === ensuring remote directory exists
"""
RUNS = {"02012026100000": MIXED, "02022026090000": ALL_OK, "15012026080000": TWICE_THEN_CUT}


@pytest.fixture(scope="module", params=["whole files", "many pieces"])
def files(request, spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("runs")
    for run, text in RUNS.items():
        (folder / f"deploy.{run}.log").write_text(text)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if request.param == "many pieces":
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    yield read_run_logs(spark, str(folder)), str(folder)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)


@pytest.fixture(scope="module")
def parsed(spark, files, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("landed") / "runs")
    table = land_run_logs(spark, files[1], out)
    return table.drop("run_date").coalesce(4)


@pytest.fixture(scope="module")
def lines(files):
    return files[0]


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_lines_are_whole_and_ordered(spark, tmp_path, lines):
    numbered = number_lines(lines).where("run = '02012026100000'").orderBy("line_no")
    assert [r.line for r in numbered.collect()] == [x for x in MIXED.split("\n") if x]
    assert [r.line_no for r in numbered.collect()] == list(range(1, 16))


def test_runs_order_by_time_not_by_text(lines):
    got = rows(lines.select("run", "run_ts").distinct(), "run_ts")
    assert [r[0] for r in got] == ["02012026100000", "15012026080000", "02022026090000"]
    assert got[0][1] == datetime(2026, 1, 2, 10)


def test_kinds(parsed):
    kinds = number_lines(parsed).where("run = '02012026100000'").orderBy("line_no")
    assert [r.kind for r in kinds.collect()] == [
        "START", "STEP_BEGIN", "OTHER", "STEP_OK", "RESULT", "START", "PHASE", "PHASE", "STEP_BEGIN",
        "STEP_ERR", "RESULT", "START", "RESULT", "SUMMARY", "DETAILS",
    ]


def test_parts_of_host_lines(parsed):
    got = parsed.where("kind = 'RESULT' AND run = '02012026100000'").select("host", "local", "status", "reason", "path")
    log = "./deploy.02012026100000.log"
    assert rows(got, "host") == [
        ("10.0.0.1", False, "SUCCESS", "local", None),
        ("10.0.0.2", False, "FAILED", "remote install", log),
        ("10.0.0.3", False, "FAILED", "SSH connect / mkdir", log),
    ]
    summary = parsed.where("kind = 'SUMMARY'").select("run", "k", "total")
    assert rows(summary, "run") == [("02012026100000", 1, 3), ("02022026090000", 2, 2)]


def test_attempts(parsed):
    got = R.host_attempts(parsed).select("run", "host", "attempt", "status", "reason", "seconds")
    assert rows(got, "run", "host", "attempt") == [
        ("02012026100000", "10.0.0.1", 1, "SUCCESS", "local", 90),
        ("02012026100000", "10.0.0.2", 1, "FAILED", "remote install", 30),
        ("02012026100000", "10.0.0.3", 1, "FAILED", "SSH connect / mkdir", 10),
        ("02022026090000", "10.0.0.1", 1, "SUCCESS", "local", 5),
        ("02022026090000", "10.0.0.2", 1, "SUCCESS", None, 15),
        ("15012026080000", "10.0.0.4", 1, "FAILED", "scp", 7),
        ("15012026080000", "10.0.0.4", 2, "SUCCESS", None, 2),
        ("15012026080000", "10.0.0.5", 1, "NO_RESULT", None, None),
    ]


def test_seconds_do_not_depend_on_the_session_zone(spark, parsed):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        across = spark.sql(
            "SELECT 'r' AS run, 0L AS part, id AS n, concat('[2026-03-08 0', if(id = 0, '1:59:50', '3:00:10'),"
            " '] === h', if(id = 0, ' === ensuring remote directory exists', ': SUCCESS ===')) AS line FROM range(2)"
        )
        got = R.host_attempts(R.parse_run_lines(across)).collect()
        assert [r.seconds for r in got] == [3620]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


# Seconds that each host's lines take after one another: the wording of a real run, invented times.
REMOTE_PHASES = ["ensuring remote directory exists", "copying settings files", "running installer remotely"]
INVENTED = {
    "03032026070000": [[75], [2, 1, 90], [0, 0, 61], [5, 0, 33]],
    "04032026235900": [[20], [1, 1, 200], [3, 2, 40], [0, 4, 8]],
}


def test_invented_durations(spark):
    lines = []
    for run, hosts in INVENTED.items():
        now = datetime.strptime(run, "%d%m%Y%H%M%S")
        for i, steps in enumerate(hosts):
            marker = "" if i else " (control server itself)"
            for phase, seconds in zip(REMOTE_PHASES if i else ["running locally"], steps, strict=True):
                lines.append((run, f"[{now}] === h{i}{marker} === {phase}"))
                now += timedelta(seconds=seconds)
            lines.append((run, f"[{now}] === h{i}: SUCCESS{'' if i else ' (local)'} ==="))
        lines.append((run, f"[{now}] Deployment complete: 4/4 hosts succeeded."))
    # Pieces of five lines, so attempts run on from piece to piece.
    rows_in = [(run, i // 5, i, line) for i, (run, line) in enumerate(lines)]
    parsed = R.parse_run_lines(spark.createDataFrame(rows_in, "run string, part long, n long, line string"))
    attempts = R.host_attempts(parsed)
    seconds = [r.seconds for r in attempts.orderBy("run", "host").collect()]
    assert seconds == [sum(steps) for hosts in INVENTED.values() for steps in hosts]
    stages = R.phase_durations(parsed).where("host = 'h1'").orderBy("run", "n").collect()
    assert [(r.stage, r.seconds) for r in stages] == [
        ("ensure_dir", 2), ("copy", 1), ("run", 90), ("ensure_dir", 1), ("copy", 1), ("run", 200),
    ]
    outcome = R.run_outcomes(attempts, parsed).select("total", "succeeded", "logged_k", "logged_total", "verdict").collect()
    assert [tuple(r) for r in outcome] == [(4, 4, 4, 4, "ok")] * 2


def test_attempts_over_many_pieces_match_a_plain_loop(spark):
    rng = random.Random(3)
    rows_in, expected, n = [], [], 0
    for run in ("a", "b"):
        state = {}
        for _ in range(400):
            host = rng.choice(["h", "h", "h", "g", "k"])
            n += 1
            ts = datetime(2026, 1, 1) + timedelta(seconds=n // 2)
            status = rng.choice([None] * 5 + ["SUCCESS", "FAILED"])
            reason = rng.choice([None, "scp"]) if status else None
            rows_in.append((run, n // 7, n, host, ts, status, reason))
            number, first = state.get(host, (1, None))
            first = first or ts
            if status:
                expected.append((run, host, number, first, ts, status, reason, int((ts - first).total_seconds()), n))
                state[host] = (number + 1, None)
            else:
                state[host] = (number, first)
        expected += [(run, h, k, t, None, "NO_RESULT", None, None, None) for h, (k, t) in state.items() if t]
    parsed = spark.createDataFrame(
        rows_in, "run string, part long, n long, host string, ts timestamp_ntz, status string, reason string"
    )
    attempts = R.host_attempts(parsed)
    got = [tuple(r) for r in attempts.drop("part").collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_attempts_are_moved_three_times_and_hashed(spark, parsed):
    for df in (R.host_attempts(parsed), R.attribute_lines(parsed)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan
    plan = R.host_attempts(parsed)._jdf.queryExecution().executedPlan().toString()
    # Before stages run a reused exchange is still printed where it is reused.
    moved = set(re.findall(r"Exchange (hashpartitioning\(.*?\))", re.sub(r"#\d+L?", "", plan)))
    assert len(moved) <= 3 and "ObjectHash" not in plan, moved


def test_bare_lines_belong_to_the_host_above(parsed):
    owned = number_lines(R.attribute_lines(parsed)).where("host IS NULL")
    got = rows(owned.select("run", "line_no", "kind", "owner"), "run", "line_no")
    assert [g[2:] for g in got if g[0] == "02012026100000"] == [
        ("STEP_BEGIN", "10.0.0.1"), ("OTHER", "10.0.0.1"), ("STEP_OK", "10.0.0.1"),
        ("STEP_BEGIN", "10.0.0.2"), ("STEP_ERR", "10.0.0.2"), ("SUMMARY", None), ("DETAILS", None),
    ]
    assert [g[2:] for g in got if g[0] == "02022026090000"] == [
        ("NOTICE", None), ("NOTICE", "10.0.0.2"), ("SUMMARY", None),
    ]


def test_phase_durations(parsed):
    got = R.phase_durations(parsed).select("run", "host", "stage", "ts", "seconds")
    assert [(r[1], r[2], r[4]) for r in rows(got, "run", "ts", F.desc("seconds"), "stage", "host")] == [
        ("10.0.0.1", "run", 90), ("10.0.0.2", "ensure_dir", 1), ("10.0.0.2", "run", 29),
        ("10.0.0.2", "copy", 0), ("10.0.0.3", "ensure_dir", 10),
        ("10.0.0.1", "run", 5), ("10.0.0.2", "ensure_dir", 1), ("10.0.0.2", "copy", 2), ("10.0.0.2", "run", 12),
        ("10.0.0.4", "ensure_dir", 7), ("10.0.0.4", "ensure_dir", 2), ("10.0.0.5", "ensure_dir", None),
    ]


def test_outcomes_count_three_states(parsed):
    got = R.run_outcomes(R.host_attempts(parsed), parsed)
    assert rows(got, "run") == [
        ("02012026100000", 3, 2, 1, 0, 1, "failed", 1, 3),
        ("02022026090000", 2, 0, 2, 0, 2, "ok", 2, 2),
        ("15012026080000", 3, 1, 1, 1, 2, "failed", None, None),
    ]


def test_every_run_has_an_outcome(spark):
    lines = [
        ("none", "[2026-01-02 10:00:00] No servers found in env.json (or none matched ONLY=x)"),
        ("cut", "[2026-01-02 10:00:00] === h === ensuring remote directory exists"),
        ("raw", "some output"),
    ]
    frame = spark.createDataFrame([(r, 0, 0, t) for r, t in lines], "run string, part long, n long, line string")
    parsed = R.parse_run_lines(frame)
    got = R.run_outcomes(R.host_attempts(parsed), parsed).select("run", "total", "succeeded", "no_result", "verdict")
    assert rows(got, "run") == [("cut", 1, 0, 1, "incomplete"), ("none", 0, 0, 0, "incomplete"), ("raw", 0, 0, 0, "incomplete")]


def test_interrupted_run_shows_hosts_it_never_reached(spark, parsed):
    selected = spark.createDataFrame(
        [("15012026080000", f"10.0.0.{i}") for i in (4, 4, 5, 6, 7)] + [("15012026080000", ""), ("never", "h")],
        "run string, hostname string",
    )
    got = R.run_outcomes(R.host_attempts(parsed).where("run = '15012026080000'"), selected=selected)
    assert rows(got, "run") == [("15012026080000", 5, 1, 1, 3, 4, "failed"), ("never", 1, 0, 0, 1, 1, "incomplete")]


def test_messages(parsed):
    attempts = R.host_attempts(parsed)
    failed = {}
    for r in R.failed_hosts(attempts).orderBy("run", "idx").collect():
        failed.setdefault(r.run, []).append(r.host)
    got = R.run_summary(R.run_outcomes(attempts)).collect()
    assert {r.run: r.head + " ".join(failed.get(r.run, [])) + (r.tail or "") for r in got} == {
        "02012026100000": "Deployment finished with failures on: 10.0.0.2 10.0.0.3 (1/3 succeeded)",
        "02022026090000": "Deployment complete: 2/2 hosts succeeded.",
        "15012026080000": "Deployment finished with failures on: 10.0.0.4 (2/3 succeeded)",
    }


def test_step_results_and_steps_behind_a_failure(spark, parsed):
    got = R.step_results(parsed).select("run", "host", "attempt", "command", "failed")
    assert rows(got, "run", "host") == [
        ("02012026100000", "10.0.0.1", 1, "a_install", False),
        ("02012026100000", "10.0.0.2", 1, "b_install", True),
    ]
    steps = spark.createDataFrame(
        [("r", "h", 0, n, n == 2) for n in range(5)] + [("r", "g", 0, 0, False)],
        "run string, host string, part long, n long, failed boolean",
    )
    got = R.steps_reached(steps).select("host", "n", "state")
    assert rows(got, "host", "n") == [
        ("g", 0, "OK"), ("h", 0, "OK"), ("h", 1, "OK"), ("h", 2, "FAILED"), ("h", 3, "NOT_RUN"), ("h", 4, "NOT_RUN"),
    ]


def test_step_report(spark, parsed):
    steps = spark.createDataFrame(
        [("i", 0, "10.0.0.1", 0, 0, "a_install"), ("i", 1, "10.0.0.2", 0, 0, "b_install"), ("i", 1, "10.0.0.2", 1, 0, "c"),
         ("i", 2, "10.0.0.3", 0, 0, "d"), ("i", 2, "10.0.0.3", 1, 0, None), ("i", 3, "10.0.0.9", 0, 0, "e")],
        "inventory string, server_pos int, hostname string, seq int, cmd_pos int, install_cmd string",
    )
    runs = spark.createDataFrame([("02012026100000", "i")], "run string, inventory string")
    got = step_report(steps, parsed, runs).select("hostname", "seq", "install_cmd", "missing", "state")
    assert rows(got, "hostname", "seq") == [
        ("10.0.0.1", 0, "a_install", False, "OK"), ("10.0.0.2", 0, "b_install", False, "FAILED"), ("10.0.0.2", 1, "c", False, "NOT_RUN"),
        ("10.0.0.3", 0, "d", False, "NOT_RUN"), ("10.0.0.3", 1, None, True, "NOT_RUN"),
    ]


def test_a_command_planned_several_times(spark):
    """Each planned step has the result of its own turn; a step without a command is one named null."""
    def attempt(*results):
        lines = ["[2026-01-02 10:00:00] === h === running installer remotely"]
        for verb, command in results:
            lines += [f"Executing: {command}", f"{verb}: {command}"]
        return [*lines, "[2026-01-02 10:00:09] === h: SUCCESS ==="]

    ok, bad = "Successfully executed", "Error executing"
    lines = attempt((ok, "sync"), (ok, "b"), (bad, "sync")) + attempt((ok, "sync"), (ok, "b"), (ok, "sync"), (bad, "null")) + attempt((bad, "sync"))
    # Pieces of three lines: the turns of a command are counted across them.
    rows_in = [("r", i // 3, i, line) for i, line in enumerate(lines)]
    parsed = R.parse_run_lines(spark.createDataFrame(rows_in, "run string, part long, n long, line string"))
    steps = spark.createDataFrame(
        [("i", 0, "h", 0, 0, "sync"), ("i", 0, "h", 0, 1, "b"), ("i", 0, "h", 1, 0, "sync"), ("i", 0, "h", 2, 0, None), ("i", 0, "h", 3, 0, "sync")],
        "inventory string, server_pos int, hostname string, seq int, cmd_pos int, install_cmd string",
    )
    got = step_report(steps, parsed, spark.createDataFrame([("r", "i")], "run string, inventory string"))
    states = {}
    for r in got.orderBy("attempt", "seq", "cmd_pos").collect():
        states.setdefault(r["attempt"], []).append(r["state"])
    skipped = "NOT_RUN"
    assert states == {
        1: ["OK", "OK", "FAILED", skipped, skipped],
        2: ["OK", "OK", "OK", "FAILED", skipped],
        3: ["FAILED", skipped, skipped, skipped, skipped],
    }
    assert [r["seq"] for r in got.where("missing").select("seq").distinct().collect()] == [2]


def test_steps_of_a_retried_host_and_of_a_host_in_two_inventories(spark):
    lines = [
        "[2026-01-02 10:00:00] === h === running installer remotely", "Error executing: a",
        "[2026-01-02 10:00:01] === h: FAILED (remote install) -- see x ===",
        "[2026-01-02 10:00:02] === h === running installer remotely", "Successfully executed: a", "Successfully executed: b",
        "[2026-01-02 10:00:03] === h: SUCCESS ===",
    ]
    rows_in = [(run, i // 2, i, line) for run in ("r1", "r2") for i, line in enumerate(lines)]
    parsed = R.parse_run_lines(spark.createDataFrame(rows_in, "run string, part long, n long, line string"))
    steps = spark.createDataFrame(
        [("i1", 0, "h", 0, 0, "a"), ("i1", 0, "h", 0, 1, "b"), ("i2", 0, "h", 0, 0, "b")],
        "inventory string, server_pos int, hostname string, seq int, cmd_pos int, install_cmd string",
    )
    runs = spark.createDataFrame([("r1", "i1"), ("r2", "i2")], "run string, inventory string")
    got = step_report(steps, parsed, runs).select("run", "inventory", "attempt", "install_cmd", "state")
    assert rows(got, "run", "attempt", "install_cmd") == [
        ("r1", "i1", 1, "a", "FAILED"), ("r1", "i1", 1, "b", "NOT_RUN"),
        ("r1", "i1", 2, "a", "OK"), ("r1", "i1", 2, "b", "OK"),
        ("r2", "i2", 1, "b", "NOT_RUN"), ("r2", "i2", 2, "b", "OK"),
    ]


def test_service_logs_keep_tool_output(spark, tmp_path):
    (tmp_path / "x.access.log").write_text(
        "[2026-01-02 10:00:01] [INFO] one\nraw output\n\n[2026-01-02 10:00:59] [INFO] two\n"
        "[2026-01-02 10:01:00] [ERROR] three\n[not a stamp] [INFO] four\n[2026-13-02 10:01:00] [INFO] five\n"
    )
    parsed = R.parse_service_lines(read_service_logs(spark, str(tmp_path)))
    assert rows(parsed.select("level", "message", "ts"), "message") == [
        (None, "[not a stamp] [INFO] four", None),
        ("INFO", "five", None),
        ("INFO", "one", datetime(2026, 1, 2, 10, 0, 1)),
        (None, "raw output", None),
        ("ERROR", "three", datetime(2026, 1, 2, 10, 1)),
        ("INFO", "two", datetime(2026, 1, 2, 10, 0, 59)),
    ]
    counts = R.level_counts(parsed).select("level", "minute", "lines")
    assert set(map(tuple, counts.collect())) == {
        (None, None, 2), ("INFO", None, 1), ("INFO", datetime(2026, 1, 2, 10), 2),
        ("ERROR", datetime(2026, 1, 2, 10, 1), 1),
    }
