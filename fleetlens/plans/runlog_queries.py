"""Queries over run logs and service logs rendered from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions import text as X
from fleetlens.operators import runlog
from fleetlens.operators.ordered import number_lines, with_part
from fleetlens.plans import samples
from fleetlens.plans.fleet import failure_report, step_report
from fleetlens.plans.registry import query
from fleetlens.plans.samples import table
from fleetlens.sources import growing, logs, sinks
from fleetlens.sources.scratch import scratch_path, stored
from fleetlens.streaming import logs as streaming
from fleetlens.streaming import state

# The events as parsed lines: one row per event, then one summary row per day.
REASON = "CASE user_id % 4 WHEN 0 THEN 'local' WHEN 1 THEN 'SSH connect / mkdir' WHEN 2 THEN 'scp' ELSE 'remote install' END"
STEP = "'step_' || event_id || ' --host ' || owner"
EVENTS = f"""WITH ev AS (SELECT event_id, event_id * 2 AS n, user_id, event_type, date_trunc('second', ts) AS t,
    strftime(ts, '%d%m%Y') || '000000' AS run, {samples.HOST} AS owner FROM events),
  lines AS (SELECT run, n, event_id, user_id, event_type,
    CASE event_type WHEN 'click' THEN CASE event_id % 3 WHEN 0 THEN 'STEP_BEGIN' WHEN 1 THEN 'STEP_OK' ELSE 'STEP_ERR' END
      WHEN 'signup' THEN 'START' WHEN 'view' THEN 'PHASE' ELSE 'RESULT' END AS kind,
    CASE WHEN event_type <> 'click' THEN t END AS ts, CASE WHEN event_type <> 'click' THEN owner END AS host,
    CASE WHEN event_type <> 'click' THEN event_type = 'signup' AND user_id % 2 = 0 END AS local,
    CASE event_type WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'FAILED' END AS status,
    CASE event_type WHEN 'purchase' THEN CASE WHEN user_id % 2 = 0 THEN 'local' END WHEN 'error' THEN {REASON} END AS reason,
    CASE event_type WHEN 'error' THEN './deploy.' || run || '.log' END AS path,
    CASE event_type WHEN 'signup' THEN CASE WHEN user_id % 2 = 0 THEN 'running locally' ELSE 'ensuring remote directory exists' END
      WHEN 'view' THEN 'copying settings files' END AS phase,
    CASE event_type WHEN 'signup' THEN CASE WHEN user_id % 2 = 0 THEN 'run' ELSE 'ensure_dir' END
      WHEN 'view' THEN 'copy' END AS stage,
    CASE event_type WHEN 'click' THEN {STEP} END AS command FROM ev),
  ends AS (SELECT run, max(n) + 1 AS n, max(t) AS ts, count(*) FILTER (event_type IN ('purchase', 'error')) AS total FROM ev GROUP BY 1),
  numbered AS (SELECT *, 1 + count(status) OVER (PARTITION BY run, host ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    AS attempt FROM lines WHERE host IS NOT NULL),
  attempts AS (SELECT run, host, attempt, min(ts) AS started, max(CASE WHEN status IS NOT NULL THEN ts END) AS ended,
    coalesce(max(status), 'NO_RESULT') AS status, max(reason) AS reason, max(CASE WHEN status IS NOT NULL THEN n END) AS n,
    date_diff('second', min(ts), max(CASE WHEN status IS NOT NULL THEN ts END)) AS seconds FROM numbered GROUP BY 1, 2, 3) """
PARSED = "kind, ts, host, local, status, reason, path, phase, stage, command"
ATTEMPT = "run, host, attempt, started, ended, status, reason, seconds"


def parsed_lines(spark, sf_dir):
    return runlog.parse_run_lines(samples.event_lines(spark, sf_dir))


def landed_hosts(spark, sf_dir):
    """Parsed host lines, written once: the ordered operators read them twice."""
    return stored(runlog.host_lines(parsed_lines(spark, sf_dir)), "host-lines")


def landed_attempts(spark, sf_dir):
    return stored(runlog.host_attempts(landed_hosts(spark, sf_dir)), "attempts")


@query(
    "parse_run_log",
    EVENTS
    + f"""SELECT run, n, {PARSED}, NULL AS k, NULL AS total FROM lines UNION ALL
      SELECT run, n, 'SUMMARY', ts, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, total, total FROM ends""",
)
def parse_run_log(spark, sf_dir):
    return parsed_lines(spark, sf_dir).select("run", "n", *PARSED.split(", "), "k", "total")


NUMBERED = (
    EVENTS
    + """SELECT run, strptime(run, '%d%m%Y%H%M%S') AS run_ts, row_number() OVER (PARTITION BY run ORDER BY n) AS line_no, kind, ts,
      host, status, command FROM (SELECT run, n, kind, ts, host, status, command FROM lines UNION ALL
      SELECT run, n, 'SUMMARY', ts, NULL, NULL, NULL FROM ends) AS t"""
)


@query("read_run_logs", NUMBERED)
def read_run_logs(spark, sf_dir):
    """Run logs written as files and read back line by line, with their line numbers."""
    files, out = samples.run_files(spark, sf_dir), scratch_path(spark, "run-lines")
    numbered = number_lines(logs.land_run_logs(spark, files, out, samples.RUN_FOLDER_PATTERN))
    return numbered.select("run", "run_ts", "line_no", "kind", "ts", "host", "status", "command")


@query("run_files_by_stamp", NUMBERED)
def run_files_by_stamp(spark, sf_dir):
    """The same from many files a run, whose names say nothing of their order."""
    files, out = scratch_path(spark, "run-logs"), scratch_path(spark, "run-lines")
    samples.write_run_files(samples.event_lines(spark, sf_dir), files, events=256, named=False)
    numbered = number_lines(logs.land_run_logs(spark, files, out, samples.RUN_FOLDER_PATTERN))
    return numbered.select("run", "run_ts", "line_no", "kind", "ts", "host", "status", "command")


@query(
    "attribute_lines",
    EVENTS
    + """SELECT run, n, kind, CASE WHEN kind <> 'SUMMARY' THEN owner END AS owner FROM (SELECT run, n, kind,
        last_value(host IGNORE NULLS) OVER (PARTITION BY run ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS owner
      FROM (SELECT run, n, kind, host FROM lines UNION ALL SELECT run, n, 'SUMMARY', NULL FROM ends) AS a) AS b""",
)
def attribute_lines(spark, sf_dir):
    parsed = stored(parsed_lines(spark, sf_dir), "run-lines")
    return runlog.attribute_lines(parsed).select("run", "n", "kind", "owner")


@query(
    "step_results",
    EVENTS
    + """SELECT run, owner AS host, 1 + done AS attempt, n, command, kind = 'STEP_ERR' AS failed FROM (SELECT *, count(status) OVER
        (PARTITION BY run, owner ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM (SELECT run, n, kind, command, status,
        last_value(host IGNORE NULLS) OVER (PARTITION BY run ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS owner
      FROM lines) AS b) AS c WHERE kind IN ('STEP_OK', 'STEP_ERR') AND owner IS NOT NULL""",
)
def step_results(spark, sf_dir):
    return runlog.step_results(stored(parsed_lines(spark, sf_dir), "run-lines")).drop("part")


@query(
    "phase_durations",
    EVENTS
    + """SELECT run, host, n, ts, stage, phase, seconds FROM (SELECT *, date_diff('second', ts,
        lead(ts) OVER (PARTITION BY run, host ORDER BY n)) AS seconds FROM lines WHERE host IS NOT NULL) AS t WHERE status IS NULL""",
)
def phase_durations(spark, sf_dir):
    return runlog.phase_durations(landed_hosts(spark, sf_dir)).drop("part")


@query("host_attempts", EVENTS + f"SELECT {ATTEMPT} FROM attempts")
def host_attempts(spark, sf_dir):
    return runlog.host_attempts(landed_hosts(spark, sf_dir)).drop("part", "n")


@query("failure_report", EVENTS + f"SELECT {ATTEMPT} FROM attempts WHERE status <> 'SUCCESS'")
def failures(spark, sf_dir):
    return failure_report(landed_hosts(spark, sf_dir))


@query(
    "steps_reached",
    """SELECT CAST(ts AS DATE) AS run, user_id AS host, event_id AS n, event_type = 'error' AS failed,
      CASE WHEN count(*) FILTER (event_type = 'error') OVER w > 0 THEN 'NOT_RUN' WHEN event_type = 'error' THEN 'FAILED'
        ELSE 'OK' END AS state
    FROM events WINDOW w AS (PARTITION BY CAST(ts AS DATE), user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def steps_reached(spark, sf_dir):
    steps = table(spark, sf_dir, "events").selectExpr(
        "date(ts) AS run", "user_id AS host", "event_id AS n", "event_type = 'error' AS failed"
    )
    return runlog.steps_reached(with_part(steps)).drop("part")


# Per event the host line of its user, the result of a step, and for a third of the events the
# host's own result, after which the host's next lines are another attempt. A run is a day of
# one inventory. Hosts plan two of their commands twice. On odd days the run's is a second
# inventory with the same hosts, fewer steps, and one step without a command.
STEP_EVENTS = """SELECT event_id, strftime(ts, '%d%m%Y') || lpad(CAST(CAST(floor(user_id / 40.0) AS BIGINT) AS VARCHAR), 6, '0') AS run, user_id,
    CAST(floor(user_id / 40.0) AS BIGINT) + 1000000 * (day(ts) % 2) AS inventory,
    CASE WHEN event_id % 7 = 6 THEN 'null' ELSE 'step_' || (event_id % 7 % 3) END AS cmd, value > 45 OR event_id % 7 = 6 AS failed,
    1 + count(*) FILTER (event_id % 3 = 0) OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS attempt FROM events"""


@query(
    "step_report",
    f"""WITH ev AS ({STEP_EVENTS}), seen AS (SELECT run, user_id, attempt, cmd, failed,
        row_number() OVER (PARTITION BY run, user_id, attempt, cmd ORDER BY event_id) AS nth FROM ev),
      planned AS (SELECT c_custkey, CAST(floor(c_custkey / 40.0) AS BIGINT) AS inventory, unnest([0, 1, 2, 3, 4]) AS seq FROM customer
        UNION ALL SELECT c_custkey, CAST(floor(c_custkey / 40.0) AS BIGINT) + 1000000, unnest([0, 1, 2]) FROM customer),
      steps AS (SELECT *, CASE WHEN inventory < 1000000 OR seq <> 1 THEN 'step_' || (seq % 3) END AS install_cmd,
        row_number() OVER (PARTITION BY inventory, c_custkey, CASE WHEN inventory >= 1000000 AND seq = 1 THEN -1 ELSE seq % 3 END ORDER BY seq) AS nth
        FROM planned),
      tried AS (SELECT steps.inventory, runs.run, c_custkey, worked.attempt, seq, install_cmd, failed FROM steps
        JOIN (SELECT DISTINCT run, inventory FROM ev) AS runs ON runs.inventory = steps.inventory
        JOIN (SELECT DISTINCT run, user_id, attempt FROM ev) AS worked ON worked.run = runs.run AND worked.user_id = c_custkey
        LEFT JOIN seen ON seen.run = runs.run AND seen.user_id = c_custkey AND seen.attempt = worked.attempt
          AND seen.cmd = coalesce(install_cmd, 'null') AND seen.nth = steps.nth)
    SELECT inventory, run, 'n' || c_custkey AS hostname, attempt, c_custkey AS server_pos, seq, 0 AS cmd_pos, install_cmd,
      install_cmd IS NULL AS missing,
      CASE WHEN failed IS NULL OR count(*) FILTER (failed) OVER (PARTITION BY run, c_custkey, attempt ORDER BY seq
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 THEN 'NOT_RUN' WHEN failed THEN 'FAILED' ELSE 'OK' END AS state FROM tried""",
)
def planned_steps(spark, sf_dir):
    """Planned steps of customers' hosts against the logged steps of the users with their numbers."""
    events = table(spark, sf_dir, "events").selectExpr(
        "*",
        "concat(date_format(ts, 'ddMMyyyy'), lpad(string(user_id div 40), 6, '0')) AS run",
        "user_id div 40 + 1000000 * (day(ts) % 2) AS inventory",
        "if(value > 45 OR event_id % 7 = 6, 'Error executing: ', 'Successfully executed: ') AS result",
        "if(event_id % 7 = 6, 'null', concat('step_', event_id % 7 % 3)) AS command",
    )
    opening = X.log_line("ts", F.concat(F.lit("=== n"), "user_id", F.lit(" === running installer remotely")))
    ended = F.when(F.expr("event_id % 3 = 0"), X.log_line("ts", F.concat(F.lit("=== n"), "user_id", F.lit(": SUCCESS ==="))))
    lines = events.select("run", "event_id", F.posexplode(F.array(opening, F.concat("result", "command"), ended)).alias("pos", "line"))
    placed = with_part(lines.where("line IS NOT NULL").select("run", F.expr("event_id * 3 + pos").alias("n"), "line"))
    parsed = stored(runlog.parse_run_lines(placed), "run-lines")
    hosts = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS server_pos",
        "concat('n', c_custkey) AS hostname",
        "explode(array(0, 1000000)) AS twin",
        "c_custkey div 40 + twin AS inventory",
        "0 AS cmd_pos",
    )
    steps = hosts.withColumn("seq", F.explode(F.expr("sequence(0, if(twin = 0, 4, 2))")))
    command = F.expr("if(twin = 0 OR seq != 1, concat('step_', seq % 3), NULL)")
    runs = events.select("run", "inventory").distinct()
    return step_report(steps.withColumn("install_cmd", command).drop("twin"), parsed, runs)


@query(
    "failed_hosts",
    EVENTS + "SELECT run, row_number() OVER (PARTITION BY run ORDER BY n) AS idx, host FROM attempts WHERE status = 'FAILED'",
)
def failed_hosts(spark, sf_dir):
    return runlog.failed_hosts(landed_attempts(spark, sf_dir))


OUTCOMES = """, outcomes AS (SELECT run, count(*) AS total, count(*) FILTER (status = 'FAILED') AS failed,
    count(*) FILTER (status = 'SUCCESS') AS succeeded FROM attempts GROUP BY 1) """
OUTCOME = """outcomes.run AS run, outcomes.total AS total, failed, succeeded, outcomes.total - failed - succeeded AS no_result,
  outcomes.total - failed AS claimed, CASE WHEN failed > 0 THEN 'failed' WHEN outcomes.total > failed + succeeded OR outcomes.total = 0
    THEN 'incomplete' ELSE 'ok' END AS verdict"""
# Beside each day's run one that found no servers.
STOPPED = "left(run, 13) || '1'"


@query(
    "run_outcomes",
    EVENTS
    + OUTCOMES
    + f"""SELECT {OUTCOME}, ends.total AS logged_k, ends.total AS logged_total FROM ends LEFT JOIN outcomes ON ends.run = outcomes.run
      UNION ALL SELECT {STOPPED}, 0, 0, 0, 0, 0, 'incomplete', NULL, NULL FROM ends""",
)
def run_outcomes(spark, sf_dir):
    needed = parsed_lines(spark, sf_dir).where("host IS NOT NULL OR kind = 'SUMMARY'")
    stopped = table(spark, sf_dir, "events").groupBy(X.run_id(F.to_date("ts").cast("timestamp_ntz")).alias("run")).agg(F.min("ts").alias("ts"))
    notice = X.log_line("ts", F.lit("No servers found in env.json (or none matched ONLY=)"))
    lines = stopped.select(F.expr(STOPPED).alias("run"), F.lit(0).cast("bigint").alias("n"), notice.alias("line"))
    parsed = stored(needed.unionByName(runlog.parse_run_lines(with_part(lines))), "run-lines")
    return runlog.run_outcomes(runlog.host_attempts(parsed), parsed)


@query(
    "run_outcomes_of_selected",
    EVENTS
    + """, selected AS (SELECT run, count(*) FILTER (event_type <> 'click') AS total FROM ev GROUP BY 1) """
    + OUTCOMES
    + f"SELECT {OUTCOME.replace('outcomes.total', 'selected.total')} FROM outcomes JOIN selected ON selected.run = outcomes.run",
)
def run_outcomes_of_selected(spark, sf_dir):
    """Totals from a selected host list: one host per event of the day, a blank one per click."""
    events = table(spark, sf_dir, "events")
    day = X.run_id(F.to_date("ts").cast("timestamp_ntz"))
    host = F.when(F.col("event_type") == "click", "").otherwise(F.expr(samples.HOST))
    selected = events.select(day.alias("run"), host.alias("hostname"))
    return runlog.run_outcomes(runlog.host_attempts(landed_hosts(spark, sf_dir)), selected=selected)


@query(
    "run_summary",
    EVENTS
    + OUTCOMES
    + f"""SELECT {OUTCOME}, CASE WHEN failed = 0 THEN 'Deployment complete: ' || outcomes.total || '/' || outcomes.total || ' hosts succeeded.'
        ELSE 'Deployment finished with failures on: ' END AS head,
        CASE WHEN failed > 0 THEN ' (' || (outcomes.total - failed) || '/' || outcomes.total || ' succeeded)' END AS tail FROM outcomes""",
)
def run_summary(spark, sf_dir):
    return runlog.run_summary(runlog.run_outcomes(landed_attempts(spark, sf_dir)))


# Service logs

SERVICE = """SELECT CASE WHEN event_type = 'error' THEN 'error' ELSE 'access' END AS sink,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN NULL ELSE 'INFO' END AS level,
    CASE WHEN event_type <> 'click' THEN date_trunc('minute', ts) END AS minute, count(*) AS lines FROM events GROUP BY 1, 2, 3"""


def routed_files(spark, sf_dir):
    path = scratch_path(spark, "service-logs")
    sinks.route_log(samples.service_lines(spark, sf_dir), path)
    return path


@query("route_log", SERVICE)
def route_log(spark, sf_dir):
    """Lines routed to two sinks, read back, and counted by sink, level and minute."""
    parsed = runlog.parse_service_lines(logs.read_service_logs(spark, routed_files(spark, sf_dir)))
    sink = parsed.withColumn("file", F.regexp_extract("file", "sink=([a-z]+)", 1))
    return runlog.level_counts(sink).withColumnRenamed("file", "sink")


@query(
    "level_counts",
    """SELECT CAST(floor(user_id / 10.0) AS BIGINT) AS file, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN NULL ELSE 'INFO' END AS level,
      CASE WHEN event_type <> 'click' THEN date_trunc('minute', ts) END AS minute, count(*) AS lines FROM events GROUP BY 1, 2, 3""",
)
def level_counts(spark, sf_dir):
    """Counts over lines held in a table, ten users to a log."""
    events = table(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") != "click", "INFO")
    line = F.coalesce(X.log_line("ts", "props", level), "props")
    lines = events.select(F.expr("user_id div 10").alias("file"), line.alias("line"))
    return runlog.level_counts(runlog.parse_service_lines(lines))


# Streams


@query(
    "stream_attempts",
    EVENTS.replace("strftime(ts, '%d%m%Y') || '000000'", samples.SHORT_RUN) + f"SELECT {ATTEMPT} FROM attempts",
)
def stream_attempts(spark, sf_dir):
    """Attempts of arriving run-log files, one file per run, written batch by batch."""
    files = scratch_path(spark, "arriving")
    lines = samples.event_lines(spark, sf_dir, samples.SHORT_RUN)
    lines.repartition("run").sortWithinPartitions("run", "n").select("run", "line").write.partitionBy("run").text(files)
    out = scratch_path(spark, "attempts")
    stream = streaming.stream_lines(spark, files, max_files=samples.files_a_batch(spark, files))
    streaming.write_attempts(stream, out, scratch_path(spark, "progress"), samples.RUN_FOLDER_PATTERN).awaitTermination()
    return streaming.read_attempts(spark, out)


@query(
    "stream_growing_files",
    EVENTS.replace("strftime(ts, '%d%m%Y') || '000000'", samples.SHORT_RUN) + f"SELECT {ATTEMPT} FROM attempts",
)
def stream_growing_files(spark, sf_dir):
    """Attempts of run logs that are read while they are written: three looks, cut within lines."""
    files, out, progress = (scratch_path(spark, name) for name in ("growing", "attempts", "progress"))
    lines = stored(samples.event_lines(spark, sf_dir, samples.SHORT_RUN).select("run", "n", "line"), "lines")
    for share in (0.4, 0.75, 1.0):
        samples.grow_run_files(lines, files, share)
        stream = growing.stream_growing(spark, files)
        streaming.write_attempts(stream, out, progress, samples.RUN_FOLDER_PATTERN).awaitTermination()
    return streaming.read_attempts(spark, out)


@query("stream_attempts_stateful", EVENTS + f"SELECT {ATTEMPT} FROM attempts")
def stream_attempts_stateful(spark, sf_dir):
    """Attempts of runs that arrive in several files, in batches that cut them."""
    files, out = samples.run_files(spark, sf_dir), scratch_path(spark, "attempts")
    stream = streaming.stream_lines(spark, files, max_files=samples.files_a_batch(spark, files))
    streaming.write_attempts(stream, out, scratch_path(spark, "progress"), samples.RUN_FOLDER_PATTERN).awaitTermination()
    return streaming.read_attempts(spark, out)


#: Attempts with a result, and others once the watermark is a day past their host's last line.
ENDED = f"""SELECT {ATTEMPT} FROM attempts WHERE status <> 'NO_RESULT' OR (run, host) IN (SELECT (run, host) FROM lines WHERE host IS NOT NULL
    GROUP BY run, host HAVING max(ts) + INTERVAL 1 DAY < (SELECT max(ts) - INTERVAL 10 MINUTE FROM lines WHERE host IS NOT NULL))"""


@query("stream_ended_attempts", EVENTS + ENDED)
def stream_ended_attempts(spark, sf_dir):
    """Attempts as they end, over three deliveries that cut runs, with state for open hosts only."""
    out, progress = scratch_path(spark, "ended"), scratch_path(spark, "progress")
    lines = samples.event_lines(spark, sf_dir)
    files = scratch_path(spark, "arriving")
    last = table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0
    for delivery in range(3):
        low, high = (2 * (last + 1) * k // 3 for k in (delivery, delivery + 1))
        samples.write_run_files(lines.where(f"n >= {low} AND n < {high + 2 * (delivery == 2)}"), f"{files}/{delivery}")
        stream = streaming.stream_lines(spark, files)
        state.write_ended_attempts(stream, out, progress, "1 day", "10 minutes", samples.RUN_FOLDER_PATTERN).awaitTermination()
    return state.read_ended_attempts(spark, out)


@query(
    "stream_level_windows",
    """WITH ev AS (SELECT *, user_id % 7 AS file, CASE WHEN event_type <> 'click' THEN date_trunc('minute', ts) END AS minute,
        CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN NULL ELSE 'INFO' END AS level, user_id % 5 = 0 AS held_back,
        (SELECT date_trunc('second', max(ts)) - INTERVAL 10 MINUTE FROM events WHERE event_type <> 'click' AND user_id % 5 <> 0) AS mark,
        (SELECT date_trunc('second', max(ts)) - INTERVAL 10 MINUTE FROM events WHERE event_type <> 'click') AS final_mark FROM events)
      SELECT file, level, minute, CASE WHEN minute IS NULL THEN 'unstamped' WHEN held_back AND minute + INTERVAL 1 MINUTE <= mark THEN 'late'
        ELSE 'final' END AS kind, count(*) AS lines FROM ev WHERE minute IS NULL OR minute + INTERVAL 1 MINUTE <= final_mark
        OR held_back AND minute + INTERVAL 1 MINUTE <= mark GROUP BY ALL""",
)
def stream_level_windows(spark, sf_dir):
    """Minutes that the watermark has passed, and beside them late and unstamped lines: a fifth of the users deliver late."""
    files, out, progress = (scratch_path(spark, name) for name in ("service-logs", "windows", "progress"))
    for late in (False, True):
        users = table(spark, sf_dir, "events").where(F.expr("user_id % 5 = 0") == late)
        lines = samples.service_lines(spark, sf_dir, users).select("line", "log")
        lines.repartition("log").write.partitionBy("log").text(f"{files}/late={late}")
        state.write_level_windows(streaming.stream_lines(spark, files), out, progress).awaitTermination()
    log = F.regexp_extract("file", r"log=(\d+)", 1).cast("bigint")
    found = [state.read_level_windows(spark, out, kind).withColumn("kind", F.lit(kind)) for kind in ("final", "late", "unstamped")]
    counts = found[0].unionByName(found[1]).unionByName(found[2]).groupBy(log.alias("file"), "level", "minute", "kind")
    return counts.agg(F.sum("lines").alias("lines"))


@query(
    "stream_levels",
    """SELECT user_id % 7 AS file, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN NULL ELSE 'INFO' END AS level,
      CASE WHEN event_type <> 'click' THEN date_trunc('minute', ts) END AS minute, count(*) AS lines FROM events GROUP BY 1, 2, 3""",
)
def stream_levels(spark, sf_dir):
    """Counts per log, level and minute of lines that arrive in any order, unstamped ones included."""
    files = scratch_path(spark, "service-logs")
    samples.service_lines(spark, sf_dir).select("line", "log").repartition("log").write.partitionBy("log").text(files)
    out = scratch_path(spark, "levels")
    stream = streaming.stream_lines(spark, files, max_files=3)
    streaming.write_level_counts(stream, out, scratch_path(spark, "progress")).awaitTermination()
    log = F.regexp_extract("file", r"log=(\d+)", 1).cast("bigint")
    counts = streaming.read_level_counts(spark, out).groupBy(log.alias("file"), "level", "minute")
    return counts.agg(F.sum("lines").alias("lines"))
