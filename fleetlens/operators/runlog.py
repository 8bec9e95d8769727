"""Run logs: line kinds, host attempts, phases, steps, outcomes; service-log levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions import text as X
from fleetlens.operators.ordered import earlier_count, fill_forward, next_value

SEP = "\u0001"


def _rest(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), F.substr(c, F.lit(len(prefix) + 1)))


def _stage(phase: Column) -> Column:
    word = F.substring_index(phase, " ", 1)
    out = F.lit(None).cast("string")
    for first, stage in C.STAGES.items():
        out = F.when(word == first, stage).otherwise(out)
    return out


def _with_groups(df: DataFrame, line: Column, pattern: str, n: int, candidate: Column) -> DataFrame:
    """Add ``__g``: the groups of one match of ``pattern``, or the whole line if it does not match."""
    joined = F.regexp_replace(line, pattern, SEP.join(f"${i}" for i in range(1, n + 1)))
    return df.select("*", F.explode(F.array(F.when(candidate, F.split(joined, SEP, n)))).alias("__g"))


def parse_run_lines(lines: DataFrame, ts_type: str = "timestamp_ntz") -> DataFrame:
    """Classify each line and pull out its parts; unknown lines stay, as OTHER.

    One pattern match per host line; lines that cannot be host lines are not matched at all.
    The matched groups go through a one-element explode: a filter on a part of the line
    then reads the groups instead of being rewritten into more pattern matches.
    """
    line = F.col("line")
    stamp = F.regexp_extract(line, C.STAMP_PATTERN, 1)
    staged = lines.withColumn("__stamp", F.when(line.startswith("["), stamp))
    message = F.when(F.col("__stamp") != "", F.substr(line, F.lit(23)))
    staged = staged.withColumn("__msg", message)
    msg = F.col("__msg")
    staged = _with_groups(staged, line, C.HOST_PATTERN, 6, msg.startswith("=== "))
    # An unmatched line comes back whole, so its first piece holds the blanks of the stamp.
    is_host = (F.size("__g") == 6) & ~F.contains(F.col("__g")[0], F.lit(" "))

    def group(i: int) -> Column:
        return F.when(is_host, X.present(F.col("__g")[i]))

    staged = staged.select(
        *lines.columns,
        "__msg",
        F.col("__stamp").try_cast(ts_type).alias("ts"),
        group(0).alias("host"),
        F.when(is_host, F.col("__g")[1] != "").alias("local"),
        group(2).alias("status"),
        group(3).alias("reason"),
        F.coalesce(group(4), _rest(msg, C.DETAILS_PREFIX)).alias("path"),
        group(5).alias("phase"),
        F.when(msg.isNull(), F.coalesce(*[_rest(line, p) for p in C.STEP_PREFIXES.values()])).alias("command"),
        *[
            F.when(msg.startswith("Deployment "), X.present(F.regexp_extract(msg, C.SUMMARY_PATTERN, i)))
            .try_cast("bigint")
            .alias(name)
            for i, name in ((1, "k"), (2, "total"))
        ],
    ).withColumn("stage", _stage(F.col("phase")))
    kind = (
        F.when(F.col("status").isNotNull(), "RESULT")
        .when(F.col("host").isNotNull() & (F.col("local") | (F.col("stage") == "ensure_dir")), "START")
        .when(F.col("host").isNotNull(), "PHASE")
        .when(F.col("k").isNotNull(), "SUMMARY")
        .when(msg.startswith(C.DETAILS_PREFIX), "DETAILS")
        .when(msg.isNotNull() | line.startswith(C.NO_STEPS_PREFIX), "NOTICE")
    )
    for name, prefix in C.STEP_PREFIXES.items():
        kind = kind.when(line.startswith(prefix), name)
    return staged.withColumn("kind", kind.otherwise("OTHER")).drop("__msg")


def host_lines(parsed: DataFrame) -> DataFrame:
    return parsed.where("host IS NOT NULL")


def attribute_lines(parsed: DataFrame) -> DataFrame:
    """Add ``owner``: the host of the line, for a bare line that of the last host line above.

    Stamped lines without a host (summary, notices) belong to no host.
    """
    filled = fill_forward(parsed, "host", ["run"], "owner")
    is_bare = F.col("ts").isNull() & ~F.col("kind").isin("SUMMARY", "DETAILS")
    return filled.withColumn("owner", F.when(F.col("host").isNotNull() | is_bare, F.col("owner")))


def number_attempts(parsed: DataFrame) -> DataFrame:
    """Host lines with ``attempt``: 1 + the results the host already has in the run."""
    done = F.col("status").isNotNull()
    counted = earlier_count(host_lines(parsed), done, ["run", "host"], "attempt")
    return counted.withColumn("attempt", F.col("attempt") + 1)


def host_attempts(parsed: DataFrame) -> DataFrame:
    """One row per (run, host, attempt); NO_RESULT when the log has no result line for it.

    ``part`` and ``n`` are the place of the result line. The lines of a host are moved once,
    by piece. An attempt is its last line in a piece, with the time of its first; an attempt
    that goes on into later pieces hands that time over, one row a piece.
    """
    return join_pieces(piece_attempts(parsed))


def piece_attempts(parsed: DataFrame) -> DataFrame:
    """The attempts of each (run, host) as far as one piece tells: the last line of each in the piece.

    ``nth`` counts the results above it in the piece, ``first`` and ``until`` are the earliest and latest time of
    its lines there. Depends on nothing outside the piece, so pieces may be worked out as they come.
    """
    keys = ["run", "host"]
    lines = host_lines(parsed).select(*keys, "part", "n", "ts", "status", "reason")
    piece = Window.partitionBy(*keys, "part").orderBy("n")
    local = lines.withColumns(
        {
            "nth": F.count("status").over(piece.rowsBetween(Window.unboundedPreceding, -1)),
            "__last": F.lead(F.lit(1)).over(piece).isNull(),
        }
    )
    attempt = Window.partitionBy(*keys, "part", "nth")
    spans = local.withColumns({"first": F.min("ts").over(attempt), "until": F.max("ts").over(attempt)})
    return spans.where(F.col("status").isNotNull() | F.col("__last")).drop("__last")


def join_pieces(ends: DataFrame) -> DataFrame:
    """Attempts from those of all pieces (``piece_attempts``), one that spans pieces being one row."""
    keys = ["run", "host"]
    done = F.col("status").isNotNull()
    pieces = ends.groupBy(*keys, "part").agg(
        F.count("status").alias("__done"), F.min(F.when(~done, F.col("first"))).alias("__open")
    )
    order = Window.partitionBy(*keys).orderBy("part")
    upto, above = (order.rowsBetween(Window.unboundedPreceding, k) for k in (Window.currentRow, -1))
    # Pieces since the last one with a result share an attempt that is open at their end.
    pieces = pieces.withColumn("__group", F.count_if(F.col("__done") > 0).over(upto))
    since = Window.partitionBy(*keys, "__group").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.withColumn("__open", F.min("__open").over(since))
    carry = pieces.select(
        *keys,
        "part",
        F.coalesce(F.sum("__done").over(above), F.lit(0)).alias("__before"),
        F.lag("__open").over(order).alias("__from"),
        F.lead(F.lit(1)).over(order).isNull().alias("__tail"),
    )
    found = ends.join(carry, [*keys, "part"]).where(done | F.col("__tail"))
    started = F.least("first", F.when(F.col("nth") == 0, F.col("__from")))
    return (
        found.select(
            *keys,
            (F.col("nth") + F.col("__before") + 1).alias("attempt"),
            started.alias("started"),
            F.when(done, F.col("ts")).alias("ended"),
            F.coalesce("status", F.lit("NO_RESULT")).alias("status"),
            "reason",
            F.when(done, F.col("part")).alias("part"),
            F.when(done, F.col("n")).alias("n"),
        )
        .withColumn("seconds", X.seconds_between("started", "ended"))
        .select(*keys, "attempt", "started", "ended", "status", "reason", "seconds", "part", "n")
    )


def phase_durations(parsed: DataFrame) -> DataFrame:
    """Seconds from each phase line to the host's next line in the run; NULL for the last."""
    after = next_value(host_lines(parsed), "ts", ["run", "host"], "next_ts")
    return (
        after.where("status IS NULL")
        .withColumn("seconds", X.seconds_between("ts", "next_ts"))
        .select("run", "host", "part", "n", "ts", "stage", "phase", "seconds")
    )


def step_results(parsed: DataFrame) -> DataFrame:
    """Finished steps with their host and its attempt: ``run, host, attempt, part, n, command, failed``.

    Only host lines and step lines are moved; the tool output between them stays behind.
    """
    needed = parsed.where("host IS NOT NULL OR kind IN ('STEP_OK', 'STEP_ERR')")
    owned = attribute_lines(needed).where("owner IS NOT NULL")
    counted = earlier_count(owned, F.col("status").isNotNull(), ["run", "owner"], "attempt")
    return counted.where("kind IN ('STEP_OK', 'STEP_ERR')").select(
        "run",
        F.col("owner").alias("host"),
        (F.col("attempt") + 1).alias("attempt"),
        "part",
        "n",
        "command",
        (F.col("kind") == "STEP_ERR").alias("failed"),
    )


def steps_reached(steps: DataFrame, keys=("run", "host"), part: str = "part", order="n") -> DataFrame:
    """Planned steps with ``failed`` -> OK, FAILED, or NOT_RUN.

    A step has not run when an earlier step of its host failed, or when ``failed`` is NULL.
    """
    counted = earlier_count(steps, F.coalesce("failed", F.lit(False)), list(keys), "__failed_before", part, order)
    state = (
        F.when((F.col("__failed_before") > 0) | F.col("failed").isNull(), "NOT_RUN")
        .when(F.col("failed"), "FAILED")
        .otherwise("OK")
    )
    return counted.withColumn("state", state).drop("__failed_before")


def run_outcomes(attempts: DataFrame, parsed: DataFrame | None = None, selected: DataFrame | None = None) -> DataFrame:
    """One row for every run that ``attempts``, ``parsed`` or ``selected`` knows.

    ``total`` counts the selected hosts (``run, hostname``) of runs that have such, else the
    attempts seen. ``claimed`` is total - failed, the number a run prints; it counts a host
    that was never reached as a success. ``succeeded`` counts real results. ``verdict``:
    ``failed`` with a failed host, ``incomplete`` if a host has no result or no host was
    worked on, else ``ok``. With ``parsed`` the numbers printed in the log stand beside them.

    All three come as small facts about runs and meet in one aggregate.
    """
    none = F.lit(None).cast("bigint")
    columns = ["attempted", "failed", "succeeded", "chosen", "logged_k", "logged_total"]

    def facts(df: DataFrame, **values) -> DataFrame:
        return df.select("run", *[values.get(c, none).cast("bigint").alias(c) for c in columns])

    status = F.col("status")
    known = facts(attempts, attempted=F.lit(1), failed=status == "FAILED", succeeded=status == "SUCCESS")
    if selected is not None:
        known = known.unionByName(facts(selected, chosen=F.col("hostname") != ""))
    if parsed is not None:
        summary = F.col("kind") == "SUMMARY"
        known = known.unionByName(
            facts(parsed, logged_k=F.when(summary, F.col("k")), logged_total=F.when(summary, F.col("total")))
        )
    sums = known.groupBy("run").agg(
        F.coalesce(F.sum("chosen"), F.sum("attempted"), F.lit(0)).alias("total"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("failed", "succeeded")],
        *[F.max(c).alias(c) for c in ("logged_k", "logged_total")],
    )
    reached = F.col("failed") + F.col("succeeded")
    verdict = F.when(F.col("failed") > 0, "failed").when((F.col("total") > reached) | (F.col("total") == 0), "incomplete")
    return sums.select(
        "run",
        "total",
        "failed",
        "succeeded",
        (F.col("total") - reached).alias("no_result"),
        (F.col("total") - F.col("failed")).alias("claimed"),
        verdict.otherwise("ok").alias("verdict"),
        *(["logged_k", "logged_total"] if parsed is not None else []),
    )


def failed_hosts(attempts: DataFrame) -> DataFrame:
    """Failed hosts of each run in the order of failure, repeats kept: ``run, idx, host``."""
    failed = attempts.where("status = 'FAILED'").select("run", "part", "n", "host")
    counted = earlier_count(failed, F.lit(True), ["run"], "idx")
    return counted.select("run", (F.col("idx") + 1).alias("idx"), "host")


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Outcome rows, one a run, with the fixed texts of the message a run prints.

    ``head``, then the hosts of ``failed_hosts`` in their order, then ``tail``. Without a
    failure ``head`` is the whole message and ``tail`` is null. The hosts stay rows: no
    value grows with the run.
    """
    total, claimed = (F.col(c).cast("string") for c in ("total", "claimed"))
    clean = F.col("failed") == 0
    return outcomes.withColumns(
        {
            "head": F.when(clean, X.fill(C.SUMMARY_OK_FORMAT, total=total)).otherwise(C.SUMMARY_FAILED_START),
            "tail": F.when(~clean, X.fill(C.SUMMARY_FAILED_END, succeeded=claimed, total=total)),
        }
    )


def parse_service_lines(lines: DataFrame, ts_type: str = "timestamp_ntz") -> DataFrame:
    """``ts, level, message`` of service-log lines; tool output keeps a NULL level."""
    line = F.col("line")
    staged = _with_groups(lines, line, C.SERVICE_LINE_PATTERN, 3, line.startswith("["))
    group = F.col("__g")
    matched = (F.size(group) == 3) & ~group[0].startswith("[")
    return staged.withColumns(
        {
            "ts": F.when(matched, group[0]).try_cast(ts_type),
            "level": F.when(matched, group[1]),
            "message": F.when(matched, group[2]).otherwise(line),
        }
    ).drop("__g")


def level_counts(parsed: DataFrame) -> DataFrame:
    """Lines per file, level and minute."""
    return parsed.groupBy("file", "level", X.minute_of("ts").alias("minute")).agg(
        F.count("*").alias("lines")
    )
