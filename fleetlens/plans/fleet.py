"""Whole jobs, put together from the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.operators import render, runlog
from fleetlens.operators.inventory import server_rows, service_rows
from fleetlens.operators.ordered import earlier_count
from fleetlens.operators.resolve import resolve
from fleetlens.operators.select import drop_blank_rows, select_hosts
from fleetlens.operators.skew import salted_join


def services_of(documents: DataFrame) -> DataFrame:
    return service_rows(server_rows(documents))


def rollout_hosts(documents: DataFrame, only: str | DataFrame | None = None) -> DataFrame:
    """The hosts a run works on, in document order: ``inventory, server_pos, hostname``."""
    hosts = server_rows(documents).select("inventory", "server_pos", "hostname")
    return select_hosts(drop_blank_rows(hosts), only)


def step_report(steps: DataFrame, parsed: DataFrame, runs: DataFrame) -> DataFrame:
    """State of every planned step in every attempt at its host.

    ``steps`` are install steps. ``runs`` ties a run to the one inventory it works on:
    ``run, inventory``; a run that is not in it has no planned steps. The n-th time an attempt
    logs a command belongs to the n-th step of the host with that command. Failed, or
    finished, or not run: because a step before it failed or because the log ends first.
    A step without a command stays, with ``missing`` set; a log names its command ``null``.
    """
    worked = runlog.number_attempts(parsed).select("run", F.col("host").alias("hostname"), "attempt").distinct()
    results = runlog.step_results(parsed).select(
        "run", F.col("host").alias("hostname"), "attempt", F.col("command").alias("__command"), "failed", "part", "n"
    )
    named = ["run", "hostname", "attempt", "__command"]
    seen = earlier_count(results, F.lit(True), named, "__nth").drop("part", "n")
    placed = steps.withColumns(
        {
            "missing": F.col("install_cmd").isNull(),
            "__command": F.coalesce("install_cmd", F.lit(C.NO_COMMAND)),
            "place": F.struct("seq", "cmd_pos"),
        }
    )
    numbered = earlier_count(placed, F.lit(True), ["inventory", "hostname", "__command"], "__nth", "server_pos", "place")
    planned = numbered.join(runs.select("run", "inventory"), "inventory")
    tried = salted_join(planned, worked, ["run", "hostname"], ["server_pos", "seq", "cmd_pos"])
    # Both sides have one row for each key, so no key is hot.
    states = tried.join(seen, [*named, "__nth"], "left")
    states = runlog.steps_reached(states, ("inventory", "run", "hostname", "attempt"), "server_pos", "place")
    return states.select(
        "inventory", "run", "hostname", "attempt", "server_pos", "seq", "cmd_pos", "install_cmd", "missing", "state"
    )


def fleet_documents(services: DataFrame, java_home: Column) -> DataFrame:
    """Every rendered document of every service: units, profiles, environment scripts.

    Narrow from the scan to the sink. Over a table of services partitioned by service
    (``land_services``) each of the three branches reads its own rows only.
    """
    return reduce(
        DataFrame.unionByName,
        [render.render_all(resolve(services, s), s, java_home) for s in (C.SCHEDULER, C.WORKER, C.SPARK)],
    )


def failure_report(parsed: DataFrame) -> DataFrame:
    """Which hosts failed or never finished in each run, why, and how long it took."""
    return runlog.host_attempts(parsed).where("status != 'SUCCESS'").drop("part", "n")
