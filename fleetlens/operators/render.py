"""Units, environment blocks and documents of resolved services. Narrow, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions import text as X

DOCUMENT_KEYS = ["inventory", "server_pos", "hostname", "service_pos"]


def env_block(service: str) -> Column:
    """Ordered environment entries of a resolved scheduler or worker row."""
    lines = C.ENV_KEYS if service == C.SCHEDULER else C.ENV_KEYS[:-1]
    return F.array(
        *[
            F.struct(
                F.lit(key).alias("key"),
                (X.or_empty(column) if column else F.lit(C.EXECUTOR)).alias("value"),
            )
            for key, column in lines
        ]
    )


def env_rows(resolved: DataFrame, service: str) -> DataFrame:
    """One row per environment line."""
    return resolved.select(*DOCUMENT_KEYS, F.posexplode(env_block(service)).alias("pos", "env")).select(
        *DOCUMENT_KEYS, "pos", "env.key", "env.value"
    )


def unit_array(service: str) -> Column:
    """Units of a resolved row; a conditional unit is there only when its flag is ``1``."""
    units = []
    for owner, unit, description, command, flag in C.UNITS:
        if owner != service:
            continue
        row = F.struct(
            X.fill(unit).alias("unit"),
            X.fill(description).alias("description"),
            X.fill(command).alias("command"),
        )
        units.append(F.when(F.col(flag) == "1", row) if flag else row)
    return F.filter(F.array(*units), lambda u: u.isNotNull())


def expand_units(resolved: DataFrame, service: str) -> DataFrame:
    """One row per unit: ``unit, description, command`` beside the resolved columns."""
    return resolved.select("*", F.posexplode(unit_array(service)).alias("unit_pos", "u")).select(
        *resolved.columns, "unit_pos", "u.*"
    )


def _airflow_body(service: str, unit: Column) -> Column:
    # The block is read line by line: a value that holds a line break gives further lines.
    text = F.array_join(F.transform(env_block(service), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\n")
    env_lines = F.array_join(
        F.transform(
            X.env_entries(text),
            lambda e: F.concat(F.lit('Environment="'), e["key"], F.lit("="), e["value"], F.lit('"\n')),
        ),
        "",
    )
    return X.fill(
        C.AIRFLOW_UNIT,
        description=unit["description"],
        command=unit["command"],
        user="SERVICE_USER",
        home="airflow_home",
        bin_dir="python_bin_dir",
        env_lines=env_lines,
    )


def _spark_body(unit: Column, java_home: Column) -> Column:
    is_worker = unit["unit"] == "spark-worker"
    return X.fill(
        C.SPARK_UNIT,
        description=unit["description"],
        command=unit["command"],
        user="SERVICE_USER",
        home="spark_home",
        java_home=java_home,
        after=F.when(is_worker, C.SPARK_WORKER_AFTER),
        requires=F.when(is_worker, C.SPARK_WORKER_REQUIRES),
    )


def _unit_documents(service: str, java_home: Column | None) -> Column:
    java_home = java_home if java_home is not None else F.lit("")

    def document(unit: Column) -> Column:
        body = _spark_body(unit, java_home) if service == C.SPARK else _airflow_body(service, unit)
        return F.struct(unit["unit"].alias("unit"), body.alias("body"))

    return F.transform(unit_array(service), document)


def _script(service: str, java_home: Column | None) -> Column:
    if service == C.SPARK:
        body = X.fill(C.SPARK_ENV, java_home=java_home if java_home is not None else F.lit(""))
        return F.struct(F.lit("spark-env").alias("unit"), body.alias("body"))
    body = X.fill(C.PROFILE, home="airflow_home", bin_dir="python_bin_dir")
    return F.struct(F.lit("profile").alias("unit"), body.alias("body"))


def render_units(resolved: DataFrame, service: str, java_home: Column | None = None) -> DataFrame:
    """One unit document per row. ``java_home`` is a machine fact, used by Spark units only."""
    documents = _unit_documents(service, java_home)
    return resolved.select(*DOCUMENT_KEYS, F.inline_outer(documents)).where("unit IS NOT NULL")


def render_profile(resolved: DataFrame) -> DataFrame:
    """Shell profile of a resolved scheduler or worker row."""
    return resolved.select(*DOCUMENT_KEYS, F.inline(F.array(_script(C.WORKER, None))))


def render_spark_env(resolved: DataFrame, java_home: Column) -> DataFrame:
    """Environment script of a resolved Spark row."""
    return resolved.select(*DOCUMENT_KEYS, F.inline(F.array(_script(C.SPARK, java_home))))


def render_all(resolved: DataFrame, service: str, java_home: Column | None = None) -> DataFrame:
    """Every document of a resolved row, in one pass: its units and its script."""
    documents = F.concat(_unit_documents(service, java_home), F.array(_script(service, java_home)))
    return resolved.select(*DOCUMENT_KEYS, F.inline_outer(documents)).where("unit IS NOT NULL")
