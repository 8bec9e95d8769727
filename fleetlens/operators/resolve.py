"""Configuration of a service: lookup, default, derived columns. Narrow, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions import text as X

ROW_KEYS = ["inventory", "server_pos", "hostname", "service_pos", "service"]


def rules_of(service: str, rules=C.RULES) -> list[tuple]:
    """(order, key, kind, default) of one service."""
    mine = [r for r in rules if r[0] == service]
    return [(order, key, kind, default) for order, (_, key, kind, default) in enumerate(mine, 1)]


def rule_literal(service: str, rules=C.RULES) -> Column:
    """The rules of one service as a constant array."""
    return F.array(
        *[
            F.struct(
                F.lit(order).alias("rule_order"),
                F.lit(key).alias("key"),
                F.lit(kind).alias("kind"),
                F.lit(default).cast("string").alias("default"),
            )
            for order, key, kind, default in rules_of(service, rules)
        ]
    )


def rule_array(rules=C.RULES) -> Column:
    """The rules of the row's service as an array; NULL for an unknown service."""
    out = F.lit(None)
    for service in dict.fromkeys(r[0] for r in rules):
        out = F.when(F.col("service") == service, rule_literal(service, rules)).otherwise(out)
    return out


def _own(rule: Column) -> Column:
    return X.present(F.col("cfg")[rule["key"]])


def _fallback(rule: Column) -> Column:
    return F.when(rule["kind"] == "host", F.col("hostname")).otherwise(rule["default"])


def config_lookup(requests: DataFrame, entries: DataFrame, keys=("inventory", "hostname", "service", "key")) -> DataFrame:
    """Each request with its value; NULL when host, service or key is absent or the value is null.

    Both sides come straight from their shuffle, so the adaptive skew join can split a
    host that is asked for very often.
    """
    return requests.join(entries.select(*keys, "value"), list(keys), "left")


def apply_defaults(df: DataFrame, value: str = "value", default: str = "default", out: str = "resolved") -> DataFrame:
    return df.withColumn(out, X.or_default(value, F.col(default)))


def resolved_entries(services: DataFrame, rules=C.RULES) -> DataFrame:
    """One row per (service block, rule): the effective value and where it came from."""
    def effective(r: Column) -> Column:
        own, fallback = _own(r), _fallback(r)
        return F.struct(
            r["rule_order"].alias("rule_order"),
            r["key"].alias("key"),
            F.coalesce(own, fallback).alias("value"),
            F.when(own.isNotNull(), "set").when(fallback.isNotNull(), "default").otherwise("missing").alias("origin"),
        )

    found = F.transform(rule_array(rules), effective)
    return services.select(*ROW_KEYS, F.inline_outer(found)).where("key IS NOT NULL")


def _airflow_columns(log_name: str) -> list[dict[str, Column]]:
    place = {
        "base_dir": X.base_dir("DiskPath"),
    }
    paths = {
        "source_dir": F.concat("base_dir", F.lit("/softwares")),
        "python_home": F.concat("base_dir", F.lit("/apps/python")),
        "python_bin_dir": F.concat("base_dir", F.lit("/apps/python/bin")),
        "airflow_home": F.concat("base_dir", F.lit("/apps/airflow")),
        "access_log": F.concat("base_dir", F.lit(f"/{log_name}.access.log")),
        "error_log": F.concat("base_dir", F.lit(f"/{log_name}.error.log")),
        "extras": X.merge_csv("AIRFLOW_EXTRAS"),
        "sql_alchemy_conn": X.sql_conn("DB_USER", "DB_PASSWORD", "DB_HOST", "DB_PORT", "DB_NAME"),
        "result_backend": X.result_backend("DB_USER", "DB_PASSWORD", "DB_HOST", "DB_PORT", "DB_NAME"),
        "broker_url": X.broker_url("REDIS_PASSWORD", "REDIS_HOST", "REDIS_PORT", "REDIS_DB"),
    }
    tools = {
        "python_exe": F.concat("python_bin_dir", F.lit("/python"), X.major_minor("PYTHON_VERSION")),
        "airflow_exe": F.concat("python_bin_dir", F.lit("/airflow")),
    }
    return [place, paths, tools]


def _spark_columns() -> list[dict[str, Column]]:
    place = {"base_dir": X.base_dir("DiskPath")}
    paths = {
        "source_dir": F.concat("base_dir", F.lit("/softwares")),
        "spark_home": F.concat("base_dir", F.lit("/apps/spark")),
        "access_log": F.concat("base_dir", F.lit("/spark_standalone.access.log")),
        "error_log": F.concat("base_dir", F.lit("/spark_standalone.error.log")),
        "worker_args": X.optional_args("WORKER_CORES", "WORKER_MEMORY"),
        **X.package_urls("SPARK_VERSION", "HADOOP_VARIANT"),
    }
    return [place, paths]


def resolve(services: DataFrame, service: str, short_name: str = "hostname", rules=C.RULES) -> DataFrame:
    """One wide row per block of ``service``: every rule key, then the derived columns.

    ``short_name`` is the column with the machine's own short name, used for worker units.
    The values are looked up in one transform over the rules, not one expression per key:
    so many map lookups in one generated method would be too long for the JVM to compile.
    """
    values = F.transform(rule_literal(service, rules), lambda r: F.coalesce(_own(r), _fallback(r)))
    found = services.where(F.col("service") == service).select(
        *ROW_KEYS, F.col(short_name).alias("short_name"), values.alias("__values")
    )
    picked = found.select(
        *ROW_KEYS,
        "short_name",
        *[F.col("__values")[order - 1].alias(key) for order, key, _, _ in rules_of(service, rules)],
    )
    if service == C.SPARK:
        steps = _spark_columns()
    else:
        steps = _airflow_columns("airflow_scheduler" if service == C.SCHEDULER else "airflow_worker")
        if service == C.WORKER:
            steps[0]["worker_unit"] = X.slug("short_name")
    for step in steps:
        picked = picked.withColumns(step)
    return picked


def package_rows(resolved: DataFrame) -> DataFrame:
    """One row per package a resolved scheduler or worker installs, in order, and the address of its Python source.

    First the package alone, then once with each extra. Extras are compared before they are
    trimmed, so one that differs in blanks only comes twice.
    """
    version = F.col("AIRFLOW_VERSION")
    plain = X.fill(C.REQUIREMENT_FORMAT, version=version)
    extras = F.transform(X.csv_items("extras"), lambda e: X.fill(C.EXTRA_REQUIREMENT_FORMAT, extra=e, version=version))
    return resolved.select(
        *ROW_KEYS,
        X.fill(C.PYTHON_SOURCE_FORMAT, version=F.col("PYTHON_VERSION")).alias("python_source_url"),
        F.posexplode(F.concat(F.array(plain), extras)).alias("pos", "requirement"),
    )


def mask_secrets(df: DataFrame, secret: str) -> DataFrame:
    """``df`` for reports: whatever may hold a secret is a hash under the key ``secret``.

    Secret columns, rendered bodies, whole blocks and documents are hashed; so are the values
    of secret keys, and of environment lines that are made of them, in (key, value) rows.
    """
    hidden = {c: X.secret_hash(c, secret) for c in df.columns if c in C.SECRET_COLUMNS}
    for c in df.columns:
        if c in C.SECRET_NESTED:
            text = F.col(c) if dict(df.dtypes)[c] == "string" else F.to_json(c)
            hidden[c] = X.secret_hash(text, secret)
    if {"key", "value"} <= set(df.columns):
        is_secret = F.col("key").isin(*C.SECRET_KEYS, *C.SECRET_ENV_KEYS)
        hidden["value"] = F.when(is_secret, X.secret_hash("value", secret)).otherwise(F.col("value"))
    return df.withColumns(hidden) if hidden else df
