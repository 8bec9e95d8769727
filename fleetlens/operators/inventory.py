"""Flattening and updating inventory documents. Everything here is narrow: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions.text import variant_text
from fleetlens.operators.skew import salted_join


def server_rows(documents: DataFrame) -> DataFrame:
    """One row per server in document order; a repeated host keeps all its rows."""
    return documents.select("inventory", F.posexplode("servers").alias("server_pos", "server")).select(
        "inventory", "server_pos", "server.hostname", "server.server_type", "server.services"
    )


def service_rows(servers: DataFrame) -> DataFrame:
    """One row per service block; a server without services gives no row.

    ``cfg`` holds the block as texts. JSON null and false become NULL: the key is there,
    a lookup finds nothing.
    """
    blocks = servers.select(
        "inventory", "server_pos", "hostname", F.posexplode("services").alias("service_pos", "block")
    )
    return blocks.select(
        "inventory",
        "server_pos",
        "hostname",
        "service_pos",
        variant_text(F.col("block")["name"]).alias("service"),
        F.transform_values("block", lambda _, v: variant_text(v)).alias("cfg"),
    )


def config_entries(services: DataFrame) -> DataFrame:
    """One row per (host, service, key).

    The outer explode, with its empty rows dropped, computes ``cfg`` once; a plain explode
    would compute it a second time to test that it is not empty.
    """
    return services.select(
        "inventory", "server_pos", "hostname", "service_pos", "service", F.explode_outer("cfg").alias("key", "value")
    ).where("key IS NOT NULL")


def has_key(key: str, cfg: str = "cfg") -> Column:
    """The key is present, even with a NULL value."""
    return F.map_contains_key(cfg, key)


def install_steps(services: DataFrame) -> DataFrame:
    """Commands of each host in order. One text may hold several lines; blank ones are skipped.

    A block without a command keeps its row with a NULL command and ``missing`` set.
    """
    command = F.col("cfg")["install_cmd"]
    lines = F.coalesce(F.split(command, "\n"), F.array(F.lit(None).cast("string")))
    steps = services.select(
        "inventory",
        "server_pos",
        "hostname",
        F.col("service_pos").alias("seq"),
        F.posexplode(lines).alias("cmd_pos", "install_cmd"),
    )
    return steps.where("install_cmd IS NULL OR install_cmd != ''").withColumn(
        "missing", F.col("install_cmd").isNull()
    )


def host_services(hosts: DataFrame, services: DataFrame, keys=("inventory", "hostname")) -> DataFrame:
    """Service rows of the given hosts.

    A host that is listed several times is worked on several times: ``times`` says how
    often, instead of repeating its rows.
    """
    listed = hosts.groupBy(*keys).agg(F.count("*").alias("times"))
    return salted_join(services, listed, keys, ["server_pos", "service_pos"])


def needs_backfill(servers: str = "servers", placeholders: dict[str, str] = C.BACKFILL_PLACEHOLDERS) -> Column:
    """Any block holds one of the keys with exactly its placeholder or an empty text."""
    def waiting(block: Column) -> Column:
        tests = [
            F.coalesce(variant_text(F.element_at(block, key)).isin("", text), F.lit(False))
            for key, text in placeholders.items()
        ]
        return F.array_contains(F.array(*tests), True)

    in_server = F.exists(servers, lambda s: F.coalesce(F.exists(s["services"], waiting), F.lit(False)))
    return F.coalesce(in_server, F.lit(False))


def _with_values(block: Column, values: dict[str, str], only: dict[str, str] | None) -> Column:
    def value_of(entry: Column) -> Column:
        out = entry["value"]
        for key, new in values.items():
            hit = entry["key"] == key
            if only is not None:
                old = variant_text(entry["value"])
                hit = hit & (old.isNull() | old.isin("", only.get(key, "")))
            out = F.when(hit, F.lit(new).cast("variant")).otherwise(out)
        return out

    rewritten = F.map_from_entries(
        F.transform(
            F.map_entries(block),
            lambda e: F.struct(e["key"].alias("key"), value_of(e).alias("value")),
        )
    )
    touched = F.exists(F.map_keys(block), lambda k: k.isin(*values))
    return F.when(touched, rewritten).otherwise(block)


def backfill_keys(
    documents: DataFrame,
    values: dict[str, str],
    placeholders: dict[str, str] = C.BACKFILL_PLACEHOLDERS,
    only_missing: bool = False,
) -> DataFrame:
    """Set each key to its one value in every block that has the key.

    As soon as one block of a document waits for a value, all its blocks get the new
    values, valid ones included. ``only_missing`` leaves valid values alone.
    """
    only = placeholders if only_missing else None
    servers = F.transform(
        "servers",
        lambda s: s.withField(
            "services", F.transform(s["services"], lambda b: _with_values(b, values, only))
        ),
    )
    return documents.withColumn(
        "servers", F.when(needs_backfill("servers", placeholders), servers).otherwise(F.col("servers"))
    )
