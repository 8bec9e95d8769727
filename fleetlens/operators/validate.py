"""Missing, placeholder and inconsistent configuration. No output column holds a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions import text as X
from fleetlens.operators.resolve import ROW_KEYS, rule_array
from fleetlens.operators.skew import salted_join


def violation_reason(value, kind) -> Column:
    """Why a value fails a ``req`` or ``match`` rule; NULL when it passes or the rule checks nothing."""
    value, kind = X.column(value), X.column(kind)
    reason = (
        F.when(value.isNull(), "missing")
        .when(value == "", "empty")
        .when(value == C.NULL_TEXT, "null_text")
        .when(value.startswith(C.PLACEHOLDER_PREFIX), "placeholder")
        .when((kind == "match") & value.startswith(C.COPY_PREFIX), "copy_from")
    )
    return F.when(kind.isin("req", "match"), reason)


def _failing(rules) -> Column:
    checked = F.transform(
        rule_array(rules),
        lambda r: F.struct(
            r["rule_order"].alias("rule_order"),
            r["key"].alias("key"),
            violation_reason(F.col("cfg")[r["key"]], r["kind"]).alias("reason"),
        ),
    )
    return F.filter(checked, lambda v: v["reason"].isNotNull())


def violations(services: DataFrame, rules=C.RULES) -> DataFrame:
    """Every failing rule of every service block."""
    return services.select(*ROW_KEYS, F.inline_outer(_failing(rules))).where("key IS NOT NULL")


def first_violation(services: DataFrame, rules=C.RULES) -> DataFrame:
    """The failing rule a service stops at."""
    first = F.slice(_failing(rules), 1, 1)
    return services.select(*ROW_KEYS, F.inline_outer(first)).where("key IS NOT NULL")


def _shared_values(services: DataFrame, keys, among) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col("cfg")[k].alias("value")) for k in keys])
    return services.where(F.col("service").isin(*among)).select(
        "inventory", "server_pos", "hostname", "service_pos", "service", F.inline(pairs)
    )


def consistent_across(
    services: DataFrame,
    keys=tuple(C.BACKFILL_PLACEHOLDERS),
    among=(C.SCHEDULER, C.WORKER),
) -> DataFrame:
    """Per inventory and key: blocks, blocks without a value, different values.

    ``consistent``: every block has the same value, and none is without.

    Counted by value first, so a large inventory is reduced before its rows meet.
    """
    by_value = (
        _shared_values(services, keys, among)
        .withColumn("value", X.present("value"))
        .groupBy("inventory", "key", "value")
        .agg(F.count("*").alias("n"))
    )
    return by_value.groupBy("inventory", "key").agg(
        F.sum("n").alias("n_blocks"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"),
        F.count("value").alias("n_values"),
        ((F.count("value") == 1) & (F.count("*") == 1)).alias("consistent"),
    )


def inconsistent_blocks(
    services: DataFrame,
    keys=tuple(C.BACKFILL_PLACEHOLDERS),
    among=(C.SCHEDULER, C.WORKER),
    *,
    secret: str,
) -> DataFrame:
    """The blocks behind each inconsistent (inventory, key), with a keyed hash in place of the value."""
    broken = consistent_across(services, keys, among).where("NOT consistent").select("inventory", "key")
    blocks = _shared_values(services, keys, among).withColumn("value_hash", X.secret_hash("value", secret)).drop("value")
    return salted_join(blocks, broken, ["inventory", "key"], ["hostname", "service_pos", "server_pos"])


def backfill_flags(entries: DataFrame, placeholders: dict[str, str] = C.BACKFILL_PLACEHOLDERS) -> DataFrame:
    """Per inventory: some entry is empty or exactly the placeholder of its key."""
    waiting = F.lit(False)
    for key, text in placeholders.items():
        waiting = waiting | ((F.col("key") == key) & F.col("value").isin("", text))
    return entries.groupBy("inventory").agg(F.coalesce(F.bool_or(waiting), F.lit(False)).alias("needs_backfill"))


def non_empty_guard(inventories: DataFrame, selected: DataFrame) -> DataFrame:
    """Per inventory: number of selected rows and whether the selection is empty (an error)."""
    counts = selected.groupBy("inventory").agg(F.count("*").alias("n_selected"))
    return inventories.select("inventory").join(counts, "inventory", "left").select(
        "inventory",
        F.coalesce("n_selected", F.lit(0)).alias("n_selected"),
        F.col("n_selected").isNull().alias("is_empty"),
    )
