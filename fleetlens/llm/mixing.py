"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.ordered import earlier_count
from fleetlens.operators.skew import salted_join
from fleetlens.sources.scratch import stored

SEED = "mix-1"
#: Hash digits of a uniform number, and the largest mean inverted at once.
DIGITS = 12
MEAN_STEP = 32.0


def hash_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts joined by ``:``."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, DIGITS), 16, 10).cast("long") / F.lit(
        float(16**DIGITS)
    )


def poisson_steps(mean: Column) -> Column:
    """The distribution function of a Poisson variable at 0, 1, 2, ... up to 1 - 2^-48."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def add(acc, k):
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    most = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")
    return F.aggregate(F.sequence(F.lit(1), most), start, add, lambda acc: acc["cdf"])


def repetition_rates(docs: DataFrame, weights: DataFrame | None = None, source: str = "source") -> DataFrame:
    """``source, n, rate``: mean copies of a row so that sources reach their shares of ``docs``' rows.

    ``weights`` has (source, weight), any positive scale, at most one row a source; sources
    that it does not name, or names with a null or negative weight, get no rows. Without it all
    sources weigh the same. Null is a source like any other.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        shares = sizes.withColumn("weight", F.lit(1.0))
    else:
        named = weights.select(F.col("source").alias("w_source"), F.col("weight").cast("double").alias("weight"))
        shares = sizes.join(named, F.col("source").eqNullSafe(F.col("w_source")), "left").drop("w_source")
        shares = shares.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    total = shares.agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).first()
    if not total["weight"]:
        return shares.select("source", "n", F.lit(0.0).alias("rate"))
    rate = F.col("weight") / F.lit(total["weight"]) * F.lit(total["n"]) / F.col("n")
    return shares.select("source", "n", rate.alias("rate"))


def _draw_names(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with ``mix_draw``, the text that a row's draw is hashed from: its key.

    Rows without a key, or with one that others have too, add a hash of the whole row and its number
    among equal rows. Such rows are numbered by pieces, so that one row may be repeated without bound.
    """
    id_text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    counted = docs.groupBy(F.col(key).alias("mix_id")).agg(F.count("*").alias("n"))
    shared = stored(counted.filter("n > 1 or mix_id is null").select("mix_id"), "mix_shared")
    if shared.isEmpty():
        return docs.withColumn("mix_draw", id_text)
    same = F.col(key).eqNullSafe(F.col("mix_id"))
    place = F.monotonically_increasing_id()
    columns = [F.col(f"`{c}`").cast("string") for c in docs.columns]
    whole = F.md5(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)])))
    odd = stored(docs.join(shared, same, "left_semi").withColumn("mix_row", whole).withColumn("mix_n", place), "mix_odd")
    odd = earlier_count(odd.withColumn("mix_part", F.shiftright("mix_n", 33)), F.lit(True), ["mix_row"], "mix_nth", "mix_part", "mix_n")
    odd = odd.withColumn("mix_draw", F.concat_ws(":", id_text, "mix_row", "mix_nth")).select(*docs.columns, "mix_draw")
    return docs.join(shared, same, "left_anti").withColumn("mix_draw", id_text).unionByName(odd)


def mix_sources(
    docs: DataFrame, weights: DataFrame | None = None, seed: str = SEED, source: str = "source", key: str = "doc_id"
) -> DataFrame:
    """``docs`` with each row repeated a Poisson number of times, plus ``mix_copy`` (from 0), in a random order.

    The number of copies is the quantile of a Poisson distribution with the source's rate at
    a uniform number hashed from ``seed`` and ``key``; large rates are sums of several such
    numbers. Rows with a null key, and rows that share one, have draws of their own, hashed from the whole row
    and its number among equal rows too. An empty table gives an empty table. ``docs`` must not have columns ``mix_*``
    of its own: they are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower().startswith("mix_")])
    parts = F.greatest(F.ceil(F.col("rate") / MEAN_STEP), F.lit(1)).cast("int")
    rates = stored(
        repetition_rates(docs, weights, source).select(
            F.col("source").alias("mix_source"), parts.alias("mix_parts"), poisson_steps(F.col("rate") / parts).alias("mix_cdf")
        ),
        "mix_rates",
    )
    # A null source must join: its hash key is a text no other source has.
    name = lambda c: F.when(c.isNull(), "n").otherwise(F.concat(F.lit("v"), c.cast("string")))
    rates = rates.withColumn("mix_key", name(F.col("mix_source"))).drop("mix_source")
    id_text = F.col("mix_draw")
    joined = salted_join(_draw_names(docs, key).withColumn("mix_key", name(F.col(source))), rates, ["mix_key"], ["mix_draw"])
    count = F.aggregate(
        F.sequence(F.lit(1), F.col("mix_parts")),
        F.lit(0),
        lambda total, part: total
        + F.size(
            F.filter("mix_cdf", lambda step: step <= hash_uniform(F.lit(seed), id_text, part.cast("string")))
        ),
    )
    copies = (
        joined.withColumn("mix_n", count)
        .filter("mix_n > 0")
        .withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("mix_n") - 1)))
    )
    order = F.xxhash64(F.lit(seed), id_text, F.col("mix_copy"))
    mixed = copies.withColumn("mix_order", order).drop("mix_key", "mix_parts", "mix_cdf", "mix_n", "mix_draw")
    return mixed.repartition("mix_order").sortWithinPartitions("mix_order").drop("mix_order")
