"""Joins of a large table, in which one key may hold a third of all rows, to a small per-key table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 4
SALT = "__salt"


def salted_join(big: DataFrame, per_key: DataFrame, keys, spread, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Equi-join that spreads each key of ``big`` over ``salts`` partitions.

    ``per_key`` holds one row per key and is repeated once per salt. A table that was
    aggregated on the join keys would be joined without a new exchange, and then the
    adaptive skew join cannot act. With the salt both sides get their own exchange, so it
    splits whatever a few salts leave too large.
    """
    keys = list(keys)
    salted = big.withColumn(SALT, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = per_key.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, SALT], how).drop(SALT)
