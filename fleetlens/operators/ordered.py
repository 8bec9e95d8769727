"""Ordered operators that survive a group holding a large share of all rows.

A window over a whole run or host would put that group into one task. Here the input
carries ``part``, which cuts every group into ordered pieces of bounded size. The window
runs inside a piece; one row per (group, piece) carries the state over to later pieces,
and only those few rows meet in a window over the whole group.

The order of a group is (part, order column), the order column being unique in a piece.
Key columns must not be NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART_ROWS = 1 << 18
CARRY = "__carry"


def with_part(df: DataFrame, n: str = "n", rows: int = PART_ROWS) -> DataFrame:
    """Pieces from a number that is unique within a group."""
    return df.withColumn("part", F.expr(f"{n} div {rows}"))


def _over_pieces(pieces: DataFrame, keys: list[str], across, part: str) -> DataFrame:
    """One row per (group, piece), its CARRY replaced by ``across`` over the group's pieces."""
    return pieces.withColumn(CARRY, across(CARRY, Window.partitionBy(*keys).orderBy(part)))


def fill_forward(df: DataFrame, column: str, keys: list[str], out: str, part="part", order="n") -> DataFrame:
    """Last non-NULL value of ``column`` at or above the row.

    What a piece hands on is the value at its last row, which the window has found already.
    """
    piece = Window.partitionBy(*keys, part).orderBy(order)
    here = piece.rowsBetween(Window.unboundedPreceding, 0)
    filled = df.withColumn(out, F.last(column, ignorenulls=True).over(here))
    ends = filled.select(*keys, part, F.col(out).alias(CARRY), F.lead(F.lit(1)).over(piece).isNull().alias("__end"))
    carry = _over_pieces(
        ends.where("__end").drop("__end"),
        keys,
        lambda c, w: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        part,
    )
    return filled.join(carry, [*keys, part], "left").withColumn(out, F.coalesce(out, CARRY)).drop(CARRY)


def earlier_count(df: DataFrame, condition: Column, keys: list[str], out: str, part="part", order="n") -> DataFrame:
    """Number of earlier rows of the group that meet ``condition``."""
    here = Window.partitionBy(*keys, part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    carry = _over_pieces(
        df.groupBy(*keys, part).agg(F.count_if(condition).alias(CARRY)),
        keys,
        lambda c, w: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        part,
    )
    return (
        df.withColumn(out, F.count_if(condition).over(here))
        .join(carry, [*keys, part], "left")
        .withColumn(out, F.coalesce(out, F.lit(0)) + F.coalesce(CARRY, F.lit(0)))
        .drop(CARRY)
    )


def next_value(df: DataFrame, column: str, keys: list[str], out: str, part="part", order="n") -> DataFrame:
    """``column`` of the row that follows in the group."""
    here = Window.partitionBy(*keys, part).orderBy(order)
    firsts = df.select(*keys, part, F.col(column).alias(CARRY), F.lag(F.lit(1)).over(here).isNull().alias("__top"))
    firsts = firsts.where("__top").drop("__top")
    carry = _over_pieces(firsts, keys, lambda c, w: F.lead(c).over(w), part)
    last_here = "__last"
    return (
        df.withColumn(out, F.lead(column).over(here))
        .withColumn(last_here, F.lead(F.lit(1)).over(here).isNull())
        .join(carry, [*keys, part], "left")
        .withColumn(out, F.when(F.col(last_here), F.col(CARRY)).otherwise(F.col(out)))
        .drop(CARRY, last_here)
    )


def number_lines(lines: DataFrame, keys=("run",), out: str = "line_no") -> DataFrame:
    """Dense line number from 1 within a run."""
    counted = earlier_count(lines, F.lit(True), list(keys), out)
    return counted.withColumn(out, F.col(out) + 1)
