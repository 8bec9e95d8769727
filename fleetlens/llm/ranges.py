"""Ranges of ordered keys between splitters that a sample gives, as a number on every row."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from fleetlens.llm.common import partitions

#: Sampled keys for each range.
SAMPLES = 32
#: Ranges are at least this many a shuffle partition, and no larger than this many bytes.
RANGES_PER_PARTITION = 4
RANGE_BYTES = 1 << 30


class Splitters:
    """Sorted keys that cut rows into ranges: a row's range is the number of splitters up to its key."""

    def __init__(self, points: list[dict], schema: str):
        self.points, self.count = points, len(points)
        # A literal once the optimizer has seen it: it travels with the tasks.
        self._array = F.from_json(F.lit(json.dumps(points)), f"array<struct<{schema}>>")

    def range_of(self, key: Column) -> Column:
        """The range of a key, a struct like the splitters."""
        return self.count_while(lambda point: point <= key)

    def count_while(self, holds) -> Column:
        """How many splitters a condition holds for, by binary search: it must hold up to some splitter and for none after."""
        steps = [1 << b for b in reversed(range(self.count.bit_length()))]
        if not steps:
            return F.lit(0)

        def look(low, step):
            point = F.get(self._array, low + step - 1)  # null beyond the last
            return F.when(point.isNotNull() & holds(point), low + step).otherwise(low)

        return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), look)


def splitters(rows: DataFrame, keys: dict[str, Column], schema: str, weight: Column, ranges: int | None = None) -> Splitters:
    """Splitters that cut ``rows`` into ranges of about equal ``weight`` (bytes).

    ``keys`` must hold no nulls, each of bounded size; ``schema`` gives their names and types. The
    driver sees at most a sample of ``SAMPLES`` keys a range. Equal keys are one range: let
    the last key tell rows apart where a hot key must be cut.
    """
    size = rows.agg(F.count("*").alias("n"), F.sum(weight).alias("bytes")).first()
    if not size["n"]:
        return Splitters([], schema)
    if ranges is None:
        ranges = max(RANGES_PER_PARTITION * partitions(rows.sparkSession), -(-int(size["bytes"] or 0) // RANGE_BYTES))
    share = min(1.0, SAMPLES * ranges / size["n"])
    named = rows.select(F.struct(*[c.alias(k) for k, c in keys.items()]).alias("key"), weight.cast("long").alias("weight"))
    sample: list[Row] = (named if share == 1.0 else named.sample(share, seed=1)).orderBy("key").collect()
    total, seen, points = sum(r["weight"] or 0 for r in sample), 0, []
    for row in sample:
        point = row["key"].asDict()
        # A splitter opens a range: the first key at or after each equal share of the weight.
        if seen * ranges >= (len(points) + 1) * total and (not points or points[-1] != point):
            points.append(point)
        seen += row["weight"] or 0
    return Splitters(points, schema)
