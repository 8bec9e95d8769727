"""Isotonic calibration of raw scores, and sums of matrices over tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partial sums that reach the driver at most.
PARTIALS = 16


def pool_adjacent(x: np.ndarray, positive: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing share of positives at each ``x`` (sorted): the closest to the data by least squares."""
    blocks: list[list[float]] = []  # positives, total, first, last
    for at, (p, n) in enumerate(zip(positive, total, strict=True)):
        blocks.append([float(p), float(n), at, at])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p2, n2, _, last = blocks.pop()
            blocks[-1][0] += p2
            blocks[-1][1] += n2
            blocks[-1][3] = last
    share = np.empty(len(x))
    for p, n, first, last in blocks:
        share[int(first) : int(last) + 1] = p / n
    return np.asarray(x, float), share


def sum_over_tasks(partials: DataFrame) -> np.ndarray | None:
    """The sum of equally long float64 vectors, given as ``m binary``; None if there are none.

    They are added in ``PARTIALS`` groups by tasks, then on the driver.
    """

    def add(table: pa.Table) -> pa.Table:
        total = 0.0
        for m in table["m"]:
            total = total + np.frombuffer(m.as_buffer())
        return pa.table({"m": pa.array([np.asarray(total).tobytes()], pa.binary())})

    slots = partials.withColumn("slot", F.pmod(F.xxhash64("m"), F.lit(PARTIALS)))
    sums = [np.frombuffer(bytes(r["m"])) for r in slots.groupBy("slot").applyInArrow(add, "m binary").collect()]
    return np.sum(sums, axis=0) if sums else None
