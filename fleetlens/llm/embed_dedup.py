"""Embedding near-duplicates: PCA-ordered comparison in tiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import components, forest, partitions
from fleetlens.operators.skew import salted_join
from fleetlens.sources.scratch import stored

THRESHOLD = 0.98
#: Distinct vectors in a tile at most.
TILE = 512
#: Leading dimensions summed before the first test against the bound.
LEAD = 8
#: Numbers of the vectors of pairs that are held at once.
PAIR_NUMBERS = 1 << 21
#: Rounding room of the bounds; links are decided on the vectors themselves.
SLACK = 1e-9
#: Partial sums that reach the driver for one vector length, at most.
PARTIALS = 16


def usable(vector) -> F.Column:
    """Not null, not empty, not zero, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length the axes of the unit vectors, that with the largest squares first.

    Tasks sum products of their unit vectors; sums are added in a few groups and only those
    (a matrix of the vector length, ``PARTIALS`` at most) reach the driver.
    """

    def products(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, x in _by_length(batch.column("v")):
                x = _unit(x)
                sums[d] = sums.get(d, 0) + x.T @ x
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([m.tobytes() for m in sums.values()], pa.binary())], ["d", "m"]
            )

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(m) for m in table["m"].to_pylist())
        return pa.table({"d": pa.array([table["d"][0].as_py()], pa.int32()), "m": pa.array([total.tobytes()], pa.binary())})

    parts = classes.select("v").mapInArrow(products, "d int, m binary")
    parts = parts.withColumn("slot", F.pmod(F.xxhash64("m"), F.lit(PARTIALS)))
    sums: dict[int, np.ndarray] = {}
    for row in parts.groupBy("d", "slot").applyInArrow(add, "d int, m binary").collect():
        m = np.frombuffer(bytes(row["m"])).reshape(row["d"], row["d"])
        sums[row["d"]] = sums.get(row["d"], 0) + m
    return {d: np.linalg.eigh(m)[1][:, ::-1] for d, m in sums.items()}


def _by_length(column: pa.Array):
    """(length, matrix) for each length of the vectors of an Arrow list column."""
    sizes = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten(), np.float64)
    if len(sizes) and (sizes == sizes[0]).all():
        yield int(sizes[0]), flat.reshape(len(sizes), int(sizes[0]))
        return
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        yield int(d), flat[(starts[sizes == d][:, None] + np.arange(d))]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def linked_pairs(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x`` and ``y`` with cosine at least ``threshold``.

    Products are summed along the axes, leading ones first. What is left of a product is at
    most the product of the suffix norms, so a pair is given up once that can't reach the
    threshold; pairs that stay are decided by their cosine in double precision.
    """
    a, b = _unit(x) @ axes, _unit(y) @ axes
    d = a.shape[1]
    rest = lambda m, k: np.sqrt((m[:, k:] ** 2).sum(axis=1))
    k = min(LEAD, d)
    sums = a[:, :k] @ b[:, :k].T
    i, j = np.nonzero(sums + np.outer(rest(a, k), rest(b, k)) >= threshold - SLACK)
    norm = lambda m: np.sqrt(np.einsum("nd,nd->n", m, m))
    norm_x, norm_y = norm(x), norm(y)
    found = [(i[:0], j[:0])]
    step = max(1, PAIR_NUMBERS // d)
    for at in range(0, len(i), step):
        p, q = i[at : at + step], j[at : at + step]
        part, upto = sums[p, q], k
        while upto < d and len(p):
            now, upto = upto, min(2 * upto, d)
            part = part + np.einsum("nd,nd->n", a[p, now:upto], b[q, now:upto])
            stay = part + rest(a, upto)[p] * rest(b, upto)[q] >= threshold - SLACK
            p, q, part = p[stay], q[stay], part[stay]
        stay = np.einsum("nd,nd->n", x[p], y[q]) / (norm_x[p] * norm_y[q]) >= threshold
        found.append((p[stay], q[stay]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _narrow(x: np.ndarray) -> bytes:
    """The vectors' bytes, as single floats where that loses nothing."""
    single = x.astype(np.float32)
    return (single if (single == x).all() else x).tobytes()


def _wide(data: bytes, d: int, n: int) -> np.ndarray:
    return np.frombuffer(data, np.float32 if len(data) == 4 * n * d else np.float64).reshape(n, d).astype(np.float64)


def _tiles(classes: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    """Runs of up to TILE vectors of one label and length, sorted along the first axis."""

    def first_axis(batches):
        for batch in batches:
            column = batch.column("v")
            sizes = np.diff(np.asarray(column.offsets))
            lead = np.zeros(len(sizes))
            for d, x in _by_length(column):
                lead[sizes == d] = _unit(x) @ axes[d][:, 0]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(sizes.astype(np.int32)), pa.array(lead), batch.column("rep"), batch.column("n"), column],
                ["label", "d", "lead", "rep", "n", "v"],
            )

    def cut(frames):
        held, key, out = [], None, []

        def close():
            if held:
                out.append(
                    (
                        key[0], key[1], held[0][1], held[0][0], held[-1][0],
                        np.array([h[1] for h in held], np.int64).tobytes(),
                        np.array([h[2] for h in held], np.int64).tobytes(),
                        _narrow(np.array([h[3] for h in held], np.float64)),
                    )
                )
                held.clear()

        names = ["label", "d", "tile", "low", "high", "reps", "ns", "vs"]
        for f in frames:
            for label, d, *row in zip(f["label"].tolist(), f["d"].tolist(), f["lead"].tolist(), f["rep"].tolist(), f["n"].tolist(), f["v"], strict=True):
                if (label, d) != key or len(held) == TILE:
                    close()
                    key = (label, d)
                held.append(row)
            if out:
                yield pd.DataFrame(out, columns=names)
                out.clear()
        close()
        if out:
            yield pd.DataFrame(out, columns=names)

    led = classes.mapInArrow(first_axis, "label long, d int, lead double, rep long, n long, v array<double>")
    ordered = led.repartitionByRange(partitions(classes.sparkSession), "label", "d", "lead", "rep")
    return ordered.sortWithinPartitions("label", "d", "lead", "rep").mapInPandas(
        cut, "label long, d int, tile long, low double, high double, reps binary, ns binary, vs binary"
    )


def embedding_groups(
    vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row: links have cosine >= ``threshold`` and equal labels.

    Null, empty and zero vectors, vectors with null or non-finite components, rows with a null
    label or a null id link with nothing: no links, their own component, kept. Vectors of
    different lengths never link. Rows that repeat a vector are copies of one class, counted
    and never paired; each counts as a link of the others. Other columns are not read.

    Classes are cut into tiles along the first principal axis of each label. Unit vectors
    with cosine c are at most sqrt(2 - 2c) apart along any axis, so a tile meets only tiles
    that near. A tile pair returns link counts and a spanning forest, never its pairs.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    rows = vectors.select(
        F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v")
    )
    linkable = rows.filter(usable(F.col("v")) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    classes = stored(linkable.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vector_classes")
    # A repeated id with several vectors: classes need names of their own.
    axes = principal_axes(classes)
    tiles = stored(_tiles(classes.select("label", "v", F.xxhash64("label", "v").alias("rep"), "n"), axes), "vector_tiles")

    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    left = tiles.select(
        "label", "d", F.col("tile").alias("ta"), (cell("low") - 1).alias("from_cell"), F.explode(F.sequence(cell("low") - 1, cell("high") + 1)).alias("cell"),
        F.col("low").alias("low_a"), F.col("high").alias("high_a"), F.col("reps").alias("ra"), F.col("ns").alias("na"), F.col("vs").alias("va"),
    )
    right = tiles.withColumn("first_cell", cell("low")).withColumn("cell", F.explode(F.sequence(cell("low"), cell("high"))))
    pairs = (
        left.join(right, ["label", "d", "cell"])
        .filter("ta <= tile and low <= high_a + {0} and high >= low_a - {0}".format(reach))
        # Tiles that share several cells meet in the first.
        .filter("cell = greatest(from_cell, first_cell)")
        .select("d", "ta", "ra", "na", "va", "tile", "reps", "ns", "vs")
    )

    def compare(frames):
        for f in frames:
            out = []
            for d, ta, ra, na, va, tb, rb, nb, vb in f.itertuples(index=False):
                ra, na, rb, nb = (np.frombuffer(x, np.int64) for x in (ra, na, rb, nb))
                x, y = _wide(va, d, len(ra)), _wide(vb, d, len(rb))
                i, j = linked_pairs(x, y, axes[d], threshold)
                if ta == tb:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                for ids, at, n in ((ra, i, nb[j]), (rb, j, na[i])):
                    sums = np.bincount(at, n, len(ids)).astype(np.int64)
                    out.append(pd.DataFrame({"a": ids[sums > 0], "b": None, "n": sums[sums > 0]}))
                a, b = forest(ra[i], rb[j])
                out.append(pd.DataFrame({"a": a, "b": b, "n": None}))
            if out:
                yield pd.concat([o.astype({"a": "Int64", "b": "Int64", "n": "Int64"}) for o in out])

    found = stored(pairs.mapInPandas(compare, "a long, b long, n long"), "vector_links")
    links = found.filter("b is null").groupBy(F.col("a").alias("name")).agg(F.sum("n").alias("links"))
    linked = components(found.filter("b is not null").select("a", "b"))
    named = classes.withColumn("name", F.xxhash64("label", "v"))
    grouped = (
        named.join(links, "name", "left")
        .join(linked.withColumnRenamed("node", "name"), "name", "left")
        .select("label", "v", "rep", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "name").alias("component"))
    )
    least = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
    answers = salted_join(grouped, least, ["component"], ["rep"]).select(
        F.col("label"), F.col("v"), (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id"
    )
    found_rows = salted_join(linkable, answers, ["label", "v"], ["vec_id"]).select("vec_id", "n_links", "component_id")
    others = rows.filter(~F.coalesce(usable(F.col("v")) & F.col("vec_id").isNotNull() & F.col("label").isNotNull(), F.lit(False)))
    alone = others.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found_rows.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
