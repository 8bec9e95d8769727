"""SimHash near-duplicates: exact comparison of all fingerprints in tiles."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import components, forest, free_name, numbered
from fleetlens.operators.skew import salted_join
from fleetlens.sources.scratch import stored

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Bits of each part of a fingerprint whose set bits are counted; tiles hold fingerprints of equal counts.
PART_BITS = 16
PARTS = 64 // PART_BITS
#: Fingerprints in a tile at most; a tile pair is compared by one task at a time.
TILE = 2048
#: The number of a row of a stage's input, written with it.
ROW = "__simhash_row"


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits: each is 1 if set in over half the shingle hashes. No words: 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    of = xxhash.xxh64_intdigest
    hashes = np.fromiter((of(data[s:e], seed) for s, e in zip(starts, stops, strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        bits = np.unpackbits(hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(
    docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, text: str = "text", keys: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """``keys`` (as longs) and ``fp`` (the fingerprint's bits as a long), without a shuffle."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(fps.view(np.int64))], [*keys, "fp"])

    whole = docs.select(*[F.col(k).cast("long").alias(k) for k in keys], F.col(text).cast("binary").alias("text"))
    return whole.mapInArrow(run, ", ".join(f"{k} long" for k in [*keys, "fp"]))


def _tiles(fps: DataFrame) -> DataFrame:
    """Sorted runs of up to TILE distinct fingerprints with equal bit counts in every part."""
    counts = [
        F.bit_count(F.shiftrightunsigned("fp", PART_BITS * p).bitwiseAND(F.lit((1 << PART_BITS) - 1)))
        for p in range(PARTS)
    ]
    key = sum((c.cast("long") * (2 * PART_BITS) ** p for p, c in enumerate(counts)), F.lit(0).cast("long"))

    def cut(frames):
        key, held = None, []
        out = []

        def close():
            if held:
                out.append((held[0], key, np.array(held, np.int64).tobytes()))
                held.clear()

        for frame in frames:
            for k, fp in zip(frame["key"].tolist(), frame["fp"].tolist(), strict=True):
                if k != key or len(held) == TILE:
                    close()
                    key = k
                held.append(fp)
            if out:
                yield pd.DataFrame(out, columns=["tile", "key", "fps"])
                out.clear()
        close()
        if out:
            yield pd.DataFrame(out, columns=["tile", "key", "fps"])

    ordered = fps.select("fp", key.alias("key")).repartitionByRange("key", "fp").sortWithinPartitions("key", "fp")
    return ordered.mapInPandas(cut, "tile long, key long, fps binary")


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``a`` and ``b`` of all pairs that differ in ``radius`` bits at most."""
    rows, cols = [], []
    step = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(np.bitwise_xor.outer(a[at : at + step], b)) <= radius)
        rows.append(i + at)
        cols.append(j)
    return np.concatenate(rows), np.concatenate(cols)


def near_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) with the same components as all pairs of distinct ``fp`` within ``radius`` bits.

    Every part of two such fingerprints differs in its number of set bits by no more than
    they differ in bits there, so a tile meets only tiles whose counts differ by ``radius``
    at most in all. Each tile pair returns a spanning forest of its links.
    """
    tiles = stored(_tiles(fps), "simhash_tiles")
    steps = [d for d in product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, d)) <= radius]
    shifts = [sum(x * (2 * PART_BITS) ** p for p, x in enumerate(d)) for d in steps if d >= (0,) * PARTS]
    left = tiles.select(F.col("tile").alias("ta"), F.col("fps").alias("fa"), F.col("key").alias("from_key")).withColumn(
        "key", F.explode(F.transform(F.array(*map(F.lit, shifts)), lambda s: s + F.col("from_key")))
    )
    pairs = left.join(tiles, "key").filter("key != from_key or ta <= tile").select("fa", "fps")

    def compare(frames):
        for frame in frames:
            found = []
            for x, y in zip(frame["fa"], frame["fps"], strict=True):
                a, b = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                i, j = near_pairs(a.view(np.uint64), b.view(np.uint64), radius)
                apart = a[i] != b[j]
                if apart.any():
                    found.append(forest(a[i[apart]], b[j[apart]]))
            if found:
                yield pd.DataFrame({"a": np.concatenate([f[0] for f in found]), "b": np.concatenate([f[1] for f in found])})

    return pairs.mapInPandas(compare, "a long, b long")


def _least(marked: DataFrame, value: Column, radius: int) -> DataFrame:
    """``fp, least``: the least ``value`` of all rows linked to each fingerprint, over any links."""
    classes = marked.groupBy("fp").agg(F.min(value).alias("first"))
    linked = components(near_links(classes.select("fp"), radius))
    in_groups = classes.join(linked, classes["fp"] == linked["node"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )
    least = in_groups.groupBy("component").agg(F.min("first").alias("least"))
    return salted_join(in_groups, least, ["component"], ["fp"]).select("fp", "least")


def simhash_groups(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id, fp, component_id`` for every row: the smallest doc_id linked to it, over any links.

    Null and empty texts have fingerprint 0 and link like any other. Rows that repeat a
    doc_id stay rows. A null doc_id never becomes a component id; a group of none but null
    ids has a null component. Other columns of ``docs`` are not read.
    """
    marked = stored(fingerprints(docs, shingle, seed), "fingerprints")
    named = _least(marked, F.col("doc_id"), radius).withColumnRenamed("least", "component_id")
    return salted_join(marked, named, ["fp"], [F.coalesce("doc_id", F.lit(0))]).select("doc_id", "fp", "component_id")


def one_of_each_group(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``docs`` with exactly one row of each group of ``simhash_groups``: one with the smallest doc_id, null last.

    Rows go one by one, by a number written with the input: rows that repeat a doc_id, or
    have a null one, are rows like any other. The number's column takes a name that ``docs`` does not have.
    """
    row = free_name(docs, ROW)
    rows = numbered(docs, row, "simhash_rows")
    marked = stored(fingerprints(rows, shingle, seed, keys=("doc_id", row)), "fingerprints")
    named = _least(marked, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", row), radius)
    others = salted_join(marked, named, ["fp"], [row]).filter(F.col(row) != F.col(f"least.{row}")).select(row)
    return rows.join(others, row, "left_anti").select(*docs.columns)
