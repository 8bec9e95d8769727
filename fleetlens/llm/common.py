"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.skew import salted_join
from fleetlens.sources.scratch import stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Batches of documents for each shuffle partition: a Python task holds one batch at a time.
BATCHES_PER_PARTITION = 4


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(col: Column) -> Column:
    """``col`` with A-Z, and no other letter, lower-cased."""
    return F.translate(col, UPPER, UPPER.lower())


def crc_mod(key: Column, modulus: int) -> Column:
    """crc32 of ``key`` as text, modulo ``modulus``; null for null."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batch_of(spark: SparkSession, *cols) -> Column:
    """A number that spreads rows evenly over batches which fit one Python task each.

    Batches follow ``spark.sql.shuffle.partitions``, which a cluster sets by its input.
    """
    return F.pmod(F.xxhash64(*cols), F.lit(BATCHES_PER_PARTITION * partitions(spark))).cast("int")


def numbered(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` written once with a number of its own on every row, in ``column``.

    Identical rows can be dealt apart by it, and a repeated task deals them as before, since the
    number is read and not made again.
    """
    return stored(rows.withColumn(column, F.monotonically_increasing_id()), name)


def free_name(rows: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``rows`` has it in any case."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


# ---------------------------------------------------------------- words and hashes in numpy

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def pair_name(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit name for each ordered pair."""
    return mix(mix(a + _GOLD) * np.uint64(3) + b)


def word_spans(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by one space, and where each starts and ends."""
    words = text.split()  # at 0x20 and 0x09-0x0D, as bytes
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    return b" ".join(words), ends - lengths, ends


def span_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[starts:ends]``, eight bytes a step for all spans at once."""
    lengths = (ends - starts).astype(np.int64)
    out = mix(lengths.astype(np.uint64) + _GOLD)
    raw = data + b"\0" * 8
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
    at, left, open_ = starts.astype(np.int64), lengths, np.arange(len(starts))
    while len(open_):
        part = eight[at]
        short = left < 8
        keep = (np.uint64(1) << (np.minimum(left, 7) * 8).astype(np.uint64)) - np.uint64(1)
        part = np.where(short, part & keep, part)
        out[open_] = mix(out[open_] * np.uint64(3) + part + _GOLD)
        more = left > 8
        at, left, open_ = at[more] + 8, left[more] - 8, open_[more]
    return out


# ---------------------------------------------------------------- connected components


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the edges: (node, smallest node) for every other node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node either has one smaller neighbour or only larger ones."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select(F.col("b"), F.lit(0), F.lit(1))
    )
    sums = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sums.filter("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``: component is its smallest reachable node.

    Alternates two joins that hang neighbours on smaller nodes until only stars are left.
    Every round is written to the shared folder, so a lost executor costs one round at most.
    A node with very many neighbours is only aggregated and salted, never gathered.
    """

    def star(pairs: DataFrame, larger_only: bool) -> DataFrame:
        both = pairs if larger_only else pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low"))
        joined = salted_join(both, least, ["a"], ["b"])
        if larger_only:
            moved = joined.select(F.col("b").alias("a"), F.col("low").alias("b"))
            return moved.filter("a != b").union(least.select("a", F.col("low").alias("b"))).distinct()
        return joined.filter("b > a").select(F.col("b").alias("a"), F.least("a", "low").alias("b")).distinct()

    now = stored(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a != b").distinct(), "edges"
    )
    while not _are_stars(now):
        now = stored(star(stored(star(now, False), "large_star"), True), "small_star")
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.union(now.select(F.col("b"), F.col("b")).distinct())


# ---------------------------------------------------------------- whole documents in batches


def squeeze(rows: DataFrame, batch: Column) -> DataFrame:
    """``batch, data``: the rows of each batch in compressed Arrow streams, several a batch.

    What is shuffled is compressed text, and tasks get whole batches without a Python object a row.
    """

    def run(batches):
        press = zstandard.ZstdCompressor(1)
        for b in batches:
            part_rows = pa.RecordBatch.from_struct_array(b.column("row"))
            where = np.asarray(b.column("batch"))
            by = np.argsort(where, kind="stable")
            edges = np.flatnonzero(np.diff(where[by])) + 1
            numbers, blobs = [], []
            for part in np.split(by, edges) if len(by) else []:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part_rows.schema) as out:
                    out.write_batch(part_rows.take(pa.array(part)))
                numbers.append(int(where[part[0]]))
                blobs.append(press.compress(sink.getvalue()))
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], ["batch", "data"])

    whole = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), batch.alias("batch"))
    return whole.mapInArrow(run, "batch int, data binary")


def unsqueeze(blobs: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(zstandard.decompress(b)).read_all() for b in blobs])


def name_ranges(names: np.ndarray, count: int) -> Iterator[tuple[int, slice]]:
    """(bucket, slice) for sorted 64-bit names: a bucket is a range of names."""
    cuts = np.array([(k << 64) // count for k in range(1, count)], np.uint64)
    edges = np.concatenate([[0], np.searchsorted(names, cuts), [len(names)]]).tolist()
    for k in range(count):
        if edges[k] < edges[k + 1]:
            yield k, slice(edges[k], edges[k + 1])


def words_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """Names of all words, words in each text, and the words' bytes with their starts and stops."""
    split = [(t or b"").split() for t in texts]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    flat = [w for words in split for w in words]
    size = np.fromiter(map(len, flat), np.int64, len(flat))
    stops = np.cumsum(size)
    data = b"".join(flat)
    return span_hashes(data, stops - size, stops), lengths, data, stops - size, stops
