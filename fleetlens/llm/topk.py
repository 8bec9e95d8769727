"""Exact top-k search by inner product in KD-trees, one for each shard."""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import numbered, partitions
from fleetlens.sources.scratch import stored

K = 5
LEAF = 256
#: Candidates in a shard and queries in a block, about.
SHARD_ROWS = 4096
BLOCK_ROWS = 256
#: Scores beyond it, on either side, are given as it.
MOST = 2**63 - 1


def finite(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def build_tree(x: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> dict:
    """Median splits along the widest side; every node has the tight box of its rows."""
    order = np.arange(len(x))
    low, high, child, span = [], [], [], []

    def node(start: int, end: int) -> int:
        rows = x[order[start:end]]
        low.append(rows.min(axis=0))
        high.append(rows.max(axis=0))
        child.append((-1, -1))
        span.append((start, end))
        at = len(low) - 1
        width = high[at].astype(float) - low[at]
        if end - start > leaf and width.any():
            middle = (end - start) // 2
            side = rows[:, int(width.argmax())]
            order[start:end] = order[start:end][np.argpartition(side, middle)]
            child[at] = (node(start, start + middle), node(start + middle, end))
        return at

    node(0, len(x))
    return {"x": x[order], "ids": ids[order], "low": np.array(low), "high": np.array(high), "child": child, "span": span}


def search(tree: dict, q: np.ndarray, qids: np.ndarray, known: list[list[int]], k: int) -> list[tuple[int, int, int]]:
    """(query's place, vec_id, score) of every candidate that may be among a query's best ``k``.

    ``known``: the best scores of each query from other shards, which bound the search from
    the start. Nodes are visited best bound first, until the next bound is below the kth score.
    """
    x, ids, child, span = tree["x"], tree["ids"], tree["child"], tree["span"]
    largest = _largest(tree["low"], tree["high"]) * _largest(q, q) * x.shape[1]
    # Whole numbers below 2^53 are exact in double precision, those past 2^63 only as Python's own.
    kind = np.float64 if largest < 2**53 else np.int64 if largest <= MOST else object
    xs, qs = x.astype(kind), q.astype(kind)
    bounds = np.maximum(qs, 0) @ tree["high"].astype(kind).T + np.minimum(qs, 0) @ tree["low"].astype(kind).T
    if kind is object:
        bounds = np.clip(bounds, -MOST, MOST)
    out = []
    for i in range(len(q)):
        best = list(known[i])  # heap of the k best scores seen
        heapq.heapify(best)
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        queue = [(-bounds[i, 0], 0)]
        while queue:
            bound, at = heapq.heappop(queue)
            if len(best) == k and -bound < best[0]:
                break
            if child[at][0] >= 0:
                for c in child[at]:
                    if len(best) < k or bounds[i, c] >= best[0]:
                        heapq.heappush(queue, (-bounds[i, c], c))
                continue
            s, e = span[at]
            scores = xs[s:e] @ qs[i]
            if kind is object:
                scores = np.clip(scores, -MOST, MOST).astype(np.int64)
            rows = np.flatnonzero((ids[s:e] != qids[i]) & (scores >= best[0] if len(best) == k else True))
            if not len(rows):
                continue
            seen.append((ids[s:e][rows], scores[rows]))
            for score in np.sort(scores[rows])[::-1][:k]:
                if len(best) < k:
                    heapq.heappush(best, score)
                elif score > best[0]:
                    heapq.heapreplace(best, score)
        if seen:
            vec, score = (np.concatenate(c) for c in zip(*seen, strict=True))
            for r in np.lexsort((vec, -score))[:k]:
                out.append((i, int(vec[r]), int(score[r])))
    return out


def _largest(low: np.ndarray, high: np.ndarray) -> int:
    return max(abs(int(low.min(initial=0))), abs(int(high.max(initial=0))))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.int64).reshape(len(flat), -1)


def _block(build: bool):
    def run(table: pa.Table) -> pa.Table:
        x, ids = _matrix(table["v"]), np.asarray(table["vec_id"], np.int64)
        # The smallest type that holds the components.
        x = x.astype(np.min_scalar_type(min(int(x.min()), -int(x.max()) - 1)))
        made = build_tree(x, ids) if build else {"x": x, "ids": ids, "names": np.asarray(table["name"], np.int64)}
        return pa.table(
            {"d": pa.array([x.shape[1]], pa.int32()), "block": table["block"].slice(0, 1), "data": pa.array([pickle.dumps(made)], pa.binary())}
        )

    return run


def top_k(rows: DataFrame, is_query: Column, k: int = K, key: str = "vec_id", vector: str = "v") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows with the highest inner products for each query row.

    ``vector`` is an array of whole numbers; rows where it, or the id, is null, or which is
    empty or has null components, take no part. Candidates have the query's length and another id; fewer than
    ``k`` give all. Ties go to the smaller ``vec_id``. Repeated candidate rows all count; a
    repeated query row counts once. Other columns are not read. A score past 64 bits is given, and
    ranked, as the largest or smallest of 2^63 - 1 and its negative.

    Candidates are spread over shards of bounded size, identical rows too, by a number written with
    them, and queries over blocks. Each block
    first searches one shard; the scores it finds go along to all other shards as the kth
    score to beat.
    """
    valid = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<long>").alias("v"), is_query.alias("is_query"))
    ok = F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda c: c.isNull())
    valid = valid.filter(ok).withColumn("d", F.size("v")).withColumn("name", F.xxhash64("vec_id", "v"))
    valid = numbered(valid, "row", "search_rows")
    sizes = valid.groupBy("d").agg(F.count("*").alias("n"), F.count(F.when(F.col("is_query"), 1)).alias("nq"))
    split = sizes.select(
        "d", F.ceil(F.col("n") / SHARD_ROWS).cast("int").alias("shards"), F.greatest(F.ceil(F.col("nq") / BLOCK_ROWS), F.lit(1)).cast("int").alias("blocks")
    )
    split = stored(split, "search_sizes")
    sized = valid.join(split, "d")
    spread = F.xxhash64("row")
    schema = "d int, block int, data binary"
    shards = stored(
        sized.select("d", F.pmod(spread, F.col("shards")).cast("int").alias("block"), "vec_id", "v", "name")
        .groupBy("d", "block")
        .applyInArrow(_block(True), schema),
        "search_shards",
    )
    blocks = stored(
        sized.filter("is_query")
        .dropDuplicates(["vec_id", "v"])
        .select("d", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int").alias("block"), "vec_id", "v", "name")
        .groupBy("d", "block")
        .applyInArrow(_block(False), schema),
        "search_blocks",
    ).join(split, "d")

    def visit(batches):
        for batch in batches:
            out: list[tuple] = []
            for queries, tree, known in zip(*(batch.column(c).to_pylist() for c in ("queries", "tree", "known")), strict=True):
                q = pickle.loads(queries)
                scores = {r["name"]: r["scores"] for r in known or ()}
                found = search(pickle.loads(tree), q["x"].astype(np.int64), q["ids"], [scores.get(int(n), []) for n in q["names"]], k)
                out += [(int(q["names"][i]), int(q["ids"][i]), vec, score) for i, vec, score in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 4,
                ["name", "query_id", "vec_id", "score"],
            )

    answer = "name long, query_id long, vec_id long, score long"
    none = F.lit(None).cast("array<struct<name:long,scores:array<long>>>")
    home = F.pmod(F.col("qblock"), F.col("shards"))
    asked = blocks.select("d", F.col("block").alias("qblock"), F.col("data").alias("queries"), "shards")
    trees = shards.withColumnRenamed("data", "tree")
    at_home = asked.withColumn("block", home.cast("int")).join(trees, ["d", "block"])
    first = stored(at_home.withColumn("known", none).select("d", "qblock", "queries", "tree", "known").mapInArrow(visit, answer), "search_first")
    # The k scores of each query so far, beside its block.
    names = asked.select("d", "qblock").join(
        valid.filter("is_query").join(split, "d").select("d", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int").alias("qblock"), "name").distinct(),
        ["d", "qblock"],
    )
    scores = first.groupBy("name").agg(F.collect_list("score").alias("scores"))
    known = names.join(scores, "name").groupBy("d", "qblock").agg(F.collect_list(F.struct("name", "scores")).alias("known"))
    elsewhere = (
        asked.join(known, ["d", "qblock"], "left")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        .filter(F.col("block") != home)
        .withColumn("block", F.col("block").cast("int"))
        .repartition(partitions(rows.sparkSession), "d", "block", "qblock")
    )
    rest = elsewhere.join(trees, ["d", "block"]).select("d", "qblock", "queries", "tree", "known").mapInArrow(visit, answer)
    ranked = Window.partitionBy("name").orderBy(F.desc("score"), "vec_id")
    return (
        first.union(rest)
        .withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
