"""One row repeated for a third of a table, values past 64 bits, links at the threshold, and the pipeline over awkward rows."""

import pickle
import random
from collections import Counter
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from fleetlens.llm import embed_dedup, packing, simhash, topk, url_rules
from tests.llm.data import awkward, documents, words
from tests.llm.test_documents_ops import check_packing
from tests.llm.test_vectors_urls import RULES, judge


def written(spark, name):
    """The newest folder that an operator wrote under this name."""
    base = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")) / "fleetlens"
    return spark.read.parquet(str(max(base.glob(f"{name}-*"), key=lambda p: p.stat().st_mtime_ns)))


def best(rows, is_query, k=5):
    out = []
    for q, x in {(i, tuple(x)) for i, x in rows if is_query(i)}:
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in rows if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_copies_of_a_vector_fill_many_shards(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    rng = random.Random(5)
    rows = [(i, [rng.randrange(-300, 300) for _ in range(6)]) for i in range(400)] + [(1001, [9] * 6)] * 200
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, v array<long>"), F.col("vec_id") % 40 == 0)
    assert sorted(map(tuple, got.collect())) == best(rows, lambda i: i % 40 == 0)
    sizes = [len(pickle.loads(r["data"])["ids"]) for r in written(spark, "search_shards").collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 80


def test_scores_past_64_bits(spark):
    top = 2**63 - 1
    rows = [(0, [top, top]), (1, [top, 1]), (2, [top, top]), (3, [-top - 1, -top - 1]), (4, [1, 0]), (5, [2**31, 2**31]), (20, [2**31, 2**31]), (6, [0, 0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, v array<long>"), F.col("vec_id") % 20 == 0, k=7)
    want = []
    for q, x in ((0, rows[0][1]), (20, [2**31, 2**31])):
        scored = sorted((-max(-top, min(top, sum(a * b for a, b in zip(x, y, strict=True)))), i) for i, y in rows if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:7])]
    assert sorted(map(tuple, got.collect())) == want


def test_copies_of_a_page_fill_many_ranges(spark):
    long = "http://a.example.org/es/x" + "y" * 300_000
    rows = [(7, "http://example.org/es/1")] * 600 + [(k, f"http://h{k}.org/") for k in range(100)] + [(None, long)] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string")
    judged = url_rules.judge_urls(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"))
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in judged.collect())
    assert got == Counter((i, *judge(u)) for i, u in rows)
    # The ranges are cut at (key, salt), and copies have salts of their own.
    assert written(spark, "urls").select("row").distinct().count() == len(rows)


def test_copies_of_a_piece_have_places_of_their_own(spark):
    rows = [(7, 0, 0, 30, 1)] * 500 + [(k, 0, 0, 1 + k % 90, k) for k in range(300)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, value long")
    out = packing.pack(pieces.withColumn("row", F.lit("x")), 100)
    assert out.columns == [*pieces.columns, "row", "sequence_id", "offset"]
    assert check_packing(out.collect(), 100) > 0
    assert Counter((r["doc_id"], r["length"]) for r in out.collect()) == Counter((r[0], r[3]) for r in rows)


def test_a_cosine_at_the_threshold_links(spark):
    # 49 / (1 * 50) is 0.98 itself.
    rows = [(1, [1.0, 0.0, 0.0, 0.0], 0), (2, [49.0, 9.0, 3.0, 3.0], 0), (3, [49.0, -9.0, -3.0, -3.0078125], 0)]
    assert np.dot(rows[0][1], rows[1][1]) / np.sqrt(np.dot(rows[1][1], rows[1][1])) == 0.98
    groups = embed_dedup.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in groups.collect()) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_one_of_each_group_keeps_other_columns(spark):
    docs = awkward(spark).withColumn(simhash.ROW, F.lit("mine"))
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in kept.collect())
    # Null, empty and blank texts are one group; so are the two long texts and the two rows of document 6.
    assert got == [-1, 1, 4, 6, 7, 8, 9]
    assert {r[simhash.ROW] for r in kept.collect()} == {"mine"}


def test_pipeline_over_awkward_rows(spark, tmp_path):
    rng = random.Random(8)
    docs = awkward(spark).union(documents(spark, [(k, " ".join(words(rng, 30, 3000)), "abc"[k % 3]) for k in range(20, 50)]))
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (20, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert check_packing(out, 2048) > 0
    # Copies go with the near duplicates; texts may be drawn any number of times by the mixing.
    assert {r["doc_id"] for r in out} <= {None, 1, 4, 6, 7, 8, 9, *range(20, 50)}
    assert len({r["doc_id"] for r in out}) > 10


def test_pipeline_over_nothing(spark, tmp_path):
    awkward(spark).filter("doc_id = -1").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.collect() == []
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
