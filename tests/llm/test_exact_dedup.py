"""The content sort beside brute force."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from fleetlens.llm import exact_dedup
from fleetlens.llm.ranges import splitters
from tests.llm.data import awkward, documents, words

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def brute(rows):
    plain = [(r["doc_id"], SPACE.sub(" ", r["text"] or "")) for r in rows]
    groups = {}
    for i, (doc_id, text) in enumerate(plain):
        groups.setdefault(text, []).append((doc_id is None, doc_id or 0, i))
    out = []
    for i, (doc_id, text) in enumerate(plain):
        low = min(groups[text])
        keep = None if low[0] else low[1]
        out.append((doc_id, keep, len(groups[text]), i == low[2], hashlib.sha256(text.encode()).hexdigest()))
    return sorted(map(str, out))


def found(df):
    return sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])) for r in df.collect())


def check(docs):
    assert found(exact_dedup.exact_groups(docs)) == brute(docs.select("doc_id", "text").collect())


def test_awkward_rows(spark):
    check(awkward(spark))


def test_no_rows_and_one_row(spark):
    docs = awkward(spark)
    assert exact_dedup.exact_groups(docs.filter("doc_id = -1")).collect() == []
    check(docs.filter("doc_id = 4"))


def test_groups_that_span_ranges(spark):
    """A third of all rows are one text, a sixth one row, and others differ at their ends only."""
    rng = random.Random(3)
    head = " ".join(words(rng, 60))
    rows = [(i, "same  \t text", "s") for i in range(400)] + [(7, "one row", "s")] * 100 + [(None, "no id", "s")] * 100
    rows += [(1000 + i, f"{head} {i % 150}", "s") for i in range(300)] + [(5000 + i, " ".join(words(rng, 5)), "s") for i in range(300)]
    rng.shuffle(rows)
    check(documents(spark, rows).repartition(7))


def test_deduplicated_texts(spark):
    docs = documents(spark, ["a  b", "a b", " a b", None, "", "c"])
    kept = exact_dedup.exact_groups(docs, keep_text=True).filter("kept")
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(0, "a b"), (2, " a b"), (3, ""), (5, "c")]


def test_a_hot_key_is_cut(spark):
    """Ranges stay about even when every row has the same text and id."""
    rows = spark.range(4000).select(F.lit("x").alias("k"), F.monotonically_increasing_id().alias("row"))
    keys = {"k": F.col("k"), "row": F.col("row")}
    cuts = splitters(rows, keys, "k string, row bigint", F.lit(1), ranges=20)
    sizes = [r["count"] for r in rows.groupBy(cuts.range_of(F.struct(*keys))).count().collect()]
    assert len(sizes) > 15 and max(sizes) < 600
