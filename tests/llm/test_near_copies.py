"""Toxic texts copied with small changes, and rows that the pipeline's stage must take."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import toxicity
from tests.llm.data import awkward, documents, words


def corpus(copies, seed=3):
    rng = random.Random(seed)
    toxic = [" ".join([*words(rng, 12, 300), "moron", *words(rng, 12, 300)]) for _ in range(60)]
    clean = [" ".join(words(rng, 25, 300)) for _ in range(300)]
    near = []
    for _ in range(copies):
        text = toxic[0].split()
        text[rng.choice([i for i, w in enumerate(text) if w != "moron"])] = f"w{rng.randrange(300)}"
        near.append(" ".join(text))
    return toxic + near, clean


@pytest.mark.parametrize("copies", [60, 150, 1000])
def test_near_copies_of_a_toxic_text(spark, copies):
    toxic, clean = corpus(copies)
    docs = documents(spark, toxic + clean)
    labels = spark.createDataFrame([(i, int(i < len(toxic))) for i in range(len(toxic + clean))], "doc_id long, toxic int")
    scored = toxicity.score_toxicity(docs, labels, F.lit(False)).join(labels, "doc_id")
    assert scored.filter("predicted != toxic").count() == 0
    kept = toxicity.drop_toxic(docs.withColumn(toxicity.RATE, F.lit("x")), labels, F.lit(False))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(len(toxic), len(toxic + clean)))


def test_the_stage_takes_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 0), (4, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    assert toxicity.drop_toxic(docs, labels, F.lit(False)).count() == docs.count()
    assert toxicity.drop_toxic(docs.filter("doc_id = -1"), labels, F.lit(False)).collect() == []
    assert toxicity.drop_toxic(docs, labels.filter("doc_id = -1"), F.lit(False)).count() == docs.count()
