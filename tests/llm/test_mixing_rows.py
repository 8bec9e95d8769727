"""Draws of rows that have no doc_id of their own."""

import pytest

from fleetlens.llm import mixing
from tests.llm.data import documents


@pytest.mark.parametrize("seed", ["a", "mix-1"])
def test_rows_without_an_id_draw_by_themselves(spark, seed):
    """1000 different rows each with a null id, one shared id, and one row repeated; a Poisson of mean 1 keeps 63 %."""
    for rows in (
        [(None, f"text {i}", "s") for i in range(1000)],
        [(7, f"text {i}", "s") for i in range(1000)],
        [(7, "one text", "s")] * 1000,
    ):
        docs = documents(spark, rows).repartition(3)
        mixed = mixing.mix_sources(docs, seed=seed)
        first = mixed.filter("mix_copy = 0").count()
        assert 570 < first < 700 and 880 < mixed.count() < 1120
        assert mixed.columns == [*docs.columns, "mix_copy"]
    # Where a row lies does not matter.
    again = mixing.mix_sources(documents(spark, rows).repartition(5), seed=seed)
    assert again.count() == mixed.count()


def test_other_rows_keep_their_draws(spark):
    plain = [(i, f"text {i}", "s") for i in range(300)]
    alone = mixing.mix_sources(documents(spark, plain)).select("doc_id", "mix_copy").collect()
    beside = mixing.mix_sources(documents(spark, plain + [(None, "x", "t")] * 300)).filter("doc_id is not null")
    assert sorted(map(tuple, alone)) == sorted(map(tuple, beside.select("doc_id", "mix_copy").collect()))
