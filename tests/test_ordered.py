"""Ordered operators against a plain loop, with tiny pieces and a group that holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import ordered as O
from fleetlens.operators.skew import salted_join

KEYS = ["run", "host"]


@pytest.fixture(scope="module", params=[1, 3, 7, 1000])
def case(request, spark):
    rng = random.Random(request.param)
    rows = []
    for n in rng.sample(range(900), 300):
        run, host = ("hot", "h") if rng.random() < 0.6 else (rng.choice("abc"), rng.choice("xyz"))
        rows.append((run, host, n, rng.choice([None, None, "p", "q", "r"])))
    df = spark.createDataFrame(rows, "run string, host string, n long, v string").repartition(5)
    return sorted(rows, key=lambda r: r[2]), O.with_part(df, rows=request.param)


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r[:2], []).append(r)
    return out.values()


def got(df):
    return {r.n: r.out for r in df.collect()}


def test_fill_forward(case):
    rows, df = case
    expected = {}
    for group in groups(rows):
        last = None
        for r in group:
            last = r[3] or last
            expected[r[2]] = last
    assert got(O.fill_forward(df, "v", KEYS, "out")) == expected


def test_earlier_count(case):
    rows, df = case
    expected = {}
    for group in groups(rows):
        seen = 0
        for r in group:
            expected[r[2]] = seen
            seen += r[3] == "q"
    assert got(O.earlier_count(df, F.col("v") == "q", KEYS, "out")) == expected


def test_next_value(case):
    rows, df = case
    expected = {}
    for group in groups(rows):
        for r, after in zip(group, [*group[1:], None]):
            expected[r[2]] = after[3] if after else None
    assert got(O.next_value(df, "v", KEYS, "out")) == expected


def test_line_numbers(case):
    rows, df = case
    expected = {}
    for group in groups(rows):
        expected |= {r[2]: i for i, r in enumerate(group, 1)}
    assert got(O.number_lines(df, KEYS, "out")) == expected


def test_no_window_covers_a_whole_group_of_rows(case):
    _, df = case
    plan = O.earlier_count(df, F.lit(True), KEYS, "out")._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert len(windows) == 2
    assert sum("part" in line.split("], [")[1] for line in windows) == 1, "rows are windowed by piece"


def test_salted_join_equals_a_plain_join(spark):
    big = spark.range(1000).selectExpr("if(id % 3 = 0, -1, id % 50) AS k", "id")
    per_key = spark.createDataFrame([(k, f"v{k}") for k in range(-1, 40)], "k long, v string")
    for how in ("inner", "left"):
        salted = salted_join(big, per_key, ["k"], ["id"], how)
        assert sorted(map(tuple, salted.collect()), key=str) == sorted(
            map(tuple, big.join(per_key, "k", how).select(*salted.columns).collect()), key=str
        )


def test_adaptive_skew_join_acts_on_a_salted_join(spark, tmp_path):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "32",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200KB",
    }
    before = {k: spark.conf.get(k) for k in settings}
    spark.range(400_000).selectExpr("if(id % 3 = 0, -1, id % 5000) AS k", "id", "uuid() AS v").write.parquet(
        str(tmp_path / "big")
    )
    big = spark.read.parquet(str(tmp_path / "big"))
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        per_key = big.groupBy("k").agg(F.count("*").alias("times"))
        total = salted_join(big, per_key, ["k"], ["id"]).agg(F.sum("times"), F.max("v"))
        assert total.collect()[0][0] == sum(
            r.times**2 for r in per_key.collect()
        )
        final = total._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "skew=true" in final
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
