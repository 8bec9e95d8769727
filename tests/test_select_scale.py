"""Loose matches by index against the pattern itself, and the filter before the anti join."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import select


def plan_of(df):
    return df._jdf.queryExecution().toString()


def matches(host, addresses):
    # A dot stands for any character that does not end a line; a word is of ASCII letters, digits and _.
    body = "".join("[^\\n\\r\\u0085\\u2028\\u2029]" if c == "." else re.escape(c) for c in host)
    return re.search(rf"(?<![A-Za-z0-9_]){body}(?![A-Za-z0-9_])", addresses) is not None


def loose(spark, hosts, lists):
    wanted = spark.createDataFrame(hosts, "inventory string, pos int, hostname string")
    table = spark.createDataFrame(lists, "inventory string, addresses string")
    return sorted(r.pos for r in select.match_local(wanted, table, "loose").collect())


def test_loose_match_equals_the_pattern(spark):
    draw = random.Random(7)

    def text(longest):
        return "".join(draw.choices("ab1..-: \n\r_é😀", k=draw.randint(0, longest)))

    hosts = [(draw.choice("ijkl"), n, text(4)) for n in range(1500)]
    lists = [(draw.choice("ijkl"), text(14)) for _ in range(60)]
    expected = [n for key, n, name in hosts if any(k == key and matches(name, held) for k, held in lists)]
    assert 200 < len(expected) < 1300 and loose(spark, hosts, lists) == expected


def test_loose_match_of_nulls_repeats_and_long_lists(spark):
    lists = [("i", "".join(f"10.0.{n // 256}.{n % 256} " for n in range(3000))), ("i", None), (None, "a"), ("j", "")]
    hosts = [("i", 0, "10.0.11.183"), ("i", 1, "10.0.11.999"), ("i", 2, None), (None, 3, "a"), ("i", 4, "10.0.11.183"), ("j", 5, ""), ("j", 6, "a")]
    assert loose(spark, hosts, lists) == [0, 4, 5]
    assert loose(spark, hosts, []) == [] and loose(spark, [], lists) == []


def test_loose_match_joins_by_equality_only(spark):
    wanted = spark.createDataFrame([("i", "a")], "inventory string, hostname string")
    table = spark.createDataFrame([("i", "a b")], "inventory string, addresses string")
    joins = [line for line in plan_of(select.match_local(wanted, table, "loose")).split("== Physical Plan ==")[1].splitlines() if "Join" in line]
    assert len(joins) == 2 and not any("LIKE" in line for line in joins)


def test_filtered_skip_gives_the_same_rows_and_shuffles_fewer(spark):
    desired = spark.range(20000).selectExpr("id AS k", "if(id % 7 = 0, NULL, concat('h', id)) AS hostname")
    observed = spark.range(0, 2000).selectExpr("id * 10 AS k", "concat('h', id * 10) AS hostname")
    for keys in (["k"], ["hostname"], ["k", "hostname"]):
        there = {tuple(r) for r in observed.select(*keys).collect()}
        expected = [r for r in desired.collect() if tuple(r[k] for k in keys) not in there]
        for bits in (64, 1 << 16, select.BLOOM_BITS):
            got = select.skip_existing(desired, observed, keys, bloom_bits=bits)
            assert sorted(map(str, got.select("k", "hostname").collect())) == sorted(map(str, expected)), (keys, bits)
    asked = desired.where(select.maybe_existing(observed, ["k"])).count()
    assert 2000 <= asked < 2100
    # Rows that are surely absent reach the union without an exchange.
    passing = plan_of(desired.where(~select.maybe_existing(observed, ["k"]))).split("== Physical Plan ==")[1]
    assert "Exchange" not in passing.split("Subquery")[0]


def test_filtered_skip_of_empty_tables_other_types_and_repeats(spark):
    some = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c")], "k long, v string")
    none = some.limit(0)
    assert select.skip_existing(some, none, ["k"], bloom_bits=1024).count() == 4
    assert select.skip_existing(none, some, ["k"], bloom_bits=1024).count() == 0
    narrow = some.select(F.col("k").cast("int").alias("k"))
    assert sorted(r.v for r in select.skip_existing(some, narrow.where("k = 1"), ["k"], bloom_bits=1024).collect()) == ["b", "c"]
    assert [r.v for r in select.skip_existing(some, some, ["k"], bloom_bits=1024).collect()] == ["c"]


@pytest.mark.parametrize("bits", [1, 63, 64, 65])
def test_a_filter_of_any_size_is_exact(spark, bits):
    desired, observed = spark.range(50), spark.range(0, 50, 2)
    assert [r.id for r in select.skip_existing(desired, observed, ["id"], bloom_bits=bits).orderBy("id").collect()] == list(range(1, 50, 2))
