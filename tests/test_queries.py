"""Every registered query beside its SQL on the smallest driver tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point
from fleetlens.plans import samples
from fleetlens.plans.registry import ORACLES, QUERIES

SF_DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for file in SF_DIR.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_point.queries()) and set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = entry_point.queries()[name](spark, str(SF_DIR))
    columns = sorted(df.columns)
    cursor = con.execute(entry_point.oracle_sql()[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == columns
    place = [theirs.index(c) for c in columns]
    expected = sorted(tuple(str(r[i]) for i in place) for r in cursor.fetchall())
    assert sorted(tuple(str(v) for v in r) for r in df.select(*columns).collect()) == expected


def test_inputs_landed_beside_the_tables_give_the_same_rows(spark, tmp_path):
    for file in SF_DIR.glob("*.parquet"):
        (tmp_path / file.name).symlink_to(file)
    samples.land(spark, str(SF_DIR), str(tmp_path))
    for name, landed in (("server_rows", "inventories"), ("level_counts", None), ("parse_run_log", "event_lines")):
        here, there = (QUERIES[name](spark, str(folder)) for folder in (tmp_path, SF_DIR))
        assert sorted(map(str, here.collect())) == sorted(map(str, there.collect()))
        if landed:
            assert any(f"{landed}.parquet" in f for f in here.inputFiles())
