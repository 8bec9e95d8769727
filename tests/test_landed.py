"""Landed inventories: partial updates against rewriting everything."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import inventory as I
from fleetlens.sources import inventory as S
from fleetlens.sources import landed

NEW = {"FERNET_KEY": "new-fernet"}


def documents(spark, named):
    """Each document has one block with the given FERNET_KEY."""
    texts = [(n, json.dumps({"servers": [{"hostname": f"h{n}", "services": [{"name": "W", "FERNET_KEY": key, "PORT": 1}]}]})) for n, key in named]
    return S.parse_inventory(spark.createDataFrame(texts, "inventory string, text string"))


def content(df):
    servers = F.to_json("servers")
    return sorted(map(str, df.select("inventory", servers.alias("servers"), "_document").collect()))


def files(path):
    return {f.relative_to(path) for f in Path(path).glob("versions/*/*/*.parquet")}


@pytest.fixture
def fleet(spark, tmp_path):
    docs = documents(spark, [(f"i{n}", "" if n in (3, 57) else f"key{n}") for n in range(100)])
    path = str(tmp_path / "fleet")
    landed.land_documents(docs, path, buckets=16)
    return docs, path


def test_landing_keeps_all_documents_and_no_path_is_landed_twice(spark, fleet):
    docs, path = fleet
    assert landed.read_documents(spark, path).schema == docs.schema
    assert content(landed.read_documents(spark, path)) == content(docs)
    with pytest.raises(ValueError):
        landed.land_documents(docs, path)


def test_partial_backfill_equals_the_full_rewrite_and_leaves_other_files(spark, fleet):
    docs, path = fleet
    before = files(path)
    old = landed.read_documents(spark, path)
    touched = landed.backfill_landed(spark, path, NEW)
    assert 1 <= len(touched) <= 2
    assert content(landed.read_documents(spark, path)) == content(I.backfill_keys(docs, NEW))
    # Files of the table before are all there still, for its readers; the new ones are those of the touched buckets.
    assert before <= files(path) and content(old) == content(docs)
    assert {f.parts[2] for f in files(path) - before} == {f"__bucket={b}" for b in touched}
    # Nothing waits any more: nothing is written.
    now = files(path)
    assert landed.backfill_landed(spark, path, NEW) == [] and files(path) == now
    # The next update drops what the first had replaced, and nothing else.
    landed.update_documents(documents(spark, [("i1", "other")]), path)
    untouched = {f for f in before if f.parts[2] not in {f"__bucket={b}" for b in touched}}
    assert untouched <= files(path) and not (before - untouched) & files(path)


def test_changes_replace_add_and_repeat(spark, fleet):
    docs, path = fleet
    changes = documents(spark, [("i7", "seven"), ("fresh", "f"), (None, "nameless")])
    expected = content(docs.where("inventory != 'i7'").unionByName(changes))
    for _ in range(3):
        landed.update_documents(changes, path)
        assert content(landed.read_documents(spark, path)) == expected
    # Of repeated rows of a name the change is what stays.
    twin = landed.read_documents(spark, path).where("inventory = 'i9'")
    with pytest.raises(ValueError, match="changed twice: i9"):
        landed.update_documents(twin.unionByName(twin), path)
    assert content(landed.read_documents(spark, path)) == expected


def test_an_update_stopped_before_its_manifest_changes_nothing(spark, fleet, monkeypatch):
    docs, path = fleet

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as patched:
        patched.setattr(landed, "write_manifest", stop)
        with pytest.raises(RuntimeError):
            landed.backfill_landed(spark, path, NEW)
    assert content(landed.read_documents(spark, path)) == content(docs)
    landed.backfill_landed(spark, path, NEW)
    assert content(landed.read_documents(spark, path)) == content(I.backfill_keys(docs, NEW))


def test_empty_tables_and_other_columns(spark, tmp_path):
    docs = documents(spark, [("a", ""), ("a", "x")])
    path = str(tmp_path / "empty")
    landed.land_documents(docs.limit(0), path)
    assert landed.read_documents(spark, path).count() == 0 and landed.backfill_landed(spark, path, NEW) == []
    landed.update_documents(docs.limit(1).withColumn("__bucket", F.lit("x")), path)
    assert content(landed.read_documents(spark, path)) == content(docs.limit(1))
    with pytest.raises(ValueError, match="no landed inventories"):
        landed.read_documents(spark, str(tmp_path / "nowhere"))
    # Two rows of one name, both waiting: the update can't tell which counts.
    other = str(tmp_path / "twins")
    landed.land_documents(docs.unionByName(docs), other)
    with pytest.raises(ValueError, match="changed twice"):
        landed.backfill_landed(spark, other, NEW)
    landed.update_documents(documents(spark, [("a", "one")]), other)
    assert content(landed.read_documents(spark, other)) == content(documents(spark, [("a", "one")]))
