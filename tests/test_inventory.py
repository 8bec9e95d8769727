"""Inventory documents: reading, flattening, rewriting."""

import json

import pytest
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.operators import inventory as I
from fleetlens.operators import resolve as R
from fleetlens.sources import inventory as S

DOCUMENT = """{"_notes": "synthetic", "servers": [
  {"hostname": "10.0.0.1", "server_type": "CONTROL", "services": [
    {"name": "Airflow-Scheduler", "install_cmd": "install_a", "DiskPath": "/data/",
     "DB_HOST": "10.0.0.1", "DB_PORT": 5432, "DB_USER": "u s", "DB_PASSWORD": "p@ss/1",
     "FERNET_KEY": "CHANGE_ME_FERNET_KEY", "AIRFLOW_EXTRAS": "aws, redis,,celery",
     "JWT_ISSUER": false, "DB_NAME": "false", "API_PORT": 1, "API_PORT": 9090, "REDIS_PASSWORD": null}]},
  {"hostname": "10.0.0.2", "server_type": "APP", "services": [
    {"name": "Airflow-Worker", "install_cmd": "install_b\\n\\nsecond --x", "FERNET_KEY": ""},
    {"name": "Spark-Standalone", "install_cmd": "install_c", "WORKER_CORES": 0},
    {"name": "Spark-Standalone"}]},
  {"hostname": "10.0.0.2", "server_type": "APP", "services": [
    {"name": "Airflow-Worker", "install_cmd": "", "FERNET_KEY": null, "WEBSERVER_SECRET_KEY": "good"}]},
  {"hostname": "10.0.0.3", "server_type": "APP", "services": []}]}"""


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("inventory")
    (folder / "a.json").write_text(DOCUMENT)
    (folder / "broken.json").write_text(DOCUMENT[:200])
    return S.read_inventory(spark, str(folder))


@pytest.fixture(scope="module")
def services(documents):
    return I.service_rows(I.server_rows(documents))


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_broken_document_is_kept_with_its_text(documents):
    got = documents.select(
        F.regexp_extract("inventory", r"([^/]*)$", 1).alias("f"),
        F.size("servers").alias("n"),
        F.col("_corrupt_record").isNotNull().alias("broken"),
    )
    assert rows(got, "f") == [("a.json", 4, False), ("broken.json", None, True)]


def test_servers_keep_order_and_repeats(documents):
    got = I.server_rows(documents).select("server_pos", "hostname", "server_type")
    assert rows(got, "server_pos") == [
        (0, "10.0.0.1", "CONTROL"), (1, "10.0.0.2", "APP"), (2, "10.0.0.2", "APP"), (3, "10.0.0.3", "APP"),
    ]


def test_service_rows(services):
    got = services.select("server_pos", "service_pos", "service")
    assert rows(got, "server_pos", "service_pos") == [
        (0, 0, C.SCHEDULER), (1, 0, C.WORKER), (1, 1, C.SPARK), (1, 2, C.SPARK), (2, 0, C.WORKER),
    ]


def test_entry_values(services):
    got = dict(
        (r.key, r.value) for r in I.config_entries(services).where("server_pos = 0").collect()
    )
    assert got["DB_PORT"] == "5432"
    assert got["API_PORT"] == "9090", "the last of a repeated key"
    assert got["JWT_ISSUER"] is None, "JSON false is like a missing key"
    assert got["DB_NAME"] == "false", "the text false is a value"
    assert got["REDIS_PASSWORD"] is None
    assert "ADMIN_PASSWORD" not in got


def test_has_key_counts_null_values(services):
    got = services.select("server_pos", I.has_key("FERNET_KEY").alias("f"), I.has_key("REDIS_PASSWORD").alias("r"))
    assert rows(got.distinct(), "server_pos", "f") == [
        (0, True, True), (1, False, False), (1, True, False), (2, True, False),
    ]


def test_install_steps(services):
    got = I.install_steps(services).select("server_pos", "seq", "cmd_pos", "install_cmd", "missing")
    assert rows(got, "server_pos", "seq", "cmd_pos") == [
        (0, 0, 0, "install_a", False),
        (1, 0, 0, "install_b", False),
        (1, 0, 2, "second --x", False),
        (1, 1, 0, "install_c", False),
        (1, 2, 0, None, True),
    ]


def test_host_services_say_how_often_a_host_is_listed(documents, services):
    got = I.host_services(I.server_rows(documents), services).select("hostname", "server_pos", "service_pos", "times")
    assert rows(got, "hostname", "server_pos", "service_pos") == [
        ("10.0.0.1", 0, 0, 1), ("10.0.0.2", 1, 0, 2), ("10.0.0.2", 1, 1, 2), ("10.0.0.2", 1, 2, 2),
        ("10.0.0.2", 2, 0, 2),
    ]


def test_lookup(spark, services):
    requests = spark.createDataFrame(
        [("i", "10.0.0.1", C.SCHEDULER, k) for k in ("DB_PORT", "JWT_ISSUER", "NOPE")]
        + [("i", "10.0.0.9", C.SCHEDULER, "DB_PORT"), ("i", "10.0.0.2", C.WORKER, "FERNET_KEY")],
        "inventory string, hostname string, service string, key string",
    )
    here = I.config_entries(services.withColumn("inventory", F.lit("i")))
    # The same hosts in another inventory.
    there = here.withColumns({"inventory": F.lit("k"), "value": F.lit("other")})
    got = R.config_lookup(requests, here.unionByName(there)).select("hostname", "key", "value")
    assert rows(got, "hostname", "key", "value") == [
        ("10.0.0.1", "DB_PORT", "5432"), ("10.0.0.1", "JWT_ISSUER", None), ("10.0.0.1", "NOPE", None),
        ("10.0.0.2", "FERNET_KEY", None), ("10.0.0.2", "FERNET_KEY", ""), ("10.0.0.9", "DB_PORT", None),
    ]


NEW = {"FERNET_KEY": "new-f", "WEBSERVER_SECRET_KEY": "new-w"}


def body(documents):
    return [json.loads(r.j) for r in documents.where("servers IS NOT NULL").select(F.to_json("servers").alias("j")).collect()][0]


def test_backfill_replaces_all_blocks_that_have_the_key(documents):
    got = body(I.backfill_keys(documents, NEW))
    blocks = [b for s in got for b in s["services"]]
    assert [b.get("FERNET_KEY", "absent") for b in blocks] == ["new-f", "new-f", "absent", "absent", "new-f"]
    assert [b.get("WEBSERVER_SECRET_KEY", "absent") for b in blocks] == ["absent"] * 4 + ["new-w"]
    assert blocks[0]["DB_PORT"] == 5432 and blocks[0]["JWT_ISSUER"] is False and blocks[0]["REDIS_PASSWORD"] is None
    assert list(blocks[1]) == ["name", "install_cmd", "FERNET_KEY"]


def test_backfill_of_missing_values_only(documents):
    blocks = [b for s in body(I.backfill_keys(documents, NEW, only_missing=True)) for b in s["services"]]
    assert [b.get("FERNET_KEY", "absent") for b in blocks] == ["new-f", "new-f", "absent", "absent", "new-f"]
    assert blocks[4]["WEBSERVER_SECRET_KEY"] == "good"


def test_backfill_twice_is_backfill_once(documents):
    once = I.backfill_keys(documents, NEW)
    other = {k: v + "2" for k, v in NEW.items()}
    assert body(I.backfill_keys(once, other)) == body(once)


@pytest.mark.parametrize(
    "block, expected",
    [
        ({"FERNET_KEY": "CHANGE_ME_FERNET_KEY"}, True),
        ({"FERNET_KEY": ""}, True),
        ({"WEBSERVER_SECRET_KEY": ""}, True),
        ({"WEBSERVER_SECRET_KEY": "CHANGE_ME_FERNET_KEY"}, False),
        ({"FERNET_KEY": "CHANGE_ME_OTHER"}, False),
        ({"FERNET_KEY": "COPY_FROM_scheduler"}, False),
        ({"FERNET_KEY": None}, False),
        ({}, False),
    ],
)
def test_needs_backfill_takes_exact_texts_only(spark, block, expected):
    text = json.dumps({"servers": [{"hostname": "h", "services": [{"name": "x"}, {"name": "y", **block}]}]})
    docs = S.parse_inventory(spark.createDataFrame([("i", text)], "inventory string, text string"))
    assert docs.select(I.needs_backfill()).collect() == [(expected,)]


def test_no_services_needs_no_backfill(spark):
    texts = [("a", '{"servers": []}'), ("b", '{"servers": [{"hostname": "h"}]}'), ("c", "{"), ("d", "{}")]
    docs = S.parse_inventory(spark.createDataFrame(texts, "inventory string, text string"))
    assert docs.select(I.needs_backfill()).distinct().collect() == [(False,)]


def test_written_documents_read_back_the_same(spark, documents, tmp_path):
    path = str(tmp_path / "out")
    readable = documents.where("_corrupt_record IS NULL")
    S.write_inventory(readable, path)
    back = S.read_inventory(spark, path, multiline=False)
    assert back.count() == 1
    assert body(back) == body(documents)
    assert back.select("inventory").collect() == readable.select("inventory").collect()


FIELDS = {
    "version": 7, "text": "7", "nested": {"servers": [1, {"a": 1.5}], "quote": "\\E\\Q\"]}"},
    "servers": [
        {"rack": 12, "hostname": "h1", "services": [{"name": "Airflow-Worker", "FERNET_KEY": "", "n": 1, "b": None}], "tags": ["x", True]},
        {"hostname": "h2"}, {"hostname": "h3", "services": [{"name": "z", "FERNET_KEY": "old"}]},
    ],
}


def test_fields_of_no_schema_survive_an_update(spark, tmp_path):
    texts = spark.createDataFrame([("a", json.dumps(FIELDS)), ("b", '{"x": 1}'), ("c", "{}")], "inventory string, text string")
    path = str(tmp_path / "out")
    S.write_inventory(I.backfill_keys(S.parse_inventory(texts), NEW), path)
    back = {r.inventory: json.loads(r._document) for r in S.read_inventory(spark, path, multiline=False).collect()}
    expected = json.loads(json.dumps(FIELDS))
    for server in (0, 2):
        expected["servers"][server]["services"][0]["FERNET_KEY"] = "new-f"
    assert back == {
        "a": {"_inventory": "a", **expected}, "b": {"_inventory": "b", "x": 1}, "c": {"_inventory": "c"},
    }
    again = str(tmp_path / "again")
    S.write_inventory(S.read_inventory(spark, path, multiline=False), again)
    assert {r.inventory for r in S.read_inventory(spark, again, multiline=False).collect()} == {"a", "b", "c"}


def test_what_cannot_be_written_whole_fails(spark, documents, tmp_path):
    with pytest.raises(Exception, match="unreadable document"):
        S.write_inventory(documents, str(tmp_path / "broken"))
    fewer = documents.where("_corrupt_record IS NULL").withColumn("servers", F.slice("servers", 1, 1))
    with pytest.raises(Exception, match="added or taken away"):
        S.write_inventory(fewer, str(tmp_path / "fewer"))


def test_names_do_not_depend_on_the_scan(spark, tmp_path):
    (tmp_path / "lines.json").write_text("\n".join(json.dumps({"servers": [], "n": i}) for i in range(50)))
    names = [r.inventory for r in S.read_inventory(spark, str(tmp_path), multiline=False).collect()]
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        again = [r.inventory for r in S.read_inventory(spark, str(tmp_path), multiline=False).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert len(set(names)) == 50 and sorted(names) == sorted(again)


def test_landed_entries_are_pruned_by_service(spark, services, tmp_path):
    path = str(tmp_path / "entries")
    S.land_config_entries(I.config_entries(services), path)
    scan = spark.read.parquet(path).where(F.col("service") == C.SPARK)
    assert scan.count() == 4
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(service" in plan


def test_flatten_and_backfill_do_not_shuffle(documents, services):
    for df in (I.config_entries(services), I.install_steps(services), I.backfill_keys(documents, NEW)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan
