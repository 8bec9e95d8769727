"""Resolution, validation, rendering and selection on small hand-written tables."""

import json
import urllib.parse

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions import text as X
from fleetlens.operators import inventory as I
from fleetlens.operators import render, resolve, select, validate
from fleetlens.sources import inventory as S
from fleetlens.sources import sinks

GOOD = {
    "DiskPath": "/data/", "DAGS_FOLDER": "/dags", "DB_HOST": "db", "DB_PASSWORD": "p@ss/1", "REDIS_HOST": "rd",
    "FERNET_KEY": "fk", "WEBSERVER_SECRET_KEY": "wk", "ADMIN_PASSWORD": "adm",
}


def services_of(spark, *blocks):
    """Each block is (host, service, keys), all in one inventory."""
    servers = [{"hostname": h, "server_type": "APP", "services": [{"name": s, **keys}]} for h, s, keys in blocks]
    docs = spark.createDataFrame([("inv", json.dumps({"servers": servers}))], "inventory string, text string")
    return I.service_rows(I.server_rows(S.parse_inventory(docs)))


def one(df):
    (row,) = df.collect()
    return row.asDict()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("service", [C.SCHEDULER, C.WORKER, C.SPARK])
def test_every_rule_line(spark, service):
    rules = [r for r in C.RULES if r[0] == service]
    assert len(rules) == {C.SCHEDULER: 23, C.WORKER: 19, C.SPARK: 10}[service]
    blanks = {"absent": {}, "null": dict.fromkeys([r[1] for r in rules])}
    blanks |= {f"is {v}": dict.fromkeys([r[1] for r in rules], v) for v in ("", False)}
    texts = {"text": dict.fromkeys([r[1] for r in rules], "null")}
    services = services_of(spark, *[(host, service, keys) for host, keys in (blanks | texts).items()])
    wide = {r.hostname: r for r in resolve.resolve(services, service).collect()}
    long = {(r.hostname, r.key): (r.value, r.origin) for r in resolve.resolved_entries(services).collect()}
    for _, key, kind, default in rules:
        for host in blanks:
            value = host if kind == "host" else default
            assert wide[host][key] == value, (host, key)
            assert long[host, key] == (value, "default" if value else "missing")
        assert wide["text"][key] == "null" and long["text", key] == ("null", "set")


def test_scheduler_columns(spark):
    keys = {**GOOD, "DB_USER": "u s", "REDIS_PASSWORD": "r*d", "AIRFLOW_EXTRAS": "aws, redis,,celery", "DB_PORT": 5433}
    got = one(resolve.resolve(services_of(spark, ("10.0.0.1", C.SCHEDULER, keys)), C.SCHEDULER))
    assert got["base_dir"] == "/data" and got["airflow_home"] == "/data/apps/airflow"
    assert got["python_exe"] == "/data/apps/python/bin/python3.10"
    assert got["access_log"] == "/data/airflow_scheduler.access.log"
    assert got["extras"] == "celery,postgres,redis,aws, redis"
    assert got["sql_alchemy_conn"] == "postgresql+psycopg2://u%20s:p%40ss%2F1@db:5433/airflow"
    assert got["result_backend"] == "db+postgresql://u%20s:p%40ss%2F1@db:5433/airflow"
    assert got["broker_url"] == "redis://:r%2Ad@rd:6379/0"


def test_spark_columns(spark):
    got = one(resolve.resolve(services_of(spark, ("h", C.SPARK, {"DiskPath": "/d//", "WORKER_CORES": 4})), C.SPARK))
    assert got["base_dir"] == "/d/" and got["spark_home"] == "/d//apps/spark"
    assert got["worker_args"] == " -c 4"
    assert got["package"] == "spark-4.0.3-bin-hadoop3" and got["tarball"] == "spark-4.0.3-bin-hadoop3.tgz"
    assert got["primary_url"].endswith("/spark/spark-4.0.3/spark-4.0.3-bin-hadoop3.tgz")
    assert got["archive_url"].startswith("https://archive.apache.org/dist/spark/")


def test_scheduler_units(spark):
    services = services_of(
        spark, ("a", C.SCHEDULER, {**GOOD, "INSTALL_FLOWER": 1}), ("b", C.SCHEDULER, {**GOOD, "INSTALL_FLOWER": "yes"})
    )
    units = render.expand_units(resolve.resolve(services, C.SCHEDULER), C.SCHEDULER)
    got = [(r.hostname, r.unit) for r in units.orderBy("hostname", "unit_pos").collect()]
    four = ["airflow-apiserver", "airflow-dagprocessor", "airflow-scheduler", "airflow-triggerer"]
    assert got == [("a", u) for u in [*four, "airflow-flower"]] + [("b", u) for u in four]
    flower = units.where("unit = 'airflow-flower'").collect()[0]
    assert flower.command == "/data/apps/python/bin/airflow celery flower --port 5555"


def test_worker_unit_document(spark):
    services = services_of(spark, ("Node_A.7", C.WORKER, GOOD))
    got = one(render.render_units(resolve.resolve(services, C.WORKER), C.WORKER))
    assert got["unit"] == "airflow-worker-nodea7"
    assert got["body"] == (
        "[Unit]\nDescription=Airflow Celery Worker (Node_A.7)\nRequires=network-online.target\n"
        "After=network-online.target\n\n[Service]\nType=simple\nUser=airflow\nGroup=airflow\n"
        'Environment="AIRFLOW_HOME=/data/apps/airflow"\n'
        'Environment="PATH=/data/apps/python/bin:/usr/bin:/bin"\n'
        'Environment="AIRFLOW__CORE__EXECUTOR=CeleryExecutor"\n'
        'Environment="AIRFLOW__CORE__DAGS_FOLDER=/dags"\n'
        'Environment="AIRFLOW__CORE__FERNET_KEY=fk"\n'
        'Environment="AIRFLOW__DATABASE__SQL_ALCHEMY_CONN=postgresql+psycopg2://airflow:p%40ss%2F1@db:5432/airflow"\n'
        'Environment="AIRFLOW__CELERY__BROKER_URL=redis://rd:6379/0"\n'
        'Environment="AIRFLOW__CELERY__RESULT_BACKEND=db+postgresql://airflow:p%40ss%2F1@db:5432/airflow"\n'
        'Environment="AIRFLOW__WEBSERVER__SECRET_KEY=wk"\n'
        "ExecStart=/data/apps/python/bin/airflow celery worker --queues default --concurrency 16\n"
        "Restart=always\nRestartSec=5s\n\n[Install]\nWantedBy=multi-user.target\n"
    )


def test_line_break_in_a_value_gives_a_further_line(spark):
    services = services_of(spark, ("h", C.WORKER, {**GOOD, "DAGS_FOLDER": "/dags\nX=1\n\nplain"}))
    body = one(render.render_units(resolve.resolve(services, C.WORKER), C.WORKER))["body"]
    assert 'DAGS_FOLDER=/dags"\nEnvironment="X=1"\nEnvironment="plain=plain"\nEnvironment="AIRFLOW__CORE__FERNET' in body


def test_spark_unit_documents(spark):
    services = services_of(spark, ("10.0.0.4", C.SPARK, {"DiskPath": "/d", "WORKER_MEMORY": "4g"}))
    rows = render.render_units(resolve.resolve(services, C.SPARK), C.SPARK, F.lit("/jvm")).orderBy("unit").collect()
    tail = "Restart=always\nRestartSec=5s\n[Install]\nWantedBy=multi-user.target\n"
    env = 'Environment="JAVA_HOME=/jvm"\nEnvironment="SPARK_HOME=/d/apps/spark"\n'
    assert [r.unit for r in rows] == ["spark-master", "spark-worker"]
    assert rows[0].body == (
        "[Unit]\nDescription=Apache Spark Master (standalone)\nAfter=network-online.target\n"
        f"Wants=network-online.target\n[Service]\nType=simple\nUser=spark\nGroup=spark\n{env}"
        "ExecStart=/d/apps/spark/bin/spark-class org.apache.spark.deploy.master.Master --host 10.0.0.4 --port 7077"
        f" --webui-port 8080\n{tail}"
    )
    assert rows[1].body == (
        "[Unit]\nDescription=Apache Spark Worker (standalone)\nAfter=network-online.target spark-master.service\n"
        "Wants=network-online.target\nRequires=spark-master.service\n[Service]\nType=simple\nUser=spark\n"
        f"Group=spark\n{env}ExecStart=/d/apps/spark/bin/spark-class org.apache.spark.deploy.worker.Worker"
        f" spark://10.0.0.4:7077 --webui-port 8081 -m 4g\n{tail}"
    )


def test_profile_and_spark_env(spark):
    services = services_of(spark, ("h", C.SCHEDULER, GOOD), ("s", C.SPARK, {"DiskPath": "/d"}))
    profile = one(render.render_profile(resolve.resolve(services, C.SCHEDULER)))["body"]
    assert profile == "export AIRFLOW_HOME=/data/apps/airflow\nexport PATH=/data/apps/python/bin:$PATH\n"
    env = one(render.render_spark_env(resolve.resolve(services, C.SPARK), F.lit("/jvm")))["body"]
    assert env == (
        "export JAVA_HOME=/jvm\nexport SPARK_MASTER_HOST=s\nexport SPARK_MASTER_PORT=7077\n"
        "export SPARK_MASTER_WEBUI_PORT=8080\nexport SPARK_WORKER_WEBUI_PORT=8081\n"
    )


def test_env_block_lengths(spark):
    services = services_of(spark, ("a", C.SCHEDULER, GOOD), ("b", C.WORKER, GOOD))
    for service, n, last in ((C.SCHEDULER, 8, "AIRFLOW__API_AUTH__JWT_ISSUER"), (C.WORKER, 7, "AIRFLOW__WEBSERVER__SECRET_KEY")):
        rows = render.env_rows(resolve.resolve(services, service), service).orderBy("pos").collect()
        assert len(rows) == n and rows[-1].key == last


def test_documents_are_written_once_per_host_and_unit(spark, tmp_path):
    services = services_of(spark, *[(f"h{i}", C.SPARK, {"DiskPath": "/d"}) for i in range(5)])
    docs = render.render_units(resolve.resolve(services, C.SPARK), C.SPARK)
    sinks.write_documents(docs, str(tmp_path / "ranged"), files=2)
    sinks.write_documents(docs, str(tmp_path / "hosts"), by_host=True)
    for name in ("ranged", "hosts"):
        back = spark.read.parquet(str(tmp_path / name))
        assert back.select("hostname", "unit").distinct().count() == back.count() == 10


def test_violation_reasons(spark):
    expected = [
        (None, "missing", "missing"), ("", "empty", "empty"), ("null", "null_text", "null_text"),
        ("CHANGE_ME", "placeholder", "placeholder"), ("CHANGE_ME_X", "placeholder", "placeholder"),
        ("xCHANGE_ME", None, None), ("COPY_FROM_scheduler", None, "copy_from"), ("COPY_FROM", None, None),
        ("ok", None, None), (" ", None, None),
    ]
    df = spark.createDataFrame([(v,) for v, _, _ in expected], "v string")
    reasons = [validate.violation_reason("v", F.lit(k)) for k in ("req", "match", "default", "optional", "host")]
    got = df.select("v", *[r.alias(f"r{i}") for i, r in enumerate(reasons)]).collect()
    assert {tuple(r) for r in got} == {(*e, None, None, None) for e in expected}


def test_all_and_first_violations(spark):
    bad = {**GOOD, "DAGS_FOLDER": "CHANGE_ME_DAGS", "DB_PASSWORD": "", "FERNET_KEY": "COPY_FROM_scheduler"}
    services = services_of(spark, ("a", C.SCHEDULER, bad), ("b", C.WORKER, GOOD), ("c", "Other", {"x": ""}), ("d", C.SPARK, {}))
    got = [(r.hostname, r.key, r.reason) for r in validate.violations(services).orderBy("hostname", "rule_order").collect()]
    assert got == [
        ("a", "DAGS_FOLDER", "placeholder"), ("a", "DB_PASSWORD", "empty"), ("a", "FERNET_KEY", "copy_from"),
        ("d", "DiskPath", "missing"),
    ]
    first = validate.first_violation(services)
    assert sorted((r.hostname, r.key) for r in first.collect()) == [("a", "DAGS_FOLDER"), ("d", "DiskPath")]
    assert "value" not in validate.violations(services).columns
    assert "Exchange" not in plan_of(validate.violations(services)) + plan_of(first)


def test_consistency(spark):
    services = services_of(
        spark,
        ("a", C.SCHEDULER, GOOD), ("b", C.WORKER, {**GOOD, "FERNET_KEY": "other"}), ("c", C.WORKER, {"FERNET_KEY": ""}),
        ("d", C.SPARK, {"FERNET_KEY": "third"}),
    )
    got = {r.key: (r.n_blocks, r.n_missing, r.n_values, r.consistent) for r in validate.consistent_across(services).collect()}
    assert got == {"FERNET_KEY": (3, 1, 2, False), "WEBSERVER_SECRET_KEY": (3, 1, 1, False)}
    blocks = validate.inconsistent_blocks(services, secret="s").collect()
    assert sorted((r.hostname, r.key) for r in blocks) == [(h, k) for h in "abc" for k in ("FERNET_KEY", "WEBSERVER_SECRET_KEY")]
    assert not {"fk", "other"} & {v for r in blocks for v in r}


def test_backfill_flags_on_entries(spark):
    entries = I.config_entries(services_of(spark, ("a", C.WORKER, {"FERNET_KEY": "CHANGE_ME_FERNET_KEY"})))
    assert validate.backfill_flags(entries).collect() == [("inv", True)]
    entries = I.config_entries(services_of(spark, ("a", C.WORKER, {"FERNET_KEY": None})))
    assert validate.backfill_flags(entries).collect() == [("inv", False)]


def test_empty_selection_is_flagged(spark):
    inventories = spark.createDataFrame([("a",), ("b",)], "inventory string")
    selected = spark.createDataFrame([("a", "h")], "inventory string, hostname string")
    got = {r.inventory: (r.n_selected, r.is_empty) for r in validate.non_empty_guard(inventories, selected).collect()}
    assert got == {"a": (1, False), "b": (0, True)}


def test_same_values_on_all_blocks_are_consistent(spark):
    same = services_of(spark, ("a", C.SCHEDULER, GOOD), ("b", C.WORKER, GOOD))
    assert {r.consistent for r in validate.consistent_across(same).collect()} == {True}
    none = services_of(spark, ("a", C.SCHEDULER, {}), ("b", C.WORKER, {}))
    assert {r.consistent for r in validate.consistent_across(none).collect()} == {False}


def test_no_secret_leaves_a_masked_table(spark):
    rows = [("a", C.SCHEDULER, {**GOOD, "REDIS_PASSWORD": "rpw"})]
    services = services_of(spark, *rows)
    resolved = resolve.resolve(services, C.SCHEDULER)
    text = json.dumps({"servers": [{"hostname": h, "services": [{"name": s, **cfg}]} for h, s, cfg in rows]})
    documents = S.parse_inventory(
        spark.createDataFrame([("i", text), ("j", text[:-5])], "inventory string, text string")
    )
    frames = [
        resolved, I.config_entries(services), render.render_units(resolved, C.SCHEDULER), services, documents,
        render.env_rows(resolved, C.SCHEDULER), resolve.resolved_entries(services), I.server_rows(documents),
        render.expand_units(resolved, C.SCHEDULER), validate.violations(services),
    ]
    masked = [str(resolve.mask_secrets(f, "s").collect()) for f in frames]
    for secret in ("p@ss/1", "p%40ss", "rpw", "'fk'", "=fk", '"fk"', "'wk'", '"wk"', "'adm'", '"adm"'):
        for frame, shown in zip(frames, masked, strict=True):
            assert secret not in shown, (secret, frame.columns)
    one, two = (str(resolve.mask_secrets(resolved, k).collect()) for k in ("s", "t"))
    assert one != two, "the hash depends on the key"


# Every rule, spelled out apart from the library's table.
RULE_TABLE = """
Airflow-Scheduler: DiskPath req | SERVICE_USER airflow | PYTHON_VERSION 3.10.10 | AIRFLOW_VERSION 3.1.2 | AIRFLOW_EXTRAS optional
 | API_PORT 8080 | JWT_ISSUER airflow-api | DAGS_FOLDER req | DB_HOST req | DB_PORT 5432 | DB_NAME airflow | DB_USER airflow
 | DB_PASSWORD req | REDIS_HOST req | REDIS_PORT 6379 | REDIS_DB 0 | REDIS_PASSWORD optional | FERNET_KEY match
 | WEBSERVER_SECRET_KEY match | ADMIN_USERNAME admin | ADMIN_PASSWORD req | INSTALL_FLOWER 0 | FLOWER_PORT 5555
Airflow-Worker: DiskPath req | SERVICE_USER airflow | PYTHON_VERSION 3.10.10 | AIRFLOW_VERSION 3.1.2 | AIRFLOW_EXTRAS optional
 | DAGS_FOLDER req | DB_HOST req | DB_PORT 5432 | DB_NAME airflow | DB_USER airflow | DB_PASSWORD req | REDIS_HOST req
 | REDIS_PORT 6379 | REDIS_DB 0 | REDIS_PASSWORD optional | FERNET_KEY match | WEBSERVER_SECRET_KEY match
 | WORKER_QUEUES default | WORKER_CONCURRENCY 16
Spark-Standalone: DiskPath req | SPARK_VERSION 4.0.3 | HADOOP_VARIANT hadoop3 | SERVICE_USER spark | MASTER_IP host
 | MASTER_PORT 7077 | MASTER_UI_PORT 8080 | WORKER_UI_PORT 8081 | WORKER_CORES 0 | WORKER_MEMORY 0
"""


def test_rules_are_those_of_the_table(spark):
    """Effective values and violations of empty blocks, against the written table."""
    services = services_of(spark, *[("h", s, {}) for s in (C.SCHEDULER, C.WORKER, C.SPARK)])
    got = {(r.service, r.key): r.value for r in resolve.resolved_entries(services).collect()}
    missing = {(r.service, r.key) for r in validate.violations(services).collect()}
    copied = services_of(spark, *[("h", s, {k: "COPY_FROM_x" for t, k in got if t == s}) for s in (C.SCHEDULER, C.WORKER, C.SPARK)])
    matched = {(r.service, r.key) for r in validate.violations(copied).collect()}
    expected = {}
    for line in RULE_TABLE.replace("\n |", " |").strip().split("\n"):
        service, entries = line.split(": ")
        for entry in entries.split(" | "):
            key, rule = entry.split(" ")
            expected[service, key] = rule
    plain = {"req": None, "match": None, "optional": None, "host": "h"}
    assert got == {k: plain.get(r, r) for k, r in expected.items()}
    assert missing == {k for k, r in expected.items() if r in ("req", "match")}
    assert matched == {k for k, r in expected.items() if r == "match"}


def test_packages_of_a_service(spark):
    services = services_of(spark, ("a", C.WORKER, {**GOOD, "AIRFLOW_EXTRAS": "aws, redis,,celery", "PYTHON_VERSION": "3.12.4"}))
    got = resolve.package_rows(resolve.resolve(services, C.WORKER)).orderBy("pos").collect()
    assert [r.requirement for r in got] == [
        "apache-airflow==3.1.2", "apache-airflow[celery]==3.1.2", "apache-airflow[postgres]==3.1.2", "apache-airflow[redis]==3.1.2",
        "apache-airflow[aws]==3.1.2", "apache-airflow[redis]==3.1.2",
    ]
    assert {r.python_source_url for r in got} == {"https://www.python.org/ftp/python/3.12.4/Python-3.12.4.tgz"}


def hosts(spark, *names):
    return spark.createDataFrame([("i", p, h) for p, h in enumerate(names)], "inventory string, pos int, hostname string")


@pytest.mark.parametrize(
    "only, expected",
    [(None, "aAbaX"), ("", "aAbaX"), ("a", "aa"), ("a,a,zz", "aa"), ("b,A", "Ab"), (" a", ""), (",", ""), ("a\nb", "aba")],
)
def test_select_hosts(spark, only, expected):
    got = select.select_hosts(hosts(spark, *"aAbaX"), only).orderBy("pos").collect()
    assert "".join(r.hostname for r in got) == expected


def test_select_hosts_by_table(spark, tmp_path):
    hosts(spark, *"aAbaX").write.parquet(str(tmp_path / "h"))
    only = spark.createDataFrame([("a",), ("a",), ("b",)], "hostname string")
    everything = select.select_hosts(hosts(spark, *"aAbaX"), only.where("hostname = 'none'")).collect()
    assert sorted(r.hostname for r in everything) == sorted("aAbaX"), "an empty table means all"
    table = spark.read.parquet(str(tmp_path / "h"))
    assert sorted(r.hostname for r in select.select_hosts(table, only).collect()) == ["a", "a", "b"]
    assert "ExistenceJoin" in plan_of(select.select_hosts(table, only)) and "NestedLoop" not in plan_of(select.select_hosts(table, only))
    assert "PushedFilters: [In(hostname, [a,b])]" in plan_of(select.select_hosts(table, "a,b"))


def test_match_local(spark):
    expected = [
        ("192.0.2.85", True, True), ("0.2.85", False, True), ("192.0.2.8", False, False), ("10.0.0.2", True, True),
        ("10x0.0.2", False, False), ("192.0.2", False, True), ("192+0.2.85", False, False), ("1.0.0.2", False, False),
        ("10.0.0.", False, False), ("10.0.0.2.", False, True), ("19.0", False, False), ("0.2", False, True),
        ("(", False, False), ("[a", False, False),
    ]
    addresses = "192.0.2.85 10.0.0.2 "
    wanted = hosts(spark, *[h for h, _, _ in expected])
    lists = [("i", addresses), ("j", " ".join(h for h, _, _ in expected))]
    table = spark.createDataFrame(lists, "inventory string, addresses string")
    for given_as in (addresses, table):
        for mode, place in (("exact", 1), ("loose", 2)):
            got = {r.hostname for r in select.match_local(wanted, given_as, mode).collect()}
            assert got == {e[0] for e in expected if e[place]}, (mode, given_as)


def test_local_match_by_table_is_an_equi_join(spark):
    table = spark.createDataFrame([("i", "a b")], "inventory string, addresses string")
    for mode in ("exact", "loose"):
        plan = plan_of(select.match_local(hosts(spark, "a"), table, mode))
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_skip_existing_total_and_distinct(spark):
    wanted = hosts(spark, "a", "b", "", "a")
    assert [r.hostname for r in select.skip_existing(wanted, hosts(spark, "a"), ["hostname"]).orderBy("pos").collect()] == ["b", ""]
    assert select.total_hosts(wanted).collect() == [("i", 3)]
    assert select.drop_blank_rows(wanted).count() == 3
    got = select.ordered_distinct(wanted, "inventory", "hostname", "pos").orderBy("first_pos").collect()
    assert [(r.hostname, r.first_pos) for r in got] == [("a", 0), ("b", 1), ("", 2)]


def value(spark, expression, text):
    return spark.createDataFrame([(text,)], "c string").select(expression.alias("v")).collect()[0].v


@pytest.mark.parametrize(
    "expression, text, expected",
    [
        (lambda: X.first_token("c"), "10.0.0.1 172.17.0.1 ", "10.0.0.1"), (lambda: X.first_token("c"), "  a\tb", "a"),
        (lambda: X.first_token("c"), "", ""), (lambda: X.first_token("c"), None, None),
        (lambda: X.url_encode("c"), "a b+*~%é€-_.", "a%20b%2B%2A~%25%C3%A9%E2%82%AC-_."),
        (lambda: X.base_dir("c"), "/data", "/data"), (lambda: X.base_dir("c"), "/data/", "/data"), (lambda: X.base_dir("c"), "/data//", "/data/"),
        (lambda: X.base_dir("c"), "/", ""),
        (lambda: X.major_minor("c"), "3", "3"), (lambda: X.major_minor("c"), "3.10", "3"), (lambda: X.major_minor("c"), "3.10.10", "3.10"),
        (lambda: X.merge_csv("c"), None, "celery,postgres,redis"), (lambda: X.merge_csv("c"), "aws, redis,,celery", "celery,postgres,redis,aws, redis"),
        (lambda: X.merge_csv("c"), "a\nb,a", "celery,postgres,redis,a,b"),
        (lambda: X.csv_items("c"), " a  b , ,c,c,", ["a b", "c", "c"]),
        (lambda: X.split_kv("c"), "K=a=b", ("K", "a=b")), (lambda: X.split_kv("c"), "K=", ("K", "")), (lambda: X.split_kv("c"), "K", ("K", "K")),
        (lambda: X.split_kv("c"), "=v", ("", "v")),
        (lambda: X.env_entries("c"), "A=1\n\nB=x=y\n", [("A", "1"), ("B", "x=y")]),
        (lambda: X.slug("c"), "Node_A.é-7", "airflow-worker-nodea-7"), (lambda: X.slug("c"), "KXİ", "airflow-worker-x"),
        (lambda: X.run_id(F.col("c").cast("timestamp_ntz")), "2026-09-25 16:24:29.5", "25092026162429"),
        (lambda: X.run_time("c").cast("string"), "25092026162429", "2026-09-25 16:24:29"), (lambda: X.run_time("c"), "99992026162429", None),
        (lambda: X.log_line(F.col("c").cast("timestamp_ntz"), F.lit("m")), "2026-01-02 03:04:05", "[2026-01-02 03:04:05] m"),
        (lambda: X.log_line(F.col("c").cast("timestamp_ntz"), F.lit("m"), F.lit("INFO")), "2026-01-02 03:04:05", "[2026-01-02 03:04:05] [INFO] m"),
        (lambda: X.optional_args("c", F.lit("0")), "0", ""), (lambda: X.optional_args("c", F.lit("2g")), "4", " -c 4 -m 2g"),
        (lambda: X.broker_url("c", F.lit("h"), F.lit("1"), F.lit("0")), "", "redis://h:1/0"),
        (lambda: X.broker_url("c", F.lit("h"), F.lit("1"), F.lit("0")), "p/", "redis://:p%2F@h:1/0"),
    ],
)
def test_text_functions(spark, expression, text, expected):
    assert value(spark, expression(), text) == expected


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x00")), min_size=50, max_size=50))
def test_text_properties(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    merged = X.merge_csv("c")
    got = df.select(
        "c", X.url_encode("c").alias("u"), merged.alias("m"), X.merge_csv(merged).alias("m2"), X.slug("c").alias("s")
    ).collect()
    for r in got:
        assert r.u == urllib.parse.quote(r.c, safe="~")
        assert r.m2 == r.m
        assert set(r.s) <= set("abcdefghijklmnopqrstuvwxyz0123456789-")


def test_resolve_and_render_do_not_shuffle(spark):
    services = services_of(spark, ("a", C.SCHEDULER, GOOD))
    plan = plan_of(render.render_units(resolve.resolve(services, C.SCHEDULER), C.SCHEDULER))
    assert "Exchange" not in plan and "Python" not in plan.replace("ExistingRDD", "")
