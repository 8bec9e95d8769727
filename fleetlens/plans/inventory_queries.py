"""Queries over inventories rendered from the customer table."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions import text as X
from fleetlens.operators import inventory as I
from fleetlens.operators import render, resolve, select, validate
from fleetlens.plans import samples
from fleetlens.plans.fleet import fleet_documents, rollout_hosts, services_of
from fleetlens.plans.registry import ORACLES, query
from fleetlens.plans.samples import table
from fleetlens.sources import inventory as source
from fleetlens.sources import landed, sinks
from fleetlens.sources.scratch import scratch_path

WITH = f"WITH {samples.blocks_sql()} "
PLACE = "inventory, server_pos, hostname, service_pos"
JAVA_HOME = "/usr/lib/jvm/java-17"
# The key of the hashes that stand for secrets in these queries.
HASH_KEY = "sample-key"


def _hidden(value):
    """SQL side of the keyed hash."""
    return f"sha256('{HASH_KEY}' || chr(2) || sha256('{HASH_KEY}' || chr(1) || {value}))"


def services(spark, sf_dir):
    return services_of(samples.inventories(spark, sf_dir))


# Documents on disk


@query(
    "read_inventory",
    f"""SELECT CAST(floor(c_custkey / 40.0) AS BIGINT) AS id,
      CAST(floor(c_custkey / 40.0) AS BIGINT) % 13 = 12 AS broken,
      CASE WHEN CAST(floor(c_custkey / 40.0) AS BIGINT) % 13 <> 12 THEN count(*) END AS n_servers
    FROM customer GROUP BY 1, 2""",
)
def read_inventory(spark, sf_dir):
    """Documents written as lines, some cut short, and read back."""
    path = scratch_path(spark, "documents")
    texts = samples.inventory_texts(spark, sf_dir)
    noted = F.replace("text", F.lit('"synthetic"'), F.concat(F.lit('"inventory '), "inventory", F.lit('"')))
    cut = F.expr("int(inventory) % 13 = 12")
    texts.select(F.when(cut, F.left(noted, F.length(noted) - 20)).otherwise(noted).alias("value")).write.text(path)
    documents = source.read_inventory(spark, path, multiline=False)
    note = F.coalesce("_notes", "_corrupt_record")
    return documents.select(
        F.regexp_extract(note, r"inventory (\d+)", 1).cast("bigint").alias("id"),
        F.col("_corrupt_record").isNotNull().alias("broken"),
        F.array_size("servers").cast("bigint").alias("n_servers"),
    )


# Per block: keys in the order of their names, each with the value found and its raw kind.
BLOCK_TEXT = "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN raw_{k} IS NOT NULL THEN '{k}=' || coalesce({k}, '-') END" for k in sorted(samples.VALUES)
) + "], lambda x: x IS NOT NULL), chr(10))"


@query(
    "write_inventory",
    WITH
    + f"""SELECT {PLACE}, service, 'rack ' || (c_custkey % 10) AS rack, 'v' || (CAST(inventory AS BIGINT) % 3) AS version,
      md5({BLOCK_TEXT}) AS block FROM blocks""",
)
def write_inventory(spark, sf_dir):
    """Documents with fields of their own, updated by nothing, written and read back whole."""
    path = scratch_path(spark, "documents")
    texts = samples.inventory_texts(spark, sf_dir)
    version = F.concat(F.lit('{"version":"v'), F.expr("int(inventory) % 3"), F.lit('","_notes"'))
    text = F.replace("text", F.lit('{"_notes"'), version)
    # A server field of its own, from the last digit of the host name.
    text = F.regexp_replace(text, r'(\d)","server_type"', r'$1","rack":"rack $1","server_type"')
    source.write_inventory(source.parse_inventory(texts.select("inventory", text.alias("text"))), path)
    back = source.read_inventory(spark, path, multiline=False)
    rows = services_of(back).join(back.select("inventory", "_document"), "inventory")
    rack = F.get(F.from_json("_document", "servers array<struct<rack: string>>")["servers"], F.col("server_pos").cast("int"))
    pairs = F.filter(F.map_entries("cfg"), lambda e: e["key"] != "name")
    lines = F.transform(F.array_sort(pairs), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("-"))))
    return rows.select(
        *PLACE.split(", "),
        "service",
        rack["rack"].alias("rack"),
        F.get_json_object("_document", "$.version").alias("version"),
        F.md5(F.array_join(lines, "\n")).alias("block"),
    )


# Flattening


@query(
    "server_rows",
    f"""SELECT {samples.INVENTORY} AS inventory, {samples.SERVER_POS} AS server_pos, c_name AS hostname,
      CASE WHEN c_custkey % 40 = 0 THEN 'CONTROL' ELSE 'APP' END AS server_type,
      {' + '.join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in samples.BLOCKS.values())} AS n_services FROM customer""",
)
def server_rows(spark, sf_dir):
    rows = I.server_rows(samples.inventories(spark, sf_dir))
    return rows.withColumn("n_services", F.size("services")).drop("services")


@query("flatten_inventory", WITH + f"SELECT {PLACE}, service FROM blocks")
def flatten_inventory(spark, sf_dir):
    return services(spark, sf_dir).drop("cfg")


def _entry(key):
    hidden = _hidden(key) if key in C.SECRET_KEYS else key
    return f"{{'key': '{key}', 'value': {hidden}, 'there': raw_{key} IS NOT NULL}}"


ENTRIES_SQL = (
    f"SELECT {PLACE}, service, u.key AS key, u.value AS value FROM (SELECT *, unnest([{{'key': 'name', 'value': service,"
    f" 'there': true}}, {', '.join(_entry(k) for k in samples.VALUES)}]) AS u FROM blocks) AS t WHERE u.there"
)


@query("config_entries", WITH + ENTRIES_SQL)
def config_entries(spark, sf_dir):
    return resolve.mask_secrets(I.config_entries(services(spark, sf_dir)), HASH_KEY)


@query("land_config_entries", WITH + ENTRIES_SQL)
def land_config_entries(spark, sf_dir):
    """Entries written as a table by service, and read back."""
    landed = source.land_config_entries(I.config_entries(services(spark, sf_dir)), scratch_path(spark, "entries"))
    return resolve.mask_secrets(landed, HASH_KEY)


@query(
    "install_steps",
    WITH
    + f"""SELECT inventory, server_pos, hostname, service_pos AS seq, cmd_pos - 1 AS cmd_pos,
      install_cmd, install_cmd IS NULL AS missing FROM (
        SELECT {PLACE}, unnest(l) AS install_cmd, generate_subscripts(l, 1) AS cmd_pos FROM (
          SELECT {PLACE}, CASE WHEN install_cmd IS NULL THEN [CAST(NULL AS VARCHAR)]
            ELSE string_split(install_cmd, chr(10)) END AS l FROM blocks) AS a) AS b
      WHERE install_cmd IS NULL OR install_cmd <> ''""",
)
def install_steps(spark, sf_dir):
    return I.install_steps(services(spark, sf_dir))


@query(
    "key_presence",
    WITH
    + f"""SELECT {PLACE}, raw_FERNET_KEY IS NOT NULL AS fernet, raw_JWT_ISSUER IS NOT NULL AS jwt,
      raw_REDIS_PORT IS NOT NULL AS redis_port, raw_install_cmd IS NOT NULL AS install_cmd FROM blocks""",
)
def key_presence(spark, sf_dir):
    names = {"FERNET_KEY": "fernet", "JWT_ISSUER": "jwt", "REDIS_PORT": "redis_port", "install_cmd": "install_cmd"}
    flags = [I.has_key(key).alias(name) for key, name in names.items()]
    return services(spark, sf_dir).select(*PLACE.split(", "), *flags)


@query(
    "host_services",
    WITH
    + f""", listed AS (SELECT o_custkey, count(*) AS times FROM orders GROUP BY 1)
      SELECT {PLACE}, service, times FROM blocks JOIN listed ON o_custkey = c_custkey""",
)
def host_services(spark, sf_dir):
    """Service blocks of the hosts that have orders, with the number of orders."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    hosts = orders.select(
        F.expr(samples.INVENTORY).alias("inventory"),
        F.concat(F.lit("Customer#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("hostname"),
    )
    found = I.host_services(hosts, services(spark, sf_dir))
    return found.select(*PLACE.split(", "), "service", "times")


# Update

FLAGS = """, flags AS (SELECT inventory, bool_or(coalesce(FERNET_KEY IN ('', 'CHANGE_ME_FERNET_KEY'), false)
    OR coalesce(WEBSERVER_SECRET_KEY IN ('', 'CHANGE_ME_WEBSERVER_SECRET_KEY'), false)) AS needs_backfill
  FROM blocks GROUP BY 1)"""
NEW_VALUES = {"FERNET_KEY": "new-fernet", "WEBSERVER_SECRET_KEY": "new-secret"}


def _backfilled(key, condition="true"):
    return f"CASE WHEN needs_backfill AND raw_{key} IS NOT NULL AND {condition} THEN '{NEW_VALUES[key]}' ELSE {key} END"


def _waiting(key):
    return f"({key} IS NULL OR {key} IN ('', 'CHANGE_ME_{key}'))"


def _backfill_rows(spark, sf_dir, only_missing):
    return _key_rows(I.backfill_keys(samples.inventories(spark, sf_dir), NEW_VALUES, only_missing=only_missing))


def _key_rows(documents):
    cfg = F.col("cfg")
    return services_of(documents).select(
        *PLACE.split(", "),
        cfg["FERNET_KEY"].alias("fernet"),
        cfg["WEBSERVER_SECRET_KEY"].alias("secret"),
        cfg["DB_PORT"].alias("db_port"),
        I.has_key("FERNET_KEY").alias("has_fernet"),
    )


@query(
    "backfill",
    WITH
    + FLAGS
    + f"""SELECT {PLACE}, {_backfilled('FERNET_KEY')} AS fernet, {_backfilled('WEBSERVER_SECRET_KEY')} AS secret,
      DB_PORT AS db_port, raw_FERNET_KEY IS NOT NULL AS has_fernet FROM blocks JOIN flags USING (inventory)""",
)
def backfill(spark, sf_dir):
    return _backfill_rows(spark, sf_dir, False)


@query("backfill_landed", ORACLES["backfill"])
def backfill_landed(spark, sf_dir):
    """The same update of landed inventories, in which only buckets with a waiting document are rewritten."""
    path = scratch_path(spark, "landed")
    landed.land_documents(samples.inventories(spark, sf_dir), path)
    landed.backfill_landed(spark, path, NEW_VALUES)
    return _key_rows(landed.read_documents(spark, path))


@query(
    "backfill_only_missing",
    WITH
    + FLAGS
    + f"""SELECT {PLACE}, {_backfilled('FERNET_KEY', _waiting('FERNET_KEY'))} AS fernet,
      {_backfilled('WEBSERVER_SECRET_KEY', _waiting('WEBSERVER_SECRET_KEY'))} AS secret,
      DB_PORT AS db_port, raw_FERNET_KEY IS NOT NULL AS has_fernet FROM blocks JOIN flags USING (inventory)""",
)
def backfill_only_missing(spark, sf_dir):
    return _backfill_rows(spark, sf_dir, True)


@query("needs_backfill", WITH + FLAGS + "SELECT inventory, needs_backfill FROM flags")
def needs_backfill(spark, sf_dir):
    return samples.inventories(spark, sf_dir).select("inventory", I.needs_backfill().alias("needs_backfill"))


@query("backfill_flags", WITH + FLAGS + "SELECT inventory, needs_backfill FROM flags")
def backfill_flags(spark, sf_dir):
    return validate.backfill_flags(I.config_entries(services(spark, sf_dir)))


# Resolution


def _effective(service, key, kind, default):
    fallback = "hostname" if kind == "host" else "NULL" if default is None else f"'{default}'"
    return f"coalesce(nullif({key}, ''), {fallback})"


def _resolved_sql(service):
    """Resolved rows of one service as SQL steps: effective keys, then derived columns."""
    keys = ", ".join(f"{_effective(service, k, kind, d)} AS {k}" for _, k, kind, d in resolve.rules_of(service))
    base = f"eff AS (SELECT {PLACE}, service, hostname AS short_name, {keys} FROM blocks WHERE service = '{service}')"
    dirs = "dirs AS (SELECT *, CASE WHEN right(DiskPath, 1) = '/' THEN left(DiskPath, length(DiskPath) - 1) ELSE DiskPath END AS base_dir FROM eff)"
    if service == C.SPARK:
        package = "'spark-' || SPARK_VERSION || '-bin-' || HADOOP_VARIANT"
        derived = f"""base_dir || '/softwares' AS source_dir, base_dir || '/apps/spark' AS spark_home,
          base_dir || '/spark_standalone.access.log' AS access_log, base_dir || '/spark_standalone.error.log' AS error_log,
          (CASE WHEN WORKER_CORES = '0' THEN '' ELSE ' -c ' || WORKER_CORES END)
            || (CASE WHEN WORKER_MEMORY = '0' THEN '' ELSE ' -m ' || WORKER_MEMORY END) AS worker_args,
          {package} AS package, {package} || '.tgz' AS tarball,
          'https://dlcdn.apache.org/spark/spark-' || SPARK_VERSION || '/' || {package} || '.tgz' AS primary_url,
          'https://archive.apache.org/dist/spark/spark-' || SPARK_VERSION || '/' || {package} || '.tgz' AS archive_url"""
        return f"{base}, {dirs}, res AS (SELECT *, {derived} FROM dirs)"
    log = "airflow_scheduler" if service == C.SCHEDULER else "airflow_worker"
    login = (
        "url_encode(coalesce(DB_USER, '')) || ':' || url_encode(coalesce(DB_PASSWORD, '')) || '@' || coalesce(DB_HOST, '')"
        " || ':' || DB_PORT || '/' || DB_NAME"
    )
    redis = "coalesce(REDIS_HOST, '') || ':' || REDIS_PORT || '/' || REDIS_DB"
    # First occurrences of the merged list, by position.
    extras = """array_to_string(list_filter(string_split('celery,postgres,redis,' || coalesce(AIRFLOW_EXTRAS, ''), ','),
      lambda x, i: x <> '' AND list_position(string_split('celery,postgres,redis,' || coalesce(AIRFLOW_EXTRAS, ''), ','), x) = i), ',')"""
    worker = (
        ", 'airflow-worker-' || regexp_replace(lower(short_name), '[^a-z0-9-]', '', 'g') AS worker_unit"
        if service == C.WORKER
        else ""
    )
    derived = f"""base_dir || '/softwares' AS source_dir, base_dir || '/apps/python' AS python_home,
      base_dir || '/apps/python/bin' AS python_bin_dir, base_dir || '/apps/airflow' AS airflow_home,
      base_dir || '/{log}.access.log' AS access_log, base_dir || '/{log}.error.log' AS error_log, {extras} AS extras,
      'postgresql+psycopg2://' || {login} AS sql_alchemy_conn, 'db+postgresql://' || {login} AS result_backend,
      CASE WHEN coalesce(REDIS_PASSWORD, '') <> '' THEN 'redis://:' || url_encode(REDIS_PASSWORD) || '@' || {redis}
        ELSE 'redis://' || {redis} END AS broker_url,
      base_dir || '/apps/python/bin/python' || regexp_replace(PYTHON_VERSION, '\\.[^.]*$', '') AS python_exe,
      base_dir || '/apps/python/bin/airflow' AS airflow_exe {worker}"""
    return f"{base}, {dirs}, res AS (SELECT *, {derived} FROM dirs)"


def _resolve_query(name, service):
    admin = [] if service == C.SCHEDULER else ["ADMIN_PASSWORD"]
    hidden = ", ".join(f"{_hidden(c)} AS {c}" for c in C.SECRET_COLUMNS if c not in admin)
    present = "" if service == C.SPARK else f" REPLACE ({hidden})"

    @query(name, WITH + f", {_resolved_sql(service)} SELECT *{present} FROM res")
    def run(spark, sf_dir):
        return resolve.mask_secrets(resolve.resolve(services(spark, sf_dir), service), HASH_KEY)

    return run


_resolve_query("resolve_scheduler", C.SCHEDULER)
_resolve_query("resolve_worker", C.WORKER)
_resolve_query("resolve_spark", C.SPARK)


@query(
    "package_rows",
    WITH
    + f""", {_resolved_sql(C.WORKER)}, named AS (SELECT *, list_concat(['apache-airflow==' || AIRFLOW_VERSION],
        list_transform(list_filter(list_transform(string_split(extras, ','), lambda e: trim(e)), lambda e: e <> ''),
          lambda e: 'apache-airflow[' || e || ']==' || AIRFLOW_VERSION)) AS l FROM res)
      SELECT {PLACE}, service, 'https://www.python.org/ftp/python/' || PYTHON_VERSION || '/Python-' || PYTHON_VERSION || '.tgz' AS python_source_url,
        generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS requirement FROM named""",
)
def package_rows(spark, sf_dir):
    return resolve.package_rows(resolve.resolve(services(spark, sf_dir), C.WORKER))


def _rule_entry(order, key, kind, default, service):
    value = _effective(service, key, kind, default)
    hidden = _hidden(value) if key in C.SECRET_KEYS else value
    origin = f"CASE WHEN coalesce({key}, '') <> '' THEN 'set' WHEN {value} IS NOT NULL THEN 'default' ELSE 'missing' END"
    return f"{{'o': {order}, 'k': '{key}', 'v': {hidden}, 'g': {origin}}}"


def _rule_rows(service):
    entries = ", ".join(_rule_entry(*r, service) for r in resolve.rules_of(service))
    return f"SELECT {PLACE}, service, unnest([{entries}]) AS u FROM blocks WHERE service = '{service}'"


@query(
    "resolved_entries",
    WITH
    + f"SELECT {PLACE}, service, u.o AS rule_order, u.k AS key, u.v AS value, u.g AS origin FROM ("
    + " UNION ALL ".join(_rule_rows(s) for s in samples.BLOCKS)
    + ") AS t",
)
def resolved_entries(spark, sf_dir):
    return resolve.mask_secrets(resolve.resolved_entries(services(spark, sf_dir)), HASH_KEY)


# Units and documents


def _slots(template):
    """A text template as SQL concatenation."""
    out = []
    for literal, name, _, _ in X.Formatter().parse(template):
        if literal:
            quoted = literal.replace("'", "''").replace("\n", "' || chr(10) || '")
            out.append(f"'{quoted}'")
        if name:
            out.append(f"coalesce({name}, '')")
    return " || ".join(out) or "''"


def _unit_rows(service, columns):
    out = []
    for pos, (_, unit, description, command, flag) in enumerate(u for u in C.UNITS if u[0] == service):
        where = f" WHERE {flag} = '1'" if flag else ""
        out.append(
            f"SELECT {columns}, {pos} AS unit_pos, {_slots(unit)} AS unit, {_slots(description)} AS description,"
            f" {_slots(command)} AS command FROM res{where}"
        )
    return " UNION ALL ".join(out)


def _unit_query(name, service):
    @query(name, WITH + f", {_resolved_sql(service)} {_unit_rows(service, PLACE)}")
    def run(spark, sf_dir):
        units = render.expand_units(resolve.resolve(services(spark, sf_dir), service), service)
        return units.select(*PLACE.split(", "), "unit_pos", "unit", "description", "command")

    return run


_unit_query("scheduler_units", C.SCHEDULER)
_unit_query("worker_units", C.WORKER)
_unit_query("spark_units", C.SPARK)


def _env_pairs(service):
    lines = C.ENV_KEYS if service == C.SCHEDULER else C.ENV_KEYS[:-1]
    return [(key, f"coalesce({column}, '')" if column else f"'{C.EXECUTOR}'") for key, column in lines]


def _env_query(name, service):
    pairs = ", ".join(f"{{'pos': {i}, 'key': '{k}', 'value': {v}}}" for i, (k, v) in enumerate(_env_pairs(service)))

    secret = "'AIRFLOW__CORE__FERNET_KEY', 'AIRFLOW__DATABASE__SQL_ALCHEMY_CONN', 'AIRFLOW__CELERY__BROKER_URL', 'AIRFLOW__CELERY__RESULT_BACKEND', 'AIRFLOW__WEBSERVER__SECRET_KEY'"

    @query(
        name,
        WITH
        + f", {_resolved_sql(service)} SELECT {PLACE}, u.pos AS pos, u.key AS key, CASE WHEN u.key IN ({secret}) THEN {_hidden('u.value')} ELSE u.value END AS value"
        + f" FROM (SELECT {PLACE}, unnest([{pairs}]) AS u FROM res) AS t",
    )
    def run(spark, sf_dir):
        rows = render.env_rows(resolve.resolve(services(spark, sf_dir), service), service)
        return resolve.mask_secrets(rows, HASH_KEY)

    return run


_env_query("scheduler_env", C.SCHEDULER)
_env_query("worker_env", C.WORKER)


def _body_sql(service):
    if service == C.SPARK:
        text = C.SPARK_UNIT.replace("{user}", "{SERVICE_USER}").replace("{home}", "{spark_home}")
        text = text.replace("{java_home}", JAVA_HOME)
        body = _slots(text)
        requires = C.SPARK_WORKER_REQUIRES.rstrip("\n")
        body = body.replace("coalesce(after, '')", f"CASE unit WHEN 'spark-worker' THEN '{C.SPARK_WORKER_AFTER}' ELSE '' END")
        return body.replace(
            "coalesce(requires, '')", f"CASE unit WHEN 'spark-worker' THEN '{requires}' || chr(10) ELSE '' END"
        )
    text = C.AIRFLOW_UNIT.replace("{user}", "{SERVICE_USER}").replace("{home}", "{airflow_home}")
    body = _slots(text.replace("{bin_dir}", "{python_bin_dir}"))
    env = " || ".join(f"'Environment=\"{k}=' || {v} || '\"' || chr(10)" for k, v in _env_pairs(service))
    return body.replace("coalesce(env_lines, '')", env)


def _document_sql(service):
    columns = {C.SPARK: "spark_home", C.SCHEDULER: "airflow_home, python_bin_dir", C.WORKER: "airflow_home, python_bin_dir"}
    kept = [*PLACE.split(", "), "SERVICE_USER", *columns[service].split(", ")]
    if service != C.SPARK:
        kept += [column for _, column in C.ENV_KEYS if column and not (service == C.WORKER and column == "JWT_ISSUER")]
    return f"SELECT {PLACE}, unit, {_body_sql(service)} AS body FROM ({_unit_rows(service, ', '.join(kept))}) AS u"


def _render_query(name, service):
    @query(
        name,
        WITH + f", {_resolved_sql(service)} SELECT {PLACE}, unit, {_hidden('body')} AS body FROM ({_document_sql(service)}) AS d",
    )
    def run(spark, sf_dir):
        rows = resolve.resolve(services(spark, sf_dir), service)
        units = render.render_units(rows, service, F.lit(JAVA_HOME))
        return resolve.mask_secrets(units, HASH_KEY)

    return run


_render_query("render_scheduler_units", C.SCHEDULER)
_render_query("render_worker_units", C.WORKER)
_render_query("render_spark_units", C.SPARK)

PROFILE_SQL = "'export AIRFLOW_HOME=' || coalesce(airflow_home, '') || chr(10) || 'export PATH=' || coalesce(python_bin_dir, '') || ':$PATH' || chr(10)"
SPARK_ENV_SQL = f"""'export JAVA_HOME={JAVA_HOME}' || chr(10) || 'export SPARK_MASTER_HOST=' || MASTER_IP || chr(10)
  || 'export SPARK_MASTER_PORT=' || MASTER_PORT || chr(10) || 'export SPARK_MASTER_WEBUI_PORT=' || MASTER_UI_PORT || chr(10)
  || 'export SPARK_WORKER_WEBUI_PORT=' || WORKER_UI_PORT || chr(10)"""


@query("render_profiles", WITH + f", {_resolved_sql(C.WORKER)} SELECT {PLACE}, 'profile' AS unit, {PROFILE_SQL} AS body FROM res")
def render_profiles(spark, sf_dir):
    return render.render_profile(resolve.resolve(services(spark, sf_dir), C.WORKER))


@query("render_spark_env", WITH + f", {_resolved_sql(C.SPARK)} SELECT {PLACE}, 'spark-env' AS unit, {SPARK_ENV_SQL} AS body FROM res")
def render_spark_env(spark, sf_dir):
    return render.render_spark_env(resolve.resolve(services(spark, sf_dir), C.SPARK), F.lit(JAVA_HOME))


def _all_documents(service):
    extra = f"SELECT {PLACE}, 'spark-env' AS unit, {SPARK_ENV_SQL} AS body FROM res"
    if service != C.SPARK:
        extra = f"SELECT {PLACE}, 'profile' AS unit, {PROFILE_SQL} AS body FROM res"
    return f"(WITH {_resolved_sql(service)} {_document_sql(service)} UNION ALL {extra})"


@query(
    "write_documents",
    WITH
    + f"SELECT {PLACE}, unit, {_hidden('body')} AS body FROM ("
    + " UNION ALL ".join(f"SELECT * FROM {_all_documents(s)} AS d" for s in samples.BLOCKS)
    + ") AS t",
)
def write_documents(spark, sf_dir):
    """All documents of the fleet, written and read back."""
    path = scratch_path(spark, "rendered")
    landed = source.land_services(services(spark, sf_dir), scratch_path(spark, "services"))
    sinks.write_documents(fleet_documents(landed, F.lit(JAVA_HOME)), path)
    return resolve.mask_secrets(spark.read.parquet(path), HASH_KEY)


# Validation


def _reason(value, kind):
    copied = f" WHEN starts_with({value}, 'COPY_FROM_') THEN 'copy_from'" if kind == "match" else ""
    return (
        f"CASE WHEN {value} IS NULL THEN 'missing' WHEN {value} = '' THEN 'empty' WHEN {value} = 'null' THEN 'null_text'"
        f" WHEN starts_with({value}, 'CHANGE_ME') THEN 'placeholder'{copied} END"
    )


def _violation_rows(service):
    entries = ", ".join(
        f"{{'o': {order}, 'k': '{key}', 'r': {_reason(key, kind)}}}"
        for order, key, kind, _ in resolve.rules_of(service)
        if kind in ("req", "match")
    )
    return f"SELECT {PLACE}, service, unnest([{entries}]) AS u FROM blocks WHERE service = '{service}'"


VIOLATIONS = (
    f", violations AS (SELECT {PLACE}, service, u.o AS rule_order, u.k AS key, u.r AS reason FROM ("
    + " UNION ALL ".join(_violation_rows(s) for s in samples.BLOCKS)
    + ") AS t WHERE u.r IS NOT NULL) "
)


@query("config_violations", WITH + VIOLATIONS + "SELECT * FROM violations")
def config_violations(spark, sf_dir):
    return validate.violations(services(spark, sf_dir))


@query(
    "first_violations",
    WITH
    + VIOLATIONS
    + f"SELECT {PLACE}, service, min(rule_order) AS rule_order, arg_min(key, rule_order) AS key,"
    f" arg_min(reason, rule_order) AS reason FROM violations GROUP BY {PLACE}, service",
)
def first_violations(spark, sf_dir):
    return validate.first_violation(services(spark, sf_dir))


@query(
    "placeholder_violations",
    f"""SELECT o_orderkey, kind, CASE kind WHEN 'req' THEN {_reason('v', 'req')} ELSE {_reason('v', 'match')} END AS reason
    FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'req' WHEN 'O' THEN 'match' ELSE 'optional' END AS kind,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'CHANGE_ME_' || o_orderkey WHEN '2-HIGH' THEN 'COPY_FROM_scheduler'
          WHEN '3-MEDIUM' THEN '' WHEN '4-NOT SPECIFIED' THEN 'null' ELSE o_orderpriority END AS v FROM orders) AS t
    WHERE kind IN ('req', 'match') AND CASE kind WHEN 'req' THEN {_reason('v', 'req')} ELSE {_reason('v', 'match')} END IS NOT NULL""",
)
def placeholder_violations(spark, sf_dir):
    """The two value checks over a plain table of values."""
    orders = table(spark, sf_dir, "orders")
    values = orders.selectExpr(
        "o_orderkey",
        "CASE o_orderstatus WHEN 'F' THEN 'req' WHEN 'O' THEN 'match' ELSE 'optional' END AS kind",
        "CASE o_orderpriority WHEN '1-URGENT' THEN concat('CHANGE_ME_', o_orderkey) WHEN '2-HIGH' THEN 'COPY_FROM_scheduler'"
        " WHEN '3-MEDIUM' THEN '' WHEN '4-NOT SPECIFIED' THEN 'null' ELSE o_orderpriority END AS v",
    )
    checked = values.withColumn("reason", validate.violation_reason("v", "kind"))
    return checked.where("reason IS NOT NULL").drop("v")


SHARED = f""", shared AS (SELECT {PLACE}, service, u.key AS key, u.value AS value FROM (SELECT {PLACE}, service,
    unnest([{{'key': 'FERNET_KEY', 'value': FERNET_KEY}}, {{'key': 'WEBSERVER_SECRET_KEY', 'value': WEBSERVER_SECRET_KEY}}]) AS u
    FROM blocks WHERE service IN ('{C.SCHEDULER}', '{C.WORKER}')) AS t),
  report AS (SELECT inventory, key, count(*) AS n_blocks, count(*) - count(nullif(value, '')) AS n_missing,
    count(DISTINCT nullif(value, '')) AS n_values, count(DISTINCT nullif(value, '')) = 1 AND count(*) = count(nullif(value, '')) AS consistent
    FROM shared GROUP BY 1, 2) """


@query("consistency_check", WITH + SHARED + "SELECT * FROM report")
def consistency_check(spark, sf_dir):
    return validate.consistent_across(services(spark, sf_dir))


@query(
    "inconsistent_blocks",
    WITH
    + SHARED
    + f"SELECT {PLACE}, service, key, {_hidden('value')} AS value_hash FROM shared JOIN report USING (inventory, key) WHERE NOT consistent",
)
def inconsistent_blocks(spark, sf_dir):
    documents = source.land_inventory(samples.inventories(spark, sf_dir), scratch_path(spark, "documents"))
    return validate.inconsistent_blocks(services_of(documents), secret=HASH_KEY)


@query(
    "empty_selection_guard",
    WITH
    + f"""SELECT inv AS inventory, count(hostname) AS n_selected, count(hostname) = 0 AS is_empty
      FROM (SELECT DISTINCT {samples.INVENTORY} AS inv FROM customer) AS i
      LEFT JOIN (SELECT inventory, hostname FROM blocks WHERE starts_with(FERNET_KEY, 'odd')) AS b ON inv = inventory GROUP BY 1""",
)
def empty_selection_guard(spark, sf_dir):
    selected = services(spark, sf_dir).where(F.col("cfg")["FERNET_KEY"].startswith("odd"))
    return validate.non_empty_guard(samples.inventories(spark, sf_dir), selected)


# Host sets

ONLY = "Customer#000000007,Customer#000000011,Customer#000000007,customer#000000012, Customer#000000013,nobody"


@query(
    "select_hosts",
    "SELECT c_custkey AS pos, c_name AS hostname FROM customer WHERE c_name IN ("
    + ", ".join(f"'{h}'" for h in ONLY.split(","))
    + ")",
)
def select_hosts(spark, sf_dir):
    hosts = table(spark, sf_dir, "customer").selectExpr("c_custkey AS pos", "c_name AS hostname")
    return select.select_hosts(hosts, ONLY)


@query(
    "rollout_hosts",
    f"""SELECT {samples.INVENTORY} AS inventory, {samples.SERVER_POS} AS server_pos, c_name AS hostname FROM customer
    WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def hosts_of_rollout(spark, sf_dir):
    """Hosts of all inventories that a table asks for."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    only = urgent.select(F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("hostname"))
    return rollout_hosts(samples.inventories(spark, sf_dir), only)


@query(
    "select_hosts_by_table",
    """SELECT o_orderkey AS pos, o_custkey AS hostname FROM orders
    WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""",
)
def select_hosts_by_table(spark, sf_dir):
    hosts = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS pos", "o_custkey AS hostname")
    only = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").selectExpr("c_custkey AS hostname")
    return select.select_hosts(hosts, only)


LOCAL_HOST = "'10.' || c_nationkey || '.' || (c_custkey % 7) || '.1'"
LOCAL_LIST = "'10.' || n_nationkey || '.1.1 192.10.' || n_nationkey || '.2.1 10.' || n_nationkey || '.3.1 10.' || n_nationkey || 'x4.1 '"


def _local(spark, sf_dir, mode):
    hosts = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "c_nationkey AS nation", f"{LOCAL_HOST} AS hostname"
    )
    lists = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS nation", f"{LOCAL_LIST} AS addresses")
    return select.match_local(hosts, lists, mode, keys=["nation"])


@query(
    "match_local",
    f"""SELECT c_custkey, c_nationkey AS nation, {LOCAL_HOST} AS hostname FROM customer JOIN nation ON c_nationkey = n_nationkey
    WHERE list_contains(string_split({LOCAL_LIST}, ' '), {LOCAL_HOST})""",
)
def match_local(spark, sf_dir):
    return _local(spark, sf_dir, "exact")


@query(
    "match_local_loose",
    f"""SELECT c_custkey, c_nationkey AS nation, {LOCAL_HOST} AS hostname FROM customer JOIN nation ON c_nationkey = n_nationkey
    WHERE regexp_matches({LOCAL_LIST}, '(^|[^A-Za-z0-9_])' || {LOCAL_HOST} || '($|[^A-Za-z0-9_])')""",
)
def match_local_loose(spark, sf_dir):
    return _local(spark, sf_dir, "loose")


@query(
    "skip_existing",
    """SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS
    (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""",
)
def skip_existing(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    done = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").selectExpr("o_custkey AS c_custkey")
    return select.skip_existing(wanted, done, ["c_custkey"])


@query(
    "skip_existing_filtered",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS
    (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderpriority = '1-URGENT')""",
)
def skip_existing_filtered(spark, sf_dir):
    """Lines of orders that are not urgent; most of them are found absent before any shuffle."""
    wanted = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    done = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").selectExpr("o_orderkey AS l_orderkey")
    return select.skip_existing(wanted, done, ["l_orderkey"], bloom_bits=select.BLOOM_BITS)


@query(
    "total_hosts",
    "SELECT c_nationkey AS inventory, count(*) FILTER (c_acctbal >= 0) AS total FROM customer GROUP BY 1",
)
def total_hosts(spark, sf_dir):
    """Customers in debt stand for blank host lines."""
    hosts = table(spark, sf_dir, "customer").selectExpr(
        "c_nationkey AS inventory", "if(c_acctbal >= 0, c_name, '') AS hostname"
    )
    return select.total_hosts(hosts)


@query(
    "config_lookup_default",
    """SELECT user_id % 3 AS inventory, CAST(event_id AS VARCHAR) AS hostname, event_type AS service, r.key AS key,
      CASE r.key WHEN 'k' THEN json_extract_string(props, '$.k') END AS value,
      coalesce(CASE r.key WHEN 'k' THEN nullif(json_extract_string(props, '$.k'), '') END, 'unset') AS resolved
    FROM events CROSS JOIN (SELECT unnest(['k', 'absent']) AS key) AS r""",
)
def config_lookup_default(spark, sf_dir):
    """Two requests per event against the entries of its own settings text."""
    events = table(spark, sf_dir, "events").selectExpr(
        "user_id % 3 AS inventory", "string(event_id) AS hostname", "event_type AS service", "props"
    )
    place = ["inventory", "hostname", "service"]
    entries = events.select(*place, F.explode(F.from_json("props", "map<string, string>")))
    # The same host in another inventory has other entries.
    entries = entries.unionByName(entries.withColumns({"inventory": F.col("inventory") + 3, "value": F.lit("elsewhere")}))
    requests = events.select(*place, F.explode(F.array(F.lit("k"), F.lit("absent"))).alias("key"))
    found = resolve.config_lookup(requests, entries)
    return resolve.apply_defaults(found.withColumn("default", F.lit("unset"))).drop("default")
