"""Inventories and logs rendered from the driver tables.

The tables hold no inventories or logs, so each query first renders its input from all
rows of a table and then runs the library over that input. A rendered document or log
file covers a fixed number of consecutive keys, so none grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions import text as X
from fleetlens.operators.ordered import with_part
from fleetlens.sources.folders import Folder
from fleetlens.sources.growing import open_folder
from fleetlens.sources.inventory import parse_inventory
from fleetlens.sources.scratch import scratch_path

HOSTS_PER_INVENTORY = 40
FILE_EVENTS = 1 << 12

# Which service blocks a customer's server has, as SQL conditions over the customer row.
BLOCKS = {
    C.SCHEDULER: "c_custkey % 40 = 0",
    C.WORKER: "c_custkey % 40 <> 0 AND c_custkey % 3 <> 0",
    C.SPARK: "c_custkey % 40 <> 0 AND c_custkey % 3 <> 1 AND c_custkey % 17 <> 5",
}
INVENTORY = "CAST(CAST(floor(c_custkey / 40.0) AS BIGINT) AS STRING)"
SERVER_POS = "CAST(c_custkey % 40 AS BIGINT)"

# Raw value of each key, as SQL over the customer row. NULL leaves the key out of the
# document; <null>, <false> and <int> become JSON null, false and a number.
VALUES = {
    "install_cmd": "CASE c_custkey % 11 WHEN 3 THEN NULL WHEN 4 THEN '' WHEN 5 THEN 'prepare --x' || chr(10) || chr(10)"
    " || 'install' WHEN 6 THEN '<null>' ELSE 'install_' || c_custkey END",
    "DiskPath": "CASE c_custkey % 13 WHEN 0 THEN '/data/' WHEN 1 THEN '/data//' WHEN 2 THEN NULL WHEN 3 THEN 'CHANGE_ME_DISK'"
    " WHEN 4 THEN '' WHEN 5 THEN 'null' WHEN 6 THEN '/' ELSE '/mnt/' || c_mktsegment END",
    "SERVICE_USER": "CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'svc' || c_nationkey END",
    "PYTHON_VERSION": "CASE c_custkey % 6 WHEN 0 THEN '3' WHEN 1 THEN '3.11' WHEN 2 THEN '3.12.4' WHEN 3 THEN '<null>' ELSE NULL END",
    "AIRFLOW_VERSION": "CASE WHEN c_custkey % 5 = 1 THEN '3.0.' || c_nationkey ELSE NULL END",
    "AIRFLOW_EXTRAS": "CASE c_custkey % 7 WHEN 0 THEN 'aws, redis,,celery' WHEN 1 THEN 'redis' WHEN 2 THEN '' WHEN 3 THEN 'ssh,ssh' ELSE NULL END",
    "API_PORT": "CASE WHEN c_custkey % 3 = 0 THEN '<int>' || (9000 + c_nationkey) ELSE NULL END",
    "JWT_ISSUER": "CASE c_custkey % 3 WHEN 0 THEN '<false>' WHEN 1 THEN 'false' ELSE NULL END",
    "DAGS_FOLDER": "CASE c_custkey % 10 WHEN 0 THEN 'CHANGE_ME' WHEN 1 THEN 'COPY_FROM_x' ELSE '/dags/' || c_mktsegment END",
    "DB_HOST": "CASE c_custkey % 8 WHEN 7 THEN NULL ELSE 'db' || c_nationkey END",
    "DB_PORT": "CASE c_custkey % 2 WHEN 0 THEN '<int>5433' ELSE NULL END",
    "DB_NAME": "CASE c_custkey % 5 WHEN 2 THEN 'af_' || c_nationkey ELSE NULL END",
    "DB_USER": "CASE c_custkey % 5 WHEN 3 THEN 'u s/' || c_mktsegment WHEN 4 THEN 'é€+*~%' ELSE NULL END",
    "DB_PASSWORD": "CASE c_custkey % 12 WHEN 9 THEN 'null' ELSE c_name || '@:/' END",
    "REDIS_HOST": "'rd' || c_nationkey",
    "REDIS_PORT": "CASE c_custkey % 2 WHEN 1 THEN '<int>6380' ELSE '<null>' END",
    "REDIS_DB": "CASE c_custkey % 3 WHEN 1 THEN '<int>' || c_nationkey ELSE NULL END",
    "REDIS_PASSWORD": "CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'r p' || c_custkey END",
    "FERNET_KEY": "CASE WHEN c_custkey % 400 = 81 THEN 'CHANGE_ME_FERNET_KEY' WHEN c_custkey % 400 = 121 THEN ''"
    " WHEN c_custkey % 400 = 161 THEN 'COPY_FROM_scheduler' WHEN c_custkey % 400 = 202 THEN 'CHANGE_ME_OTHER'"
    " WHEN c_custkey % 50 = 7 THEN 'odd' || c_custkey WHEN c_custkey % 9 = 4 THEN NULL"
    " ELSE 'fernet' || CAST(floor(c_custkey / 40.0) AS BIGINT) END",
    "WEBSERVER_SECRET_KEY": "CASE WHEN c_custkey % 600 = 241 THEN '' WHEN c_custkey % 600 = 401 THEN 'CHANGE_ME_WEBSERVER_SECRET_KEY'"
    " WHEN c_custkey % 17 = 3 THEN '<null>' ELSE 'secret' || CAST(floor(c_custkey / 80.0) AS BIGINT) END",
    "ADMIN_USERNAME": "CASE c_custkey % 3 WHEN 0 THEN 'root' ELSE NULL END",
    "ADMIN_PASSWORD": "CASE c_custkey % 320 WHEN 0 THEN 'CHANGE_ME_ADMIN' ELSE 'adm' || c_custkey END",
    "INSTALL_FLOWER": "CASE c_custkey % 160 WHEN 0 THEN '<int>1' WHEN 40 THEN '<int>0' WHEN 80 THEN '1' ELSE NULL END",
    "FLOWER_PORT": "CASE c_custkey % 80 WHEN 0 THEN '<int>5556' ELSE NULL END",
    "WORKER_QUEUES": "CASE c_custkey % 5 WHEN 0 THEN 'default,gpu' ELSE NULL END",
    "WORKER_CONCURRENCY": "CASE c_custkey % 5 WHEN 1 THEN '<int>4' ELSE NULL END",
    "SPARK_VERSION": "CASE c_custkey % 5 WHEN 1 THEN '4.1.1' ELSE NULL END",
    "HADOOP_VARIANT": "CASE c_custkey % 7 WHEN 1 THEN 'hadoop3-connect' ELSE NULL END",
    "MASTER_IP": "CASE c_custkey % 3 WHEN 0 THEN '10.9.0.' || c_nationkey ELSE NULL END",
    "MASTER_PORT": "CASE c_custkey % 4 WHEN 1 THEN '<int>7078' ELSE NULL END",
    "MASTER_UI_PORT": "CASE c_custkey % 4 WHEN 2 THEN '<int>18080' ELSE NULL END",
    "WORKER_UI_PORT": "CASE c_custkey % 4 WHEN 3 THEN '<int>18081' ELSE NULL END",
    "WORKER_CORES": "CASE c_custkey % 5 WHEN 0 THEN '<int>0' WHEN 1 THEN '<int>8' ELSE NULL END",
    "WORKER_MEMORY": "CASE c_custkey % 5 WHEN 1 THEN '16g' WHEN 2 THEN '0' WHEN 3 THEN '4g' ELSE NULL END",
}
# Blocks that state the key a second time, after the first: (condition, value).
REPEATED = {"DB_PORT": ("c_custkey % 10 = 0", "<int>6432")}


def keys_of(service: str) -> list[str]:
    return ["install_cmd", *[r[1] for r in C.RULES if r[0] == service]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _landed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame | None:
    return table(spark, sf_dir, name) if f"{name}.parquet" in Folder(spark, sf_dir).names() else None


def _block_json(service: str) -> Column:
    fields = [F.lit(service).alias("name")]
    for key in keys_of(service):
        fields.append(F.expr(VALUES[key]).alias(key))
        if key in REPEATED:
            condition, value = REPEATED[key]
            fields.append(F.when(F.expr(condition), value).alias(f"again_{key}"))
    out = F.regexp_replace(F.to_json(F.struct(*fields)), '"<(null|false)>"', "$1")
    out = F.regexp_replace(out, '"<int>([0-9]+)"', "$1")
    for key in REPEATED:
        out = F.replace(out, F.lit(f'"again_{key}"'), F.lit(f'"{key}"'))
    return F.when(F.expr(BLOCKS[service]), out)


def inventory_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``inventory, text``: one JSON document per 40 consecutive customers."""
    blocks = F.filter(F.array(*[_block_json(s) for s in BLOCKS]), lambda b: b.isNotNull())
    server = F.concat(
        F.lit('{"hostname":"'),
        F.col("c_name"),
        F.lit('","server_type":"'),
        F.when(F.expr(BLOCKS[C.SCHEDULER]), "CONTROL").otherwise("APP"),
        F.lit('","services":['),
        F.array_join(blocks, ","),
        F.lit("]}"),
    )
    servers = table(spark, sf_dir, "customer").select(
        F.expr(INVENTORY).alias("inventory"), F.expr(SERVER_POS).alias("pos"), server.alias("server")
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "server"))), lambda s: s["server"])
    return servers.groupBy("inventory").agg(
        F.concat(F.lit('{"_notes":"synthetic","servers":['), F.array_join(ordered, ","), F.lit("]}")).alias("text")
    )


def inventories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _landed(spark, sf_dir, "inventories") or parse_inventory(inventory_texts(spark, sf_dir))


def _effective(key: str) -> str:
    """What a lookup finds, as SQL over the raw column: NULL for JSON null and false."""
    found = f"CASE WHEN {key} IN ('<null>', '<false>') THEN NULL WHEN {key} LIKE '<int>%' THEN substr({key}, 6) ELSE {key} END"
    if key in REPEATED:
        condition, value = REPEATED[key]
        owners = ", ".join(f"'{o}'" for o in BLOCKS if key in keys_of(o))
        found = f"CASE WHEN {condition} AND service IN ({owners}) THEN '{value.removeprefix('<int>')}' ELSE {found} END"
    return found


def blocks_sql() -> str:
    """Oracle side of ``inventories``: flat service blocks with raw (``raw_*``) and found values."""
    order = list(BLOCKS)
    selects = []
    for service, condition in BLOCKS.items():
        mine = keys_of(service)
        raw = ", ".join(f"{VALUES[k] if k in mine else 'CAST(NULL AS VARCHAR)'} AS {k}" for k in VALUES)
        earlier = " + ".join(
            ["0", *[f"CASE WHEN {BLOCKS[s]} THEN 1 ELSE 0 END" for s in order[: order.index(service)]]]
        )
        selects.append(
            f"SELECT c_custkey, {INVENTORY} AS inventory, {SERVER_POS} AS server_pos, c_name AS hostname,"
            f" CAST({earlier} AS BIGINT) AS service_pos, '{service}' AS service, {raw} FROM customer WHERE {condition}"
        )
    found = ", ".join(f"{_effective(k)} AS {k}, {k} AS raw_{k}" for k in VALUES)
    return (
        f"raw_blocks AS ({' UNION ALL '.join(selects)}), blocks AS (SELECT c_custkey, inventory, server_pos,"
        f" hostname, service_pos, service, {found} FROM raw_blocks)"
    )


# Run logs from events: one run per day, one host per user, one line per event.

HOST = "'10.0.' || CAST(floor(user_id / 256.0) AS BIGINT) || '.' || (user_id % 256)"


SHORT_RUN = f"lpad(CAST(CAST(floor(event_id / {FILE_EVENTS}.0) AS BIGINT) AS STRING), 14, '0')"


def event_lines(spark: SparkSession, sf_dir: str, run: str | None = None) -> DataFrame:
    """``run, part, n, line`` with one line per event, and one summary line per run.

    A run is a day, of any size, unless ``run`` says otherwise (``SHORT_RUN``: a fixed
    number of events).
    """
    landed = None if run else _landed(spark, sf_dir, "event_lines")
    if landed:
        return landed
    events = table(spark, sf_dir, "events")
    day = X.run_id(F.to_date("ts").cast("timestamp_ntz"))
    events = events.withColumn("run", F.expr(run) if run else day)
    log = F.concat(F.lit("./deploy."), F.col("run"), F.lit(".log"))
    host = F.expr(HOST)
    reason = F.expr("element_at(array('local', 'SSH connect / mkdir', 'scp', 'remote install'), int(user_id % 4 + 1))")
    opening = F.expr(
        "if(user_id % 2 = 0, ' (control server itself) === running locally', ' === ensuring remote directory exists')"
    )
    message = (
        F.when(F.col("event_type") == "signup", F.concat(F.lit("=== "), host, opening))
        .when(F.col("event_type") == "view", F.concat(F.lit("=== "), host, F.lit(" === copying settings files")))
        .when(
            F.col("event_type") == "purchase",
            F.concat(F.lit("=== "), host, F.lit(": SUCCESS"), F.expr("if(user_id % 2 = 0, ' (local)', '')"), F.lit(" ===")),
        )
        .otherwise(F.concat(F.lit("=== "), host, F.lit(": FAILED ("), reason, F.lit(") -- see "), log, F.lit(" ===")))
    )
    verb = F.expr("element_at(array('Executing', 'Successfully executed', 'Error executing'), int(event_id % 3 + 1))")
    bare = F.concat(verb, F.lit(": step_"), F.col("event_id"), F.lit(" --host "), host)
    line = F.when(F.col("event_type") == "click", bare).otherwise(X.log_line("ts", message))
    lines = events.select("run", (F.col("event_id") * 2).alias("n"), line.alias("line"))
    ends = events.groupBy("run").agg(
        (F.max("event_id") * 2 + 1).alias("n"),
        F.max("ts").alias("ts"),
        F.count_if(F.col("event_type").isin("purchase", "error")).alias("total"),
    )
    done = F.concat(F.lit("Deployment complete: "), "total", F.lit("/"), "total", F.lit(" hosts succeeded."))
    return with_part(lines.unionByName(ends.select("run", "n", X.log_line("ts", done).alias("line"))))


def write_run_files(lines: DataFrame, path: str, events: int = FILE_EVENTS, named: bool = True) -> None:
    """Rendered lines as text, one file per run and ``events`` events, in line order.

    ``named``: file names sort like the lines. Else they are hashes.
    """
    piece = F.expr(f"lpad(string(n div {2 * events}), 12, '0')")
    pieces = lines.withColumn("piece", piece if named else F.md5(F.concat("run", piece)))
    (
        pieces.repartition("run", "piece")
        .sortWithinPartitions("run", "piece", "n")
        .select("run", "piece", "line")
        .write.partitionBy("run", "piece")
        .text(path)
    )


def grow_run_files(lines: DataFrame, path: str, share: float) -> None:
    """Each run's rendered lines as one file, written as far as the first ``share`` of its bytes.

    Called again with a larger share, the files have grown. Runs are those of ``SHORT_RUN``, of bounded size.
    """

    def write(run):
        data = ("\n".join(run.sort_values("n")["line"]) + "\n").encode()
        system, folder = open_folder(path)
        place = f"{folder}/run={run['run'].iloc[0]}"
        system.create_dir(place)
        with system.open_output_stream(f"{place}/deploy.log") as out:
            out.write(data[: int(len(data) * share)])
        return run[["run"]].head(1)

    lines.select("run", "n", "line").groupBy("run").applyInPandas(write, "run string").count()


def land(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Render the inputs of ``sf_dir`` into ``folder``, as tables.

    Queries that are given a folder with these tables beside the driver tables read them and don't render.
    """
    for name, make in (("inventories", inventories), ("event_lines", event_lines)):
        make(spark, sf_dir).write.parquet(f"{folder}/{name}.parquet")


def run_files(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "run-logs")
    write_run_files(event_lines(spark, sf_dir), path)
    return path


def files_a_batch(spark: SparkSession, path: str, least: int = 8, batches: int = 32) -> int:
    """Files that one batch of a stream takes from ``path``: ``least``, and more where those would be over ``batches`` batches.

    A file holds a few thousand lines at any size of the tables; batches of a fixed number of
    them would cost the start of a few jobs for every 30,000 lines.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(path).inputFiles()
    return max(least, -(-len(files) // batches))


RUN_FOLDER_PATTERN = r"run=(\d{14})"


def service_lines(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """``line, level``: stamped lines for most events (all of the table's unless given), raw tool output for clicks."""
    events = table(spark, sf_dir, "events") if events is None else events
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") != "click", "INFO")
    message = F.concat("event_type", F.lit(" of user "), "user_id")
    return events.select(
        F.coalesce(X.log_line("ts", message, level), F.concat(F.lit("output "), "event_id")).alias("line"),
        level.alias("level"),
        F.expr("user_id % 7").alias("log"),
    )
