"""Service names, rules, message formats and document texts.

Everything here is data that results must agree with; no logic lives in this module.
"""

SCHEDULER = "Airflow-Scheduler"
WORKER = "Airflow-Worker"
SPARK = "Spark-Standalone"

# Fixed values: (service, key, kind, default) in evaluation order.
# kind: req = must be set, match = must be set and shared by all nodes,
# default = falls back to the given text, host = falls back to the host name,
# optional = may stay empty.
RULES = [
    (SCHEDULER, "DiskPath", "req", None),
    (SCHEDULER, "SERVICE_USER", "default", "airflow"),
    (SCHEDULER, "PYTHON_VERSION", "default", "3.10.10"),
    (SCHEDULER, "AIRFLOW_VERSION", "default", "3.1.2"),
    (SCHEDULER, "AIRFLOW_EXTRAS", "optional", None),
    (SCHEDULER, "API_PORT", "default", "8080"),
    (SCHEDULER, "JWT_ISSUER", "default", "airflow-api"),
    (SCHEDULER, "DAGS_FOLDER", "req", None),
    (SCHEDULER, "DB_HOST", "req", None),
    (SCHEDULER, "DB_PORT", "default", "5432"),
    (SCHEDULER, "DB_NAME", "default", "airflow"),
    (SCHEDULER, "DB_USER", "default", "airflow"),
    (SCHEDULER, "DB_PASSWORD", "req", None),
    (SCHEDULER, "REDIS_HOST", "req", None),
    (SCHEDULER, "REDIS_PORT", "default", "6379"),
    (SCHEDULER, "REDIS_DB", "default", "0"),
    (SCHEDULER, "REDIS_PASSWORD", "optional", None),
    (SCHEDULER, "FERNET_KEY", "match", None),
    (SCHEDULER, "WEBSERVER_SECRET_KEY", "match", None),
    (SCHEDULER, "ADMIN_USERNAME", "default", "admin"),
    (SCHEDULER, "ADMIN_PASSWORD", "req", None),
    (SCHEDULER, "INSTALL_FLOWER", "default", "0"),
    (SCHEDULER, "FLOWER_PORT", "default", "5555"),
    (WORKER, "DiskPath", "req", None),
    (WORKER, "SERVICE_USER", "default", "airflow"),
    (WORKER, "PYTHON_VERSION", "default", "3.10.10"),
    (WORKER, "AIRFLOW_VERSION", "default", "3.1.2"),
    (WORKER, "AIRFLOW_EXTRAS", "optional", None),
    (WORKER, "DAGS_FOLDER", "req", None),
    (WORKER, "DB_HOST", "req", None),
    (WORKER, "DB_PORT", "default", "5432"),
    (WORKER, "DB_NAME", "default", "airflow"),
    (WORKER, "DB_USER", "default", "airflow"),
    (WORKER, "DB_PASSWORD", "req", None),
    (WORKER, "REDIS_HOST", "req", None),
    (WORKER, "REDIS_PORT", "default", "6379"),
    (WORKER, "REDIS_DB", "default", "0"),
    (WORKER, "REDIS_PASSWORD", "optional", None),
    (WORKER, "FERNET_KEY", "match", None),
    (WORKER, "WEBSERVER_SECRET_KEY", "match", None),
    (WORKER, "WORKER_QUEUES", "default", "default"),
    (WORKER, "WORKER_CONCURRENCY", "default", "16"),
    (SPARK, "DiskPath", "req", None),
    (SPARK, "SPARK_VERSION", "default", "4.0.3"),
    (SPARK, "HADOOP_VARIANT", "default", "hadoop3"),
    (SPARK, "SERVICE_USER", "default", "spark"),
    (SPARK, "MASTER_IP", "host", None),
    (SPARK, "MASTER_PORT", "default", "7077"),
    (SPARK, "MASTER_UI_PORT", "default", "8080"),
    (SPARK, "WORKER_UI_PORT", "default", "8081"),
    (SPARK, "WORKER_CORES", "default", "0"),
    (SPARK, "WORKER_MEMORY", "default", "0"),
]

# Texts that count as "not filled in yet".
NULL_TEXT = "null"
PLACEHOLDER_PREFIX = "CHANGE_ME"
COPY_PREFIX = "COPY_FROM_"
BACKFILL_PLACEHOLDERS = {
    "FERNET_KEY": "CHANGE_ME_FERNET_KEY",
    "WEBSERVER_SECRET_KEY": "CHANGE_ME_WEBSERVER_SECRET_KEY",
}

# Columns whose content is secret, raw and derived.
SECRET_KEYS = ["DB_PASSWORD", "REDIS_PASSWORD", "FERNET_KEY", "WEBSERVER_SECRET_KEY", "ADMIN_PASSWORD"]
SECRET_COLUMNS = [*SECRET_KEYS, "sql_alchemy_conn", "result_backend", "broker_url"]
# Columns that hold whole blocks, documents or lists of them.
SECRET_NESTED = ["body", "cfg", "servers", "services", "env", "_corrupt_record", "_document"]

# Extras every installation gets, before the configured ones.
BASE_EXTRAS = "celery,postgres,redis"

# Environment block, in order. The scheduler has all eight lines, a worker
# all but the last.
ENV_KEYS = [
    ("AIRFLOW__CORE__EXECUTOR", None),
    ("AIRFLOW__CORE__DAGS_FOLDER", "DAGS_FOLDER"),
    ("AIRFLOW__CORE__FERNET_KEY", "FERNET_KEY"),
    ("AIRFLOW__DATABASE__SQL_ALCHEMY_CONN", "sql_alchemy_conn"),
    ("AIRFLOW__CELERY__BROKER_URL", "broker_url"),
    ("AIRFLOW__CELERY__RESULT_BACKEND", "result_backend"),
    ("AIRFLOW__WEBSERVER__SECRET_KEY", "WEBSERVER_SECRET_KEY"),
    ("AIRFLOW__API_AUTH__JWT_ISSUER", "JWT_ISSUER"),
]
EXECUTOR = "CeleryExecutor"

# What is installed, and where the language's source comes from.
REQUIREMENT_FORMAT = "apache-airflow=={version}"
EXTRA_REQUIREMENT_FORMAT = "apache-airflow[{extra}]=={version}"
PYTHON_SOURCE_FORMAT = "https://www.python.org/ftp/python/{version}/Python-{version}.tgz"

# Environment keys whose value is a secret or is made of one.
SECRET_ENV_KEYS = [key for key, column in ENV_KEYS if column in SECRET_COLUMNS]

# Connection string formats.
SQL_CONN_FORMAT = "postgresql+psycopg2://{user}:{password}@{host}:{port}/{db}"
RESULT_BACKEND_FORMAT = "db+postgresql://{user}:{password}@{host}:{port}/{db}"
BROKER_FORMAT = "redis://{host}:{port}/{db}"
BROKER_PASSWORD_FORMAT = "redis://:{password}@{host}:{port}/{db}"

# Package names and download addresses.
PACKAGE_FORMAT = "spark-{version}-bin-{variant}"
TARBALL_FORMAT = "spark-{version}-bin-{variant}.tgz"
PRIMARY_URL_FORMAT = "https://dlcdn.apache.org/spark/spark-{version}/spark-{version}-bin-{variant}.tgz"
ARCHIVE_URL_FORMAT = "https://archive.apache.org/dist/spark/spark-{version}/spark-{version}-bin-{variant}.tgz"

# Fixed values: (service, unit, description, command, condition column that must be "1").
UNITS = [
    (SCHEDULER, "airflow-apiserver", "Airflow API Server", "{airflow_exe} api-server --port {API_PORT}", None),
    (SCHEDULER, "airflow-dagprocessor", "Airflow DAG Processor", "{airflow_exe} dag-processor", None),
    (SCHEDULER, "airflow-scheduler", "Airflow Scheduler", "{airflow_exe} scheduler", None),
    (SCHEDULER, "airflow-triggerer", "Airflow Triggerer", "{airflow_exe} triggerer", None),
    (SCHEDULER, "airflow-flower", "Airflow Flower", "{airflow_exe} celery flower --port {FLOWER_PORT}", "INSTALL_FLOWER"),
    (WORKER, "{worker_unit}", "Airflow Celery Worker ({short_name})",
     "{airflow_exe} celery worker --queues {WORKER_QUEUES} --concurrency {WORKER_CONCURRENCY}", None),
    (SPARK, "spark-master", "Apache Spark Master (standalone)",
     "{spark_home}/bin/spark-class org.apache.spark.deploy.master.Master --host {MASTER_IP} --port {MASTER_PORT}"
     " --webui-port {MASTER_UI_PORT}", None),
    (SPARK, "spark-worker", "Apache Spark Worker (standalone)",
     "{spark_home}/bin/spark-class org.apache.spark.deploy.worker.Worker spark://{MASTER_IP}:{MASTER_PORT}"
     " --webui-port {WORKER_UI_PORT}{worker_args}", None),
]
WORKER_UNIT_PREFIX = "airflow-worker-"

# Document texts.
AIRFLOW_UNIT = """\
[Unit]
Description={description}
Requires=network-online.target
After=network-online.target

[Service]
Type=simple
User={user}
Group={user}
Environment="AIRFLOW_HOME={home}"
Environment="PATH={bin_dir}:/usr/bin:/bin"
{env_lines}ExecStart={command}
Restart=always
RestartSec=5s

[Install]
WantedBy=multi-user.target
"""
SPARK_UNIT = """\
[Unit]
Description={description}
After=network-online.target{after}
Wants=network-online.target
{requires}[Service]
Type=simple
User={user}
Group={user}
Environment="JAVA_HOME={java_home}"
Environment="SPARK_HOME={home}"
ExecStart={command}
Restart=always
RestartSec=5s
[Install]
WantedBy=multi-user.target
"""
SPARK_WORKER_AFTER = " spark-master.service"
SPARK_WORKER_REQUIRES = "Requires=spark-master.service\n"
PROFILE = """\
export AIRFLOW_HOME={home}
export PATH={bin_dir}:$PATH
"""
SPARK_ENV = """\
export JAVA_HOME={java_home}
export SPARK_MASTER_HOST={MASTER_IP}
export SPARK_MASTER_PORT={MASTER_PORT}
export SPARK_MASTER_WEBUI_PORT={MASTER_UI_PORT}
export SPARK_WORKER_WEBUI_PORT={WORKER_UI_PORT}
"""

# Line patterns of run logs and service logs.
RUN_FILE_PATTERN = r"deploy\.(\d{14})\.log"
STAMP_PATTERN = r"^\[(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)\] "
# groups: 1 host, 2 local marker, 3 status, 4 reason, 5 path, 6 phase
HOST_PATTERN = (
    r"^\[\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\] === ([^ :]+)( \(control server itself\))?"
    r"(?:: (SUCCESS|FAILED)(?: \(([^)]*)\))?(?: -- see (.*?))?)? ===(?: (.*))?$"
)
SUMMARY_PATTERN = (
    r"^Deployment (?:complete: |finished with failures on: .* \()(\d+)/(\d+)"
    r" (?:hosts succeeded\.|succeeded\))$"
)
SUMMARY_OK_FORMAT = "Deployment complete: {total}/{total} hosts succeeded."
SUMMARY_FAILED_START = "Deployment finished with failures on: "
SUMMARY_FAILED_END = " ({succeeded}/{total} succeeded)"
DETAILS_PREFIX = "Full details in "
NO_STEPS_PREFIX = "No install commands found for host "
# What a step without a command is called in the log.
NO_COMMAND = "null"
STEP_PREFIXES = {
    "STEP_BEGIN": "Executing: ",
    "STEP_OK": "Successfully executed: ",
    "STEP_ERR": "Error executing: ",
}
# The first word of a phase text names the stage.
STAGES = {"ensuring": "ensure_dir", "copying": "copy", "running": "run"}
SERVICE_LINE_PATTERN = r"^\[(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)\] \[(INFO|ERROR)\] (.*)$"
LOG_SINKS = {"INFO": "access", "ERROR": "error"}
