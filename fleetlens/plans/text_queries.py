"""Queries of the derived columns over whole texts and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions import text as X
from fleetlens.operators import select
from fleetlens.plans.registry import query
from fleetlens.plans.samples import table


@query("url_encode_pages", "SELECT page_id, url_encode(url) AS encoded FROM pages")
def url_encode_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.url_encode("url").alias("encoded"))


@query("url_encode_docs", "SELECT doc_id, md5(url_encode(text)) AS encoded FROM documents")
def url_encode_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.url_encode("text")).alias("encoded"))


@query("first_tokens", r"SELECT doc_id, regexp_extract(text, '^\s*(\S*)', 1) AS token FROM documents")
def first_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.first_token("text").alias("token"))


@query(
    "drop_blank_lines",
    """SELECT doc_id, len(l) AS n_lines, md5(array_to_string(l, '|')) AS lines
    FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM documents) AS t""",
)
def drop_blank_lines(spark, sf_dir):
    kept = X.drop_blank(F.split("text", "\n"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(kept).cast("bigint").alias("n_lines"), F.md5(F.array_join(kept, "|")).alias("lines")
    )


@query(
    "merge_csv_docs",
    """WITH items AS (SELECT doc_id, unnest(l) AS item, generate_subscripts(l, 1) AS pos FROM (
        SELECT doc_id, string_split('celery,postgres,redis,' || replace(replace(text, ' ', ','), chr(10), ','), ',') AS l
        FROM documents) AS t),
      firsts AS (SELECT doc_id, item, min(pos) AS pos FROM items WHERE item <> '' GROUP BY 1, 2)
    SELECT doc_id, count(*) AS n_items, md5(string_agg(item, ',' ORDER BY pos)) AS merged FROM firsts GROUP BY 1""",
)
def merge_csv_docs(spark, sf_dir):
    """The words of each whole text, merged behind the base list."""
    merged = X.merge_csv(F.translate("text", " ", ","))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(F.split(merged, ",")).cast("bigint").alias("n_items"), F.md5(merged).alias("merged")
    )


@query(
    "csv_items_docs",
    r"""SELECT doc_id, pos - 1 AS pos, item FROM (SELECT doc_id, unnest(l) AS item, generate_subscripts(l, 1) AS pos FROM (
      SELECT doc_id, list_filter(list_transform(string_split(text, ','),
        lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM documents) AS t) AS u""",
)
def csv_items_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.csv_items("text")).alias("pos", "item"))


@query(
    "split_kv_pages",
    """SELECT page_id, string_split(url, '=')[1] AS key,
      CASE WHEN contains(url, '=') THEN substr(url, strpos(url, '=') + 1) ELSE url END AS value FROM pages""",
)
def split_kv_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.split_kv("url").alias("kv")).select("page_id", "kv.*")


@query(
    "env_entries_docs",
    """WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM documents),
      e AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM l)
    SELECT doc_id, pos, string_split(line, '=')[1] AS key,
      CASE WHEN contains(line, '=') THEN substr(line, strpos(line, '=') + 1) ELSE line END AS value FROM e""",
)
def env_entries_docs(spark, sf_dir):
    entries = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.env_entries("text")).alias("pos", "e"))
    return entries.select("doc_id", "pos", "e.key", "e.value")


CONN = "url_encode(s_name) || ':' || url_encode(s_name || '/é €') || '@db' || s_nationkey || ':5432/' || s_suppkey"


@query(
    "conn_strings",
    f"""SELECT s_suppkey, 'postgresql+psycopg2://' || {CONN} AS sql_conn, 'db+postgresql://' || {CONN} AS result_backend,
      CASE WHEN s_acctbal > 5000 THEN 'redis://:' || url_encode(s_name || '*') || '@rd:6379/' || s_nationkey
        ELSE 'redis://rd:6379/' || s_nationkey END AS broker_url FROM supplier""",
)
def conn_strings(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey", "s_name AS user", "s_name || '/é €' AS password", "concat('db', s_nationkey) AS host",
        "string(s_suppkey) AS db", "if(s_acctbal > 5000, s_name || '*', '') AS redis", "string(s_nationkey) AS n",
    )
    login = ("user", "password", "host", F.lit("5432"), "db")
    return rows.select(
        "s_suppkey",
        X.sql_conn(*login).alias("sql_conn"),
        X.result_backend(*login).alias("result_backend"),
        X.broker_url("redis", F.lit("rd"), F.lit("6379"), "n").alias("broker_url"),
    )


@query(
    "paths_and_versions",
    r"""SELECT page_id, CASE WHEN right(url, 1) = '/' THEN left(url, length(url) - 1) ELSE url END || '/apps/airflow' AS home,
      regexp_replace(url, '\.[^.]*$', '') AS series FROM pages""",
)
def paths_and_versions(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.concat(X.base_dir("url"), F.lit("/apps/airflow")).alias("home"),
        X.major_minor("url").alias("series"),
    )


@query(
    "slugs",
    """SELECT page_id, 'airflow-worker-' || regexp_replace(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9-]', '', 'g') AS slug FROM pages""",
)
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.slug("url").alias("slug"))


NAME = "'spark-' || p_size || '.' || (p_partkey % 10) || '-bin-' || lower(p_type)"


@query(
    "package_urls",
    f"""SELECT p_partkey, {NAME} AS package, {NAME} || '.tgz' AS tarball,
      'https://dlcdn.apache.org/spark/spark-' || p_size || '.' || (p_partkey % 10) || '/' || {NAME} || '.tgz' AS primary_url,
      'https://archive.apache.org/dist/spark/spark-' || p_size || '.' || (p_partkey % 10) || '/' || {NAME} || '.tgz' AS archive_url
    FROM part""",
)
def package_urls(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "concat(p_size, '.', p_partkey % 10) AS version", "lower(p_type) AS variant"
    )
    return rows.select("p_partkey", *[c.alias(n) for n, c in X.package_urls("version", "variant").items()])


@query(
    "optional_args",
    """SELECT o_orderkey, (CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ' -c ' || (o_orderkey % 5) END)
      || (CASE WHEN o_orderstatus = 'P' THEN '' ELSE ' -m ' || o_custkey || 'g' END) AS args FROM orders""",
)
def optional_args(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "string(o_orderkey % 5) AS cores", "if(o_orderstatus = 'P', '0', concat(o_custkey, 'g')) AS memory"
    )
    return rows.select("o_orderkey", X.optional_args("cores", "memory").alias("args"))


@query(
    "log_lines",
    """SELECT event_id, '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] [' || CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END
      || '] ' || event_type AS service_line, '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] ' || event_type AS run_line,
      strftime(ts, '%d%m%Y%H%M%S') AS run_id, date_trunc('second', ts) AS run_time FROM events""",
)
def log_lines(spark, sf_dir):
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    return table(spark, sf_dir, "events").select(
        "event_id",
        X.log_line("ts", "event_type", level).alias("service_line"),
        X.log_line("ts", "event_type").alias("run_line"),
        X.run_id("ts").alias("run_id"),
        X.run_time(X.run_id("ts")).alias("run_time"),
    )


@query(
    "ordered_distinct",
    "SELECT l_orderkey, l_suppkey, min(l_linenumber) AS first_pos FROM lineitem GROUP BY 1, 2",
)
def ordered_distinct(spark, sf_dir):
    return select.ordered_distinct(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", "l_linenumber")
