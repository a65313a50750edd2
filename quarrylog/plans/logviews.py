"""Log-shaped views over the events table, and log lines rendered from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ip() -> Column:
    u = F.col("user_id")
    return F.concat_ws(".", F.lit("10"), (u % 4).cast("string"), (u % 16).cast("string"), (u % 250 + 1).cast("string"))


def _time() -> Column:
    return F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")


AUTH_EVENTS = {"click": "sshd_failed_password", "view": "sshd_accepted_password", "purchase": "sshd_accepted_publickey", "error": "sshd_invalid_user", "signup": "sudo_command"}
STATUS = {"click": 200, "view": 200, "purchase": 301, "error": 500, "signup": 404}


def _mapped(column: str, values: dict) -> Column:
    return F.coalesce(*(F.when(F.col(column) == k, F.lit(v)) for k, v in values.items()))


def auth(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), _time().alias("date_time"), _mapped("event_type", AUTH_EVENTS).alias("event_type"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"), _ip().alias("src_ip"), F.lit("").alias("detail"))


def web(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    method = F.when(F.col("event_id") % 5 == 0, "POST").when(F.col("event_id") % 17 == 0, "PUT").otherwise("GET")
    vhost = F.when(F.col("event_id") % 3 == 0, "default").otherwise(F.concat(F.lit("v"), (F.col("event_id") % 4).cast("string")))
    uri = F.concat(F.lit("/p/"), (F.col("user_id") % 40).cast("string"))
    return e.select(F.col("event_id").alias("id"), _time().alias("date_time"), _ip().alias("src_ip"), method.alias("method"), uri.alias("uri"), _mapped("event_type", STATUS).alias("status"), vhost.alias("vhost"), F.lit(None).cast("string").alias("user_agent"))


def web_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'error'")
    return e.select(F.col("event_id").alias("id"), _time().alias("date_time"), _ip().alias("client_ip"))


def web_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"apache2": web(spark, sf_dir), "apache2_error": web_errors(spark, sf_dir)}


#: The same views in DuckDB's SQL.
SQL_VIEWS = """
WITH base AS (
  SELECT *, '10.' || (user_id % 4) || '.' || (user_id % 16) || '.' || (user_id % 250 + 1) AS ip, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS date_time FROM events),
v_auth AS (
  SELECT event_id AS id, date_time,
         CASE event_type WHEN 'click' THEN 'sshd_failed_password' WHEN 'view' THEN 'sshd_accepted_password' WHEN 'purchase' THEN 'sshd_accepted_publickey'
                         WHEN 'error' THEN 'sshd_invalid_user' WHEN 'signup' THEN 'sudo_command' END AS event_type,
         'u' || user_id AS "user", ip AS src_ip, '' AS detail FROM base),
v_web AS (
  SELECT event_id AS id, date_time, ip AS src_ip, CASE WHEN event_id % 5 = 0 THEN 'POST' WHEN event_id % 17 = 0 THEN 'PUT' ELSE 'GET' END AS method, '/p/' || (user_id % 40) AS uri,
         CASE event_type WHEN 'click' THEN 200 WHEN 'view' THEN 200 WHEN 'purchase' THEN 301 WHEN 'error' THEN 500 WHEN 'signup' THEN 404 END AS status,
         CASE WHEN event_id % 3 = 0 THEN 'default' ELSE 'v' || (event_id % 4) END AS vhost, NULL::VARCHAR AS user_agent FROM base),
v_weberr AS (SELECT event_id AS id, date_time, ip AS client_ip FROM base WHERE event_type = 'error')
"""


def rendered(spark: SparkSession, sf_dir: str, line: Column, file_name: str | None = None, mtime: str = "2024-06-01 00:00:00") -> DataFrame:
    """One log line an event, with the source columns that parsers read."""
    e = table(spark, sf_dir, "events")
    cores = spark.sparkContext.defaultParallelism
    # Log files split among tasks; a table of one row group doesn't, so it is dealt out.
    e = (e.repartition(cores) if e.rdd.getNumPartitions() < cores else e).withColumns({"ip": _ip(), "stamp": _time()})
    return e.select("event_id", line.alias("value"), F.lit("/logs/" + (file_name or "log")).alias("path"), F.lit(file_name or "log").alias("file_name"), F.lit(mtime).cast("timestamp").alias("mtime"), F.lit(None).cast("string").alias("format"))


def stamp(pattern: str) -> Column:
    return F.date_format("ts", pattern)
