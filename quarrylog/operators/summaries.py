"""Summaries of log-ins, commands, jobs and web attacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylog.operators.dashboards import ACCEPTED, ATTACKS

_SPAN = lambda time: [F.min(time).alias("first_dt"), F.max(time).alias("last_dt"), F.count("*").alias("cnt")]


def logs(tables: dict[str, DataFrame]) -> DataFrame:
    """(log, first_dt, last_dt, total, file_count) of every table."""
    parts = [SparkSession.active().createDataFrame([], "first_dt string, last_dt string, total bigint, file_count bigint, log string")]
    for name, df in sorted(tables.items()):
        time = next(c for c in ("date_time", "timestamp") if c in df.columns)
        files = F.countDistinct("source_file") if "source_file" in df.columns else F.lit(None).cast("bigint")
        parts.append(df.agg(F.min(time).alias("first_dt"), F.max(time).alias("last_dt"), F.count("*").alias("total"), files.alias("file_count")).withColumn("log", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def logins(auth: DataFrame) -> DataFrame:
    """(src_ip, user, auth_method, first_dt, last_dt, cnt) of successful log-ins."""
    won = auth.filter(F.col("event_type").isin(*ACCEPTED))
    return won.groupBy("src_ip", "user", F.replace("event_type", F.lit("sshd_accepted_"), F.lit("")).alias("auth_method")).agg(*_SPAN("date_time"))


def sudo_commands(auth: DataFrame) -> DataFrame:
    return auth.filter("event_type = 'sudo_command'").groupBy("user", F.col("detail").alias("command")).agg(*_SPAN("date_time"))


def attack_ips(auth: DataFrame) -> DataFrame:
    """(src_ip, total, success_count, fail_count, first_dt, last_dt) of addresses with a failed log-in."""
    kind = F.col("event_type")
    tried = auth.filter((F.col("src_ip") != "") & kind.isin(*ACCEPTED, *ATTACKS))
    out = tried.groupBy("src_ip").agg(F.count("*").alias("total"), F.count_if(kind.isin(*ACCEPTED)).alias("success_count"), F.count_if(kind.isin(*ATTACKS)).alias("fail_count"), F.min("date_time").alias("first_dt"), F.max("date_time").alias("last_dt"))
    return out.filter("fail_count > 0")


def su_changes(auth: DataFrame) -> DataFrame:
    return auth.filter("event_type = 'su_to'").groupBy(F.col("user").alias("from_user"), F.col("detail").alias("to_user")).agg(*_SPAN("date_time"))


def audit_logins(audit: DataFrame) -> DataFrame:
    return audit.filter(F.col("type").isin("USER_LOGIN", "USER_AUTH")).groupBy("addr", "acct", F.col("msg_res").alias("result")).agg(*_SPAN("date_time"))


def audit_commands(audit: DataFrame) -> DataFrame:
    return audit.filter(F.col("type").isin("EXECVE", "USER_CMD")).groupBy("auid", F.coalesce(F.nullif(F.col("cmd"), F.lit("")), F.col("comm")).alias("command")).agg(*_SPAN("date_time"))


def audit_files(audit: DataFrame) -> DataFrame:
    """Folders and title lines of the records that name a file's place."""
    return audit.filter(F.col("type").isin("CWD", "PROCTITLE", "PATH")).groupBy("type", F.coalesce(F.nullif(F.col("cwd"), F.lit("")), F.col("proctitle")).alias("what")).agg(*_SPAN("date_time"))


def _seconds(time: str) -> Column:
    return F.unix_millis(F.to_timestamp(F.col(time), "yyyy-MM-dd HH:mm:ss.SSS")) / 1000


def cron_jobs(cron: DataFrame) -> DataFrame:
    """(process, user, exec_count, avg_seconds, total_seconds): sessions, each opening paired with the close that follows it in its process."""
    in_process = Window.partitionBy("hostname", "pid", "user").orderBy("timestamp", F.desc("event_type"))
    sessions = cron.filter(F.col("event_type").isin("SESSION_OPEN", "SESSION_CLOSE"))
    sessions = sessions.withColumns({"next_type": F.lead("event_type").over(in_process), "next_time": F.lead("timestamp").over(in_process)}).filter("event_type = 'SESSION_OPEN'")
    took = F.when(F.col("next_type") == "SESSION_CLOSE", _seconds("next_time") - _seconds("timestamp"))
    return sessions.withColumn("took", took).groupBy("process", "user").agg(F.count("*").alias("exec_count"), F.avg("took").alias("avg_seconds"), F.sum("took").alias("total_seconds"))


def cron_process_names(sessions: DataFrame, audit: DataFrame) -> DataFrame:
    """(ses, process_name): of each session the first program name its audit records give."""
    name = F.coalesce(F.nullif(F.col("proctitle"), F.lit("")), F.nullif(F.col("comm"), F.lit("")), F.nullif(F.col("exe"), F.lit("")))
    named = audit.filter(F.col("type").isin("EXECVE", "SYSCALL", "PROCTITLE")).withColumn("name", name).filter("name is not null")
    return sessions.join(named.groupBy("ses").agg(F.min_by("name", F.struct("date_time", "sequence")).alias("process_name")), "ses", "left")


# Our own rules: attack classes of a decoded, lower-cased request.
ATTACK_RULES = {
    "sql_injection": r"union(?:\s|/\*.{0,40}\*/)+(?:all\s+)?select|'\s*or\s+'?\d|sleep\s*\(|information_schema|--\s*$",
    "xss": r"<\s*script|javascript:|onerror\s*=|onload\s*=",
    "path_traversal": r"\.\./|\.\.\\|/etc/passwd",
    "file_inclusion": r"(?:php|data|expect|zip)://|=https?://",
    "command_injection": r"[;|`]\s*(?:cat|id|wget|curl|nc|bash|sh)\b|\$\(",
    "webshell": r"(?:cmd|shell|c99|r57|webshell)\.(?:php|jsp|asp)|[?&]cmd=",
    "scanner": r"/(?:\.git|\.env|wp-login\.php|phpmyadmin|actuator|manager/html)",
    "log4shell": r"\$\{jndi:",
}


def decoded_uri(uri: Column) -> Column:
    """Lower-cased request, URL-decoded twice over where that is possible."""
    once = F.coalesce(F.try_url_decode(uri), uri)
    return F.lower(F.coalesce(F.try_url_decode(once), once))


def attack_types(uri: Column) -> Column:
    """Names of the rules that a request matches, in the rules' order."""
    text = decoded_uri(uri)
    return F.array_compact(F.array(*(F.when(text.rlike(rule), F.lit(name)) for name, rule in ATTACK_RULES.items())))


def attacks(web: DataFrame) -> DataFrame:
    """(src_ip, attack_type, first_dt, last_dt, cnt) of requests that look like attacks."""
    return web.select("src_ip", "date_time", F.explode(attack_types(F.col("uri"))).alias("attack_type")).groupBy("src_ip", "attack_type").agg(*_SPAN("date_time"))


def top_attack_ips(web: DataFrame, n: int = 10) -> DataFrame:
    """(src_ip, attack_count, attack_types) of the addresses with most attacks."""
    hit = web.withColumn("types", attack_types(F.col("uri"))).filter(F.size("types") > 0)
    out = hit.groupBy("src_ip").agg(F.count("*").alias("attack_count"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))), ",").alias("attack_types"))
    return out.orderBy(F.desc("attack_count"), "src_ip").limit(n)


# Our own thresholds: what each sign of a web shell weighs.
SHELL_WEIGHTS = {"script_file": 2, "post_only": 2, "few_ips": 1, "varying_bytes": 2, "odd_folder": 2, "shell_name": 3}


def webshells(web: DataFrame, least: int = 5) -> DataFrame:
    """(path, ip_count, hits, bytes_min, bytes_max, bytes_distinct, flags..., score) of paths that score `least` or more."""
    path = F.regexp_extract(decoded_uri(F.col("uri")), r"^([^?]*)", 1)
    by = web.filter("status = 200").groupBy(path.alias("path")).agg(
        F.countDistinct("src_ip").alias("ip_count"), F.count("*").alias("hits"), F.min("bytes_sent").alias("bytes_min"), F.max("bytes_sent").alias("bytes_max"), F.countDistinct("bytes_sent").alias("bytes_distinct"), F.count_if(F.col("method") == "POST").alias("posts")
    )
    flags = {
        "script_file": F.col("path").rlike(r"\.(?:php|jsp|jspx|asp|aspx|cgi)$"), "post_only": F.col("posts") == F.col("hits"), "few_ips": F.col("ip_count") <= 2,
        "varying_bytes": F.col("bytes_distinct") > F.greatest(F.lit(2), F.col("hits") / 2), "odd_folder": F.col("path").rlike(r"/(?:upload|uploads|images|img|tmp|files|data)/"), "shell_name": F.col("path").rlike(r"(?:cmd|shell|c99|r57|eval|upload)[^/]*$"),
    }
    by = by.withColumns(flags)
    score = reduce(Column.__add__, [F.when(F.col(f), w).otherwise(0) for f, w in SHELL_WEIGHTS.items()])
    return by.withColumn("score", score).filter(F.col("score") >= least).drop("posts")
