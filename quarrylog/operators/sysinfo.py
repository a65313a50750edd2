"""Facts of a machine from the dumps of its commands, one row.

The dumps come as one row of texts (`uname`, `ip`, `lscpu`, `df`, `timezone`, `date`, `uptime`, `last`, `sessions`,
`whoami`); a missing dump is the empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylog.functions.text import valid_utf8

# Files of the dumps below the collection's folder.
DUMPS = {
    "uname": "Volatile/uname_dmp", "ip": "Volatile/ip_dmp", "lscpu": "Volatile/lscpu_dmp", "df": "NonVolatile/df_dmp", "timezone": "Volatile/timezone_dmp", "date": "Volatile/date_dmp",
    "uptime": "Volatile/uptime_dmp", "last": "NonVolatile/last_dmp", "sessions": "Volatile/session_dmp", "whoami": "NonVolatile/whoami_dmp",
}
# Columns of the facts, and names of interfaces that are no machine's own.
COLUMNS = "hostname internal_ip external_ip mac_address os kernel architecture cpu_model cpu_cores disk_total disk_used disk_avail disk_use_pct timezone collected_at booted_at uptime_days last_reboot wtmp_begins listen_ports collect_user analyzed_at".split()
VIRTUAL_INTERFACE = "^(br-|docker|veth|virbr)"


def is_private(ip: Column) -> Column:
    """Private, shared, link-local and loopback IPv4 networks; anything that isn't four parts counts as private."""
    part = F.transform(F.split(ip, r"\."), lambda p: p.try_cast("int"))
    a, b = F.get(part, F.lit(0)), F.get(part, F.lit(1))
    inside = a.isin(10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254))
    return F.coalesce((F.size(part) != 4) | inside, F.lit(True))


def _lines(text: Column) -> Column:
    return F.split(text, r"\r\n|\r|\n")


def _first(items: Column) -> Column:
    return F.coalesce(F.get(items, F.lit(0)), F.lit(""))


def _value(text: Column, label: str) -> Column:
    """What follows the last `label...:` at the beginning of a line."""
    found = F.filter(_lines(text), lambda x: x.startswith(label))
    return F.coalesce(F.trim(F.regexp_replace(F.get(found, F.size(found) - 1), "^[^:]*:", "")), F.lit(""))


def global_ips(text: Column) -> Column:
    """Addresses of global scope on interfaces that aren't virtual, in order."""

    def step(so_far: Column, line: Column) -> Column:
        name = F.regexp_extract(line, r"^\d+:\s+(\S+?):", 1)
        ip = F.regexp_extract(line, r"^\s*inet ([\d.]+)/\d+.*scope global", 1)
        use = (name == "") & (ip != "") & ~so_far["interface"].rlike(VIRTUAL_INTERFACE)
        return F.struct(F.when(name != "", name).otherwise(so_far["interface"]).alias("interface"), F.when(use, F.concat(so_far["ips"], F.array(ip))).otherwise(so_far["ips"]).alias("ips"))

    start = F.struct(F.lit("").alias("interface"), F.array().cast("array<string>").alias("ips"))
    return F.aggregate(_lines(text), start, step)["ips"]


def collected_at(text: Column) -> Column:
    """`Mon Mar  2 16:01:37 UTC 2026` as a time text; another notation stays as it is."""
    p = F.regexp_extract_all(F.regexp_replace(text, r"\s+", " "), F.lit(r"^\w{3} (\w{3}) (\d{1,2}) (\d{2}:\d{2}:\d{2}) \S+ (\d{4})$"), F.lit(0))
    clean = F.get(p, F.lit(0))
    stamp = F.try_to_timestamp(F.regexp_replace(clean, r"^\w{3} (\w{3} \d{1,2} [\d:]+) \S+ (\d{4})$", "$1 $2"), F.lit("MMM d HH:mm:ss yyyy"))
    return F.coalesce(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss.SSS"), text)


def facts(dumps: DataFrame) -> DataFrame:
    d = dumps.select(*(F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"^\s+|\s+$", "")).alias(c) for c in DUMPS))
    words = F.split(F.col("uname"), r"\s+")
    word = lambda i: F.coalesce(F.get(words, F.lit(i)), F.lit(""))
    release = F.regexp_extract("uname", r"(\d+\.\d+\.\d+)-Ubuntu", 1)
    root = F.get(F.filter(F.transform(_lines(F.col("df")), lambda x: F.split(F.trim(x), r"\s+")), lambda p: F.get(p, F.lit(5)) == "/"), F.lit(0))
    disk = lambda i: F.coalesce(F.get(root, F.lit(i)), F.lit(""))
    ips = global_ips(F.col("ip"))
    d = d.withColumns({"collected_at": collected_at(F.col("date")), "ips": ips})
    up = lambda i: F.regexp_extract("uptime", r"up\s+(\d+)\s+days?,\s+(\d+):(\d+)", i)
    stamp = F.try_to_timestamp("collected_at", F.lit("yyyy-MM-dd HH:mm:ss.SSS"))
    booted = stamp - F.make_dt_interval(up(1).try_cast("int"), up(2).try_cast("int"), up(3).try_cast("int"))
    listening = F.filter(_lines(F.col("sessions")), lambda x: x.contains("LISTEN") & x.startswith("tcp"))
    ports = F.filter(F.transform(listening, lambda x: F.regexp_extract(x, r"[*\d.]+:(\d+)\s", 1)), lambda p: p != "")
    sorted_ports = F.transform(F.array_sort(F.array_distinct(F.transform(ports, lambda p: p.try_cast("int")))), lambda p: p.cast("string"))
    reboot = F.filter(F.transform(F.filter(_lines(F.col("last")), lambda x: x.startswith("reboot")), lambda x: F.regexp_extract(x, r"(\w{3}\s+\w{3}\s+\d+\s+\d{2}:\d{2})", 1)), lambda x: x != "")
    own = {
        "hostname": word(1), "kernel": word(2), "architecture": word(11), "os": F.when(release != "", F.concat(F.lit("Ubuntu "), release)).when(F.col("uname").contains("Ubuntu"), "Ubuntu").otherwise(""),
        "internal_ip": F.array_join(F.filter("ips", is_private), ", "), "external_ip": F.array_join(F.filter("ips", lambda x: ~is_private(x)), ", "), "mac_address": F.regexp_extract("ip", r"link/ether ([\da-f:]+)", 1),
        "cpu_model": _value(F.col("lscpu"), "Model name"), "cpu_cores": _value(F.col("lscpu"), "CPU(s):"), "disk_total": disk(1), "disk_used": disk(2), "disk_avail": disk(3), "disk_use_pct": disk(4),
        "timezone": F.regexp_extract("timezone", r"Time zone:\s+(\S+)", 1), "collected_at": F.col("collected_at"), "uptime_days": up(1),
        "booted_at": F.when(up(1) == "", "").otherwise(F.coalesce(F.date_format(booted, "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(""))),
        "last_reboot": _first(reboot), "wtmp_begins": F.trim(F.regexp_extract("last", r"wtmp begins (.+)", 1)), "listen_ports": F.array_join(sorted_ports, ", "), "collect_user": F.col("whoami"),
        "analyzed_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss.SSS"),
    }
    return d.select(*(own[c].alias(c) for c in COLUMNS))


def dumps_of(spark: SparkSession, base: str) -> DataFrame:
    """The dump files below a folder as one row; those that aren't there are null."""
    from pathlib import Path

    found = {c: f"{base.rstrip('/')}/{p}" for c, p in DUMPS.items() if Path(base, p).is_file()}
    if not found:
        return spark.createDataFrame([tuple(None for _ in DUMPS)], ", ".join(f"{c} string" for c in DUMPS))
    texts = spark.read.text(list(found.values()), wholetext=True).select(F.col("_metadata.file_path").alias("path"), valid_utf8(F.col("value")).alias("text"))
    return texts.agg(*(F.max(F.when(F.col("path").endswith("/" + DUMPS[c]), F.col("text"))).alias(c) for c in DUMPS))
