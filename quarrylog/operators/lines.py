"""Line grammars: DataFrames of raw lines to typed tables, by projections alone.

A table of lines has `value` and may have `path`, `file_name` and `mtime`. Tables keep the source columns they are given
besides their own only as `source_file`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylog.functions import patterns as P
from quarrylog.functions import times
from quarrylog.functions.text import clean_ip, extract, field_in, fields_of, found, hex_text, unescape, valid_utf8, with_groups

BSD, ISO = "syslog", "iso8601"
#: Files whose formats are still sent to all tasks.
BROADCAST_FILES = 200_000


def _prepared(lines: DataFrame, strip: bool = True) -> DataFrame:
    """Valid text in `line` (without trailing white space), and null for what the source doesn't know."""
    value = valid_utf8(F.col("value"))
    known = set(lines.columns)
    extra = {"path": "string", "file_name": "string", "mtime": "timestamp", "format": "string"}
    lines = lines.withColumns({c: F.lit(None).cast(t) for c, t in extra.items() if c not in known})
    return lines.withColumn("line", F.regexp_replace(value, r"\s+$", "") if strip else value)


def _matched(rows: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """The rows whose line matches, with its groups in struct column `h`."""
    return rows.select("*", F.explode(found(extract(F.col("line"), pattern, names))).alias("h"))


def line_format(value: Column) -> Column:
    """Which header a line has, null if none."""
    line = F.trim(value)
    return F.when(line.rlike(P.ISO_HEADER), ISO).when(line.rlike(P.BSD_HEADER), BSD)


def with_format(lines: DataFrame, files: int | None = None) -> DataFrame:
    """Adds the format of each file: that of the first of its first ten lines that has one, BSD otherwise.

    Needs `path` and `place` (a number that grows by one from line to line within the beginning of a file). files: how many
    there are, if that is known.
    """
    seen = F.when(line_format(F.col("value")).isNotNull(), F.struct("place", line_format(F.col("value")).alias("format")))
    heads = lines.filter("at_start").groupBy("path").agg(F.min("place").alias("first"), F.min(seen).alias("seen"))
    heads = heads.select("path", F.when(F.col("seen.place") - F.col("first") < 10, F.col("seen.format")).alias("format"))
    # One row a file: sent to all tasks, as lines are many; a collection of more files is joined by shuffles.
    heads = F.broadcast(heads) if files is not None and files <= BROADCAST_FILES else heads
    return lines.join(heads, "path", "left").withColumn("format", F.coalesce("format", F.lit(BSD)))


def _header(lines: DataFrame, all_lines: bool = False) -> DataFrame:
    """Columns time, host, service, pid and message of the lines with a header of their format (with all_lines blank ones of the others)."""
    names = ["ok", "mon", "day", "clock", "host", "service", "pid", "message"]
    struct = lambda *values: F.struct(*(v.alias(n) for n, v in zip(names, values, strict=True)))
    blank = F.lit("")
    bsd = with_groups(F.col("line"), P.BSD_HEADER, 7, lambda ok, g: struct(ok, *(g(i) for i in range(1, 8))))
    iso = with_groups(F.col("line"), P.ISO_HEADER, 5, lambda ok, g: struct(ok, blank, blank, *(g(i) for i in range(1, 6))))
    lines = lines.withColumn("format", F.coalesce("format", F.lit(BSD)))
    lines = lines.select("*", F.explode(found(F.when(F.col("format") == ISO, iso).otherwise(bsd), all_lines)).alias("h"))
    time = F.when(F.col("format") == ISO, times.iso_time(F.col("h.clock"))).otherwise(times.bsd_time(F.col("h.mon"), F.col("h.day"), F.col("h.clock"), F.col("mtime")))
    return lines.select("*", F.when(F.col("h.ok"), time).otherwise("").alias("time"), *(F.col(f"h.{c}").alias(c) for c in names[4:])).drop("h")


def _classified(message: Column, events: list[tuple], fields: tuple[str, ...], default: Column) -> Column:
    """Struct (event, *fields) of the first event whose pattern is found; events without a group for `detail` keep the default's."""
    out = default
    for name, pattern, groups in reversed(events):
        at = {g: i + 1 for i, g in enumerate(groups) if g}
        values = [F.regexp_extract(message, pattern, at[f]) if f in at else default[f] for f in fields]
        out = F.when(message.rlike(pattern), F.struct(F.lit(name).alias("event"), *(v.alias(f) for v, f in zip(values, fields, strict=True)))).otherwise(out)
    return out


def authlog(lines: DataFrame) -> DataFrame:
    """Log-in events; lines without a header stay, with blank fields and event type `unknown`."""
    rows = _header(_prepared(lines).filter(F.trim("line") != ""), all_lines=True)
    fields = ("user", "src_ip", "port", "detail")
    message, service = F.col("message"), F.col("service")
    plain = F.struct(F.lit("unknown").alias("event"), *(F.lit("").alias(f) for f in fields[:3]), message.alias("detail"))
    kind = (
        F.when(service.contains("sshd"), _classified(message, P.SSHD_EVENTS, fields, plain))
        .when(service.contains("sudo"), _classified(message, P.SUDO_EVENTS, fields, plain))
        .when(service.contains("CRON") | service.contains("cron"), _classified(message, P.CRON_LOGIN_EVENTS, fields, plain))
        .when(service.isin("su", "su-l"), _classified(message, P.SU_EVENTS, fields, plain))
        .otherwise(plain)
    )
    rows = rows.withColumn("k", kind)
    return rows.select(F.col("time").alias("date_time"), F.col("host").alias("hostname"), "service", "pid", F.col("k.event").alias("event_type"), *(F.col(f"k.{f}").alias(f) for f in fields), F.col("line").alias("raw_line"), F.col("path").alias("source_file"))


def syslog(lines: DataFrame) -> DataFrame:
    rows = _header(_prepared(lines).filter(F.trim("line") != ""))
    return rows.select(F.col("time").alias("timestamp"), F.col("host").alias("hostname"), "service", "pid", "message", F.col("line").alias("raw_line"), F.col("path").alias("source_file"))


def cron(lines: DataFrame) -> DataFrame:
    rows = _header(_prepared(lines).filter(F.trim("line") != ""))
    plain = F.struct(F.lit("OTHER").alias("event"), F.lit("").alias("user"), F.lit("").alias("detail"))
    rows = rows.withColumn("k", _classified(F.col("message"), P.CRON_EVENTS, ("user", "detail"), plain))
    is_command = F.col("k.event") == "CMD"
    return rows.select(
        F.col("time").alias("timestamp"), F.col("host").alias("hostname"), F.col("service").alias("process"), "pid", F.col("k.event").alias("event_type"), F.col("k.user").alias("user"),
        F.when(is_command, F.col("k.detail")).otherwise("").alias("command"), F.when(is_command, "").otherwise(F.col("k.detail")).alias("detail"), "message", F.col("line").alias("raw_line"), F.col("path").alias("source_file"),
    )


def kernlog(lines: DataFrame) -> DataFrame:
    """Kernel messages with an ISO header; firewall lines belong to another log."""
    rows = _prepared(lines).filter((F.col("line") != "") & ~F.col("line").contains("[UFW "))
    rows = _matched(rows, P.KERNEL_HEADER, ["stamp", "host", "pid", "message"])
    return rows.select(times.iso_time(F.col("h.stamp")).alias("date_time"), F.col("h.host").alias("hostname"), F.col("h.pid").alias("pid"), F.trim("h.message").alias("message"), F.col("line").alias("raw_line"), F.col("path").alias("source_file"))


def vhost_of_file(name: Column) -> Column:
    """Virtual host that an access log's file name tells."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"\.gz$", ""), r"\.txt$", ""), r"\.(\d{4}-\d{2}-\d{2}|\d+)$", "")
    joined = F.replace(F.replace(bare, F.lit("_access_log"), F.lit("-access.log")), F.lit("_access.log"), F.lit("-access.log"))
    host = F.regexp_extract(joined, r"^(.+)-access\.log$", 1)
    return F.when(bare == "other_vhosts_access.log", "").when(host != "", host).when(bare.isin("access.log", "access_log"), "default").otherwise("unknown")


def _has_vhost_field(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"\.gz$", ""), r"\.txt$", ""), r"\.(\d{4}-\d{2}-\d{2}|\d+)$", "") == "other_vhosts_access.log"


def _access(rows: DataFrame) -> DataFrame:
    """Fields of access lines from struct column `h` (ip, time, request, status, bytes, rest); lines without status go."""
    rows = rows.select("*", "h.*").filter(F.col("status").cast("int") != 0)
    quoted = F.regexp_extract_all("rest", F.lit(f'"({P.QUOTED})"'), F.lit(1))
    body = F.trim(F.regexp_replace("rest", r"^\s+|\s+$", ""))
    first = F.regexp_extract(body, r"^(\S+)", 1)
    marked = (first == "-") | first.startswith("http://") | first.startswith("https://")
    tail = F.regexp_extract(body, r"(?s)^\S+\s*(.*)$", 1)
    bare = F.when(body == "", F.array().cast("array<string>")).when(marked, F.array(first, tail)).otherwise(F.array(F.lit(""), body))
    rows = rows.withColumn("fields", F.when(F.size(quoted) > 0, quoted).otherwise(bare))
    at = lambda i: F.coalesce(unescape(F.get("fields", F.lit(i))), F.lit(""))
    rows = rows.withColumn("asked", unescape(F.col("request"))).withColumn("r", extract(F.col("asked"), P.REQUEST, ["method", "uri", "protocol"]))
    rows = rows.withColumns({
        "date_time": times.access_time(F.col("time")), "src_ip": clean_ip(F.col("ip")), "method": F.col("r.method"), "protocol": F.col("r.protocol"),
        "uri": F.when(F.col("r.ok"), F.col("r.uri")).otherwise(F.col("asked")), "status": F.col("status").cast("int"),
        "bytes_sent": F.coalesce(F.when(F.col("bytes") == "-", F.lit(0)).otherwise(F.col("bytes").try_cast("bigint")), F.lit(0)).cast("bigint"),
        "referer": at(0), "user_agent": at(1), "xff": at(2),
    })
    return rows


_ACCESS_NAMES = ["ip", "time", "request", "status", "bytes", "rest"]


def nginx(lines: DataFrame) -> DataFrame:
    rows = _access(_matched(_prepared(lines), P.ACCESS, _ACCESS_NAMES))
    return rows.select("date_time", "src_ip", "method", "uri", "protocol", "status", "bytes_sent", "referer", "user_agent", "xff", F.col("line").alias("raw_line"), F.col("path").alias("source_file"))


def apache2(lines: DataFrame) -> DataFrame:
    """Access lines; of `other_vhosts_access.log` each line names its virtual host, otherwise the file's name does."""
    rows = _prepared(lines)
    with_field = F.coalesce(_has_vhost_field(F.col("file_name")), F.lit(False))
    names = ["ok", "vhost_port", *_ACCESS_NAMES]
    struct = lambda *values: F.struct(*(v.alias(n) for n, v in zip(names, values, strict=True)))
    long = with_groups(F.col("line"), P.VHOST_ACCESS, 7, lambda ok, g: struct(ok, *(g(i) for i in range(1, 8))))
    short = with_groups(F.col("line"), P.ACCESS, 6, lambda ok, g: struct(ok, F.lit(""), *(g(i) for i in range(1, 7))))
    rows = _access(rows.select("*", F.explode(found(F.when(with_field, long).otherwise(short))).alias("h")))
    vhost = F.when(F.col("vhost_port") != "", F.substring_index("vhost_port", ":", 1)).otherwise(F.coalesce(vhost_of_file(F.col("file_name")), F.lit("unknown")))
    return rows.select("date_time", vhost.alias("vhost"), "src_ip", "method", "uri", "protocol", "status", "bytes_sent", "referer", "user_agent", F.col("line").alias("raw_line"), F.col("path").alias("source_file"))


def _client(raw: Column) -> Column:
    """Address of a client field: what stands before its last colon, if it has one."""
    return clean_ip(F.regexp_replace(raw, ":[^:]*$", ""))


def apache2_error(lines: DataFrame) -> DataFrame:
    rows = _prepared(lines).filter(F.trim("line") != "")
    names = ["ok", "new", "time", "module", "level", "pid", "client", "message"]
    struct = lambda *values: F.struct(*(v.alias(n) for n, v in zip(names, values, strict=True)))
    new = with_groups(F.col("line"), P.APACHE_ERROR_24, 6, lambda ok, g: struct(ok, ok, *(g(i) for i in range(1, 7))))
    old = with_groups(F.col("line"), P.APACHE_ERROR_22, 4, lambda ok, g: struct(ok, F.lit(False), g(1), F.lit("core"), g(2), F.lit(""), g(3), g(4)))
    # The older form is tried where the newer doesn't match.
    first = F.filter(F.array(new), lambda s: s["ok"])
    rows = rows.withColumn("first", first).select("*", F.explode(F.when(F.size("first") > 0, F.col("first")).otherwise(found(old))).alias("h"))
    return rows.select(
        times.apache_error_time(F.col("h.time")).alias("date_time"), F.lower("h.level").alias("level"), F.col("h.module").alias("module"),
        F.when(F.col("h.new"), F.col("h.pid").try_cast("int")).otherwise(0).alias("pid"), _client(F.col("h.client")).alias("client_ip"), F.col("h.message").alias("message"), F.col("line").alias("raw_line"), F.col("path").alias("source_file"),
    )


def nginx_error(lines: DataFrame) -> DataFrame:
    rows = _matched(_prepared(lines), P.NGINX_ERROR, ["time", "level", "pid", "tid", "cid", "message"])
    number = lambda c: F.coalesce(F.col(f"h.{c}").try_cast("int"), F.lit(0))
    message = F.trim("h.message")
    return rows.select(
        times.nginx_error_time(F.col("h.time")).alias("date_time"), F.lower("h.level").alias("level"), number("pid").alias("pid"), number("tid").alias("tid"), number("cid").alias("cid"),
        F.regexp_extract(message, P.NGINX_CLIENT, 1).alias("client_ip"), message.alias("message"), F.col("line").alias("raw_line"), F.col("path").alias("source_file"),
    )


def mysql_query(lines: DataFrame) -> DataFrame:
    """General query log; header lines and continuation lines are left out."""
    rows = _prepared(lines, strip=False).filter((F.col("line") != "") & ~F.col("line").rlike(P.MYSQL_HEADER_LINE))
    rows = _matched(rows, P.MYSQL_QUERY, ["time", "thread", "command", "argument"])
    return rows.select(times.mysql_time(F.col("h.time")).alias("date_time"), F.col("h.thread").try_cast("bigint").alias("thread_id"), F.col("h.command").alias("command"), F.regexp_replace("h.argument", r"\s+$", "").alias("argument"), F.col("line").alias("raw_line"), F.col("path").alias("source_file"))


def mysql_error(lines: DataFrame) -> DataFrame:
    rows = _matched(_prepared(lines, strip=False), P.MYSQL_ERROR, ["time", "thread", "level", "code", "subsystem", "message"])
    return rows.select(times.mysql_time(F.col("h.time")).alias("date_time"), F.col("h.thread").try_cast("bigint").alias("thread_id"), F.col("h.level").alias("level"), F.col("h.code").alias("error_code"), F.col("h.subsystem").alias("subsystem"), F.trim("h.message").alias("message"), F.col("line").alias("raw_line"), F.col("path").alias("source_file"))


# Fields of an audit record's body, of its quoted message, and those the message overrides.
AUDIT_BODY = {"pid": "pid", "uid": "uid", "auid": "auid", "ses": "ses", "old_auid": "old-auid", "tty": "tty", "old_ses": "old-ses", "body_res": "res"}
AUDIT_MESSAGE = ["grantors", "acct", "exe", "hostname", "addr", "terminal"]
AUDIT_COLUMNS = "type date_time sequence pid uid auid ses old_auid tty old_ses body_res proctitle op subj grantors acct exe hostname addr terminal cmd cwd unit comm msg_res raw_line".split()


def audit(lines: DataFrame, zone: str = times.EPOCH_ZONE) -> DataFrame:
    """Audit records; every line is kept, one without a stamp with sequence 0.

    The header is what stands before the second colon. A quoted message's own fields win over the body's.
    """
    rows = _prepared(lines, strip=False)
    line = F.col("line")
    rows = rows.withColumns({"head": F.substring_index(line, ":", 2), "rest": F.expr("substring(line, length(substring_index(line, ':', 2)) + 2)")})
    rows = rows.withColumn("parts", F.split(F.trim("rest"), "msg='"))
    rows = rows.withColumns({"body": F.get("parts", F.lit(0)), "msg": F.when(F.size("parts") > 1, F.replace(F.get("parts", F.lit(1)), F.lit("'"), F.lit("")))})
    rows = rows.withColumns({"of_head": fields_of(F.col("head")), "of_body": fields_of(F.col("body")), "of_msg": fields_of(F.col("msg"))})
    # Without a second colon the head is the whole line.
    stamp = field_in(F.col("of_head"), "msg")
    rows = rows.withColumn("at", with_groups(stamp, rf"(?s)^.*?{P.AUDIT_STAMP}.*$", 2, lambda ok, g: F.struct(g(1).alias("stamp"), g(2).alias("seq"))))
    of = lambda name: field_in(F.col("of_body"), name)
    in_message = lambda name: F.when(F.col("msg").isNull(), F.lit("")).otherwise(field_in(F.col("of_msg"), name))
    inner = lambda name: field_in(F.when(F.col("msg").isNull(), F.col("of_body")).otherwise(F.col("of_msg")), name)
    own = {c: of(name) for c, name in AUDIT_BODY.items()} | {c: in_message(c) for c in AUDIT_MESSAGE}
    own |= {"type": field_in(F.col("of_head"), "type"), "date_time": F.when(F.col("at.stamp") == "", "").otherwise(F.coalesce(times.epoch_time(F.col("at.stamp").try_cast("decimal(20,6)"), zone), F.lit(""))), "sequence": F.coalesce(F.col("at.seq").try_cast("bigint"), F.lit(0)).cast("bigint")}
    own |= {"proctitle": hex_text(of("proctitle")), "subj": of("subj"), "op": inner("op"), "cwd": inner("cwd"), "unit": inner("unit"), "comm": inner("comm")}
    own |= {"cmd": F.when(F.col("msg").isNull(), of("cmd")).otherwise(hex_text(in_message("cmd"))), "msg_res": in_message("res")}
    own |= {"raw_line": line}
    return rows.select(*(own[c].alias(c) for c in AUDIT_COLUMNS), F.col("path").alias("source_file"))


def shell_history(files: DataFrame, zone: str = times.EPOCH_ZONE) -> DataFrame:
    """Commands of history files given whole: (path, content). The file's name tells the shell, its folder the user.

    In bash files `#seconds` is the time of the next line; a blank line takes it back. zsh lines may carry their own.
    One file is one row, as histories are small and their order matters.
    """
    lines = files.select("path", F.posexplode(F.split(valid_utf8(F.col("content").cast("string")), r"\r\n|\r|\n")).alias("place", "line"))
    return history_lines(lines, zone)


def history_lines(lines: DataFrame, zone: str = times.EPOCH_ZONE) -> DataFrame:
    """As `shell_history`, from (path, place, line)."""
    from pyspark.sql import Window

    in_file = Window.partitionBy("path").orderBy("place")
    is_zsh = F.element_at(F.split("path", "/"), -1).isin(".zsh_history", ".zsh_history.gz")
    marker = ~is_zsh & F.col("line").rlike(r"^#\d+$")
    before = F.lag("line").over(in_file)
    stamp = F.when(before.rlike(r"^#\d+$"), F.substring(before, 2, 1 << 20))
    rows = lines.withColumns({"is_zsh": is_zsh, "marker": marker, "stamp": F.when(is_zsh, F.lit(None)).otherwise(stamp)})
    rows = rows.filter((F.col("line") != "") & ~F.col("marker")).withColumn("z", F.when(F.col("is_zsh"), extract(F.col("line"), P.ZSH_EXTENDED, ["at", "took", "command"])))
    extended = F.coalesce("z.ok", F.lit(False))
    seconds = F.when(extended, F.col("z.at")).otherwise(F.col("stamp")).try_cast("decimal(14,0)")
    user = F.coalesce(F.get(F.split("path", "/"), F.size(F.split("path", "/")) - 2), F.lit(""))
    return rows.select(
        F.coalesce(times.epoch_time(seconds, zone), F.lit("")).alias("timestamp"), user.alias("user"), F.when(F.col("is_zsh"), "zsh").otherwise("bash").alias("shell"), F.col("path").alias("source_file"),
        F.row_number().over(in_file).alias("seq"), F.when(extended, F.col("z.command")).otherwise(F.col("line")).alias("command"), F.col("line").alias("raw_line"),
    )
