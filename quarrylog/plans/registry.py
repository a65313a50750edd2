"""Log types: where their files lie, how they are read and what their tables look like."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from fnmatch import fnmatch

from pyspark.sql import DataFrame

from quarrylog.operators import lines


@dataclass(frozen=True)
class LogType:
    name: str
    globs: tuple[str, ...]
    columns: str  # DDL of the table, without the source and partition columns
    parse: Callable[[DataFrame], DataFrame] | None
    kind: str = "lines"  # lines, detected (lines whose header is found by file), whole, utmp, journal
    excludes: tuple[str, ...] = ()

    def takes(self, path: str) -> bool:
        """Whether a file belongs here by its path; compressed files go by the name without .gz."""
        folded = path.replace("\\", "/").lower()
        if any(part in folded for part in self.excludes):
            return False
        name = path.replace("\\", "/").rsplit("/", 1)[-1]
        return any(fnmatch(name, g) or fnmatch(name, g + ".gz") for g in self.globs)


def _strings(names: str) -> str:
    return ", ".join(f"{n} string" for n in names.split())


_WEB_ERROR = "date_time string, level string, module string, pid int, client_ip string, message string, raw_line string"
UTMP_COLUMNS = "ut_type int, type_name string, timestamp string, pid int, line string, ut_id string, user string, host string, src_ip string, session int, exit_term int, exit_code int"
JOURNAL_COLUMNS = _strings("timestamp seqnum boot_id machine_id hostname priority transport identifier facility message pid uid gid comm exe cmdline unit slice cgroup kernel_sub kernel_dev extra")

# Log types in order of precedence with their file names and columns.
LOG_TYPES = [
    LogType("audit", ("audit.log*",), _strings("type date_time") + ", sequence bigint, " + _strings("pid uid auid ses old_auid tty old_ses body_res proctitle op subj grantors acct exe hostname addr terminal cmd cwd unit comm msg_res raw_line"), lines.audit),
    LogType("authlog", ("auth.log*", "secure", "secure-*"), _strings("date_time hostname service pid event_type user src_ip port detail raw_line"), lines.authlog, "detected"),
    LogType("wtmp", ("wtmp", "wtmp.[0-9]*", "wtmp-*"), UTMP_COLUMNS, None, "utmp"),
    LogType("btmp", ("btmp", "btmp.[0-9]*", "btmp-*"), UTMP_COLUMNS, None, "utmp"),
    LogType("journal", ("*.journal",), JOURNAL_COLUMNS, None, "journal"),
    LogType("cron", ("cron", "cron-*", "cron.log", "cron.log.[0-9]*"), _strings("timestamp hostname process pid event_type user command detail message raw_line"), lines.cron, "detected"),
    LogType("shell_history", (".bash_history", ".zsh_history"), _strings("timestamp user shell") + ", seq int, command string, raw_line string", lines.shell_history, "whole"),
    LogType("syslog", ("syslog", "syslog.[0-9]*", "messages", "messages-*"), _strings("timestamp hostname service pid message raw_line"), lines.syslog, "detected"),
    LogType("apache2", ("*access.log*", "*access_log*"), _strings("date_time vhost src_ip method uri protocol") + ", status int, bytes_sent bigint, " + _strings("referer user_agent raw_line"), lines.apache2, excludes=("/nginx/",)),
    LogType("apache2_error", ("*error.log*", "*error_log*"), _WEB_ERROR, lines.apache2_error, excludes=("/nginx/",)),
    LogType("nginx", ("access.log*", "access_log*"), _strings("date_time src_ip method uri protocol") + ", status int, bytes_sent bigint, " + _strings("referer user_agent xff raw_line"), lines.nginx, excludes=("/apache2/", "/httpd/")),
    LogType("nginx_error", ("error.log*", "error_log*"), _WEB_ERROR.replace("module string, pid int", "pid int, tid int, cid int"), lines.nginx_error, excludes=("/apache2/", "/httpd/")),
    LogType("kernlog", ("kern.log*",), _strings("date_time hostname pid message raw_line"), lines.kernlog),
    LogType("mysql_query", ("query.log*",), "date_time string, thread_id bigint, command string, argument string, raw_line string", lines.mysql_query),
    LogType("mysql_error", ("error.log*",), "date_time string, thread_id bigint, level string, error_code string, subsystem string, message string, raw_line string", lines.mysql_error),
]
BY_NAME = {t.name: t for t in LOG_TYPES}


def types_of(path: str) -> list[LogType]:
    """Log types whose names a file's path fits, in order of precedence."""
    return [t for t in LOG_TYPES if t.takes(path)]
