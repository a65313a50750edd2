"""Filter language of the query surface, compiled to one boolean column.

A filter is terms parted by white space and joined by AND: `word` (contains), `!word` (contains not), `=word` (equals),
each with '...' or "..." around a term with spaces. Containment folds A-Z only and takes % and _ as wildcards; equality
is exact. A comparison with null is null, so such rows fall out, also of `!word`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylog.functions.text import ascii_lower


@dataclass(frozen=True)
class Term:
    op: str  # contains, exclude, exact
    text: str


_OPS = {"!": "exclude", "=": "exact"}


def terms(raw: str | None) -> list[Term]:
    """Terms of a filter; a lone prefix is an ordinary term, an open quote runs to the end, empty terms are left out."""
    out, rest = [], (raw or "").lstrip()
    while rest:
        op = "contains"
        if rest[0] in _OPS and len(rest) > 1 and not rest[1].isspace():
            op, rest = _OPS[rest[0]], rest[1:]
        if rest[0] in "\"'":
            text, _, rest = rest[1:].partition(rest[0])
        else:
            text = rest.split(None, 1)[0]
            rest = rest[len(text) :]
        if text:
            out.append(Term(op, text))
        rest = rest.lstrip()
    return out


def like(column: Column, term: str) -> Column:
    """Contains, A-Z folded, % and _ as wildcards and the backslash as itself."""
    folded, term = ascii_lower(column), "".join(c.lower() if "A" <= c <= "Z" else c for c in term)
    if "%" not in term and "_" not in term:
        return folded.contains(term)
    # The escape is a character that the term doesn't have, so that nothing in it is escaped.
    escape = next(c for c in "~^|`\x02\x03" if c not in term)
    return F.call_function("like", folded, F.lit(f"%{term}%"), F.lit(escape))


def _matches(column: Column, term: Term) -> Column:
    text = column.cast("string")
    if term.op == "exact":
        return text == term.text
    return ~like(text, term.text) if term.op == "exclude" else like(text, term.text)


def on_column(column: Column, raw: str | None) -> Column | None:
    """Condition on one column, None if the filter has no term."""
    found = [_matches(column, t) for t in terms(raw)]
    return reduce(Column.__and__, found) if found else None


def on_any(columns: list[Column], raw: str | None) -> Column | None:
    """Search over columns: a term in any of them, a `!term` in none."""
    found = [reduce(Column.__and__ if t.op == "exclude" else Column.__or__, [_matches(c, t) for c in columns]) for t in terms(raw)]
    return reduce(Column.__and__, found) if found else None


def time_column(df: DataFrame) -> str | None:
    return next((c for c in ("date_time", "timestamp") if c in df.columns), None)


def in_days(df: DataFrame, first: str | None, last: str | None) -> DataFrame:
    """Rows of the days first to last (yyyy-mm-dd), by text order; a partition column `event_date` is pruned alike."""
    name = time_column(df)
    if name:
        if first:
            df = df.filter(F.col(name) >= f"{first} 00:00:00")
        if last:
            df = df.filter(F.col(name) <= f"{last} 23:59:59.999")
        if "event_date" in df.columns:
            df = df.filter(F.col("event_date").isNull() | F.col("event_date").between(first or "0001-01-01", last or "9999-12-31"))
    return df


def of_types(df: DataFrame, types: list[str] | None) -> DataFrame:
    """Rows whose kind (first of type, event_type, service that the table has) is one of the given."""
    name = next((c for c in ("type", "event_type", "service") if c in df.columns), None)
    return df.filter(F.col(name).isin(types)) if types and name else df


# Named groups of kinds that the query surface offers, and keywords of messages.
GROUPS = {
    "audit": {
        "login": ["USER_LOGIN", "USER_AUTH", "USER_ACCT", "USER_ERR", "USER_START", "USER_END", "CRED_ACQ", "CRED_DISP", "CRED_REFR"], "command": ["EXECVE", "PROCTITLE", "USER_CMD"], "file": ["PATH", "CWD"],
        "service": ["SERVICE_START", "SERVICE_STOP", "DAEMON_START", "DAEMON_END", "DAEMON_ABORT", "DAEMON_CONFIG"], "security": ["AVC", "CONFIG_CHANGE", "SECCOMP", "NETFILTER_PKT", "ANOMALY_ABEND"],
    },
    "authlog": {
        "success": ["sshd_accepted_password", "sshd_accepted_publickey", "sshd_session_opened", "sshd_session_closed"], "failure": ["sshd_failed_password", "sshd_invalid_user", "sshd_max_auth", "pam_auth_failure"],
        "connection": ["sshd_conn_closed", "sshd_conn_reset", "sshd_disconnected", "sshd_no_id_string", "sshd_kex_error", "sshd_banner_exchange", "sshd_unable_negotiate"], "sudo": ["sudo_command", "sudo_auth_failure"],
        "su_cron": ["su_to", "su_session_opened", "su_session_closed", "cron_session_opened", "cron_session_closed"],
    },
    "syslog": {
        "kernel": ["kernel"], "network": ["NetworkManager", "dhclient", "dhcpcd", "wpa_supplicant", "firewalld", "nftables", "pppd", "networkd", "ifup", "ifdown"],
        "system": ["systemd", "systemd-journald", "systemd-udevd", "systemd-resolved", "systemd-logind", "systemd-networkd", "systemd-timesyncd", "init", "snapd", "dbus", "dbus-daemon"],
        "login": ["sshd", "sudo", "su", "login", "gdm", "gdm3", "lightdm", "polkitd", "pam", "useradd", "usermod", "passwd"], "cron": ["cron", "CRON", "crond", "anacron", "atd"],
    },
}
KEYWORD_FILTERS = ["error", "warn", "fail", "critical", "killed", "panic"]


def keyword(df: DataFrame, word: str) -> DataFrame:
    """Rows whose message has one of KEYWORD_FILTERS."""
    if word not in KEYWORD_FILTERS:
        raise KeyError(word)
    return df.filter(like(F.col("message"), word))


def web_group(df: DataFrame, name: str) -> DataFrame:
    """Successful requests by method: 200-GET, 200-POST, or 200-ETC for the other methods there are."""
    method = F.col("method")
    kinds = {"200-GET": method == "GET", "200-POST": method == "POST", "200-ETC": ~method.isin("GET", "POST") & (method != "")}
    return df.filter((F.col("status") == 200) & kinds[name])


def filtered(df: DataFrame, search: str | None = None, columns: dict[str, str] | None = None, first: str | None = None, last: str | None = None, types: list[str] | None = None, status: int | None = None, methods: list[str] | None = None, unequal: dict[str, str] | None = None) -> DataFrame:
    """All filters of a table view; filters on columns that the table hasn't are ignored.

    `unequal` leaves out a column's exact value, where `!word` in `columns` leaves out every text that contains the word.
    """
    shown = [c for c in df.columns if c != "event_date"]
    df = of_types(in_days(df, first, last), types)
    conditions = [on_any([F.col(c) for c in shown], search)] + [on_column(F.col(c), raw) for c, raw in (columns or {}).items() if c in shown]
    conditions += [F.col(c).cast("string") != value for c, value in (unequal or {}).items() if c in shown]
    if status is not None and "status" in df.columns:
        conditions.append(F.col("status") == status)
    if methods and "method" in df.columns:
        conditions.append(F.col("method").isin(methods))
    for c in conditions:
        df = df if c is None else df.filter(c)
    return df
