"""Dashboards: overviews, filtered counts and top lists of a table.

All scalar figures of a dashboard come from one aggregation. Top lists are group counts; ties are broken by the key, so
that every list is well defined.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylog.operators.filters import like, time_column


def top(df: DataFrame, key: str, n: int | None = None, where: Column | None = None, name: str | None = None) -> DataFrame:
    """(name or key, cnt): the n most frequent values, or all."""
    df = df if where is None else df.filter(where)
    out = df.groupBy(F.col(key).alias(name or key)).agg(F.count("*").alias("cnt"))
    return out.orderBy(F.desc("cnt"), F.asc_nulls_first(name or key)).limit(n) if n else out


def overview(df: DataFrame, distinct: dict[str, str]) -> list[Column]:
    """Aggregates of an overview: rows, first and last time, and distinct values by result name."""
    time = time_column(df)
    return [F.count("*").alias("total"), F.min(time).alias("first_dt"), F.max(time).alias("last_dt"), *(F.countDistinct(c).alias(n) for n, c in distinct.items())]


def _counts(conditions: dict[str, Column]) -> list[Column]:
    return [F.coalesce(F.count_if(c), F.lit(0)).alias(n) for n, c in conditions.items()]


class Top(NamedTuple):
    """A list of a column's most frequent values (n of them, or all) among the rows that fulfil a condition."""

    key: str
    n: int | None = None
    where: Column | None = None
    name: str | None = None


class Dashboard:
    """What a table's dashboard shows: `scalars` is one row, `lists` are tables by name."""

    def __init__(self, df: DataFrame, distinct: dict[str, str], counts: dict[str, Column], lists: dict[str, Top | DataFrame], scalars: list[Column] | None = None):
        """distinct and counts: the columns whose values and the conditions whose rows are counted, by result name; scalars in their place."""
        self.df, self.distinct, self.counts, self.specs = df, distinct, counts, lists
        self.scalars = df.agg(*(overview(df, distinct) + _counts(counts) if scalars is None else scalars))

    @property
    def lists(self) -> dict[str, DataFrame]:
        return {name: top(self.df, *spec) if isinstance(spec, Top) else spec for name, spec in self.specs.items()}

    def _tops(self) -> DataFrame | None:
        """One row with all top lists, from one pass: each row becomes one (list, value) for every list that counts it."""
        tops = [(name, spec) for name, spec in self.specs.items() if isinstance(spec, Top)]
        if not tops:
            return None
        seen = [F.struct(F.lit(i).alias("list"), F.col(t.key).cast("string").alias("val")) for i, (_, t) in enumerate(tops)]
        seen = F.array(*(x if t.where is None else F.when(t.where, x) for x, (_, t) in zip(seen, tops, strict=True)))
        return self.ranked(self.df.select(F.explode(F.array_compact(seen)).alias("p")).select("p.*").groupBy("list", "val").agg(F.count("*").alias("cnt")))

    def ranked(self, counted: DataFrame) -> DataFrame:
        """One row with all top lists, from (list, val, cnt) by the lists' numbers."""
        tops = [(name, spec) for name, spec in self.specs.items() if isinstance(spec, Top)]
        kinds = {c: self.df.schema[c].dataType for _, (c, *_) in tops}
        place = F.row_number().over(Window.partitionBy("list").orderBy(F.desc("cnt"), F.asc_nulls_first("val")))
        most = max((t.n for _, t in tops if t.n), default=1)
        whole = [i for i, (_, t) in enumerate(tops) if not t.n]  # lists of all values are few: kinds of rows
        ranked = counted.filter(~F.col("list").isin(whole)).withColumn("place", place).filter(F.col("place") <= most)
        if whole:
            ranked = ranked.unionByName(counted.filter(F.col("list").isin(whole)).withColumn("place", place))
        limits = F.create_map(*(F.lit(x) for i, (_, t) in enumerate(tops) for x in (i, t.n or 1 << 30)))
        ranked = ranked.filter(F.col("place") <= limits[F.col("list")])
        own = lambda i: F.array_sort(F.collect_list(F.when(F.col("list") == i, F.struct("place", "val", "cnt"))))
        shown = lambda i, t: F.transform(own(i), lambda x: F.struct(x["val"].cast(kinds[t.key]).alias(t.name or t.key), x["cnt"].alias("cnt")))
        return ranked.agg(*(shown(i, t).alias(name) for i, (name, t) in enumerate(tops)))

    def payload(self) -> DataFrame:
        """One row with one JSON document: the scalars and every list, in the order of its rows."""
        out = self.scalars
        tops = self._tops()
        out = out if tops is None else out.join(tops)  # one row each
        for name, table in self.specs.items():
            if isinstance(table, DataFrame):
                out = out.join(in_order(table, name))
        names = [*self.scalars.columns, *self.specs]
        return out.select(F.to_json(F.struct(*names)).alias("payload"))


def in_order(table: DataFrame, name: str) -> DataFrame:
    """One row with a table's rows as an array, those with most first, ties by the other columns."""
    keys = F.struct(-F.col("cnt"), *(c for c in table.columns if c != "cnt"))
    held = F.array_sort(F.collect_list(F.struct(keys.alias("key"), F.struct(*table.columns).alias("row"))))
    return table.agg(F.transform(held, lambda x: x["row"]).alias(name))


def audit(df: DataFrame) -> Dashboard:
    kind, addr = F.col("type"), F.col("addr")
    of = {"auth": "USER_AUTH", "login": "USER_LOGIN", "err": "USER_ERR", "start": "USER_START", "end": "USER_END", "execve": "EXECVE", "user_cmd": "USER_CMD", "avc_count": "AVC"}
    counts = {n: kind == t for n, t in of.items()} | {"fail_count": F.col("body_res") == "failed", "syscall_fail": (kind == "SYSCALL") & (F.col("body_res") == "no")}
    named = kind != ""
    peers = ~addr.isin("", "?") & ~addr.contains(":") & (addr != "0.0.0.0")
    return Dashboard(
        df, {"type_count": "type"}, counts,
        {
            "type_dist": Top("type", 20, named), "top_ips": Top("addr", 5, peers & kind.isin("USER_AUTH", "USER_LOGIN", "USER_ERR", "USER_START")),
            "top_accts": Top("acct", 5, (F.col("acct") != "") & kind.isin("USER_AUTH", "USER_LOGIN", "USER_ERR")), "top_exe": Top("exe", 5, ~F.col("exe").isin("", "?") & (kind == "SYSCALL")),
            "user_err_ip": Top("addr", 1, ~addr.isin("", "?") & (kind == "USER_ERR")), "all_types": Top("type", None, named),
        },
    )


# Successful log-ins, and what counts as an attack.
ACCEPTED = ("sshd_accepted_password", "sshd_accepted_publickey")
ATTACKS = ("sshd_failed_password", "sshd_invalid_user", "sshd_max_auth")


def auth_conditions() -> dict[str, Column]:
    kind = F.col("event_type")
    of = ("accepted_password", "accepted_publickey", "failed_password", "invalid_user", "max_auth", "session_opened")
    return {n: kind == f"sshd_{n}" for n in of} | {"sudo_count": kind == "sudo_command", "su_count": kind.isin("su_to", "su_session_opened")}


def auth_counts() -> list[Column]:
    return _counts(auth_conditions())


def authlog(df: DataFrame) -> Dashboard:
    kind, ip, user = F.col("event_type"), F.col("src_ip") != "", F.col("user") != ""
    return Dashboard(
        df, {"type_count": "event_type"}, auth_conditions(),
        {
            "event_dist": Top("event_type", 20, kind != "", "type"), "top_attack_ips": Top("src_ip", 5, ip & kind.isin(*ATTACKS)), "top_success_ips": Top("src_ip", 5, ip & kind.isin(*ACCEPTED)),
            "top_users": Top("user", 5, user & kind.isin(*ACCEPTED)), "top_fail_users": Top("user", 5, user & kind.isin(*ATTACKS[:2])),
            "top_sudo_users": Top("user", 5, user & (kind == "sudo_command")), "all_types": Top("event_type", None, kind != "", "type"),
        },
    )


# Result names and keywords of messages.
KEYWORDS = {"err_count": "error", "warn_count": "warn", "fail_count": "fail", "crit_count": "critical", "killed_count": "killed", "panic_count": "panic"}


def keyword_conditions(message: Column) -> dict[str, Column]:
    return {n: like(message, word) for n, word in KEYWORDS.items()}


def keyword_counts(message: Column) -> list[Column]:
    return _counts(keyword_conditions(message))


def syslog(df: DataFrame) -> Dashboard:
    service, message = F.col("service"), F.col("message")
    families = {"kernel_count": service == "kernel", "systemd_count": F.lower(service).startswith("systemd"), "sshd_count": service == "sshd", "sudo_count": service == "sudo", "cron_count": service.isin("cron", "CRON", "crond", "anacron"), "nm_count": service == "NetworkManager"}
    return Dashboard(
        df, {"svc_count": "service"}, keyword_conditions(message) | families,
        {"top_services": Top("service", 15, service != ""), "top_err_services": Top("service", 6, like(message, "error") & (service != "")), "all_types": Top("service", None, service != "", "type")},
    )


def status_conditions() -> dict[str, Column]:
    s = F.col("status")
    return {f"s{k}xx": (s >= 100 * k) & (s < 100 * (k + 1)) for k in (2, 3, 4, 5)}


def status_classes() -> list[Column]:
    return _counts(status_conditions())


def apache2(df: DataFrame) -> Dashboard:
    status, ip = F.col("status"), F.col("src_ip") != ""
    return Dashboard(
        df, {"ip_count": "src_ip", "uri_count": "uri"}, status_conditions(),
        {
            "status_dist": Top("status", 20), "method_dist_200": Top("method", None, (status == 200) & (F.col("method") != "")), "top_uri_200": Top("uri", 10, status == 200),
            "top_ips": Top("src_ip", 5, ip), "top_err_ips": Top("src_ip", 5, (status >= 400) & ip), "vhosts": Top("vhost", 10, F.col("vhost") != ""),
        },
    )


# Columns that a dashboard of any table breaks down, in order of preference, and those it never does.
KEY_COLUMNS = "status level severity event_type type service facility unit src_ip client_ip addr ip user acct username method vhost exe comm command terminal tty hostname log_type pid".split()
SKIPPED_COLUMNS = "id raw_line message msg uri referer user_agent cmdline args line".split()
BREAKDOWN_COLUMNS, BREAKDOWN_ROWS = 4, 8


def key_columns(columns: list[str], n: int = BREAKDOWN_COLUMNS) -> list[str]:
    return [c for c in KEY_COLUMNS if c in columns and c not in SKIPPED_COLUMNS][:n]


#: Rows beyond which the tool whose tables these match doesn't scan a table for its generic dashboard.
SCAN_LIMIT = 2_000_000


def within(df: DataFrame, rows: int = SCAN_LIMIT) -> bool:
    """Whether a table has at most so many rows, counting no further."""
    return df.limit(rows + 1).count() <= rows


def breakdown(df: DataFrame, columns: list[str] | None = None, rows: int = BREAKDOWN_ROWS) -> DataFrame:
    """(column_name, val, cnt): the most frequent values that are neither null nor empty of up to four key columns.

    One pass: each row becomes one (column, value) a key column, counted before the shuffle.
    """
    columns = key_columns(df.columns) if columns is None else columns
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("val")) for c in columns))
    return most_frequent(df.select(F.explode(pairs).alias("p")).select("p.*").filter("val <> ''").groupBy("column_name", "val").agg(F.count("*").alias("cnt")), rows)


def most_frequent(counted: DataFrame, rows: int = BREAKDOWN_ROWS) -> DataFrame:
    """Of (column_name, val, cnt) the most frequent values of each column."""
    place = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("cnt"), "val"))
    return counted.withColumn("place", place).filter(F.col("place") <= rows).drop("place")


def generic(df: DataFrame, scan_limit: int | None = None) -> Dashboard:
    """Time range and breakdowns of any table; with scan_limit neither for larger ones, which `scan_limited` tells."""
    limited = scan_limit is not None and not within(df, scan_limit)
    time = None if limited else time_column(df)
    ends = [F.min(time).alias("first_dt"), F.max(time).alias("last_dt")] if time else [F.lit(None).cast("string").alias("first_dt"), F.lit(None).cast("string").alias("last_dt")]
    return Dashboard(df, {}, {}, {"breakdowns": breakdown(df)} if key_columns(df.columns) and not limited else {}, [*ends, F.lit(limited).alias("scan_limited")])


OWN = {"audit": audit, "authlog": authlog, "syslog": syslog, "apache2": apache2}


def of_table(name: str, df: DataFrame) -> Dashboard:
    return OWN.get(name, generic)(df)
