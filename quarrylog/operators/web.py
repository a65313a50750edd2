"""Web logs across tables: addresses, networks and the records of an address."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylog.operators import filters
from quarrylog.operators.views import Page, ordered

# Web tables, their address columns, what their records have in common, and what is no address.
ADDRESS_COLUMNS = {"apache2": "src_ip", "nginx": "src_ip", "apache2_error": "client_ip", "nginx_error": "client_ip"}
COMMON = ["source", "date_time", "ip", "status", "method", "uri", "user_agent"]
NO_ADDRESS = ["", "-", "?", "0.0.0.0"]


def ips(tables: dict[str, DataFrame]) -> DataFrame:
    """(ip, cnt) over all web tables there are; `ip_list` orders them."""
    parts = [SparkSession.active().createDataFrame([], "ip string"), *(tables[t].select(F.col(c).alias("ip")) for t, c in ADDRESS_COLUMNS.items() if t in tables)]
    seen = reduce(DataFrame.unionByName, parts).filter(F.col("ip").isNotNull() & ~F.col("ip").isin(NO_ADDRESS))
    return seen.groupBy("ip").agg(F.count("*").alias("cnt"))


def networks(found: DataFrame, parts: int = 3) -> DataFrame:
    """(cidr, cnt, ip_count) of IPv4 addresses by their first parts: 3 for /24, 2 for /16."""
    v4 = found.filter(F.size(F.split("ip", r"\.")) == 4)
    cidr = F.concat(F.substring_index("ip", ".", parts), F.lit(".0" * (4 - parts) + f"/{8 * parts}"))
    return v4.groupBy(cidr.alias("cidr")).agg(F.sum("cnt").alias("cnt"), F.count("*").alias("ip_count"))


def ip_list(found: DataFrame, part: str = "", rows: int = 1000) -> DataFrame:
    """Addresses that have the text, most frequent first, with each one's share of the highest count in percent."""
    from pyspark.sql import Window

    found = found.filter(F.lower("ip").contains(part.strip().lower())) if part.strip() else found
    share = F.round(100 * F.col("cnt") / F.max("cnt").over(Window.partitionBy())).cast("int")
    return found.orderBy(F.desc("cnt"), "ip").limit(rows).withColumn("share", share)


def records(tables: dict[str, DataFrame], value: str, prefix: bool = False) -> DataFrame:
    """Records of an address, or of all that begin with the value, in the columns web tables have in common."""
    parts = [SparkSession.active().createDataFrame([], "source string, date_time string, ip string, status int, method string, uri string, user_agent string")]
    for name, column in ADDRESS_COLUMNS.items():
        if name in tables:
            t = tables[name]
            own = t.filter(filters.ascii_lower(F.col(column)).startswith(value.lower()) if prefix else F.col(column) == value)
            has = lambda c: F.col(c) if c in t.columns else F.lit(None)  # noqa: B023, E731
            parts.append(own.select(F.lit(name).alias("source"), F.col("date_time"), F.col(column).alias("ip"), has("status").cast("int").alias("status"), *(has(c).cast("string").alias(c) for c in COMMON[4:])))
    return reduce(DataFrame.unionByName, parts)


def records_page(tables: dict[str, DataFrame], value: str, prefix: bool = False, number: int = 0, size: int = 100, sort: str | None = None, descending: bool = False, search: str | None = None, columns: dict[str, str] | None = None) -> Page:
    matching = filters.filtered(records(tables, value, prefix), search=search, columns=columns)
    rows = ordered(matching, sort, descending, ties=tuple(COMMON))
    return Page((rows.offset(number * size) if number else rows).limit(size), matching, COMMON)
