"""Time texts: every log's own notation to 'yyyy-MM-dd HH:mm:ss.SSS', wall time as logged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylog.functions.patterns import ACCESS_TIME, APACHE_ERROR_TIME, MONTHS, MYSQL_TIME
from quarrylog.functions.text import with_groups

#: Zone that epoch times are shown in.
EPOCH_ZONE = "Asia/Seoul"


def month_number(name: Column) -> Column:
    """1 to 12, null for anything that is no month's name."""
    at = F.array_position(F.array(*map(F.lit, MONTHS)), name)
    return F.when(at > 0, at).cast("int")


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def inferred_year(month: Column, mtime: Column) -> Column:
    """Year of a line without one: its file's, or the year before for November and December in a file of January or February."""
    stamp = F.coalesce(mtime, F.current_timestamp())
    return F.year(stamp) - F.when((month >= 11) & (F.month(stamp) <= 2) & mtime.isNotNull(), 1).otherwise(0)


def bsd_time(month: Column, day: Column, clock: Column, mtime: Column) -> Column:
    """Mon D HH:MM:SS and the file's time; an unknown month counts as January."""
    number = F.coalesce(month_number(month), F.lit(1))
    day = F.lpad(day.cast("int").cast("string"), 2, "0")
    return F.concat(inferred_year(number, mtime).cast("string"), F.lit("-"), _two(number), F.lit("-"), day, F.lit(" "), clock, F.lit(".000"))


def iso_time(stamp: Column) -> Column:
    """yyyy-mm-ddTHH:MM:SS[.fraction][offset]: the offset is dropped, the fraction cut or filled to three digits."""
    rest = F.substring(stamp, 12, 1 << 20)
    fraction = F.when(F.substring(rest, 9, 1) == ".", F.rpad(F.substring(rest, 10, 3), 3, "0")).otherwise("000")
    return F.concat(F.substring(stamp, 1, 10), F.lit(" "), F.substring(rest, 1, 8), F.lit("."), fraction)


def epoch_time(seconds: Column, zone: str = EPOCH_ZONE) -> Column:
    """Decimal seconds since the epoch, in the zone."""
    micros = (seconds.cast("decimal(20,6)") * 1000000).cast("bigint")
    return F.date_format(F.from_utc_timestamp(F.timestamp_micros(micros), zone), "yyyy-MM-dd HH:mm:ss.SSS")


def access_time(raw: Column) -> Column:
    """dd/Mon/yyyy:HH:MM:SS zone; anything else as it is; an unknown month is 00."""
    month = lambda name: F.coalesce(_two(month_number(name)), F.lit("00"))
    return with_groups(raw, ACCESS_TIME, 4, lambda ok, g: F.when(ok, F.concat(g(3), F.lit("-"), month(g(2)), F.lit("-"), g(1), F.lit(" "), g(4), F.lit(".000"))).otherwise(raw))


def apache_error_time(raw: Column) -> Column:
    month = lambda name: F.coalesce(_two(month_number(name)), F.lit("00"))
    return with_groups(raw, APACHE_ERROR_TIME, 4, lambda ok, g: F.when(ok, F.concat(g(4), F.lit("-"), month(g(1)), F.lit("-"), F.lpad(g(2), 2, "0"), F.lit(" "), g(3), F.lit(".000"))).otherwise(raw))


def nginx_error_time(raw: Column) -> Column:
    return F.concat(F.translate(raw, "/", "-"), F.lit(".000"))


def mysql_time(raw: Column) -> Column:
    return with_groups(raw, MYSQL_TIME, 3, lambda ok, g: F.when(ok, F.concat(g(1), F.lit(" "), g(2), F.lit("."), F.rpad(F.substring(g(3), 1, 3), 3, "0"))).otherwise(raw))


def event_ts(text: Column) -> Column:
    """Time texts as timestamps without zone; null for what is none."""
    return F.try_to_timestamp(F.substring(text, 1, 23), F.lit("yyyy-MM-dd HH:mm:ss.SSS")).cast("timestamp_ntz")


def event_date(text: Column) -> Column:
    """Partition column of a table: the day of the time text, null where it is none."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10).try_cast("date"))
