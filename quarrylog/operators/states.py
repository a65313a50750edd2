"""Partial aggregates of a table's runs that add up: totals, time ranges, value counts and distinct sets.

A state is a row (kind, name, val, cnt, and the first and last time among the rows that it counts). Kinds: `total`, all rows;
`count`, the rows that fulfil a dashboard's condition; `list`, the rows by value of a top list; `set`, the rows by value of a
column whose distinct values are counted. Everything is exact: states of several runs merge by sums, least and greatest times,
and sets by their values, so what they give equals the same figures over all rows. Their size follows the distinct values of
the counted columns, not the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylog.operators import dashboards
from quarrylog.operators.dashboards import BREAKDOWN_ROWS, Dashboard, Top, key_columns
from quarrylog.operators.filters import time_column

STATE = "kind string, name string, val string, cnt bigint, first_dt string, last_dt string, first_stamped string, last_stamped string"
#: The set of a table's files.
FILES = "file_count"


def _lists(board: Dashboard) -> dict[str, Top]:
    """The top lists of a dashboard; for one that breaks key columns down, a list for each of them."""
    tops = {n: t for n, t in board.specs.items() if isinstance(t, Top)}
    if "breakdowns" in board.specs:
        tops |= {c: Top(c, BREAKDOWN_ROWS, F.col(c).cast("string") != "") for c in key_columns(board.df.columns)}
    return tops


def of_rows(name: str, df: DataFrame) -> DataFrame:
    """The states of a table's rows, in one pass with one partial aggregation."""
    board = dashboards.of_table(name, df)
    time = time_column(df)
    state = lambda kind, key, val=None: F.struct(F.lit(kind).alias("kind"), F.lit(key).alias("name"), F.lit(None).cast("string").alias("val") if val is None else F.col(val).cast("string").alias("val"))
    seen: list[Column] = [state("total", "total")]
    seen += [F.when(condition, state("count", n)) for n, condition in board.counts.items()]
    sets = board.distinct | ({FILES: "source_file"} if "source_file" in df.columns else {})
    seen += [state("set", n, c) for n, c in sets.items()]
    seen += [state("list", n, t.key) if t.where is None else F.when(t.where, state("list", n, t.key)) for n, t in _lists(board).items()]
    at = F.col(time) if time else F.lit(None).cast("string")
    rows = df.select(at.alias("at"), F.explode(F.array_compact(F.array(*seen))).alias("s")).select("s.*", "at")
    stamped = F.nullif(F.col("at"), F.lit(""))
    times = [F.min("at").alias("first_dt"), F.max("at").alias("last_dt"), F.min(stamped).alias("first_stamped"), F.max(stamped).alias("last_stamped")]
    return rows.groupBy("kind", "name", "val").agg(F.count("*").alias("cnt"), *times)


def merged(states: DataFrame) -> DataFrame:
    """One state for each kind, name and value."""
    return states.groupBy("kind", "name", "val").agg(F.sum("cnt").alias("cnt"), F.min("first_dt").alias("first_dt"), F.max("last_dt").alias("last_dt"), F.min("first_stamped").alias("first_stamped"), F.max("last_stamped").alias("last_stamped"))


def _rows(of: Column) -> Column:
    return F.coalesce(F.sum(F.when(of, F.col("cnt"))), F.lit(0))


def _is_total() -> Column:
    return F.col("kind") == "total"


def _distinct(name: str) -> Column:
    return F.count_distinct(F.when((F.col("kind") == "set") & (F.col("name") == name), F.col("val")))


def total(states: DataFrame) -> DataFrame:
    """(total) of a table."""
    return states.agg(_rows(_is_total()).alias("total"))


def date_range(states: DataFrame) -> DataFrame:
    """(first_day, last_day), null for tables without time or rows."""
    day = lambda f, c: F.substring(f(F.when(_is_total(), F.col(c))), 1, 10)
    return states.agg(day(F.min, "first_stamped").alias("first_day"), day(F.max, "last_stamped").alias("last_day"))


def summary(states: DataFrame) -> DataFrame:
    """(first_dt, last_dt, total, file_count) of a table."""
    mine = lambda c: F.when(_is_total(), F.col(c))
    return states.agg(F.min(mine("first_dt")).alias("first_dt"), F.max(mine("last_dt")).alias("last_dt"), _rows(_is_total()).alias("total"), _distinct(FILES).alias("file_count"))


def scalars(board: Dashboard, states: DataFrame) -> DataFrame:
    """The scalar figures of a dashboard, as `board.scalars` gives them over rows."""
    mine = lambda c: F.when(_is_total(), F.col(c))
    ends = [F.min(mine("first_dt")).alias("first_dt"), F.max(mine("last_dt")).alias("last_dt")]
    if "breakdowns" in board.specs or "scan_limited" in board.scalars.columns:
        return states.agg(*ends, F.lit(False).alias("scan_limited"))
    counts = [_rows((F.col("kind") == "count") & (F.col("name") == n)).alias(n) for n in board.counts]
    return states.agg(_rows(_is_total()).alias("total"), *ends, *(_distinct(n).alias(n) for n in board.distinct), *counts)


def lists(board: Dashboard, states: DataFrame) -> dict[str, DataFrame]:
    """The top lists of a dashboard by name."""
    out = {}
    for name, t in _lists(board).items():
        shown = t.name or t.key
        own = states.filter((F.col("kind") == "list") & (F.col("name") == name)).groupBy(F.col("val").cast(board.df.schema[t.key].dataType).alias(shown)).agg(F.sum("cnt").alias("cnt"))
        out[name] = own.orderBy(F.desc("cnt"), F.asc_nulls_first(shown)).limit(t.n) if t.n else own
    return out


def payload(board: Dashboard, states: DataFrame) -> DataFrame:
    """One row with the JSON document that `board.payload()` gives over all rows."""
    tops = {n: t for n, t in board.specs.items() if isinstance(t, Top)}
    out = scalars(board, states)
    names = list(out.columns)
    counted = states.filter("kind = 'list'").groupBy("name", "val").agg(F.sum("cnt").alias("cnt"))
    if tops:
        index = F.create_map(*(F.lit(x) for i, n in enumerate(tops) for x in (n, i)))
        out = out.join(board.ranked(counted.select(index[F.col("name")].alias("list"), "val", "cnt")))
    if "breakdowns" in board.specs:
        out = out.join(dashboards.in_order(dashboards.most_frequent(counted.select(F.col("name").alias("column_name"), "val", "cnt")), "breakdowns"))
    return out.select(F.to_json(F.struct(*names, *board.specs)).alias("payload"))
