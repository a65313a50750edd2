"""Table pages, ranges, counts and the search over all tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylog.operators import filters

PAGE_ROWS = 100
SEARCH_ROWS = 20


@dataclass
class Page:
    """Rows of a page; the total is counted when asked for, and kept by the filter it belongs to."""

    rows: DataFrame
    matching: DataFrame
    columns: list[str]
    _total: list[int] = field(default_factory=list)

    @property
    def total(self) -> int:
        if not self._total:
            self._total.append(self.matching.count())
        return self._total[0]

    def bounds(self, number: int, size: int = PAGE_ROWS) -> tuple[int, int, int]:
        """Number of pages (1 at least), and the first and last row shown, from 1."""
        pages = max(1, -(-self.total // size))
        return pages, min(self.total, number * size + 1), min(self.total, (number + 1) * size)


def ordered(df: DataFrame, sort: str | None = None, descending: bool = False, ties: tuple[str, ...] = ()) -> DataFrame:
    """By the column asked for, else by the time column; ties by the given columns, so that pages don't overlap."""
    by = sort if sort in df.columns else filters.time_column(df)
    keys = [F.desc(by) if descending and by == sort else F.asc(by)] if by else []
    keys += [F.asc(c) for c in ties if c in df.columns and c != by]
    return df.orderBy(*keys) if keys else df


def page(df: DataFrame, number: int = 0, size: int = PAGE_ROWS, sort: str | None = None, descending: bool = False, ties: tuple[str, ...] = ("id", "source_file", "raw_line"), **options) -> Page:
    matching = filters.filtered(df, **options)
    rows = ordered(matching, sort, descending, ties).offset(number * size).limit(size) if number else ordered(matching, sort, descending, ties).limit(size)
    return Page(rows, matching, df.columns)


def date_range(df: DataFrame) -> DataFrame:
    """(first_day, last_day), null for tables without time or rows."""
    name = filters.time_column(df)
    if name is None:
        return df.sparkSession.createDataFrame([(None, None)], "first_day string, last_day string")
    stamped = df.filter(F.col(name) != "")
    return stamped.agg(F.substring(F.min(name), 1, 10).alias("first_day"), F.substring(F.max(name), 1, 10).alias("last_day"))


def _least(rows: DataFrame, n: int) -> DataFrame:
    """(total, rows): the number of rows and the n least of their column `row`, in one pass; a task keeps n of its rows."""
    from heapq import nsmallest

    import pandas as pd

    def held(batches):  # noqa: ANN001, ANN202
        total, least = 0, []
        for batch in batches:
            total += len(batch)
            least = nsmallest(n, [*least, *batch["row"]], key=lambda r: r.encode())
        yield pd.DataFrame({"total": [total], "rows": [least]})

    of_tasks = rows.mapInPandas(held, "total bigint, rows array<string>")
    return of_tasks.agg(F.sum("total").alias("total"), F.slice(F.array_sort(F.flatten(F.collect_list("rows"))), 1, n).alias("rows"))


def global_search(tables: dict[str, DataFrame], query: str, rows: int = SEARCH_ROWS) -> DataFrame:
    """(table_name, total, place, row): of each table with a match its number of matches and its first rows as JSON.

    One scan a table. Nothing for a query without terms, or without tables.
    """
    parts = [SparkSession.active().createDataFrame([], "table_name string, total bigint, place int, row string")]
    for name, df in sorted(tables.items()):
        condition = filters.on_any([F.col(c) for c in df.columns], query)
        if condition is None:
            continue
        found = _least(df.filter(condition).select(F.to_json(F.struct(*df.columns)).alias("row")), rows)
        parts.append(found.filter("total > 0").select(F.lit(name).alias("table_name"), "total", F.posexplode("rows").alias("place", "row")))
    return reduce(DataFrame.unionByName, parts)
