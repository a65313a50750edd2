"""Pages by key in place of offset: a page starts behind the last row shown, so that page 10,000 costs what page 1 does.

Rows are ordered by the column asked for (ascending with nulls first, descending with nulls last), then by the time, the tie
columns and all others, so rows of equal keys are equal rows. A cursor is the last row's key and how many rows of that key were
shown. To jump to a page, anchors tell the key at least every so many ranks; they are made by one sort over range partitions. The
scan is narrowed by a plain comparison with the first key column, which reaches the files' statistics.

Cases: null values in keys, repeated rows over a page's border, empty tables, cursors behind the last row (no rows).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from quarrylog.operators import filters
from quarrylog.operators.views import PAGE_ROWS

#: Ranks between two anchors.
EVERY = 100 * PAGE_ROWS
TIES = ("id", "source_file", "raw_line")


@dataclass(frozen=True)
class Order:
    """Key columns; only the first may be descending."""

    columns: tuple[str, ...]
    descending: bool = False

    def sorting(self) -> list[Column]:
        first, *rest = self.columns
        return [F.desc_nulls_last(first) if self.descending else F.asc_nulls_first(first), *map(F.asc_nulls_first, rest)]


@dataclass(frozen=True)
class Cursor:
    """Behind `shown` rows of the key (`values` in the order's columns)."""

    values: tuple
    shown: int


def order_of(df: DataFrame, sort: str | None = None, descending: bool = False, ties: tuple[str, ...] = TIES) -> Order:
    by = sort if sort in df.columns else filters.time_column(df)
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    names = [by, *ties, *df.columns] if by else [*ties, *df.columns]
    return Order(tuple(dict.fromkeys(c for c in names if kinds.get(c, "map") not in ("map", "variant"))), bool(descending and by == sort))


def from_key(order: Order, values: tuple) -> Column:
    """Rows at or behind a key."""
    equal, steps = F.lit(True), []
    for i, (name, value) in enumerate(zip(order.columns, values, strict=True)):
        column = F.col(name)
        if i == 0 and order.descending:
            behind = F.lit(False) if value is None else column.isNull() | (column < F.lit(value))
        else:
            behind = column.isNotNull() if value is None else column > F.lit(value)
        steps.append(equal & F.coalesce(behind, F.lit(False)))
        equal = equal & column.eqNullSafe(F.lit(value))
    condition = reduce(Column.__or__, steps, equal)
    first, value = F.col(order.columns[0]), values[0]
    if value is not None:  # what files' statistics can tell
        condition = condition & (first.isNull() | (first <= F.lit(value)) if order.descending else first >= F.lit(value))
    elif order.descending:
        condition = condition & first.isNull()
    return condition


def page_from(df: DataFrame, order: Order, cursor: Cursor | None = None, size: int = PAGE_ROWS) -> DataFrame:
    """The page behind a cursor, or the first one."""
    if cursor is None:
        return df.orderBy(*order.sorting()).limit(size)
    rows = df.filter(from_key(order, cursor.values)).orderBy(*order.sorting())
    return (rows.offset(cursor.shown) if cursor.shown else rows).limit(size)


def cursor_behind(order: Order, rows: list[Row], before: Cursor | None = None) -> Cursor | None:
    """The cursor behind a page's collected rows; the one before it if there are none."""
    if not rows:
        return before
    keys = [tuple(r[c] for c in order.columns) for r in rows]
    shown = next((i for i, k in enumerate(reversed(keys)) if k != keys[-1]), len(keys))
    return Cursor(keys[-1], shown + (before.shown if before and shown == len(keys) and before.values == keys[-1] else 0))


def anchors(df: DataFrame, order: Order, every: int = EVERY) -> DataFrame:
    """(rank, shown, *key columns) of rows at most `every` ranks apart, ranks from 0; shown: rows of the same key before it.

    Key columns are dealt out by ranges and numbered within them; equal keys lie in one range. What is then added up over
    ranges is one row for each.
    """
    keys = df.select(*order.columns).repartitionByRange(*order.sorting()).withColumn("_range", F.spark_partition_id())
    within = Window.partitionBy("_range").orderBy(*order.sorting())
    numbered = keys.withColumns({"_place": F.row_number().over(within) - 1, "_first": F.rank().over(within) - 1})
    key = F.struct("_place", (F.col("_place") - F.col("_first")).alias("shown"), *order.columns)
    # Of each range its size and, as a range's own offset isn't known yet, the rows at every `every`-th place of it: from there on
    # the ranks asked for are less than `every` rows away, so these are the anchors, at ranks of their own.
    ranges = numbered.groupBy("_range").agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("_place") % every == 0, key)).alias("ks"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranges.withColumn("_before", before).select("_before", F.explode("ks").alias("k"))
    return placed.select((F.col("_before") + F.col("k._place")).alias("rank"), "k.shown", *(F.col("k")[c].alias(c) for c in order.columns))


def page_at(df: DataFrame, order: Order, found: DataFrame | list[Row], number: int, size: int = PAGE_ROWS) -> DataFrame:
    """The page of a number, from the last anchor before it."""
    rank = number * size
    at = found.filter(F.col("rank") <= rank).orderBy(F.desc("rank")).limit(1).collect() if isinstance(found, DataFrame) else sorted((r for r in found if r["rank"] <= rank), key=lambda r: -r["rank"])[:1]
    if not at:
        return df.limit(0)
    return page_from(df, order, Cursor(tuple(at[0][c] for c in order.columns), at[0]["shown"] + rank - at[0]["rank"]), size)
