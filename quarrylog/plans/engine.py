"""The query surface over a folder of ingested tables."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylog.operators import cursors, dashboards, filters, states, views, web
from quarrylog.plans import registry
from quarrylog.plans.ingest import INFO, _table_exists, committed, info, kept_states, schema_only, searched, stored

#: Tables that the list of tables doesn't show.
HIDDEN = ("dashboard",)


def session(master: str | None = None) -> SparkSession:
    """A session with the settings that parsing relies on."""
    builder = SparkSession.builder.appName("quarrylog")
    builder = builder.master(master) if master else builder
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.sources.partitionOverwriteMode": "dynamic"}
    return builder.config(map=settings).getOrCreate()


class Engine:
    """Tables of a folder by name; a log type without files is an empty table of its columns."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._anchors: dict[tuple, list] = {}

    def table(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        if _table_exists(self.spark, path):
            if name in registry.BY_NAME:
                return stored(self.spark, self.folder, name)
            return info(self.spark, self.folder).drop("run") if name == "info" else self.spark.read.parquet(path)
        if name in registry.BY_NAME:
            return self.spark.createDataFrame([], registry.BY_NAME[name].columns + ", source_file string, event_date date")
        if name == "info":
            return self.spark.createDataFrame([], INFO)
        raise KeyError(name)

    def names(self) -> list[str]:
        known = [*registry.BY_NAME, "info", "sysinfo", "dashboard"]
        return [n for n in known if _table_exists(self.spark, f"{self.folder}/{n}")]

    def logs(self, only: list[str] | None = None) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in self.names() if n in registry.BY_NAME and (only is None or n in only)}

    def tables(self) -> DataFrame:
        """(table_name, total) of the tables shown; log tables by their kept states."""
        out = self.spark.createDataFrame([], "table_name string, total bigint")
        for n in self.names():
            if n not in HIDDEN:
                counted = states.total(self.states(n)) if n in registry.BY_NAME else self.table(n).agg(F.count("*").alias("total"))
                out = out.unionByName(counted.select(F.lit(n).alias("table_name"), "total"))
        return out

    def states(self, name: str) -> DataFrame:
        """The merged partial aggregates of a log table."""
        return kept_states(self.spark, self.folder, name)

    def log_summary(self) -> DataFrame:
        """(log, first_dt, last_dt, total, file_count) of every log table, by its kept states."""
        out = self.spark.createDataFrame([], "first_dt string, last_dt string, total bigint, file_count bigint, log string")
        for n in sorted(n for n in self.names() if n in registry.BY_NAME):
            out = out.unionByName(states.summary(self.states(n)).withColumn("log", F.lit(n)))
        return out

    def page(self, name: str, **options) -> views.Page:
        return views.page(self.table(name), **options)

    def page_at(self, name: str, number: int, size: int = views.PAGE_ROWS, sort: str | None = None, descending: bool = False, **options) -> DataFrame:
        """A page by its number, by anchors made once for the table's runs, order and filters; `page` gives the same rows by offset."""
        table = filters.filtered(self.table(name), **options)
        order = cursors.order_of(table, sort, descending)
        kind = (name, order, repr(sorted(options.items())), tuple(sorted(committed(self.spark, self.folder, name))))
        if kind not in self._anchors:
            self._anchors[kind] = cursors.anchors(table, order).collect()  # one row for some thousands
        return cursors.page_at(table, order, self._anchors[kind], number, size)

    def page_behind(self, name: str, cursor: cursors.Cursor | None = None, size: int = views.PAGE_ROWS, sort: str | None = None, descending: bool = False, **options) -> tuple[list, cursors.Cursor | None]:
        """(rows, cursor of the next page) of the page behind a cursor."""
        table = filters.filtered(self.table(name), **options)
        order = cursors.order_of(table, sort, descending)
        rows = cursors.page_from(table, order, cursor, size).collect()
        return rows, cursors.cursor_behind(order, rows, cursor)

    def date_range(self, name: str) -> DataFrame:
        return states.date_range(self.states(name)) if name in registry.BY_NAME and name in self.names() else views.date_range(self.table(name))

    def sysinfo(self) -> DataFrame:
        return self.table("sysinfo").limit(1)

    def dashboard(self, name: str, refresh: bool = False) -> DataFrame:
        """The kept document (payload, computed_at) of a table, or a new one where there is none or it is asked for."""
        if not refresh and _table_exists(self.spark, f"{self.folder}/dashboard"):
            kept = self.table("dashboard").filter(F.col("table_name") == name).select("payload", "computed_at")
            if kept.limit(1).count():
                return kept
        if name in registry.BY_NAME and name in self.names():
            fresh = states.payload(dashboards.of_table(name, schema_only(self.spark, name)), self.states(name))
        else:
            fresh = dashboards.of_table(name, self.table(name).drop("event_date")).payload()
        return fresh.withColumn("computed_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))

    def web_ips(self) -> DataFrame:
        """(ip, cnt), most frequent first."""
        return web.ips(self.logs(list(web.ADDRESS_COLUMNS))).orderBy(F.desc("cnt"), "ip")

    def web_records(self, value: str, prefix: bool = False, **options) -> views.Page:
        return web.records_page(self.logs(list(web.ADDRESS_COLUMNS)), value, prefix, **options)

    def search(self, query: str) -> DataFrame:
        """Matches of a search in all tables; of log tables only the files that may have one are read."""
        return views.global_search({n: searched(self.spark, self.folder, n, query) if n in registry.BY_NAME else self.table(n) for n in self.names()}, query)

    def register_views(self) -> None:
        for name in self.names():
            self.table(name).createOrReplaceTempView(name)


def open_folder(folder: str) -> Engine:
    if not Path(folder).is_dir():
        raise FileNotFoundError(folder)
    return Engine(session(), folder)
