"""From a folder of collected files to parquet tables.

    python -m quarrylog.plans.ingest --target FOLDER --output TABLES [--strict]

Beside its rows a run writes their states (see `operators.states`), so totals, ranges, summaries and dashboards are merged from the
states of the committed runs and no log rows are read again.

A file is identified by the digest of its bytes: one that `info` already has is left out, of several equal ones the
first by type precedence and path counts. Between log types whose names a file fits its first lines decide. Each log type's
files are written in one job below the run's id; `info`, written afterwards, is the commit record: rows of a run and type
that it doesn't name are not read, so a stop between the two leaves nothing behind that counts. A damaged file is left out,
reported and not recorded; where a type's write fails, its files are tried one by one and the readable ones written.
"""

from __future__ import annotations

import argparse
import logging
import uuid
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylog.functions.times import event_date
from quarrylog.operators import dashboards, lines, skipindex, states, sysinfo
from quarrylog.plans import registry
from quarrylog.sources import files
from quarrylog.sources.journal import JournalDataSource
from quarrylog.sources.utmp import UtmpDataSource

log = logging.getLogger(__name__)

INFO = "file_name string, file_path string, md5 string, file_size bigint, log_type string, parsed_at string"

#: Folders of the states and of the skip index.
STATES, SEARCHED = "states", "searched"

#: Columns that rows are looked up by: files are sorted by them, in this order, and have Bloom filters of them.
LOOKED_UP = ("src_ip", "client_ip", "user")

# What differs from the tool whose results these tables match; `strict` gives its own ways where it can.
DEVIATIONS = {
    "addresses": "login addresses are unsigned, so any IPv4 address is read",
    "bytes": "a size that is no number counts as 0 and doesn't end the file",
    "routing": "the first lines decide between types of equal names (strict: precedence alone)",
    "members": "all members of an archive are read (strict: the first)",
    "atomic": "a type's rows count once its files are recorded; damaged files are left out whole",
    "sysinfo": "dumps are looked for below the given folder",
}


@dataclass
class Result:
    written: dict[str, int]
    failed: dict[str, str]
    damaged: dict[str, str] = field(default_factory=dict)  # path: what is wrong with it


def _table_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def info(spark: SparkSession, output: str) -> DataFrame:
    """The files that have been read, with the run that wrote their rows."""
    return spark.read.schema(f"{INFO}, run string").parquet(f"{output}/info")


def committed(spark: SparkSession, output: str, name: str) -> list[str]:
    """The runs of a log type that `info` records."""
    return [r["run"] for r in info(spark, output).filter(F.col("log_type") == name).select("run").distinct().collect()] if _table_exists(spark, f"{output}/info") else []


def rows_of(spark: SparkSession, output: str, name: str, runs: list[str]) -> DataFrame:
    """The rows of some runs; the schema is the log type's, so a folder without rows or of older files reads as well."""
    table = spark.read.schema(f"{registry.BY_NAME[name].columns}, source_file string, run string, event_date date").parquet(f"{output}/{name}")
    return table.filter(F.col("run").isin(runs)).drop("run")  # whole folders


def stored(spark: SparkSession, output: str, name: str) -> DataFrame:
    """A table as committed."""
    return rows_of(spark, output, name, committed(spark, output, name))


def searched(spark: SparkSession, output: str, name: str, raw: str | None) -> DataFrame:
    """A table as committed, without the files that the skip index knows to have no match of a search."""
    runs, path = committed(spark, output, name), f"{output}/{name}"
    whole = stored(spark, output, name)
    if not skipindex.needed(raw) or not _table_exists(spark, f"{output}/{SEARCHED}"):
        return whole
    index = spark.read.schema(f"{skipindex.INDEX}, log_type string, run string").parquet(f"{output}/{SEARCHED}").filter((F.col("log_type") == name) & F.col("run").isin(runs))
    without = sorted(set(runs) - {r["run"] for r in index.select("run").distinct().collect()})
    files_ = [r["file"] for r in skipindex.may_match(index, raw).collect()]  # names of files, no contents
    parts = [rows_of(spark, output, name, without)] if without else []
    if files_:
        schema = f"{registry.BY_NAME[name].columns}, source_file string, run string, event_date date"
        parts.append(spark.read.schema(schema).option("basePath", path).parquet(*files_).drop("run"))
    return (parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]) if parts else whole.limit(0)


def kept_states(spark: SparkSession, output: str, name: str) -> DataFrame:
    """The merged states of a table's committed runs; those of a run written without any are computed from its rows."""
    runs = committed(spark, output, name)
    kept = spark.createDataFrame([], f"{states.STATE}, run string")
    if _table_exists(spark, f"{output}/{STATES}"):
        kept = spark.read.schema(f"{states.STATE}, log_type string, run string").parquet(f"{output}/{STATES}").filter((F.col("log_type") == name) & F.col("run").isin(runs)).drop("log_type")
    without = sorted(set(runs) - {r["run"] for r in kept.filter("kind = 'total'").select("run").distinct().collect()})
    kept = kept.drop("run")
    return states.merged(kept.unionByName(states.of_rows(name, rows_of(spark, output, name, without).drop("event_date"))) if without else kept)


def schema_only(spark: SparkSession, name: str) -> DataFrame:
    """A log type's table without rows."""
    return spark.createDataFrame([], f"{registry.BY_NAME[name].columns}, source_file string")


def routed(spark: SparkSession, candidates: DataFrame, strict: bool) -> DataFrame:
    """One row a file: with several types left, the first whose parser takes one of the file's first ten lines."""
    if strict:
        return candidates
    several = candidates.groupBy("path").count().filter("count > 1").select("path")
    open_ = candidates.join(several, "path").cache()
    heads = files.packed_lines(open_.select("path", "mtime").distinct(), "first").filter("place < 10").cache()
    names = {r["log_type"] for r in open_.select("log_type").distinct().collect()}
    fits = spark.createDataFrame([], "path string, log_type string")
    for kind in registry.LOG_TYPES:
        if kind.name in names and kind.parse is not None and kind.kind != "whole":
            own = heads.join(open_.filter(F.col("log_type") == kind.name).select("path"), "path", "left_semi").withColumn("format", F.lit(None).cast("string"))
            fits = fits.unionByName(kind.parse(own).select(F.col("source_file").alias("path"), F.lit(kind.name).alias("log_type")).distinct())
    fits = fits.cache()
    joined = candidates.join(fits, ["path", "log_type"], "left_semi").unionByName(candidates.join(fits.select("path").distinct(), "path", "left_anti"))
    from pyspark.sql import Window

    return joined.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("priority"))).filter("n = 1").drop("n")


def parsed(spark: SparkSession, kind: registry.LogType, own: list, strict: bool = False) -> DataFrame:
    """The rows of a log type's files; no files give none."""
    members = "first" if strict else "all"

    def table(rows: list) -> DataFrame:
        return spark.createDataFrame([(r["path"], r["mtime"]) for r in rows], "path string, mtime timestamp").repartition(max(1, min(len(rows), 1000)))

    if kind.kind in ("utmp", "journal"):
        return spark.read.format(kind.kind).option("paths", "\n".join(r["path"] for r in own)).option("members", members).load()
    if kind.kind == "whole":
        return kind.parse(files.whole_files(table(own), members))
    # Plain text is split among tasks by Spark; packed files, and names that Spark's listing passes over, by path.
    by_path = lambda r: r["packed"] or Path(r["path"]).name[0] in "._"
    packed, text = [r for r in own if by_path(r)], [r["path"] for r in own if not by_path(r)]
    parts = ([files.plain_lines(spark, text)] if text else []) + ([files.packed_lines(table(packed), members)] if packed else [])
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return kind.parse(lines.with_format(rows, len(own)) if kind.kind == "detected" else rows.withColumn("format", F.lit(None).cast("string")))


def record(spark: SparkSession, output: str, name: str, own: list, run: str) -> None:
    """Commits a run's rows of a log type by naming the files they are from."""
    rows = [(Path(r["path"]).name, r["path"], r["md5"], r["size"], name) for r in own]
    done = spark.createDataFrame(rows, INFO.rsplit(",", 1)[0]).withColumns({"parsed_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"), "run": F.lit(run)})
    done.coalesce(1).write.mode("append").partitionBy("run").parquet(f"{output}/info")


def write(spark: SparkSession, output: str, kind: registry.LogType, own: list, run: str, strict: bool) -> None:
    """Writes the rows, states and skip index of a log type's files as a run, and commits it."""
    table = parsed(spark, kind, own, strict)
    time = next(c for c in ("date_time", "timestamp") if c in table.columns)
    table = table.withColumn("event_date", event_date(F.col(time)))
    keys = [c for c in LOOKED_UP if c in table.columns]
    if keys:  # rows of an address lie together within a file, and a file tells which values it can't have
        table = table.sortWithinPartitions("event_date", *keys)
    writer = table.write.mode("append").partitionBy("event_date")
    for c in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.adaptive.enabled#{c}", "true")
    writer.parquet(f"{output}/{kind.name}/run={run}")
    of_run = {"log_type": F.lit(kind.name), "run": F.lit(run)}
    mine = states.of_rows(kind.name, rows_of(spark, output, kind.name, [run]).drop("event_date"))
    mine.withColumns(of_run).coalesce(1).write.mode("append").partitionBy("log_type", "run").parquet(f"{output}/{STATES}")
    index = skipindex.of_files(rows_of(spark, output, kind.name, [run]))
    index.withColumns(of_run).coalesce(1).write.mode("append").partitionBy("log_type", "run").parquet(f"{output}/{SEARCHED}")
    record(spark, output, kind.name, own, run)


def unreadable(spark: SparkSession, kind: registry.LogType, own: list, strict: bool) -> dict[str, str]:
    """What is wrong with each of the files that can't be read to their ends, found by tasks; the files of a type that failed are tried."""
    options = {"members": "first" if strict else "all"}

    def tried(path: str) -> str | None:
        try:
            if kind.kind in ("utmp", "journal"):
                reader = (UtmpDataSource if kind.kind == "utmp" else JournalDataSource)(options | {"paths": path}).reader(None)
                for part in reader.partitions():
                    for _ in reader.read(part):
                        pass
            else:
                for _, stream in files.opened(path, options["members"]):
                    while stream.read(1 << 20):
                        pass
        except Exception as error:  # noqa: BLE001 - whatever it is, this file raises it
            return f"{type(error).__name__}: {error}"[:300]
        return None

    def probe(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            yield batch.assign(why=[tried(p) for p in batch["path"]])

    paths = spark.createDataFrame([(r["path"],) for r in own], "path string").repartition(max(1, min(len(own), 1000)))
    return {r["path"]: r["why"] for r in paths.mapInPandas(probe, "path string, why string").filter("why is not null").collect()}


def orphans(spark: SparkSession, output: str, hours: float = 24) -> list[str]:
    """Folders of runs that no commit record names and that nothing was written to for some hours: what stopped runs left."""
    import time as clock

    jvm, found = spark._jvm, []
    for kind in registry.LOG_TYPES:
        for folder in (f"{output}/{kind.name}", f"{output}/{STATES}/log_type={kind.name}", f"{output}/{SEARCHED}/log_type={kind.name}"):
            if _table_exists(spark, folder):
                path = jvm.org.apache.hadoop.fs.Path(folder)
                known = set(committed(spark, output, kind.name))
                for status in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path):
                    name = status.getPath().getName()
                    if name.startswith("run=") and name[4:] not in known and status.getModificationTime() < (clock.time() - 3600 * hours) * 1000:
                        found.append(status.getPath().toString())
    return found


def sweep(spark: SparkSession, output: str, hours: float = 24) -> int:
    """Deletes the folders of `orphans` and gives their number."""
    left = orphans(spark, output, hours)
    for folder in left:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(left)


def ingest(spark: SparkSession, target: str, output: str, strict: bool = False) -> Result:
    """Reads the files below a folder that the tables don't have yet, and the host's dumps."""
    result = ingest_files(spark, files.manifest(spark, target, strict), output, strict)
    if any(Path(target, p).is_file() for p in sysinfo.DUMPS.values()):
        sysinfo.facts(sysinfo.dumps_of(spark, target)).coalesce(1).write.mode("ignore").parquet(f"{output}/sysinfo")
    return result


def ingest_files(spark: SparkSession, manifest: DataFrame, output: str, strict: bool = False) -> Result:
    """Reads the files of a manifest that the tables don't have yet; the same manifest again changes nothing."""
    spark.dataSource.register(UtmpDataSource)
    spark.dataSource.register(JournalDataSource)
    info_path, run = f"{output}/info", uuid.uuid4().hex
    before = info(spark, output) if _table_exists(spark, info_path) else None
    candidates = files.with_digest(manifest).cache()
    result = Result({}, {}, {r["path"]: r["damage"] for r in candidates.filter("damage is not null").select("path", "damage").distinct().collect()})
    for path, why in result.damaged.items():
        log.warning("%s was left out: %s", path, why)
    chosen = routed(spark, candidates.filter("damage is null"), strict)
    chosen = files.first_claims(chosen, before).orderBy("priority", "path").collect()  # names and digests of files, no contents
    for kind in registry.LOG_TYPES:
        own = [r for r in chosen if r["log_type"] == kind.name]
        if not own:
            continue
        try:
            try:
                write(spark, output, kind, own, run, strict)
            except Exception:  # one file may be to blame: those that can't be read are left out, and the others written by a run of their own
                bad = unreadable(spark, kind, own, strict)
                if not bad:
                    raise
                for path, why in bad.items():
                    log.warning("%s was left out: %s", path, why)
                result.damaged |= bad
                own = [r for r in own if r["path"] not in bad]
                if own:
                    write(spark, output, kind, own, uuid.uuid4().hex, strict)
            if own:
                result.written[kind.name] = len(own)
        except Exception as error:  # noqa: BLE001 - what one type's files hold doesn't stop the others
            log.warning("%s was not read: %s", kind.name, error)
            result.failed[kind.name] = str(error)[:500]
    candidates.unpersist()
    precompute(spark, output, list(result.written))
    return result


def precompute(spark: SparkSession, output: str, names: list[str]) -> None:
    """Writes the dashboards of the tables as one document each, replacing those of the same table; no log rows are read."""
    for name in names:
        document = states.payload(dashboards.of_table(name, schema_only(spark, name)), kept_states(spark, output, name))
        stamped = document.withColumns({"table_name": F.lit(name), "computed_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")})
        stamped.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("table_name").parquet(f"{output}/dashboard")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Read collected log files into parquet tables.")
    parser.add_argument("--target", required=True, help="folder of collected files")
    parser.add_argument("--output", required=True, help="folder of the tables")
    parser.add_argument("--strict", action="store_true", help="route by name alone, first archive member only")
    parser.add_argument("--sweep", action="store_true", help="delete what runs left that stopped a day ago and more")
    args = parser.parse_args(argv)
    from quarrylog.plans.engine import session

    spark = session()
    result = ingest(spark, args.target, args.output, args.strict)
    if args.sweep:
        print(f"{sweep(spark, args.output)} folders of stopped runs deleted")
    for name, n in result.written.items():
        print(f"{name}: {n} files")
    for name, why in result.failed.items():
        print(f"{name}: not read: {why}")
    for path, why in result.damaged.items():
        print(f"{path}: left out: {why}")
    return int(bool(result.failed or result.damaged))


if __name__ == "__main__":
    raise SystemExit(main())
