"""Log files as streams: ingest of files as they come, line grammars under readStream, failed log-ins by time window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrylog.functions.times import event_ts
from quarrylog.operators.dashboards import ATTACKS
from quarrylog.plans.ingest import ingest_files
from quarrylog.sources.files import manifest_of


def followed(spark: SparkSession, folder: str, parse: Callable[[DataFrame], DataFrame], line_format: str | None = None) -> DataFrame:
    """Table of a folder's new files as they come. The header format is given, as a stream has no first ten lines."""
    lines = spark.readStream.text(folder).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_modification_time").alias("mtime"))
    return parse(lines.withColumn("format", F.lit(line_format).cast("string")))


def failed_logins(auth: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window_start, src_ip, cnt) of failed log-ins; rows later than the watermark are left out."""
    stamped = auth.withColumn("event_ts", event_ts(F.col("date_time")).cast("timestamp")).filter(F.col("event_type").isin(*ATTACKS) & (F.col("src_ip") != ""))
    grouped = stamped.withWatermark("event_ts", late).groupBy(F.window("event_ts", window), "src_ip").agg(F.count("*").alias("cnt"))
    return grouped.select(F.col("window.start").alias("window_start"), "src_ip", "cnt")


def arriving(spark: SparkSession, folder: str, files_a_batch: int | None = None) -> DataFrame:
    """(path, size, mtime) of the files below a folder as they come, contents unread; names that begin with . or _ don't show."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true")
    found = found.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else found
    path = F.regexp_replace("path", "^file:/*", "/").alias("path")
    return found.load(folder).select(path, F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def ingested(spark: SparkSession, folder: str, output: str, checkpoint: str, strict: bool = False, files_a_batch: int | None = None) -> StreamingQuery:
    """Ingest of a folder's new files into the tables of `plans.ingest`, in one run over what there is.

    Each batch of files is routed, its formats are found by file and its rows, states and skip index written as an ingest's.
    Files count once `info` has their digests, so a batch that is run again after a stop reads what the first try didn't
    commit and nothing twice. A damaged file is left out and reported; the stream goes on.
    """

    def read(batch: DataFrame, number: int) -> None:
        result = ingest_files(batch.sparkSession, manifest_of(batch, strict), output, strict)
        if result.failed:
            raise RuntimeError(f"batch {number} was not read whole: {result.failed}")

    return arriving(spark, folder, files_a_batch).writeStream.foreachBatch(read).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def appended(table: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a followed table to a parquet folder, in one run over what there is."""
    return table.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
