"""Files of a collection as DataFrames: the manifest, text lines, whole files and archive members.

Folders are listed and contents are read by tasks only.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterable
from datetime import datetime, timezone
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylog.plans import registry

FILES = "path string, size bigint, mtime timestamp"
#: Entries that a task lists before it hands the folders left to others.
LISTED = 20_000
MANIFEST = "path string, log_type string, priority int, size bigint, mtime timestamp"
#: Lines of a file that decide between log types whose names it fits.
PROBE_BYTES = 1 << 16


def walked(folder: str, most: float = float("inf")) -> tuple[list[tuple[str, int, datetime]], list[str]]:
    """(path, size, mtime) of files below a folder, and the folders left to list once `most` entries have been seen.

    Links to files count as files, links to folders aren't followed, unreadable folders and vanished files have none. Names may
    begin with a dot.
    """
    found, folders, seen = [], deque([folder]), 0
    while folders and seen < most:
        try:
            with os.scandir(folders.popleft()) as entries:
                for entry in entries:
                    seen += 1
                    try:
                        if entry.is_dir(follow_symlinks=False):
                            folders.append(entry.path)
                        elif entry.is_file():
                            at = entry.stat()
                            found.append((entry.path, at.st_size, datetime.fromtimestamp(at.st_mtime, timezone.utc)))
                    except OSError:
                        continue
        except OSError:
            continue
    return found, list(folders)


def listed(base: str) -> list[tuple[str, int, float]]:
    """(path, size, mtime) of all files below a folder, sorted; an unreadable folder has none."""
    return sorted((path, size, at.timestamp()) for path, size, at in walked(base)[0])


def listing(spark: SparkSession, *bases: str, most: int = LISTED) -> DataFrame:
    """(path, size, mtime) of all files below folders, listed by tasks.

    A task lists its folder breadth first and hands the folders left after `most` entries to the next round, so a small
    collection takes one round and a large one is dealt out; the driver knows the roots and how many folders are open.
    """

    def walk(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            for folder in batch["folder"]:
                found, left = walked(folder, most)
                for at in range(0, len(found), LISTED):
                    part = found[at : at + LISTED]
                    yield pd.DataFrame({"path": [f[0] for f in part], "size": [f[1] for f in part], "mtime": [f[2] for f in part], "folder": [None] * len(part)})
                if left:
                    yield pd.DataFrame({"path": [None] * len(left), "size": [None] * len(left), "mtime": [None] * len(left), "folder": left})

    roots = sorted({os.path.abspath(b) for b in bases if os.path.isdir(b)})
    open_ = spark.createDataFrame([(r,) for r in roots], "folder string").repartition(max(1, len(roots)))
    parts = [spark.createDataFrame([], FILES)]
    n = len(roots)
    while n:
        # Kept for the next round and the caller; a lost executor's folders are listed again.
        level = open_.mapInPandas(walk, f"{FILES}, folder string").persist()
        parts.append(level.filter("folder is null").drop("folder"))
        open_ = level.filter("folder is not null").select("folder")
        n = open_.count()
        open_ = open_.repartition(max(1, min(n, 1000)))
    return reduce(DataFrame.unionByName, parts)


def manifest_of(found: DataFrame, strict_compat: bool = False) -> DataFrame:
    """One row for each file (path, size, mtime) and log type it may belong to; see `routed` for the decision.

    With strict_compat only the type of highest precedence whose name fits.
    """

    def types(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            fits = [registry.types_of(path)[: 1 if strict_compat else None] for path in batch["path"]]
            rows = batch.loc[batch.index.repeat([len(f) for f in fits])]
            kinds = [t for f in fits for t in f]
            yield rows.assign(log_type=[t.name for t in kinds], priority=[registry.LOG_TYPES.index(t) for t in kinds])

    return found.select("path", "size", "mtime").mapInPandas(types, MANIFEST)


def manifest(spark: SparkSession, base: str, strict_compat: bool = False) -> DataFrame:
    """The manifest of all files below a folder."""
    return manifest_of(listing(spark, base), strict_compat)


def examined(path: str) -> tuple[str | None, bool, str | None]:
    """(md5 of the bytes as stored, whether it is compressed or an archive, what is wrong with it) of a file, read in pieces."""
    import hashlib
    import lzma
    import tarfile
    import zlib

    digest, packed = hashlib.md5(), False
    try:
        with open(path, "rb") as f:
            while piece := f.read(1 << 20):
                digest.update(piece)
        packed = is_packed(path)
        if packed:
            for _, stream in opened(path):
                while stream.read(1 << 20):
                    pass
    except (OSError, EOFError, zlib.error, lzma.LZMAError, tarfile.TarError) as error:
        return digest.hexdigest(), packed, f"{type(error).__name__}: {error}"[:300]
    return digest.hexdigest(), packed, None


def with_digest(files: DataFrame) -> DataFrame:
    """Adds md5, packed and damage (see `examined`), found by the tasks."""

    def digest(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            found = [examined(path) for path in batch["path"]]
            yield batch.assign(md5=[f[0] for f in found], packed=[f[1] for f in found], damage=[f[2] for f in found])

    more = [T.StructField("md5", T.StringType()), T.StructField("packed", T.BooleanType()), T.StructField("damage", T.StringType())]
    return files.mapInPandas(digest, T.StructType([*files.schema, *more]))


def first_claims(files: DataFrame, info: DataFrame | None = None) -> DataFrame:
    """Of files with equal content the first by (priority, path); those whose digest `info` has are left out."""
    if info is not None:
        files = files.join(info.select("md5").distinct(), "md5", "left_anti")
    place = F.row_number().over(Window.partitionBy("md5").orderBy("priority", "path"))
    return files.withColumn("place", place).filter("place = 1").drop("place")


def is_packed(path: str) -> bool:
    """Whether a file is compressed or an archive, by its first bytes."""
    with open(path, "rb") as f:
        head = f.read(512)
    return head[:2] == b"\x1f\x8b" or head[257:262] == b"ustar"


def opened(path: str, members: str = "all") -> Iterable[tuple[str, object]]:
    """(name, binary stream) of a file: itself, inflated if it is gzip, or its members if it is a tar archive.

    Members are streamed, never written to disk, so their names can't leave a folder. members: all or first.
    """
    import gzip
    import tarfile

    with open(path, "rb") as f:
        head = f.read(2)
    stream = gzip.open(path, "rb") if head == b"\x1f\x8b" else open(path, "rb")  # noqa: SIM115
    with stream:
        is_tar = stream.read(512)[257:262] == b"ustar"
        stream.seek(0)
        if not is_tar:
            name = os.path.basename(path)
            yield name.removesuffix(".gz") if head == b"\x1f\x8b" else name, stream
            return
        with tarfile.open(fileobj=stream, mode="r|") as tar:
            for member in tar:
                if member.isfile():
                    yield os.path.basename(member.name), tar.extractfile(member)
                    if members == "first":
                        return


def packed_lines(files: DataFrame, members: str = "all", rows: int = 50_000) -> DataFrame:
    """(value, path, file_name, mtime, at_start, place) of compressed and archived files, read by the tasks that hold their paths."""

    def read(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            for path, mtime in zip(batch["path"], batch["mtime"], strict=True):
                for name, stream in opened(path, members):
                    held: list[str] = []
                    place = 0

                    def table(name=name, path=path, mtime=mtime):
                        n = len(held)
                        at = range(place - n, place)
                        return pd.DataFrame({"value": held, "path": [path] * n, "file_name": [name] * n, "mtime": [mtime] * n, "at_start": [p < 10 for p in at], "place": list(at)})  # noqa: B023

                    for raw in stream:
                        held.append(raw.decode("utf-8", "replace").rstrip("\r\n"))
                        place += 1
                        if len(held) >= rows:
                            yield table()
                            held.clear()
                    if held:
                        yield table()

    return files.select("path", "mtime").mapInPandas(read, "value string, path string, file_name string, mtime timestamp, at_start boolean, place bigint")


def plain_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(value, path, file_name, mtime, at_start, place) of text files, split among tasks by Spark.

    place grows by one from line to line within the first split of a file, which is all that format detection needs.
    """
    text = spark.read.text(paths)
    return text.select(
        "value", F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/").alias("path"), F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_modification_time").alias("mtime"),
        (F.col("_metadata.file_block_start") == 0).alias("at_start"), F.monotonically_increasing_id().alias("place"),
    )


def whole_files(files: DataFrame, members: str = "all") -> DataFrame:
    """(path, content): the files as text, names with a leading dot included, inflated if compressed.

    An archive's members follow each other with a blank line between, so one member's last line is not read with the next.
    """

    def read(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                content = "\n\n".join(stream.read().decode("utf-8", "replace") for _, stream in opened(path, members))
                yield pd.DataFrame({"path": [path], "content": [content]})

    return files.select("path").mapInPandas(read, "path string, content string")
