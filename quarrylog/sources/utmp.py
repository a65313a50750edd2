"""Log-in accounting files (wtmp, btmp) as a Spark data source.

    spark.dataSource.register(UtmpDataSource); spark.read.format("utmp").load(path)

Files are split at multiples of the record size; a partial record at the end is left out, as are unused records. A packed
file is one part, streamed by the task that reads it; option `members`: all (default) or first of an archive.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarrylog.plans.registry import UTMP_COLUMNS
from quarrylog.sources import files

# Record layout (little-endian) and names of record types.
RECORD = np.dtype(
    [
        ("type", "<i2"), ("pad", "<i2"), ("pid", "<i4"), ("line", "S32"), ("id", "S4"), ("user", "S32"), ("host", "S256"), ("exit_term", "<i2"), ("exit_code", "<i2"),
        ("session", "<i4"), ("seconds", "<i4"), ("micros", "<i4"), ("address", "<u4", 4), ("reserved", "S20"),
    ]
)
TYPE_NAMES = ["EMPTY", "RUN_LVL", "BOOT_TIME", "NEW_TIME", "OLD_TIME", "INIT_PROCESS", "LOGIN_PROCESS", "USER_PROCESS", "DEAD_PROCESS", "ACCOUNTING"]


def address_text(words: np.ndarray) -> str:
    """IPv4 if only the first word is set, IPv6 if any is, else ''. Words are unsigned, so no address is refused."""
    raw = words.astype("<u4").tobytes()
    if not any(raw):
        return ""
    return str(ipaddress.IPv4Address(raw[:4]) if not any(raw[4:]) else ipaddress.IPv6Address(raw))


def _text(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("utf-8", "replace").strip()


def records(raw: bytes, hours: int = 9) -> Iterator[tuple]:
    """Rows of UTMP_COLUMNS from whole records, times `hours` east of UTC."""
    zone = timezone(timedelta(hours=hours))
    for r in np.frombuffer(raw[: len(raw) // RECORD.itemsize * RECORD.itemsize], RECORD):
        kind = int(r["type"])
        if kind == 0:
            continue
        at = datetime.fromtimestamp(int(r["seconds"]), timezone.utc).astimezone(zone)
        name = TYPE_NAMES[kind] if 0 < kind < len(TYPE_NAMES) else str(kind)
        yield (
            kind, name, f"{at:%Y-%m-%d %H:%M:%S}.{int(r['micros']) // 1000:03d}", int(r["pid"]), _text(r["line"]), _text(r["id"]), _text(r["user"]), _text(r["host"]), address_text(r["address"]),
            int(r["session"]), int(r["exit_term"]), int(r["exit_code"]),
        )


class _Part(InputPartition):
    def __init__(self, path: str, begin: int, end: int | None):
        self.path, self.begin, self.end = path, begin, end


class UtmpReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options.get("paths", options.get("path", "")).split("\n")
        self.split = int(options.get("split_records", 100_000)) * RECORD.itemsize
        self.hours, self.members = int(options.get("hours", 9)), options.get("members", "all")

    def partitions(self) -> list[InputPartition]:
        import os

        out: list[InputPartition] = []
        for path in filter(None, self.paths):
            if files.is_packed(path):
                out.append(_Part(path, 0, None))
            else:
                size = os.path.getsize(path)
                out += [_Part(path, at, min(at + self.split, size)) for at in range(0, max(size, 1), self.split)]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.end is None:
            for _, stream in files.opened(partition.path, self.members):
                while raw := stream.read(self.split):  # less than asked for at the end only
                    for row in records(raw, self.hours):
                        yield (*row, partition.path)
            return
        with open(partition.path, "rb") as f:
            f.seek(partition.begin)
            raw = f.read(partition.end - partition.begin)
        for row in records(raw, self.hours):
            yield (*row, partition.path)


class UtmpDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "utmp"

    def schema(self) -> str:
        return UTMP_COLUMNS + ", source_file string"

    def reader(self, schema) -> DataSourceReader:
        return UtmpReader(self.options)
