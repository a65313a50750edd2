"""systemd journal files as a Spark data source, split among tasks.

    spark.dataSource.register(JournalDataSource); spark.read.format("journal").load(path)

Entries are found along the chain of entry arrays. The driver follows the chain's heads only and cuts the arrays into ranges of
`split_entries` entries, which are the partitions. Files that are too short, have another signature or the compact layout have
no rows. Data whose codec isn't installed ends the read; fields that can't be inflated are left out and counted in the other
fields as _DAMAGED_FIELDS. A packed file is unpacked to an unnamed file of the one task that reads it; option `members`: all
(default) or first of an archive.
"""

from __future__ import annotations

import json
import lzma
import struct
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarrylog.plans.registry import JOURNAL_COLUMNS
from quarrylog.sources import files

# The file format.
SIGNATURE, SHORTEST, COMPACT = b"LPKSHHRH", 184, 16
INCOMPATIBLE_AT, MACHINE_AT, ENTRY_ARRAY_AT = 12, 40, 176
DATA, ENTRY, ENTRY_ARRAY = 1, 3, 6
XZ, LZ4, ZSTD = 1, 2, 4
OBJECT_HEAD, OBJECT_BODY = 16, 64
# Journal fields by table column.
FIELDS = {
    "hostname": "_HOSTNAME", "priority": "PRIORITY", "transport": "_TRANSPORT", "identifier": "SYSLOG_IDENTIFIER", "facility": "SYSLOG_FACILITY", "message": "MESSAGE", "pid": "_PID", "uid": "_UID", "gid": "_GID",
    "comm": "_COMM", "exe": "_EXE", "cmdline": "_CMDLINE", "unit": "_SYSTEMD_UNIT", "slice": "_SYSTEMD_SLICE", "cgroup": "_SYSTEMD_CGROUP", "kernel_sub": "_KERNEL_SUBSYSTEM", "kernel_dev": "_KERNEL_DEVICE",
}


class MissingCodec(RuntimeError):
    """Data is compressed by a codec that isn't installed here."""


def _codec(name: str):  # noqa: ANN202
    from importlib import import_module

    try:
        return import_module(name)
    except ImportError as error:
        raise MissingCodec(f"journal data is compressed and {name} isn't installed") from error


def inflated(raw: bytes, flags: int) -> bytes | None:
    """Payload of a data object by its compression flags; None if it is damaged."""
    unpack = None
    if flags & XZ:
        unpack = lzma.decompress
    elif flags & ZSTD:
        unpack = _codec("zstandard").ZstdDecompressor().decompressobj().decompress
    elif flags & LZ4:
        block, frame = _codec("lz4.block"), _codec("lz4.frame")

        def unpack(data: bytes) -> bytes:
            try:  # older files: the size and a block
                return block.decompress(data[8:], uncompressed_size=int.from_bytes(data[:8], "little"))
            except Exception:  # noqa: BLE001 - newer ones hold a frame
                return frame.decompress(data)

    try:
        return unpack(raw) if unpack else raw
    except Exception:  # noqa: BLE001 - codecs have errors of their own
        return None


class JournalFile:
    def __init__(self, data, hours: int = 9):
        self.data, self.zone = data, timezone(timedelta(hours=hours))

    def _u64(self, at: int) -> int:
        return int.from_bytes(self.data[at : at + 8], "little")

    def _object(self, at: int, kind: int, least: int) -> tuple[int, int] | None:
        """(flags, size) of the object at an offset if it is of the kind and whole."""
        if at + OBJECT_HEAD > len(self.data) or self.data[at] != kind:
            return None
        size = self._u64(at + 8)
        return (self.data[at + 1], size) if least <= size and at + size <= len(self.data) else None

    def is_read(self) -> bool:
        """Whether the file is a journal of the layout that is read here."""
        data = self.data
        return len(data) >= SHORTEST and bytes(data[:8]) == SIGNATURE and not int.from_bytes(data[INCOMPATIBLE_AT : INCOMPATIBLE_AT + 4], "little") & COMPACT

    def arrays(self) -> Iterator[tuple[int, int]]:
        """(offset of the first item, number of items) of every entry array, along the chain."""
        at, seen = self._u64(ENTRY_ARRAY_AT), set()
        while at and at not in seen and (found := self._object(at, ENTRY_ARRAY, OBJECT_HEAD + 8)):
            seen.add(at)
            yield at + OBJECT_HEAD + 8, (found[1] - OBJECT_HEAD - 8) // 8
            at = self._u64(at + OBJECT_HEAD)

    def entry_offsets(self, ranges: list[tuple[int, int]] | None = None) -> Iterator[int]:
        for first, n in self.arrays() if ranges is None else ranges:
            for place in range(first, first + 8 * n, 8):
                if offset := self._u64(place):
                    yield offset

    def _field(self, at: int) -> tuple[str, str | None] | None:
        """(name, value) of a data object; an empty name for one that can't be inflated."""
        found = self._object(at, DATA, OBJECT_BODY)
        if not found:
            return None
        payload = inflated(bytes(self.data[at + OBJECT_BODY : at + found[1]]), found[0])
        if payload is None:
            return "", None
        name, sep, value = payload.partition(b"=")
        return (name.decode("utf-8", "replace"), value.decode("utf-8", "replace").rstrip("\n")) if sep else None

    def rows(self, ranges: list[tuple[int, int]] | None = None) -> Iterator[tuple]:
        """The entries of some ranges of array items, or all."""
        data = self.data
        if not self.is_read():
            return
        machine = bytes(data[MACHINE_AT : MACHINE_AT + 16]).hex()
        for at in self.entry_offsets(ranges):
            found = self._object(at, ENTRY, OBJECT_BODY)
            if not found:
                continue
            sequence, micros, _, boot, _ = struct.unpack_from("<QQQ16sQ", data, at + OBJECT_HEAD)
            read = [f for place in range(at + OBJECT_BODY, at + found[1] - 15, 16) if (offset := self._u64(place)) and (f := self._field(offset))]
            fields = {name: value for name, value in read if value is not None}
            if len(damaged := [1 for _, value in read if value is None]):
                fields["_DAMAGED_FIELDS"] = str(len(damaged))
            stamp = datetime.fromtimestamp(micros // 1_000_000, timezone.utc).astimezone(self.zone)
            known = {c: fields.pop(name, "") for c, name in FIELDS.items()}
            # A record's own boot id names its boot and stays among the other fields too.
            boot_id, machine_id = fields.get("_BOOT_ID") or boot.hex(), fields.pop("_MACHINE_ID", machine)
            head = (f"{stamp:%Y-%m-%d %H:%M:%S}.{micros // 1000 % 1000:03d}", str(sequence), boot_id, machine_id)
            yield (*head, *known.values(), json.dumps(fields, ensure_ascii=False) if fields else "")


class _Part(InputPartition):
    def __init__(self, path: str, ranges: list[tuple[int, int]] | None = None):
        self.path, self.ranges = path, ranges


def ranges_of(arrays: Iterator[tuple[int, int]], entries: int) -> list[list[tuple[int, int]]]:
    """Entry arrays cut and gathered into parts of so many entries; one part at least."""
    parts: list[list[tuple[int, int]]] = [[]]
    room = entries
    for first, n in arrays:
        while n:
            if not room:
                parts.append([])
                room = entries
            taken = min(n, room)
            parts[-1].append((first, taken))
            first, n, room = first + 8 * taken, n - taken, room - taken
    return parts


class JournalReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.hours = options.get("paths", options.get("path", "")).split("\n"), int(options.get("hours", 9))
        self.members, self.split = options.get("members", "all"), int(options.get("split_entries", 50_000))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in filter(None, self.paths):
            if files.is_packed(path):
                out.append(_Part(path))
                continue
            with open(path, "rb") as f:
                for journal in self._mapped(f):
                    if journal.is_read():
                        out += [_Part(path, ranges) for ranges in ranges_of(journal.arrays(), self.split)]
        return out

    def _mapped(self, file) -> Iterator[JournalFile]:  # noqa: ANN001
        """The file as a journal, none if it is too short; mapped while it is used."""
        import mmap
        import os

        if os.fstat(file.fileno()).st_size >= SHORTEST:
            with mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ) as data:
                yield JournalFile(data, self.hours)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import shutil
        import tempfile

        if not files.is_packed(partition.path):
            with open(partition.path, "rb") as f:
                for journal in self._mapped(f):
                    for row in journal.rows(partition.ranges):
                        yield (*row, partition.path)
            return
        for _, stream in files.opened(partition.path, self.members):
            with tempfile.TemporaryFile() as f:
                shutil.copyfileobj(stream, f, 1 << 20)
                f.flush()
                for journal in self._mapped(f):
                    for row in journal.rows():
                        yield (*row, partition.path)


class JournalDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "journal"

    def schema(self) -> str:
        return JOURNAL_COLUMNS + ", source_file string"

    def reader(self, schema) -> DataSourceReader:
        return JournalReader(self.options)
