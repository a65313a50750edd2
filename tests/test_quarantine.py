"""Journals in parts, codecs that are missing, damaged files among good ones, what stopped runs leave."""

import json
import struct

import pytest
from test_ingest import journal_bytes, utmp_record

from quarrylog.plans import ingest as ing
from quarrylog.sources import journal
from quarrylog.sources.journal import JournalDataSource, JournalFile


def chained(n, per_array):
    """A journal of n entries whose arrays hold so many items each."""
    raw = bytearray(journal_bytes([[(f"MESSAGE=m{i}".encode(), 0)] for i in range(n)]))
    (first, count) = next(JournalFile(bytes(raw)).arrays())
    offsets = struct.unpack_from(f"<{count}Q", raw, first)
    at = 0
    for k in reversed(range(0, n, per_array)):
        items = offsets[k : k + per_array]
        place = len(raw)
        raw += struct.pack("<BB6sQQ", 6, 0, b"", 24 + 8 * len(items), at) + struct.pack(f"<{len(items)}Q", *items)
        at = place
    struct.pack_into("<Q", raw, 176, at)
    return bytes(raw)


@pytest.mark.parametrize(("per_array", "split"), [(1000, 7), (3, 7), (7, 7), (10, 1000)])
def test_journals_are_split(spark, tmp_path, per_array, split):
    (tmp_path / "a.journal").write_bytes(chained(50, per_array))
    (tmp_path / "b.journal").write_bytes(b"short")
    spark.dataSource.register(JournalDataSource)
    table = spark.read.format("journal").option("paths", f"{tmp_path}/a.journal\n{tmp_path}/b.journal").option("split_entries", split).load()
    assert table.rdd.getNumPartitions() == max(1, -(-50 // split))
    whole = sorted(JournalFile(chained(50, per_array)).rows())
    assert len(whole) == 50 and sorted(map(tuple, table.drop("source_file").collect())) == whole


def test_ranges():
    assert journal.ranges_of(iter([]), 5) == [[]]
    assert journal.ranges_of(iter([(8, 4), (100, 7)]), 5) == [[(8, 4), (100, 1)], [(108, 5)], [(148, 1)]]


def test_codecs(monkeypatch):
    raw = journal_bytes([[(b"MESSAGE=a", 0), (b"not xz", journal.XZ)]])
    (row,) = JournalFile(raw).rows()
    assert json.loads(row[-1]) == {"_DAMAGED_FIELDS": "1"}
    monkeypatch.setitem(__import__("sys").modules, "lz4.block", None)
    with pytest.raises(journal.MissingCodec, match="lz4"):
        list(JournalFile(journal_bytes([[(b"packed", journal.LZ4)]])).rows())


def test_a_bad_file_leaves_the_good_ones_in(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    good = journal_bytes([[(b"MESSAGE=good", 0)]])
    bad = bytearray(good)
    entry = next(JournalFile(good).entry_offsets())
    struct.pack_into("<Q", bad, entry + 24, 1 << 63)  # a time that no calendar has
    (source / "a.journal").write_bytes(good)
    (source / "b.journal").write_bytes(bytes(bad))
    (source / "wtmp").write_bytes(utmp_record(7, "ann", (0,) * 4))
    first = ing.ingest(spark, str(source), out)
    assert first.written == {"wtmp": 1, "journal": 1} and first.failed == {} and list(first.damaged) == [f"{source}/b.journal"]
    assert [r.message for r in ing.stored(spark, out, "journal").collect()] == ["good"]
    assert [r.file_name for r in ing.info(spark, out).filter("log_type = 'journal'").collect()] == ["a.journal"]
    again = ing.ingest(spark, str(source), out)  # tried again, and left out again
    assert again.written == {} and list(again.damaged) == [f"{source}/b.journal"]
    # What the failed writes left counts for nothing and can be deleted.
    kept = ing.stored(spark, out, "journal").withColumn("run", ing.F.lit("stopped"))
    kept.write.mode("append").partitionBy("run", "event_date").parquet(f"{out}/journal")
    assert ing.sweep(spark, out) == 0  # not old enough
    assert any(p.endswith("run=stopped") for p in ing.orphans(spark, out, hours=-1))
    assert ing.sweep(spark, out, hours=-1) >= 1 and ing.orphans(spark, out, hours=-1) == []
    assert ing.stored(spark, out, "journal").count() == 1
