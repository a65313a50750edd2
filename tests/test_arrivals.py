"""Listing in tasks and ingest of files as they come."""

import gzip
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarrylog.plans import ingest, registry
from quarrylog.sources import files
from quarrylog.streaming import live

BSD = "".join(f"Jan  {d} 00:00:0{d} host sshd[{d}]: Failed password for bob from 10.0.0.{d} port 5 ssh2\n" for d in range(1, 8))
ISO = "".join(f"2024-02-0{d}T00:00:00Z host sshd[{d}]: Accepted password for eve from 10.1.0.{d} port 5 ssh2\n" for d in range(1, 6))
WEB = "".join(f'10.2.0.{d} - - [0{d}/Mar/2024:00:00:00 +0000] "GET /{d} HTTP/1.1" 200 5 "-" "x"\n' for d in range(1, 9))


def collection(root):
    for i in range(4):
        for j in range(3):
            folder = root / f"h{i}" / f"d{j}" / "deep" / "er"
            folder.mkdir(parents=True)
            (folder / "auth.log").write_text(f"{i}{j}")
            (folder / ".bash_history").write_text("ls")
            (folder.parent / "notes").write_text("")
    (root / "empty").mkdir()
    os.symlink(root / "h0" / "d0" / "deep" / "notes", root / "link.log")
    os.symlink(root / "h0", root / "linked")
    os.symlink(root / "nowhere", root / "broken")


@pytest.mark.parametrize("most", [1, 5, files.LISTED])
def test_listing_equals_a_walk(spark, tmp_path, most):
    collection(tmp_path)
    want = sorted((str(p), p.stat().st_size, p.stat().st_mtime) for p in tmp_path.rglob("*") if p.is_file())
    assert len(want) == 37
    got = files.listing(spark, str(tmp_path), most=most).select("path", "size", F.unix_micros("mtime").alias("at")).collect()
    assert sorted((r.path, r.size) for r in got) == [w[:2] for w in want]
    assert all(abs(a.at / 1e6 - w[2]) < 1e-5 for a, w in zip(sorted(got), want, strict=True))
    assert [f[:2] for f in files.listed(str(tmp_path))] == [w[:2] for w in want]


def test_listing_of_nothing(spark, tmp_path):
    assert files.listing(spark).count() == files.listing(spark, str(tmp_path), str(tmp_path / "nowhere")).count() == 0
    assert files.manifest(spark, str(tmp_path)).count() == 0


def test_manifest_by_type(spark, tmp_path):
    collection(tmp_path)
    got = sorted((r.path, r.log_type) for r in files.manifest(spark, str(tmp_path)).collect())
    assert got == sorted((path, t.name) for path, _, _ in files.listed(str(tmp_path)) for t in registry.types_of(path))
    assert {t for _, t in got} == {"authlog", "shell_history"}


def rows(spark, output, name):
    table = ingest.stored(spark, output, name)
    return sorted(map(repr, table.drop("source_file", "event_date").collect()))


def test_a_stream_of_files_equals_an_ingest(spark, tmp_path):
    source, check = tmp_path / "in", str(tmp_path / "check")
    (source / "a").mkdir(parents=True)
    (source / "a" / "auth.log").write_text(BSD)
    (source / "a" / "auth.log.1").write_text(ISO)
    stream, batch = str(tmp_path / "stream"), str(tmp_path / "batch")
    live.ingested(spark, str(source), stream, check, files_a_batch=1).awaitTermination()
    (source / "nginx").mkdir()
    (source / "nginx" / "access.log").write_text(WEB)
    (source / "auth.log.2.gz").write_bytes(gzip.compress(ISO.replace("2024-02", "2024-05").encode()))
    (source / "a" / "auth.log.3").write_text(BSD)  # a copy of what was read
    (source / "auth.log.4.gz").write_bytes(gzip.compress(BSD.encode() * 500)[:-20])  # damaged
    live.ingested(spark, str(source), stream, check).awaitTermination()
    assert spark.read.parquet(f"{stream}/info").count() == 4
    ingest.ingest(spark, str(source), batch)
    for name, n in (("authlog", 17), ("nginx", 8)):
        assert rows(spark, stream, name) == rows(spark, batch, name) and len(rows(spark, stream, name)) == n
    assert [r.cnt for r in ingest.kept_states(spark, stream, "authlog").filter("kind = 'total'").collect()] == [17]
    live.ingested(spark, str(source), stream, check).awaitTermination()  # nothing new
    live.ingested(spark, str(source), stream, str(tmp_path / "other")).awaitTermination()  # all again, its progress lost
    assert len(rows(spark, stream, "authlog")) == 17 and spark.read.parquet(f"{stream}/info").count() == 4


def test_a_batch_stopped_before_its_commit_is_read_again_once(spark, tmp_path, monkeypatch):
    source, output, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    source.mkdir()
    (source / "auth.log").write_text(ISO)
    (source / "access.log").write_text(WEB)
    real = ingest.record

    def stopped(spark, output, name, own, run):
        if name == "authlog":
            raise OSError("stopped")
        real(spark, output, name, own, run)

    monkeypatch.setattr(ingest, "record", stopped)
    with pytest.raises(Exception, match="not read whole"):
        live.ingested(spark, str(source), output, check).awaitTermination()
    assert Path(output, "authlog").is_dir() and rows(spark, output, "authlog") == []
    monkeypatch.setattr(ingest, "record", real)
    live.ingested(spark, str(source), output, check).awaitTermination()
    assert len(rows(spark, output, "authlog")) == 5
    assert len(rows(spark, output, "apache2")) == 8
