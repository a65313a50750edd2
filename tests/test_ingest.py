"""Binary sources, collections of files, ingest end to end, the engine and streams."""

import gzip
import io
import json
import os
import struct
import tarfile

import pytest
import zstandard
from pyspark.sql import functions as F

from quarrylog.operators import lines
from quarrylog.plans import ingest as ing
from quarrylog.plans import registry
from quarrylog.plans.engine import Engine
from quarrylog.sources import files
from quarrylog.sources.journal import JournalDataSource, JournalFile
from quarrylog.sources.utmp import RECORD, UtmpDataSource
from quarrylog.streaming import live


def utmp_record(kind, user, words, seconds=1_620_000_000, host="h"):
    return struct.pack("<hhi32s4s32s256shhiii4I20s", kind, 0, 77, b"pts/0", b"ts/0", user.encode(), host.encode(), 0, 1, 3, seconds, 123_456, *words, b"")


def journal_bytes(entries, compact=False):
    """A journal with one array of entries, each a dict of fields or ready payloads with flags."""
    out = bytearray(240)
    out[:8] = b"LPKSHHRH"
    struct.pack_into("<I", out, 12, 16 if compact else 0)
    out[40:56] = bytes(range(16))
    offsets = []
    for i, fields in enumerate(entries):
        items = []
        for payload, flags in fields:
            items.append(len(out))
            out += struct.pack("<BB6sQ", 1, flags, b"", 64 + len(payload)) + bytes(48) + payload
            out += bytes(-len(out) % 8)
        offsets.append(len(out))
        out += struct.pack("<BB6sQ", 3, 0, b"", 64 + 16 * len(items)) + struct.pack("<QQQ16sQ", i + 1, 1_620_000_000_123_456, 5, b"\xaa" * 16, 0)
        out += b"".join(struct.pack("<QQ", o, 0) for o in items)
    array = len(out)
    out += struct.pack("<BB6sQ", 6, 0, b"", 24 + 8 * len(offsets)) + struct.pack("<Q", 0) + b"".join(struct.pack("<Q", o) for o in offsets)
    struct.pack_into("<Q", out, 176, array)
    return bytes(out)


def test_utmp_source(spark, tmp_path):
    assert RECORD.itemsize == 384
    v6 = struct.unpack("<4I", bytes.fromhex("20010db8000000000000000000000001"))
    raw = utmp_record(7, "alice", (struct.unpack("<I", bytes([10, 0, 0, 200]))[0], 0, 0, 0)) + utmp_record(0, "empty", (0,) * 4) + utmp_record(8, "", v6) + utmp_record(42, "odd", (0,) * 4) + b"partial"
    path = tmp_path / "wtmp"
    path.write_bytes(raw)
    spark.dataSource.register(UtmpDataSource)
    rows = spark.read.format("utmp").option("split_records", 1).load(str(path)).orderBy("ut_type").collect()
    assert [(r.ut_type, r.type_name, r.user, r.src_ip) for r in rows] == [(7, "USER_PROCESS", "alice", "10.0.0.200"), (8, "DEAD_PROCESS", "", "2001:db8::1"), (42, "42", "odd", "")]
    assert rows[0].timestamp == "2021-05-03 09:00:00.123" and rows[0].pid == 77 and rows[0].exit_code == 1


def test_journal_source(spark, tmp_path):
    packed = zstandard.ZstdCompressor().compress(b"MESSAGE=hello = world\n")
    raw = journal_bytes([[(b"_HOSTNAME=web1", 0), (packed, 4), (b"ODD_FIELD=1", 0), (b"no separator", 0)], [(b"PRIORITY=3", 0), (b"_MACHINE_ID=ff", 0)]])
    (tmp_path / "a.journal").write_bytes(raw)
    (tmp_path / "b.journal").write_bytes(journal_bytes([[(b"X=1", 0)]], compact=True))
    (tmp_path / "c.journal").write_bytes(b"short")
    spark.dataSource.register(JournalDataSource)
    paths = "\n".join(str(tmp_path / f"{n}.journal") for n in "abc")
    rows = spark.read.format("journal").option("paths", paths).load().orderBy("seqnum").collect()
    assert [(r.seqnum, r.hostname, r.message, r.priority) for r in rows] == [("1", "web1", "hello = world", ""), ("2", "", "", "3")]
    assert rows[0].timestamp == "2021-05-03 09:00:00.123" and rows[0].machine_id == bytes(range(16)).hex() and rows[1].machine_id == "ff"
    assert json.loads(rows[0].extra) == {"ODD_FIELD": "1"} and rows[1].extra == "" and rows[0].boot_id == "aa" * 16
    assert list(JournalFile(raw[:-8]).rows()) == []  # a cut array is no array


@pytest.mark.parametrize(
    ("path", "names"),
    [
        ("/c/var/log/auth.log.1", ["authlog"]), ("/c/nginx/access.log", ["nginx"]), ("/c/apache2/access.log.gz", ["apache2"]), ("/c/access.log", ["apache2", "nginx"]), ("/c/mysql/error.log", ["apache2_error", "nginx_error", "mysql_error"]),
        ("/c/home/bob/.bash_history", ["shell_history"]), ("/c/wtmp.1", ["wtmp"]), ("/c/cron.log.2", ["cron"]), ("/c/other", []), ("/c/system.journal", ["journal"]), ("/c/secure-20240101", ["authlog"]),
    ],
)
def test_types_of(path, names):
    assert [t.name for t in registry.types_of(path)] == names


@pytest.fixture(scope="module")
def collection(tmp_path_factory):
    base = tmp_path_factory.mktemp("collected")

    def put(name, data):
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data if isinstance(data, bytes) else data.encode())
        os.utime(path, (1_704_153_600, 1_704_153_600))  # 2024-01-02

    auth = "Dec 31 23:59:59 h sshd[1]: Failed password for bob from 10.0.0.1 port 5 ssh2\nJan  1 00:00:00 h sshd[1]: Accepted password for bob from 10.0.0.2 port 5 ssh2\n"
    put("log/auth.log", auth)
    put("log/auth.log.copy", auth)  # equal content is read once
    put("log/auth.log.2.gz", gzip.compress(b"2024-01-01T00:00:00.500Z h sudo: eve : TTY=p ; PWD=/ ; USER=root ; COMMAND=/bin/id\n"))
    put("nginx/access.log", gzip.compress(b'1.2.3.4 - - [01/Jan/2024:00:00:01 +0000] "GET /a HTTP/1.1" 200 5 "-" "x"\n'))
    put("mysql/error.log", "2024-01-01T00:00:00Z 0 [Note] [MY-1] [Server] ready\n")
    put("web/error.log", "2024/01/01 12:34:56 [error] 12#5: oops, client: 10.0.0.9\n")
    put("home/bob/.bash_history", "#1620000000\nls\n")
    put("wtmp", utmp_record(7, "alice", (0,) * 4))
    put("x.journal", journal_bytes([[(b"MESSAGE=hi", 0)]]))
    put("audit/audit.log", "type=EXECVE msg=audit(1364481363.243:1): a=1 cmd=x\n")
    put("Volatile/uname_dmp", "Linux box 6.5 a")
    packed = io.BytesIO()
    with tarfile.open(fileobj=packed, mode="w:gz") as tar:
        for name in ("../../syslog", "two"):
            data = f"Jan  1 00:00:01 h svc: from {name}\n".encode()
            member = tarfile.TarInfo(name)
            member.size = len(data)
            tar.addfile(member, io.BytesIO(data))
    put("old/syslog.1", packed.getvalue())
    return str(base)


def test_ingest_and_engine(spark, collection, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    result = ing.ingest(spark, collection, out)
    assert result.failed == {}
    assert result.written == {"audit": 1, "authlog": 2, "wtmp": 1, "journal": 1, "shell_history": 1, "syslog": 1, "nginx": 1, "nginx_error": 1, "mysql_error": 1}
    engine = Engine(spark, out)
    auth = engine.table("authlog").orderBy("date_time").collect()
    assert [(r.date_time, r.event_type) for r in auth] == [("2023-12-31 23:59:59.000", "sshd_failed_password"), ("2024-01-01 00:00:00.000", "sshd_accepted_password"), ("2024-01-01 00:00:00.500", "sudo_command")]
    assert str(auth[0].event_date) == "2023-12-31"
    assert sorted(r.message for r in engine.table("syslog").collect()) == ["from ../../syslog", "from two"]
    assert engine.table("kernlog").count() == 0 and engine.table("nginx").first().uri == "/a"
    assert engine.sysinfo().first().hostname == "box"
    totals = {r.table_name: r.total for r in engine.tables().collect()}
    assert totals["info"] == 10 and totals["authlog"] == 3 and "dashboard" not in totals
    page = engine.page("authlog", first="2024-01-01", last="2024-01-01", search="!sudo")
    assert page.total == 1
    assert json.loads(engine.dashboard("authlog").first().payload)["failed_password"] == 1
    assert {r.ip for r in engine.web_ips().collect()} == {"1.2.3.4", "10.0.0.9"}
    assert engine.web_records("1.2.3.4").total == 1
    assert {r.table_name for r in engine.search("alice").collect()} == {"wtmp", "dashboard"}  # documents are searched too
    again = ing.ingest(spark, collection, out)
    assert again.written == {} and Engine(spark, out).table("authlog").count() == 3
    engine.register_views()
    assert spark.sql("select count(*) from nginx").first()[0] == 1


def tar_of(*contents):
    packed = io.BytesIO()
    with tarfile.open(fileobj=packed, mode="w:gz") as tar:
        for i, data in enumerate(contents):
            member = tarfile.TarInfo(f"m{i}")
            member.size = len(data)
            tar.addfile(member, io.BytesIO(data))
    return packed.getvalue()


def test_packed_binary_logs_and_histories(spark, tmp_path):
    who = {n: utmp_record(7, n, (0,) * 4) for n in ("ann", "bob", "cy", "dan", "eve")}
    note = {n: journal_bytes([[(b"MESSAGE=" + n.encode(), 0)]]) for n in ("one", "two", "three")}
    put = {
        "wtmp.1.gz": gzip.compress((who["ann"] + who["bob"]) * 300), "wtmp-20240101": tar_of(who["cy"], who["dan"] + b"partial"), "btmp.gz": gzip.compress(who["eve"]),
        "a.journal.gz": gzip.compress(note["one"]), "b.journal": tar_of(note["two"], b"short", note["three"]), "home/bob/.bash_history": tar_of(b"#1620000000\nls", b"#1620000060\nid\n"), "home/eve/.zsh_history.gz": gzip.compress(b": 1620000120:0;w\n"),
    }
    for name, data in put.items():
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    seen = {}
    for strict in (False, True):
        out = str(tmp_path / f"out{strict}")
        assert ing.ingest(spark, str(tmp_path / "in"), out, strict).failed == {}
        read = lambda name, column, out=out: sorted(r[0] for r in ing.stored(spark, out, name).select(column).collect())
        seen[strict] = [read("wtmp", "user"), read("btmp", "user"), read("journal", "message"), read("shell_history", "command")]
    assert seen[False] == [["ann"] * 300 + ["bob"] * 300 + ["cy", "dan"], ["eve"], ["one", "three", "two"], ["id", "ls", "w"]]
    assert seen[True] == [["ann"] * 300 + ["bob"] * 300 + ["cy"], ["eve"], ["one", "two"], ["ls", "w"]]
    times = ing.stored(spark, str(tmp_path / "outFalse"), "shell_history").orderBy("timestamp").select("timestamp", "user", "shell").collect()
    assert [(r.timestamp[11:19], r.user, r.shell) for r in times] == [("09:00:00", "bob", "bash"), ("09:01:00", "bob", "bash"), ("09:02:00", "eve", "zsh")]
    rows = spark.read.format("utmp").option("split_records", 7).load(str(tmp_path / "in/wtmp.1.gz"))
    assert rows.count() == 600 and {r[0] for r in rows.select("source_file").distinct().collect()} == {str(tmp_path / "in/wtmp.1.gz")}


def test_damaged_files_and_stopped_runs(spark, tmp_path, monkeypatch):
    line = "Jan  1 00:00:01 h svc: {}\n"
    good, cut = line.format("good"), gzip.compress((line.format("lost") * 500).encode())
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "syslog").write_text(good)
    (source / "syslog.1").write_bytes(cut[: len(cut) // 2])
    (source / "syslog.2").write_bytes(gzip.compress(line.format("packed").encode()))
    first = ing.ingest(spark, str(source), out)
    assert first.written == {"syslog": 2} and first.failed == {} and list(first.damaged) == [str(source / "syslog.1")]
    messages = lambda: sorted(r.message for r in ing.stored(spark, out, "syslog").collect())
    assert messages() == ["good", "packed"] and Engine(spark, out).table("info").count() == 2
    # A run that stops between rows and records leaves no rows behind that count, and the files are read again.
    (source / "syslog.3").write_text(line.format("late"))
    kept = spark.read.parquet(f"{out}/syslog").withColumn("run", F.lit("stopped"))
    kept.write.mode("append").partitionBy("run", "event_date").parquet(f"{out}/syslog")
    assert messages() == ["good", "packed"]
    (source / "syslog.1").write_bytes(cut)
    again = ing.ingest(spark, str(source), out)
    assert again.written == {"syslog": 2} and again.damaged == {}
    assert messages() == ["good", "late"] + ["lost"] * 500 + ["packed"]
    assert Engine(spark, str(tmp_path / "nothing")).tables().count() == 0


def test_strict_routing_takes_the_first_name(spark, collection, tmp_path):
    result = ing.ingest(spark, collection, str(tmp_path), strict=True)
    assert result.failed == {}
    assert result.written["apache2_error"] == 2 and "mysql_error" not in result.written
    assert spark.read.parquet(f"{tmp_path}/syslog").count() == 1  # first member only


def test_claims(spark):
    rows = [("/b", 1, "x"), ("/a", 2, "x"), ("/c", 1, "y")]
    df = spark.createDataFrame(rows, "path string, priority int, md5 string")
    info = spark.createDataFrame([("y",)], "md5 string")
    assert [r.path for r in files.first_claims(df, info).collect()] == ["/b"]
    assert files.listed("/nowhere") == []


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    log = "".join(f"2024-01-01T00:0{i}:00Z h sshd[1]: Failed password for bob from 10.0.0.1 port 5 ssh2\n" for i in range(6))
    (source / "auth.log").write_text(log)
    live.appended(live.followed(spark, str(source), lines.authlog, lines.ISO), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    table = spark.read.parquet(str(tmp_path / "out"))
    assert table.count() == 6
    (source / "auth2.log").write_text(log)
    live.appended(live.followed(spark, str(source), lines.authlog, lines.ISO), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12
    rates = live.failed_logins(live.followed(spark, str(source), lines.authlog, lines.ISO))
    q = rates.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((str(r.window_start), r.cnt) for r in spark.table("rates").collect()) == [("2024-01-01 00:00:00", 10), ("2024-01-01 00:05:00", 2)]


def test_detection_over_real_files(spark, tmp_path):
    (tmp_path / "syslog").write_text("\n\n2024-01-15T00:07:35Z h svc: x\nJan  1 00:00:01 h svc: y\n")
    (tmp_path / "syslog.1").write_text("Jan  1 00:00:01 h svc: z\n")
    df = lines.syslog(lines.with_format(files.plain_lines(spark, [str(tmp_path / "syslog"), str(tmp_path / "syslog.1")])))
    assert sorted(r.message for r in df.collect()) == ["x", "z"]
    assert df.filter(F.col("source_file").endswith("syslog.1")).count() == 1
