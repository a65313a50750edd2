"""Figures kept as states of runs: equal to those over all rows, without reading them."""

import json
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarrylog.operators import dashboards, states, summaries, views
from quarrylog.plans import ingest as ing
from quarrylog.plans.engine import Engine

AUTH = "Jan {day:>2} 00:00:{s:02} h sshd[{s}]: {what} password for u{u} from 10.0.0.{u} port 5 ssh2\n"
SYSLOG = "Jan {day:>2} 00:00:{s:02} h {svc}: error {s}\n"
WEB = '1.2.3.{u} - - [0{day}/Jan/2024:00:00:{s:02} +0000] "GET /{u} HTTP/1.1" {status} 5 "-" "x"\n'


def put(base, day, rows):
    for name in ("auth", "web"):
        (base / name).mkdir(parents=True, exist_ok=True)
    n = range(rows)
    (base / f"auth/auth.log.{day}").write_text("".join(AUTH.format(day=day, s=s, u=s % 7, what=("Failed", "Accepted")[s % 2]) for s in n))
    (base / f"auth/syslog.{day}").write_text("".join(SYSLOG.format(day=day, s=s, svc=("cron", "kernel", "sshd")[s % 3]) for s in n))
    (base / f"web/other_access.log.{day}").write_text("".join(WEB.format(day=day, s=s, u=s % 5, status=(200, 404, 500)[s % 3]) for s in n))


TABLES = ("authlog", "syslog", "apache2")


def live(spark, out):
    """All figures over rows."""
    tables = {n: ing.stored(spark, out, n).drop("event_date") for n in TABLES}
    return {
        "totals": {n: t.count() for n, t in tables.items()}, "ranges": {n: tuple(views.date_range(t).first()) for n, t in tables.items()},
        "summary": sorted(map(str, (r.asDict() for r in summaries.logs(tables).collect()))), "boards": {n: json.loads(dashboards.of_table(n, t).payload().first().payload) for n, t in tables.items()},
    }


def kept(spark, out):
    engine = Engine(spark, out)
    return {
        "totals": {r.table_name: r.total for r in engine.tables().collect() if r.table_name in TABLES}, "ranges": {n: tuple(engine.date_range(n).first()) for n in TABLES},
        "summary": sorted(map(str, (r.asDict() for r in engine.log_summary().collect()))), "boards": {n: json.loads(engine.dashboard(n, refresh=True).first().payload) for n in TABLES},
    }


def test_three_runs_one_of_them_cut_short(spark, tmp_path, monkeypatch):
    source, out = tmp_path / "in", str(tmp_path / "out")
    put(source, 1, 20)
    assert ing.ingest(spark, str(source), out).failed == {}
    put(source, 2, 30)
    with monkeypatch.context() as m:  # rows and states are written, the commit record is not
        m.setattr(ing, "record", lambda *_: 1 / 0)
        assert len(ing.ingest(spark, str(source), out).failed) == 3
    assert {r.table_name: r.total for r in Engine(spark, out).tables().collect() if r.table_name in TABLES} == dict.fromkeys(TABLES, 20)
    put(source, 3, 10)
    assert ing.ingest(spark, str(source), out).written == {"authlog": 2, "syslog": 2, "apache2": 2}
    want = live(spark, out)
    assert want["totals"]["authlog"] == 60 and want["boards"]["syslog"]["svc_count"] == 3
    assert {n: json.loads(Engine(spark, out).dashboard(n).first().payload) for n in TABLES} == want["boards"]  # the stored ones
    # A run written without states is read from its rows.
    other = str(tmp_path / "other")
    shutil.copytree(out, other)
    shutil.rmtree(next(Path(other, "states/log_type=authlog").iterdir()))
    assert kept(spark, other) == want
    # The figures need no log rows: without them they are the same, and a small new run doesn't read the old ones.
    for n in TABLES:
        for file in Path(out, n).rglob("*.parquet"):
            file.unlink()
    assert kept(spark, out) == want
    put(source, 4, 5)
    assert ing.ingest(spark, str(source), out).failed == {}
    assert kept(spark, out)["totals"] == {n: 65 for n in TABLES}
    assert json.loads(Engine(spark, out).dashboard("authlog").first().payload)["total"] == 65


@pytest.mark.parametrize("runs", [1, 4])
def test_states_of_odd_rows(spark, runs):
    rows = [(None, None, None, None, "f"), ("", "sshd_failed_password", "", "", "f"), ("2024", "sshd_failed_password", "u", "1.1.1.1", None), ("2023", None, None, "1.1.1.1", "g"), ("2024", "sshd_failed_password", "u", "1.1.1.1", "g")]
    df = spark.createDataFrame(rows, "date_time string, event_type string, user string, src_ip string, source_file string").withColumn("detail", F.lit(""))
    parts = [states.of_rows("authlog", df.filter(F.pmod(F.hash("date_time", "source_file"), F.lit(runs)) == k)) for k in range(runs)]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    merged = states.merged(merged)
    plain = dashboards.generic(df.drop("detail"))
    kernel = states.of_rows("kernlog", df.drop("detail"))
    assert states.payload(plain, kernel).first() == plain.payload().first() and "breakdowns" in plain.specs
    board = dashboards.authlog(df)
    assert states.payload(board, merged).first() == board.payload().first()
    assert states.summary(merged).first().asDict() == {"first_dt": "", "last_dt": "2024", "total": 5, "file_count": 2}
    assert states.payload(board, states.merged(states.of_rows("authlog", df.limit(0)))).first() == dashboards.authlog(df.limit(0)).payload().first()
