"""Line grammars on golden lines and their edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarrylog.operators import lines


def given(spark, values, file_name="log", mtime="2024-06-01 00:00:00", line_format=None):
    rows = [(v, f"/logs/{file_name}", file_name, dt.datetime.fromisoformat(mtime), line_format) for v in values]
    return spark.createDataFrame(rows, "value string, path string, file_name string, mtime timestamp, format string")


def dicts(df):
    return [r.asDict() for r in df.collect()]


def test_auth_events(spark):
    log = [
        "Mar  1 00:07:35 web1 sshd[7]: Invalid user bob from 10.0.0.1 port 22",
        "Mar  1 00:07:35 web1 sshd[7]: Failed password for invalid user bob from 10.0.0.1 port 22 ssh2",
        "Mar  1 00:07:35 web1 sshd[7]: Connection closed by 10.0.0.1 port 99 [preauth]",
        "Mar  1 00:07:35 web1 sshd[7]: Connection closed by authenticating user eve 10.0.0.1 port 99",
        "Mar  1 00:07:35 web1 sshd[7]: error: kex_exchange_identification: read: reset",
        "Mar  1 00:07:35 web1 sudo: alice : TTY=pts/0 ; PWD=/home/a ; USER=root ; COMMAND=/bin/ls -l",
        "Mar  1 00:07:35 web1 su: (to root) alice on pts/0",
        "Mar  1 00:07:35 web1 CRON[5]: pam_unix(cron:session): session opened for user root(uid=0)",
        "no header at all",
        "   ",
    ]
    rows = dicts(lines.authlog(given(spark, log)))
    assert [r["event_type"] for r in rows] == ["sshd_invalid_user", "sshd_failed_password", "sshd_conn_closed", "sshd_conn_closed", "sshd_kex_error", "sudo_command", "su_to", "cron_session_opened", "unknown"]
    assert [r["user"] for r in rows] == ["bob", "bob", "", "eve", "", "alice", "alice", "root(uid=0)", ""]
    assert rows[4]["detail"] == "read: reset" and rows[5]["detail"] == "/bin/ls -l" and rows[6]["detail"] == "root"
    assert rows[0]["date_time"] == "2024-03-01 00:07:35.000" and rows[0]["pid"] == "7"
    assert rows[8]["date_time"] == "" and rows[8]["raw_line"] == "no header at all"


@pytest.mark.parametrize(
    ("stamp", "shown"),
    [("2024-01-15T00:07:35.123456+09:00", "2024-01-15 00:07:35.123"), ("2024-01-15T00:07:35+09:00", "2024-01-15 00:07:35.000"), ("2024-01-15T00:07:35.12", "2024-01-15 00:07:35.120"), ("2024-01-15T00:07:35.1Z", "2024-01-15 00:07:35.1Z0")],
)
def test_iso_times(spark, stamp, shown):
    rows = dicts(lines.syslog(given(spark, [f"{stamp} h svc[1]: m: n"], line_format=lines.ISO)))
    assert rows[0]["timestamp"] == shown and rows[0]["message"] == "m: n"


def test_year_goes_back_over_new_year_and_unknown_months_are_january(spark):
    log = ["Dec 31 23:59:59 h svc: x", "Jan  1 00:00:01 h svc: x", "Foo 12 00:00:01 h svc: x", "not a line"]
    assert [r["timestamp"] for r in dicts(lines.syslog(given(spark, log, mtime="2024-01-02 00:00:00")))] == ["2023-12-31 23:59:59.000", "2024-01-01 00:00:01.000", "2024-01-12 00:00:01.000"]


def test_format_is_that_of_the_first_lines(spark):
    iso, bsd = "2024-01-15T00:07:35Z h svc: x", "Jan  1 00:00:01 h svc: x"
    late = ["?"] * 10 + [iso]
    rows = [(v, path, "f", None, True, i) for path, text in (("/a", ["", "?", iso, bsd]), ("/b", [bsd, iso]), ("/c", late)) for i, v in enumerate(text)]
    df = lines.with_format(spark.createDataFrame(rows, "value string, path string, file_name string, mtime timestamp, at_start boolean, place bigint"))
    assert dict(df.select("path", "format").distinct().collect()) == {"/a": lines.ISO, "/b": lines.BSD, "/c": lines.BSD}


def test_cron_kinds(spark):
    log = [f"Mar  1 00:00:00 h CRON[1]: {m}" for m in ("(root) CMD (run (all) now)", "pam_unix(cron:session): session closed for user bob", "(CRON) INFO (pidfile fd = 3)", "(bob) RELOAD (tabs/bob)", "(CRON) error (bad)", "anything")]
    rows = dicts(lines.cron(given(spark, log)))
    assert [r["event_type"] for r in rows] == ["CMD", "SESSION_CLOSE", "INFO", "RELOAD", "ERROR", "OTHER"]
    assert rows[0]["command"] == "run (all) now" and rows[0]["detail"] == "" and rows[2]["detail"] == "pidfile fd = 3"


def test_access_lines(spark):
    log = [
        r'1.2.3.4 - - [05/Mar/2026:07:38:42 +0900] "GET /a?b=\"c\" HTTP/1.1" 200 - "http://r/" "UA \"x\" y"',
        '1.2.3.4, - u [05/Foo/2026:07:38:42 +0900] "odd" 404 12 - Mozilla/5.0 (X 1)',
        '::1 - - [yesterday] "" 301 x https://ref/ agent with words',
        '1.2.3.4 - - [05/Mar/2026:07:38:42 +0900] "GET / HTTP/1.0" 000 0',
        '1.2.3.4 - - [05/Mar/2026:07:38:42 +0900] "GET / HTTP/1.0" 200 7 curl/8',
        "no line",
    ]
    rows = dicts(lines.nginx(given(spark, log)))
    assert [r["status"] for r in rows] == [200, 404, 301, 200]
    assert rows[0]["uri"] == '/a?b="c"' and rows[0]["bytes_sent"] == 0 and rows[0]["user_agent"] == 'UA "x" y' and rows[0]["xff"] == ""
    assert rows[1]["src_ip"] == "1.2.3.4" and rows[1]["date_time"] == "2026-00-05 07:38:42.000" and rows[1]["uri"] == "odd" and rows[1]["referer"] == "-" and rows[1]["user_agent"] == "Mozilla/5.0 (X 1)"
    assert rows[2]["date_time"] == "yesterday" and rows[2]["bytes_sent"] == 0 and rows[2]["referer"] == "https://ref/" and rows[2]["user_agent"] == "agent with words"
    assert rows[3]["referer"] == "" and rows[3]["user_agent"] == "curl/8"


def test_separators_in_lines(spark):
    rows = dicts(lines.authlog(given(spark, ["\x01a\x01b\x01c\x01d\x01e", "2024-01-01T00:00:00Z h s\x01shd[1]: x\x01y"], line_format=lines.ISO)))
    assert [(r["date_time"], r["service"], r["event_type"]) for r in rows] == [("", "", "unknown"), ("2024-01-01 00:00:00.000", "sshd", "unknown")]
    assert rows[1]["detail"] == "xy" and rows[1]["raw_line"].count("\x01") == 2


def test_patterns_are_evaluated_once(spark):
    plan = lines.nginx(given(spark, ["x"]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") < 20 and plan.count("split(") < 8
    body = lines.audit(given(spark, ["x"]))._jdf.queryExecution().optimizedPlan().toString()
    assert body.count("regexp_extract_all(") == 0 and body.count("split(") < 6


def test_very_long_lines(spark):
    agent = r"\"a b" * 25_000
    log = ['1.2.3.4 - - [05/Mar/2026:07:38:42 +0900] "GET /' + "x" * 100_000 + f' HTTP/1.1" 200 5 "-" "{agent}"']
    row = dicts(lines.nginx(given(spark, log)))[0]
    assert len(row["uri"]) == 100_001 and row["user_agent"] == '"a b' * 25_000
    assert dicts(lines.authlog(given(spark, ["Mar  1 00:00:00 h sshd[1]: " + "y" * 100_000])))[0]["event_type"] == "unknown"


@pytest.mark.parametrize(
    ("name", "vhost"),
    [("access.log", "default"), ("access.log.1", "default"), ("access.log.gz", "default"), ("site-access.log", "site"), ("site_access_log", "site"), ("a.b.kr_access_log.2026-03-15.txt", "a.b.kr"), ("c.b.kr_access_log.2026-04-01", "c.b.kr"), ("strange.log", "unknown")],
)
def test_vhost_of_file(spark, name, vhost):
    assert spark.range(1).select(lines.vhost_of_file(F.lit(name))).first()[0] == vhost


def test_error_lines(spark):
    new = "[Wed Oct 11 14:32:52.763677 2000] [core:error] [pid 35] [client 1.2.3.4:80] File missing"
    old = "[Wed Oct 11 14:32:52 2000] [NOTICE] Server up"
    rows = dicts(lines.apache2_error(given(spark, [new, old, "x"])))
    assert [(r["date_time"], r["level"], r["module"], r["pid"], r["client_ip"]) for r in rows] == [("2000-10-11 14:32:52.000", "error", "core", 35, "1.2.3.4"), ("2000-10-11 14:32:52.000", "notice", "core", 0, "")]
    row = dicts(lines.nginx_error(given(spark, ["2024/01/15 12:34:56 [error] 12#5: *9 open failed, client: 10.0.0.9, server: _", "2024/01/15 bad"])))
    assert [(r["pid"], r["tid"], r["cid"], r["client_ip"]) for r in row] == [(12, 5, 9, "10.0.0.9")]


def test_mysql_lines(spark):
    query = ["/usr/sbin/mysqld, Version: 8", "Time                 Id Command    Argument", "2026-03-04T15:00:02.239449Z\t   12 Query\tselect 1  ", "  more of it", "2026-03-04T15:00:02Z\t12 Quit"]
    assert [(r["date_time"], r["thread_id"], r["command"], r["argument"]) for r in dicts(lines.mysql_query(given(spark, query)))] == [("2026-03-04 15:00:02.239", 12, "Query", "select 1"), ("2026-03-04 15:00:02.000", 12, "Quit", "")]
    error = ["2026-03-04T15:00:02.2Z 0 [Warning] [MY-010068] [Server] CA is self signed. ", ""]
    assert [(r["date_time"], r["level"], r["error_code"], r["message"]) for r in dicts(lines.mysql_error(given(spark, error)))] == [("2026-03-04 15:00:02.200", "Warning", "MY-010068", "CA is self signed.")]


def test_audit_records(spark):
    log = [
        "type=USER_CMD msg=audit(1364481363.243:24287): pid=5 uid=0 auid=500 res=1 op=x msg='cwd=\"/\" cmd=6C7300FF terminal=t res=success'",
        "type=PROCTITLE msg=audit(1364481363.243:24288): proctitle=abc cmd=6C73 a=1 a=2=3",
        "",
        "nothing",
    ]
    rows = dicts(lines.audit(given(spark, log)))
    assert len(rows) == 4
    assert rows[0]["date_time"] == "2013-03-28 23:36:03.243" and rows[0]["sequence"] == 24287 and rows[0]["op"] == "" and rows[0]["cwd"] == '"/"'
    assert rows[0]["cmd"] == "ls �" and rows[0]["msg_res"] == "success" and rows[0]["body_res"] == "1"
    assert rows[1]["proctitle"] == "abc" and rows[1]["cmd"] == "6C73" and rows[1]["exe"] == ""
    assert rows[2]["type"] == "" and rows[2]["sequence"] == 0 and rows[3]["date_time"] == ""


def test_kernel_lines(spark):
    log = ["2024-01-15T00:07:35.123456+09:00 h kernel: [1.0] up ", "2024-01-15T00:07:35Z h kernel: [UFW BLOCK] x", "2024-01-15T00:07:35Z h sshd: x"]
    assert [(r["message"], r["hostname"]) for r in dicts(lines.kernlog(given(spark, log)))] == [("[1.0] up", "h")]


def test_histories(spark):
    whole = [("/home/bob/.bash_history", "one\n#1620000000\ntwo\n#1620000000\n\nthree\n#1\n#1620000001\nfour"), ("/home/eve/.zsh_history", ": 1620000000:0;ls; pwd\nplain\n\n#5")]
    rows = dicts(lines.shell_history(spark.createDataFrame(whole, "path string, content string")).orderBy("user", "seq"))
    assert [(r["user"], r["shell"], r["seq"], r["command"], r["timestamp"]) for r in rows] == [
        ("bob", "bash", 1, "one", ""), ("bob", "bash", 2, "two", "2021-05-03 09:00:00.000"), ("bob", "bash", 3, "three", ""), ("bob", "bash", 4, "four", "2021-05-03 09:00:01.000"),
        ("eve", "zsh", 1, "ls; pwd", "2021-05-03 09:00:00.000"), ("eve", "zsh", 2, "plain", ""), ("eve", "zsh", 3, "#5", ""),
    ]


@pytest.mark.parametrize("grammar", ["authlog", "syslog", "cron", "kernlog", "nginx", "apache2", "apache2_error", "nginx_error", "mysql_query", "mysql_error", "audit"])
def test_empty_tables_and_nulls(spark, grammar):
    parse = getattr(lines, grammar)
    assert parse(given(spark, [])).count() == 0
    assert parse(given(spark, [None])).count() in (0, 1)
