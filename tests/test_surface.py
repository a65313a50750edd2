"""Filters, pages, dashboards, web views, functions and summaries."""

import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylog.functions import text
from quarrylog.operators import dashboards, filters, summaries, sysinfo, views, web


@pytest.mark.parametrize(
    ("raw", "found"),
    [
        ("foo bar", [("contains", "foo"), ("contains", "bar")]), ("!x =y", [("exclude", "x"), ("exact", "y")]), ('"a b" ="c d" !\'e f', [("contains", "a b"), ("exact", "c d"), ("exclude", "e f")]),
        ("! =", [("contains", "!"), ("contains", "=")]), ('"" =""', []), ("!!a", [("exclude", "!a")]), (None, []), ("a\"b c\"", [("contains", 'a"b'), ("contains", 'c"')]), ('"a"b', [("contains", "a"), ("contains", "b")]),
    ],
)
def test_terms(raw, found):
    assert [(t.op, t.text) for t in filters.terms(raw)] == found


def _model(raw):
    """The grammar once more, by one regular expression."""
    out = []
    for op, quoted, a, b, bare in re.findall(r"""([!=](?=\S))?(?:(")([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|(\S+))""", raw):
        term = a if quoted else b or bare
        if term:
            out.append(({"!": "exclude", "=": "exact"}.get(op, "contains"), term))
    return out


@given(st.text(alphabet="ab!=\"' ", max_size=14))
@settings(max_examples=400, deadline=None)
def test_terms_agree_with_a_model(raw):
    got = [(t.op, t.text) for t in filters.terms(raw)]
    if not re.search(r"[!=](?:\s|\Z)|[\"'][\"']|[!=][\"']", raw):
        assert got == _model(raw)
    assert all(t for _, t in got)


def test_like_is_sqlites(spark):
    df = spark.createDataFrame([(x,) for x in ("aXb", "a%b", "a\\b", "É", None, "a~_b")], "v string")
    hit = lambda term: [r.v for r in df.filter(filters.like(F.col("v"), term)).collect()]
    assert hit("axB") == ["aXb"] and hit("a_b") == ["aXb", "a%b", "a\\b"] and hit("\\") == ["a\\b"] and hit("é") == [] and hit("a%b") == ["aXb", "a%b", "a\\b", "a~_b"] and hit("~_") == ["a~_b"]
    assert df.filter(~filters.like(F.col("v"), "zz")).count() == 5


@pytest.fixture(scope="module")
def auth(spark):
    rows = [(i, f"2024-01-{i % 3 + 1:02d} 00:00:{i % 60:02d}.000", "sshd_failed_password" if i % 2 else "sshd_accepted_password", f"u{i % 4}", f"1.2.{i % 2}.{i % 5}") for i in range(60)]
    return spark.createDataFrame(rows, "id int, date_time string, event_type string, user string, src_ip string")


def test_pages(auth):
    first = views.page(auth, size=7, first="2024-01-02", last="2024-01-02", types=["sshd_failed_password"], columns={"user": "u", "none": "x"})
    assert first.total == 10 and first.rows.count() == 7 and first.bounds(1, 7) == (2, 8, 10)
    ids = [r.id for n in range(2) for r in views.page(auth, n, 7, first="2024-01-02", last="2024-01-02", types=["sshd_failed_password"]).rows.collect()]
    assert len(set(ids)) == 10
    assert views.page(auth, sort="nothing", size=1).rows.first().date_time == "2024-01-01 00:00:00.000"
    assert views.date_range(auth).first().asDict() == {"first_day": "2024-01-01", "last_day": "2024-01-03"}


def test_group_filters_and_empty_tables(auth):
    assert filters.of_types(auth, filters.GROUPS["authlog"]["failure"]).count() == 30
    empty = auth.limit(0)
    assert views.page(empty).total == 0 and views.page(empty).bounds(0) == (1, 0, 0)
    assert json.loads(dashboards.authlog(empty).payload().first().payload)["total"] == 0


def test_payloads_hold_scalars_and_lists(auth):
    doc = json.loads(dashboards.authlog(auth.withColumn("detail", F.lit(""))).payload().first().payload)
    assert doc["total"] == 60 and doc["failed_password"] == 30 and [x["cnt"] for x in doc["event_dist"]] == [30, 30] and doc["top_sudo_users"] == []
    generic = json.loads(dashboards.generic(auth).payload().first().payload)
    assert {b["column_name"] for b in generic["breakdowns"]} == {"event_type", "src_ip", "user"}


def test_payloads_are_the_lists(spark):
    """The document made in one pass holds what each list by itself gives, in its order."""
    rows = [(i, f"t{i % 9}", f"10.0.0.{i % 7}", ["GET", "POST", "PUT", ""][i % 4], f"/p/{i % 13}", [200, 200, 404, 500, None][i % 5], ["a", "", "b"][i % 3]) for i in range(200)]
    web_log = spark.createDataFrame(rows, "id int, date_time string, src_ip string, method string, uri string, status int, vhost string")
    board = dashboards.apache2(web_log)
    doc = json.loads(board.payload().first().payload)
    for name, table in board.lists.items():
        assert doc[name] == [{k: v for k, v in r.asDict().items() if v is not None} for r in sorted(table.collect(), key=lambda r: (-r.cnt, r[0] is not None, str(r[0])))], name
    assert doc["total"] == 200 and len(doc["top_uri_200"]) == 10 and isinstance(doc["status_dist"][0]["status"], int)
    plan = board.payload()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 3  # scalars, lists of some, lists of all


def test_generic_dashboards_of_large_tables(auth):
    assert dashboards.within(auth, 60) and not dashboards.within(auth, 59)
    small, large = (json.loads(dashboards.generic(auth, n).payload().first().payload) for n in (60, 59))
    assert not small["scan_limited"] and small["breakdowns"] and large == {"scan_limited": True}


def test_quick_groups(spark, auth):
    log = spark.createDataFrame([("an Error here",), ("fine",), (None,)], "message string")
    assert filters.keyword(log, "error").count() == 1
    with pytest.raises(KeyError):
        filters.keyword(log, "x")
    web_log = spark.createDataFrame([("GET", 200), ("POST", 200), ("PUT", 200), ("", 200), ("GET", 404)], "method string, status int")
    assert [filters.web_group(web_log, g).count() for g in ("200-GET", "200-POST", "200-ETC")] == [1, 1, 1]
    assert {len(g) for g in filters.GROUPS.values()} == {5}


def test_nothing_to_look_in(spark, auth):
    assert views.global_search({}, "x").count() == 0 and views.global_search({"a": auth}, " ").count() == 0
    assert web.ips({}).count() == 0 and web.records({}, "1").count() == 0 and summaries.logs({}).count() == 0 and web.ip_list(web.ips({})).count() == 0


def test_generic_keys_by_preference():
    assert dashboards.key_columns(["pid", "hostname", "message", "src_ip", "status", "user"]) == ["status", "src_ip", "user", "hostname"]


def test_web_views(spark):
    a = spark.createDataFrame([("t1", "1.2.3.4", 200, "GET", "/", "ua"), ("t2", "-", 200, "GET", "/", "ua"), ("t3", "1.2.9.4", 404, "GET", "/x", "ua")], "date_time string, src_ip string, status int, method string, uri string, user_agent string")
    e = spark.createDataFrame([("t0", "1.2.3.4"), ("t4", "fe80::1"), ("t5", None)], "date_time string, client_ip string")
    tables = {"nginx": a, "nginx_error": e}
    found = web.ips(tables)
    assert {r.ip: r.cnt for r in found.collect()} == {"1.2.3.4": 2, "1.2.9.4": 1, "fe80::1": 1}
    assert {r.cidr: (r.cnt, r.ip_count) for r in web.networks(found, 2).collect()} == {"1.2.0.0/16": (3, 2)}
    page = web.records_page(tables, "1.2.", prefix=True)
    assert [(r.source, r.date_time, r.status) for r in page.rows.collect()] == [("nginx_error", "t0", None), ("nginx", "t1", 200), ("nginx", "t3", 404)]
    assert web.records_page(tables, "1.2.", prefix=True, search="!zzz").total == 2  # error rows have null columns


def test_search_over_tables(spark, auth):
    other = spark.createDataFrame([("u3",), ("x",)], "name string")
    rows = views.global_search({"a": auth, "b": other}, "=u3").collect()
    assert {(r.table_name, r.total) for r in rows} == {("a", 15), ("b", 1)}


def test_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert [one(text.hex_text(lit(x))) for x in ("6C7300", "0x6c73", "abc", '"6C"', "", "6G")] == ["ls", "ls", "abc", '"6C"', "", "6G"]
    assert [one(text.clean_ip(lit(x))) for x in ("1.2.3.4, 5.6.7.8", " 1.2.3.4,", "1.2.3.4;", "", "fe80::1")] == ["1.2.3.4", "1.2.3.4", "1.2.3.4", "", "fe80::1"]
    assert one(text.unescape(lit(r"a\"b\\c"))) == r"a\"b\\c".replace('\\"', '"').replace("\\\\", "\\")
    assert one(text.field(lit("a=1 b=2=3 a=4 old-auid=9"), "a")) == "4" and one(text.field(lit("xa=1"), "a")) == "" and one(text.field(lit("old-auid=9"), "auid")) == ""
    assert one(text.url_text(lit("a+b%20c"))) == "a b c" and one(text.url_text(lit("%zz"))) is None
    assert one(text.base64_text(lit("aGk_ aGk"))) == "hi?hi" and one(text.byte_size(lit(1536))) == "1.5 KB"


def test_summaries(spark):
    web_log = spark.createDataFrame([("1.1.1.1", "t", u, "POST", 200, i) for i, u in enumerate(["/up/tmp/c99.php", "/a?q=%3Cscript%3E", "/..%252f../etc/passwd", "/plain"])], "src_ip string, date_time string, uri string, method string, status int, bytes_sent bigint")
    assert {r.attack_type for r in summaries.attacks(web_log).collect()} == {"webshell", "xss", "path_traversal"}
    shells = summaries.webshells(web_log).collect()
    assert [r.path for r in shells] == ["/up/tmp/c99.php"] and shells[0].score >= 5
    cron = spark.createDataFrame([("h", "CRON", "1", "bob", f"2024-01-01 00:00:0{s}.000", k) for s, k in ((0, "SESSION_OPEN"), (3, "SESSION_CLOSE"), (4, "SESSION_OPEN"))], "hostname string, process string, pid string, user string, timestamp string, event_type string")
    row = summaries.cron_jobs(cron).first()
    assert (row.process, row.user) == ("CRON", "bob") and (row.exec_count, row.avg_seconds) == (2, 3.0)


def test_sysinfo(spark):
    dumps = {
        "uname": "Linux box1 6.5.0-1023-aws #23~22.04.1-Ubuntu SMP PREEMPT Mon Jan 1 00:00:00 UTC aarch64 aarch64 aarch64 GNU/Linux",
        "ip": "1: lo: <UP>\n    inet 127.0.0.1/8 scope host lo\n2: eth0: <UP>\n    link/ether 0a:bc:de:00:11:22 brd ff\n    inet 172.31.4.2/20 brd x scope global eth0\n    inet 8.8.8.8/24 scope global eth0\n3: docker0: <UP>\n    inet 172.17.0.1/16 scope global docker0",
        "lscpu": "Architecture: aarch64\nCPU(s):              4\nModel name: Neoverse: N1", "df": "Filesystem Size Used Avail Use% Mounted on\n/dev/x 10G 4G 6G 40% /\n/dev/y 1G 1G 0 100% /boot",
        "timezone": "  Time zone: Asia/Seoul (KST, +0900)", "date": "Mon Mar  2 16:01:37 UTC 2026", "uptime": " 16:01:38 up 543 days, 10:36,  2 users", "last": "bob pts/0 x\nreboot   system boot  6.5.0   Thu Sep  5 05:24   still running\n\nwtmp begins Mon Jan  1 00:00:01 2024",
        "sessions": "tcp 0 0 0.0.0.0:443 0.0.0.0:* LISTEN\ntcp 0 0 127.0.0.1:22 0.0.0.0:* LISTEN\ntcp6 0 0 :::80 :::* LISTEN\nudp 0 0 0.0.0.0:68 x", "whoami": "root\n",
    }
    row = sysinfo.facts(spark.createDataFrame([tuple(dumps[c] for c in sysinfo.DUMPS)], ", ".join(f"{c} string" for c in sysinfo.DUMPS))).first()
    assert (row.hostname, row.kernel, row.os, row.architecture) == ("box1", "6.5.0-1023-aws", "Ubuntu 22.04.1", dumps["uname"].split()[11])
    assert (row.internal_ip, row.external_ip, row.mac_address) == ("172.31.4.2", "8.8.8.8", "0a:bc:de:00:11:22")
    assert (row.cpu_model, row.cpu_cores, row.disk_total, row.disk_use_pct) == ("Neoverse: N1", "4", "10G", "40%")
    assert (row.collected_at, row.booted_at, row.uptime_days) == ("2026-03-02 16:01:37.000", "2024-09-05 05:25:37.000", "543")
    assert (row.last_reboot, row.wtmp_begins, row.listen_ports, row.collect_user) == ("Thu Sep  5 05:24", "Mon Jan  1 00:00:01 2024", "22, 443", "root")
    empty = sysinfo.facts(spark.createDataFrame([tuple(None for _ in sysinfo.DUMPS)], ", ".join(f"{c} string" for c in sysinfo.DUMPS))).first()
    assert empty.hostname == "" and empty.listen_ports == "" and empty.booted_at == ""
