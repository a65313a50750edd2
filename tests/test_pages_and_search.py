"""Pages by key, anchors, and searches with a skip index."""

import random

import pytest

from quarrylog.operators import cursors, filters, skipindex, views
from quarrylog.plans import catalogue
from quarrylog.plans import ingest as ing
from quarrylog.plans.engine import Engine


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    pick = lambda *v: rng.choice(v)
    rows = [(pick(None, "", f"2024-01-0{rng.randrange(1, 4)}"), pick(None, "a", "b", "B"), pick(None, 1, 2, -1), pick("x", "y", None)) for _ in range(230)]
    return spark.createDataFrame(rows + rows[:40] + [rows[0]] * 30, "date_time string, user string, n int, raw_line string").repartition(5).cache()


@pytest.mark.parametrize(("sort", "descending"), [(None, False), ("user", True), ("n", False), ("n", True)])
def test_pages_by_key_are_the_table(table, sort, descending):
    order = cursors.order_of(table, sort, descending)
    want = [tuple(r) for r in table.orderBy(*order.sorting()).collect()]
    assert [r[:4] for r in want] == [tuple(r) for r in views.ordered(table, sort, descending, order.columns[1:]).collect()]
    got, cursor, size = [], None, 60
    while rows := cursors.page_from(table, order, cursor, size).collect():
        got += map(tuple, rows)
        cursor = cursors.cursor_behind(order, rows, cursor)
    assert got == want
    found = cursors.anchors(table, order, every=35).collect()
    ranks = sorted(r["rank"] for r in found)
    assert ranks[0] == 0 and all(b - a <= 35 for a, b in zip(ranks, [*ranks[1:], len(want)], strict=True))
    for number in (0, 3, 27, 29, 1000):
        assert [tuple(r) for r in cursors.page_at(table, order, found, number, 10).collect()] == want[number * 10 : number * 10 + 10]


def test_cursors_of_nothing(table):
    order = cursors.order_of(table)
    assert cursors.anchors(table.limit(0), order).count() == 0 and cursors.page_at(table, order, [], 5).count() == 0
    assert cursors.cursor_behind(order, []) is None


def test_a_page_reads_no_more_than_an_anchor_allows(table):
    order = cursors.order_of(table, "n")
    plan = cursors.page_at(table, order, cursors.anchors(table, order, every=35), 27, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert int(plan.split("Offset ")[1].split()[0]) < 35 + 40 + 31  # ranks since the anchor and rows of its key, not 270


def test_needles():
    assert skipindex.needed("ab !abc 'x y'") == skipindex.needed("'x y'") != [] and skipindex.needed("a_b%cd") == [] and skipindex.needed(None) == []
    assert skipindex.needed("=ABC") == skipindex.needed("abc") == skipindex.needed("abc%de") and len(skipindex.needed("abcd")) == 2


def test_search_reads_files_that_may_match(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    line = "Jan {d:>2} 00:00:{s:02} host{d} svc{d}[1]: message {what} {s}\n"
    for d, what in ((1, "Ärger Needle"), (2, "straw"), (3, "hay")):
        (source / f"syslog.{d}").write_text("".join(line.format(d=d, s=s, what=what) for s in range(20)))
        assert ing.ingest(spark, str(source), out).failed == {}
    (source / "kern.log").write_text("2024-01-01T00:00:01Z h kernel: needle\n")
    ing.ingest(spark, str(source), out)
    files = lambda raw: len(ing.searched(spark, out, "syslog", raw).inputFiles())
    every = len(ing.stored(spark, out, "syslog").inputFiles())
    assert every >= 3 and files("needle") == 1 and files("ne") == every and files("!needle") == every and files("absent word") == 0
    engine = Engine(spark, out)
    for raw in ("needle", "NEEDLE host1", "ÄRGER", "ärger", "Ärger", "=host2", "message !needle", "stra% 1", "st", "svc3 'message hay 7'", "absent word", "2024-01-01", "syslog.2"):
        with_index = {n: ing.searched(spark, out, n, raw) for n in ("syslog", "kernlog")}
        plain = {n: ing.stored(spark, out, n) for n in ("syslog", "kernlog")}
        want = views.global_search(plain, raw).orderBy("table_name", "place").collect()
        assert views.global_search(with_index, raw).orderBy("table_name", "place").collect() == want, raw
    found = engine.search("needle").filter("table_name in ('syslog', 'kernlog')").groupBy("table_name", "total").count().collect()
    assert {(r.table_name, r.total, r["count"]) for r in found} == {("syslog", 20, 20), ("kernlog", 1, 1)}
    rows, cursor = engine.page_behind("syslog", size=25)
    more, cursor = engine.page_behind("syslog", cursor, size=40)
    assert [r.message for r in rows + more] == [r.message for r in engine.page("syslog", size=60).rows.collect()]
    assert engine.page_at("syslog", 1, size=25).collect() == more[:25] and filters.time_column(engine.table("syslog")) == "timestamp"


def test_page_filtered_leaves_out_one_address_only(spark, tmp_path):
    """10.1.1.208 starts with the address that is left out."""
    duckdb = pytest.importorskip("duckdb")
    users = ", ".join(f"({i}, {u}, timestamp '2024-01-06 00:00:00' + interval {i} second)" for i, u in enumerate((1, 1457, 1009, 17, 1025, 103, 2)))
    duckdb.sql(f"COPY (SELECT i::BIGINT AS event_id, t AS ts, u::BIGINT AS user_id, 'click' AS event_type, 1.0 AS value, '' AS props FROM (VALUES {users}) v(i, u, t)) TO '{tmp_path}/events.parquet'")
    events = duckdb.read_parquet(f"{tmp_path}/events.parquet")  # noqa: F841
    want = duckdb.sql(catalogue.ORACLES["page_filtered"]).fetchall()
    assert {"10.1.1.208", "10.1.1.10"} <= {r[4] for r in want} and "10.1.1.2" not in {r[4] for r in want}
    assert [tuple(r) for r in catalogue.QUERIES["page_filtered"](spark, str(tmp_path)).collect()] == want
