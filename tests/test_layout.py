"""Files are laid out for lookups: sorted by address, with Bloom filters that let scans pass row groups over."""

from pathlib import Path

import pyarrow.parquet as pq

from quarrylog.operators import web
from quarrylog.plans import ingest as ing


def scanned(df):
    """Rows that the scans of a query gave on."""
    df.collect()
    found, nodes = 0, [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            nodes.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            nodes.append(node.plan())
        elif name.startswith("Scan parquet"):
            found += node.metrics().apply("numOutputRows").value()
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return found


def test_lookups_pass_row_groups_over(spark, tmp_path):
    line = '10.0.{}.{} - - [01/Jan/2024:00:00:01 +0000] "GET /a HTTP/1.1" 200 5 "-" "x"\n'
    source, out = tmp_path / "in", str(tmp_path / "out")
    (source / "nginx").mkdir(parents=True)
    for k in range(3):
        # Every second address; even ones lie between them, so only a Bloom filter tells that they aren't there.
        (source / f"nginx/access.log.{k}").write_text("".join(line.format(k, 2 * (i * 37 % 100) + 1) for i in range(300)))
        assert ing.ingest(spark, str(source), out).failed == {}
    table = ing.stored(spark, out, "nginx")
    assert table.count() == 900
    for file in Path(out, "nginx").rglob("*.parquet"):
        addresses = pq.read_table(file, columns=["src_ip"])["src_ip"].to_pylist()
        assert addresses == sorted(addresses)
    absent, there = web.records({"nginx": table}, "10.0.1.42"), web.records({"nginx": table}, "10.0.1.43")
    assert scanned(absent) == 0 and absent.count() == 0
    assert there.count() == 3 and scanned(there) <= 300  # one run's file at most
