"""Graph queries over the whole of small tables, against plain loops."""

import pytest

from plait.plans import graphs


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("graph")
    rows = [(1000 * k + i, c) for k, c in enumerate((1, 2, 650, 3000)) for i in range(1, 4)] + [(650, 2), (7, 7), (3000, 1)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(f"{where}/orders.parquet")
    return str(where), rows


def test_components_of_all_orders(spark, orders):
    where, rows = orders
    part = {v: v for o, c in rows if o != c for v in (o, c)}
    while True:  # until no edge lowers a label
        low = [(v, min(part[o], part[c])) for o, c in rows if o != c for v in (o, c) if part[v] > min(part[o], part[c])]
        if not low:
            break
        for v, x in low:
            part[v] = min(part[v], x)
    assert {r.v: r.component for r in graphs.connected_components(spark, where).collect()} == part
