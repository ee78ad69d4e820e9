"""Readers, sinks, layout and index beyond what their queries show, on small tables."""

import gzip
import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plait.functions import layout
from plait.operators import filters, graphs, intervals, joins, metric
from plait.sources import readers, sinks


def test_names_and_classifications(spark, tmp_path):
    with gzip.open(tmp_path / "names.txt.gz", "wt") as f:
        f.write("1.10.8 Helicase, Ruva Protein; domain 3\n2.40\n\n")
    assert {(r.id, r["name"]) for r in readers.read_names(spark, str(tmp_path / "names.txt.gz")).collect()} == {("1.10.8", "Helicase, Ruva Protein; domain 3"), ("2.40", "")}
    (tmp_path / "c.txt").write_text("# head\n1abcA00 1 10 8 10 1 2 3 4 1 120 2.5\n")
    row = readers.read_classification(spark, str(tmp_path / "c.txt")).first()
    assert (row.domain, row.family, row.idfam, row.length, row.resolution) == ("1abcA00", "1.10.8.10", "1.2.3.4", 120, 2.5)


def test_accessions(spark, tmp_path):
    one = lambda d, a, b: {"domain": d, "struct_asym_id": "A", "chain_id": "B", "start": {"residue_number": a}, "end": {"residue_number": b}}
    (tmp_path / "a.json").write_text(json.dumps({"PF1": {"PDB": {"1abc": [one("d1", 1, 9)], "2xyz": {"mappings": [one("d2", 3, 7), one("d2", 9, 12)]}}}}))
    got = {(r.pdb, r.domain, r.start, r.end) for r in readers.read_accession(spark, str(tmp_path / "a.json"), "PF1").collect()}
    assert got == {("1abc", "d1", 1, 9), ("2xyz", "d2", 3, 7), ("2xyz", "d2", 9, 12)}
    assert readers.read_accession(spark, str(tmp_path / "a.json"), "PF2").count() == 0


def test_lists_below_a_folder(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "f1.txt").write_text("1abc,A\n1abc,A,5:9\n")
    (tmp_path / "x" / "f2.txt").write_text("# c\n2xyz,B\n")
    (tmp_path / "x" / "no.md").write_text("zzz,Z\n")
    got = readers.read_lists(spark, str(tmp_path))
    assert {(r.source, r.domain, r.ranges) for r in got.collect()} == {("f1", "1abc_A_00", ":"), ("f1", "1abc_A_01", "5:9"), ("f2", "2xyz_B_00", ":")}
    sinks.write_distinct(got, str(tmp_path / "out"), "pdb")
    assert sorted(r.pdb for r in spark.read.json(str(tmp_path / "out")).collect()) == ["1abc", "2xyz"]


def test_structures_there_and_back(spark, tmp_path):
    points = spark.createDataFrame([(2, 1.5, 0.0, -2.25, 0.5), (1, 0.0, 1.0, 2.0, 1.0)], "n int, x double, y double, z double, occupancy double")
    text = "\n".join(r.line for r in sinks.structure_lines(points, "n").orderBy("n").collect())
    (tmp_path / "s.cif").write_text(text + "\n")
    got = readers.read_structure(spark, str(tmp_path / "s.cif")).orderBy("row").collect()
    assert [(r.label_seq_id, r.Cartn_x, r.Cartn_z) for r in got] == [(1, 0.0, 2.0), (2, 1.5, -2.25)]


def test_selectors(spark):
    rows = [(1, i, c, n) for i, (c, n) in enumerate([("A", 1), ("A", 10), ("A", 11), ("B", 1), ("B", 50), ("B", 50), ("B", 51), ("A", 12)])]
    df = spark.createDataFrame(rows, "g int, pos int, chain string, number int")
    take = lambda s: [r.pos for r in filters.selected(df, s, "g", "pos", "chain", "number").orderBy("pos").collect()]
    assert take("A") == [0, 1, 2] and take("A:10") == [1, 2] and take("A:10:B:50") == [1, 2, 3, 4, 5] and take("C") == []


def test_open_ranges_cost_no_more(spark):
    rows = [(1, -(1 << 31), (1 << 31) - 1), (1, 5, 9), (1, 9, 9), (1, 200, 5000), (2, 1, 3)]
    a = spark.createDataFrame(rows, "k int, start int, end int")
    got = sorted((r.start, r.end) for r in intervals.overlap_join(a, a, "k").filter("k = 1").collect())
    want = sorted((max(x[1], y[1]), min(x[2], y[2])) for x, y in itertools.product(rows[:4], rows[:4]) if max(x[1], y[1]) <= min(x[2], y[2]))
    assert got == want


def test_unknown_keys_are_errors(spark):
    df = spark.createDataFrame([("A", 1, 5)], "chain string, start int, end int")
    index = spark.createDataFrame([("A", 1, 6, 3)], "chain string, start int, end int, id int")
    with pytest.raises(Exception, match="unknown key"):
        joins.by_keys(df, index, ["chain", "start", "end"], "id").collect()


def test_index_takes_and_gives(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 4))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    index = metric.MetricIndex.build(table.filter("k < 50"), "k", "v", str(tmp_path / "index"), pivots=5)
    index.insert(table.filter("k >= 50"), "k", "v")
    assert len(index) == 60
    with pytest.raises(Exception, match="there already"):
        index.insert(table.filter("k = 3"), "k", "v")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) + np.diag(np.full(60, np.inf))
    left = set(range(60))
    for _ in range(2):
        a, b, best = index.pop_nearest_pair()
        want = min((d[i, j], i, j) for i in left for j in left if i < j)
        assert (a, b) == want[1:] and np.isclose(best, want[0])
        left -= {a, b}
    index.delete(table.filter("k = 7"), "k")
    left -= {7}
    assert len(index) == len(left)
    assert {r.k for r in index.contains(table, "k").filter("found").collect()} == left
    got = {(r.a, r.b) for r in index.within(table.filter("k = 0"), "k", "v", 1.5).collect()}
    assert got == {(0, j) for j in left if d[0, j] <= 1.5}
    again = metric.MetricIndex(spark, str(tmp_path / "index"))
    stats = again.statistics(table.filter("k < 5"), "k", "v", 3).first()
    assert stats.scan == 5 * len(left) and stats.computed_first > 0


def test_searches_make_no_products(spark):
    rng = np.random.default_rng(2)
    table = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(80)], "k long, v array<double>")
    for df in (metric.knn(table, table, "k", "v", 3), metric.range_query(table, table, "k", "v", 0.5), metric.nearest_older(table, "k", "v")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan
        assert plan.count("BroadcastNestedLoopJoin") <= 1  # of the one row of pivots


def test_layout():
    edges = {(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (5, 6)}
    sizes = {v: (1.0, 1.0) for v in range(7)}
    assert layout.slices([0, 1, 2, 3, 4], {e for e in edges if e[0] < 5}) == [[0], [1, 2], [3], [4]]
    assert layout.parts(list(range(7)), edges) == [[0, 1, 2, 3, 4], [5, 6]]
    box = layout.embed(list(range(7)), edges, sizes, 1.0, 0.5)
    assert set(box.at) == set(range(7))
    assert all(box.at[a][0] < box.at[b][0] for a, b in edges)
    places = list(box.at.values())
    assert all(abs(p[0] - q[0]) >= 1 or abs(p[1] - q[1]) >= 1 for p, q in itertools.combinations(places, 2))
    # Of all orders of the levels, the least steep one.
    tangled = {(0, 5), (1, 4), (2, 3)}
    flat = layout.embed(list(range(6)), tangled | {(0, 4)}, {v: (1.0, 1.0) for v in range(6)})
    assert sum(abs(flat.at[a][1] - flat.at[b][1]) for a, b in tangled | {(0, 4)}) < 3
    with pytest.raises(ValueError, match="cycle"):
        layout.levels([0, 1], {(0, 1), (1, 0)})


def test_path_labels(spark):
    ok = spark.createDataFrame([(1, 2, 7), (2, 3, 8), (1, 4, 8)], "a int, b int, label int")
    assert graphs.path_labels_unique(ok).first().is_unique
    assert not graphs.path_labels_unique(ok.union(spark.createDataFrame([(3, 5, 7)], ok.schema))).first().is_unique


def test_alignment_lines(spark):
    letters = spark.createDataFrame([(1, "a", i, c) for i, c in enumerate("ABCD")] + [(1, "b", i, c) for i, c in enumerate("BXD")], "pair long, side string, pos int, letter string")
    matches = spark.createDataFrame([(1, 1, 0), (1, 3, 2)], "pair long, i int, j int")
    got = {r["name"]: r.line for r in sinks.alignment_lines(matches, letters, "first", "second").collect()}
    assert got == {"first": "ABC-D", "second": "-B-XD"}


@pytest.mark.parametrize("k", [1, 3])
def test_older_rows_by_blocks(spark, monkeypatch, k):
    """Many blocks, copies, ties and vectors that take no part, against all pairs; a row moves once a block, not once for
    every ring that it may look at."""
    monkeypatch.setattr(metric, "BLOCK", 2000)
    rng = np.random.default_rng(k)
    x = {int(i): rng.integers(0, 3, 4).astype(float).tolist() if i % 2 else rng.normal(size=4).tolist() for i in rng.permutation(300)}
    x[7], x[8], x[9] = None, [None, 0.0, 0.0, 0.0], [float("nan"), 0.0, 0.0, 0.0]
    table = spark.createDataFrame(list(x.items()), "k long, v array<double>")
    want = []
    for a in sorted(set(x) - {7, 8, 9}):
        met = sorted((float(np.sqrt(np.add.accumulate((np.array(x[a]) - x[b]) ** 2)[-1])), b) for b in range(a) if b not in (7, 8, 9))
        want += [(a, b, d) for d, b in met[:k]]
    found = metric.nearest_older(table, "k", "v") if k == 1 else metric._older_by_blocks(table, "k", "v", k)
    assert sorted((r.a, r.b, r.d) for r in found.collect()) == sorted(want)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
    best = min((d, b, a) for a, b, d in want)
    assert [tuple(r) for r in metric.nearest_pairs(table, "k", "v", 1).collect()] == [(best[1], best[2], best[0], 0)]
    assert metric.nearest_older(table.filter("k < 0"), "k", "v").count() == metric.nearest_pairs(table.filter("k < 1"), "k", "v", 1).count() == 0


def test_length_bins_in_many_tasks(spark):
    """Equal lengths too are dealt over tasks, and a pair is found once."""
    table = spark.createDataFrame([(i, 10.0 if i < 400 else i / 100) for i in range(600)], "k long, n double")
    found = metric.length_bins(table.filter("k % 50 = 0"), table, "k", "n", 0.25).withColumn("task", F.spark_partition_id())
    rows = found.collect()
    n = {r.k: r.n for r in table.collect()}
    assert sorted((r.a, r.b, r.bound) for r in rows) == sorted((a, b, abs(n[a] - n[b]) / 2) for a in n for b in n if a % 50 == 0 and a != b and abs(n[a] - n[b]) <= 0.5)
    assert len({r.task for r in rows if r.b < 400}) > 4
