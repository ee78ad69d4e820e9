"""Queries of families on a small fixture, against plain loops over every customer."""

import itertools
import random
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plait.functions import kernels
from plait.plans import groups
from plait.plans.registry import ORACLE_SQL


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("families")
    rng = random.Random(5)
    orders = [(100 + i, c) for i, c in enumerate([c for c in (1, 2, 25, 26) for _ in range(3)] + [40])]
    lines = [(o, n, rng.randrange(1, 200), rng.randrange(1, 100), float(rng.randrange(1, 50)), rng.random() * 1000, rng.choice("FO")) for o, _ in orders for n in range(1, rng.randrange(4, 7))]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{where}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_linestatus string").write.parquet(f"{where}/lineitem.parquet")
    members = {(c, o): [r for r in lines if r[0] == o] for o, c in orders}
    return str(where), members


def points(rows):
    return np.array([[n, p % 17, s % 13, n + q / 10, p % 11, s % 7] for _, n, p, s, q, _, _ in rows], float), np.array(["H" if r[6] == "F" else "E" for r in rows])


def pairs(members):
    return [(x, y) for x, y in itertools.combinations(sorted(members), 2) if x[0] == y[0]]


def plain_best(score):
    m, n = score.shape
    c = np.zeros((m + 1, n + 1))
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            c[i, j] = max(c[i, j - 1], c[i - 1, j], c[i - 1, j - 1] + score[i - 1, j - 1])
    return c[m, n]


def plain_edit(x, y):
    d = np.array([[np.sqrt(((p - q) ** 2).sum()) for q in y] for p in x])
    return max(0.0, 0.5 * (len(x) + len(y)) - plain_best(np.exp(-d / 10)))


def test_pairs_of_every_family(spark, tables):
    where, members = tables
    edits = {(r.g, r.a, r.b): r.value for r in groups.edit_distances(spark, where).collect()}
    scores = {(r.g, r.a, r.b): r.value for r in groups.pair_alignment_scores(spark, where).collect()}
    want = {(x[0], x[1], y[1]): (points(members[x]), points(members[y])) for x, y in pairs(members)}
    assert edits.keys() == scores.keys() == want.keys()
    for key, ((x, kx), (y, ky)) in want.items():
        assert edits[key] == pytest.approx(plain_edit(x, y), abs=2e-6)
        d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
        assert scores[key] == pytest.approx(plain_best(np.where(kx[:, None] == ky[None], np.maximum(0, 30 - d), 0)), abs=2e-6)


@pytest.mark.parametrize("name", ["pair_matchings", "superposition_deviations", "sliding_deviations", "iterative_superposition_scores"])
def test_all_pairs_are_there(spark, tables, name):
    where, members = tables
    got = {(r.g, r.a, r.b) for r in getattr(groups, name)(spark, where).select("g", "a", "b").collect()}
    assert got == {(x[0], x[1], y[1]) for x, y in pairs(members)}


def plain_tree(own):
    """The tree by measuring everything: (merges, root)."""
    nodes = {i: kernels.Weighted(x) for i, x in enumerate(own)}
    out = []
    for new in range(len(own), 2 * len(own) - 1):
        d, a, b = min((nodes[a].distance(nodes[b]), a, b) for a in nodes for b in nodes if a < b)
        out.append((a, b, d))
        nodes[new] = nodes.pop(a).joined(nodes.pop(b))
    return out, nodes.popitem()[1]


def test_trees_and_clusters_of_every_family(spark, tables):
    where, members = tables
    trees = groups.guide_trees(spark, where).collect()
    clusters = groups.consensus_clusters(spark, where).collect()
    roots = groups.consensus_structures(spark, where).collect()
    families = {c for c, _ in members}
    assert sorted((r.g, r.m, r.pos) for r in clusters) == sorted((c, o, i) for (c, o), rows in members.items() for i in range(len(rows)))
    assert {r.linear for r in clusters} == {0}
    for g in families:
        own = [points(members[k])[0] for k in sorted(members) if k[0] == g]
        want, root = plain_tree(own)
        got = sorted((r.node, r.left, r.right, r.distance) for r in trees if r.g == g)
        assert [t[1:3] for t in got] == [t[:2] for t in want] and np.allclose([t[3] for t in got], [t[2] for t in want])
        found = sorted((r.pos, r.point, r.occupancy) for r in roots if r.g == g)
        assert np.allclose([f[1] for f in found], root.points, atol=1e-4) and np.allclose([f[2] for f in found], root.share, atol=1e-5)
    stats = groups.consensus_statistics(spark, where).collect()
    counted = {}
    for r in clusters:
        counted.setdefault((r.g, r.cluster), []).append(r)
    assert {(r.g, r.cluster): r.found_in for r in stats} == {k: len(v) for k, v in counted.items()}
    for r in stats:
        x = np.array([points(members[r.g, c.m])[0][c.pos] for c in counted[r.g, r.cluster]])
        assert r.average_length == pytest.approx(kernels.lengths(x).mean(), abs=1e-5)
        assert r.coord_variance == pytest.approx(x.var(axis=0, ddof=1).sum() if len(x) > 1 else 0.0, abs=1e-4)
        assert (r.sheet_id > 0) <= r.label.startswith("E")
    again = groups.rematched_clusters(spark, where).collect()
    assert sorted((r.g, r.m, r.pos) for r in again) == sorted((r.g, r.m, r.pos) for r in clusters)
    assert {r.g for r in groups.family_consensus(spark, where).select("g").collect()} == families


def test_shapes_to_the_last_bit(spark, tmp_path):
    """Equal points, points on one line, gaps and coordinates that round to zero from below, as the SQL has them."""
    rows = []
    for i in range(60):
        v = [float(np.sin(i)), float(np.cos(i * 1.3)), float(np.sin(i * 2.1))]
        v = [1.0, 2.0, 3.0] if i < 10 else [float(i)] * 3 if i < 20 else [None, 1.0, 2.0] if i == 24 else [float("inf"), 1.0, 2.0] if i == 33 else [1.0, i * 1e-9, 2.0 - i * i] if i > 50 else v
        rows.append((i, v, 1))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    bits = lambda v: [None if x is None else "nan" if x != x else struct.pack("d", x) for x in v]
    want = {k: bits(v) for k, v in con.execute(ORACLE_SQL["local_shapes"]).fetchall()}
    got = {r.vec_id: bits(r["shape"]) for r in groups.local_shapes(spark, str(tmp_path)).collect()}
    assert got == want
    assert any("nan" in v for v in want.values()) and any(struct.pack("d", -0.0) in v for v in want.values())


def test_consensus_points_of_every_family(spark, tables):
    where, members = tables
    found = {}
    for r in groups.family_consensus(spark, where).orderBy("g", "pos").collect():
        found.setdefault(r.g, []).append((r.x, r.y, r.z, r.share))
    assert found.keys() == {c for c, _ in members}
    for g, rows in found.items():
        want, share, _ = kernels.family_consensus([points(members[k])[0][:, :3] for k in sorted(members) if k[0] == g])
        assert np.allclose(np.array(rows)[:, :3], want, atol=1e-9) and np.allclose(np.array(rows)[:, 3], share, atol=1e-6)


def test_families_are_dealt_over_tasks(spark, tables):
    """Kernels take long over few bytes, so families are not put into one task for their bytes."""
    for name in ("family_consensus", "consensus_clusters", "rematched_clusters", "consensus_statistics", "iterative_superposition_scores"):
        found = getattr(groups, name)(spark, tables[0]).withColumn("task", F.spark_partition_id()).collect()
        assert len({r.task for r in found}) > 1, name
