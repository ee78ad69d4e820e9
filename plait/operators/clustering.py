"""Alignment, superposition and consensus clustering of groups of element sequences.

Pairs are generated and scored by Spark; only the sequential kernels run in Python, on one pair or one group at a time.
A group is a family of members, which its operators take whole by nature; its distance matrix is made pair by pair
across the cluster beforehand.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.functions import kernels
from plait.operators.windows import running_total


#: Cells of score matrices that are filled at once; families that a kernel takes at once.
CELLS, FAMILIES = 1 << 19, 128
#: Families whose points alone go through a kernel, without Python objects of their own.
POINT_FAMILIES = 10_000
_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}


def sequences(df: DataFrame, group: str, member: str, order: list[str], coords: list[str], kind: str | None = None) -> DataFrame:
    """(group, member, xs array<array<double>>, kinds array<string>): the elements of each member in order."""
    place = F.struct(*order, *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(coords)], (F.col(kind).cast("string") if kind else F.lit("")).alias("_k"))
    own = df.groupBy(group, member).agg(F.array_sort(F.collect_list(place)).alias("_e"))
    xs = F.transform("_e", lambda e: F.array(*[e[f"_{i}"] for i in range(len(coords))]))
    return own.select(F.col(group).alias("g"), F.col(member).alias("m"), xs.alias("xs"), F.transform("_e", lambda e: e["_k"]).alias("kinds"))


def _fresh(df: DataFrame) -> DataFrame:
    """df with columns of its own, for cogroups of tables that come from one."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _dealt(df: DataFrame) -> DataFrame:
    """df by family, in a number of tasks that stays: kernels take long over few bytes, by which small tasks would be put
    together."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), "g")


def _family_rows(seqs: DataFrame, *columns: str) -> DataFrame:
    """(g, members): one row a family, its members with their columns in order."""
    return _dealt(seqs).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("m", *columns))).alias("members"))


def _each_family(rows: DataFrame, f: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """f over some families at once, as dicts of their columns; f gives tuples by the schema."""
    names, kinds = zip(*[c.split(" ", 1) for c in schema.split(", ")], strict=True)
    types = [_ARROW[k] for k in kinds]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FAMILIES):
                found = f(batch.slice(at, FAMILIES).to_pylist())
                columns = zip(*found, strict=True) if found else [()] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))

    return rows.mapInArrow(solve, schema)


def _points(members: list[dict]) -> list[np.ndarray]:
    return [np.array(m["xs"], float) for m in members]


def _elements(members: list[dict]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(coordinates, kinds) of each member; elements of fewer than six coordinates repeat them."""
    return [(np.stack([np.resize(np.asarray(v, float), 6) for v in m["xs"]]), np.asarray(m["kinds"])) for m in members]


def _pairs(seqs: DataFrame) -> DataFrame:
    x = _dealt(seqs.select("g", F.col("m").alias("a"), F.col("xs").alias("xa"), F.col("kinds").alias("ka")))
    y = _dealt(seqs.select("g", F.col("m").alias("b"), F.col("xs").alias("xb"), F.col("kinds").alias("kb")))
    return x.join(y, "g").filter("a < b")


def _each(pairs: DataFrame, kind: str, f) -> DataFrame:
    """A column ``value`` of f(xa, ka, xb, kb) for every pair, in Arrow batches."""

    @F.pandas_udf(kind)
    def value(xa: pd.Series, ka: pd.Series, xb: pd.Series, kb: pd.Series) -> pd.Series:
        return pd.Series([f(np.stack(p), np.asarray(q), np.stack(r), np.asarray(s)) for p, q, r, s in zip(xa, ka, xb, kb, strict=True)])

    return pairs.select("g", "a", "b", value("xa", "ka", "xb", "kb").alias("value"))


def _many(pairs: DataFrame, f) -> DataFrame:
    """A column ``value`` of f over lists of pairs of like size: whole Arrow batches go through the kernel in few steps."""

    @F.pandas_udf("double")
    def value(xa: pd.Series, ka: pd.Series, xb: pd.Series, kb: pd.Series) -> pd.Series:
        a, b = [np.stack(x) for x in xa], [np.stack(x) for x in xb]
        sizes = np.array([(len(p), len(q)) for p, q in zip(a, b, strict=True)])
        order = np.lexsort((sizes[:, 1], sizes[:, 0]))
        out, at = np.zeros(len(a)), 0
        while at < len(order):
            cells = np.maximum.accumulate(sizes[order[at:], 0]) * np.maximum.accumulate(sizes[order[at:], 1]) * np.arange(1, len(order) - at + 1)
            own = order[at : at + max(1, int(np.searchsorted(cells, CELLS, "right")))]
            out[own] = f([a[i] for i in own], [np.asarray(ka.iloc[i]) for i in own], [b[i] for i in own], [np.asarray(kb.iloc[i]) for i in own])
            at += len(own)
        return pd.Series(out)

    return pairs.select("g", "a", "b", value("xa", "ka", "xb", "kb").alias("value"))


def alignment_scores(seqs: DataFrame) -> DataFrame:
    """(g, a, b, value): total of the best monotone matching of the elements of each pair of members."""

    def scores(a: list, ka: list, b: list, kb: list) -> np.ndarray:
        x, y = kernels.padded(a)[0], kernels.padded(b)[0]
        names = {k: i + 1.0 for i, k in enumerate(sorted({*np.concatenate(ka), *np.concatenate(kb)}))}
        kx, ky = (kernels.padded([np.array([[names[v]] for v in k]) for k in ks])[0] for ks in (ka, kb))
        same = (kx == np.moveaxis(ky, 1, 2)) & (kx > 0)
        d = np.sqrt(((x[:, :, None] - y[:, None]) ** 2).sum(axis=3))
        return kernels.totals(np.where(same, np.maximum(0, 30 - d), 0.0))

    return _many(_pairs(seqs), scores)


def matchings(seqs: DataFrame) -> DataFrame:
    """(g, a, b, i, j): matched positions of each pair of members."""
    out = _each(_pairs(seqs), "array<struct<i:int,j:int>>", lambda x, k, y, l: [{"i": i, "j": j} for i, j in kernels.align(np.where(k[:, None] == l[None], np.maximum(0, 30 - np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))), 0))[1]])
    return out.select("g", "a", "b", F.explode("value").alias("p")).select("g", "a", "b", "p.i", "p.j")


def edit_distances(seqs: DataFrame) -> DataFrame:
    """(g, a, b, value): the metric distance of each pair of members, all weights 1."""
    return _many(_pairs(seqs), lambda a, _, b, __: kernels.edit_distances(a, [np.ones(len(x)) for x in a], b, [np.ones(len(x)) for x in b]))


def superposition_deviations(seqs: DataFrame) -> DataFrame:
    """(g, a, b, value): deviation of the first three coordinates after the best rigid move, over the shorter length."""

    def deviation(x, k, y, l) -> float:
        n = min(len(x), len(y))
        p, q = x[:n, :3], y[:n, :3]
        r, t = kernels.superpose(p, q)
        return kernels.rmsd(p @ r.T + t, q)

    return _each(_pairs(seqs), "double", deviation)


def sliding_deviations(seqs: DataFrame) -> DataFrame:
    return _each(_pairs(seqs), "double", lambda x, k, y, l: kernels.slide(x[:, :3], y[:, :3])[1])


def iterative_scores(seqs: DataFrame) -> DataFrame:
    """(g, a, b, value): total of matching and superposing the elements of each pair of members in turn."""
    return _many(_pairs(seqs), lambda a, ka, b, kb: kernels.iterative_superpositions(a, ka, b, kb)[0])


def guide_trees(seqs: DataFrame) -> DataFrame:
    """(g, node, left, right, distance, newick, measured): merges of each family, whose leaves are numbered in order of
    member; measured counts the distances that its tree took. A family is one task's by nature of its merges; families
    of one member have no merges and no rows."""

    def trees(families: list[dict]) -> list[tuple]:
        rows = []
        for family in families:
            n = len(family["members"])
            merges, _, measured = kernels.guide_tree(_points(family["members"]))
            text = kernels.newick([str(m["m"]) for m in family["members"]], merges, weighted=True)
            rows += [(family["g"], n + i, int(l), int(r), float(x), text, measured) for i, (l, r, x) in enumerate(merges)]
        return rows

    return _each_family(_family_rows(seqs, "xs"), trees, "g long, node int, left int, right int, distance double, newick string, measured long")


def consensus_structures(seqs: DataFrame) -> DataFrame:
    """(g, pos, point, occupancy): the weighted sequence at the root of each family's guide tree."""

    def root(pdf: pd.DataFrame) -> pd.DataFrame:
        _, top, _ = kernels.guide_tree([np.stack(x).astype(float) for x in pdf.sort_values("m")["xs"]])
        return pd.DataFrame({"g": pdf.g.iloc[0], "pos": range(len(top.points)), "point": list(top.points), "occupancy": top.share})

    return seqs.groupBy("g").applyInPandas(root, "g long, pos int, point array<double>, occupancy double")


def consensus_clusters(seqs: DataFrame, trees: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(g, m, pos, cluster, label, linear): the cluster of every element, in order. A cluster has one kind and one element
    of a member at most, and clusters are partially ordered. edges: (g, m, i, j, orient) between positions of a member.
    linear: merges of the family that were matched along linear orders, as their partial orders were too wide."""
    packed = seqs.select("g", "m", "xs", "kinds", F.lit(None).cast("array<struct<i:int,j:int,orient:int>>").alias("links"))
    if edges is not None:
        links = edges.groupBy("g", "m").agg(F.sort_array(F.collect_list(F.struct(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("orient").cast("int").alias("orient")))).alias("links"))
        packed = seqs.select("g", "m", "xs", "kinds").join(links, ["g", "m"], "left")
    merges = _dealt(trees.select("g", "node", "left", "right", "distance")).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("node", "left", "right", "distance"))).alias("merges"))

    def solve(families: list[dict]) -> list[tuple]:
        rows = []
        for family in families:
            own = family["members"] or []
            members = [(x, kinds, sorted((e["i"], e["j"], e["orient"]) for e in m["links"] or [])) for (x, kinds), m in zip(_elements(own), own, strict=True)]
            steps = [(e["left"], e["right"], e["distance"]) for e in family["merges"] or []]
            if len(members) != len(steps) + 1:
                raise ValueError(f"the tree of family {family['g']} has other leaves than the family")
            clusters, _, linear = kernels.consensus(members, steps)
            for c, inside in enumerate(clusters):
                label = f"{members[inside[0][0]][1][inside[0][1]]}{c}"
                rows += [(family["g"], own[m]["m"], i, c, label, linear) for m, i in inside]
        return rows

    return _each_family(_family_rows(_fresh(packed), "xs", "kinds", "links").join(_fresh(merges), "g", "full"), solve, "g long, m long, pos int, cluster int, label string, linear int")


def rematched_clusters(seqs: DataFrame, clusters: DataFrame) -> DataFrame:
    """(g, m, pos, cluster): clusters after rematching each family's members to their mean elements, up to the highest
    self-classification probability; -1 for elements that are left out."""

    placed = _dealt(clusters.select("g", "m", "pos", "cluster")).groupBy("g").agg(F.collect_list(F.struct("m", "pos", "cluster")).alias("placed"))

    def solve(families: list[dict]) -> list[tuple]:
        asked = []
        for family in families:
            own = _elements(family["members"])
            at = {(p["m"], p["pos"]): p["cluster"] for p in family["placed"] or []}
            asked.append((own, [np.array([at.get((m["m"], i), -1) for i in range(len(x))]) for m, (x, _) in zip(family["members"], own, strict=True)]))
        found = kernels.rematches(asked)
        return [(f["g"], m["m"], i, c) for f, new in zip(families, found, strict=True) for m, row in zip(f["members"], new, strict=True) for i, c in enumerate(row.tolist())]

    return _each_family(_family_rows(_fresh(seqs), "xs", "kinds").join(_fresh(placed), "g", "left"), solve, "g long, m long, pos int, cluster int")


def cluster_statistics(seqs: DataFrame, clusters: DataFrame, edges: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """(g, cluster, label, sheet_id, found_in, occurrence, average_length, coord_variance): the statistics of every cluster
    of every family. Sheets are the components of strong edges between clusters of kind E, numbered from 1 by falling
    occurrence times length, 0 for others."""
    x = seqs.select("g", "m", F.posexplode(F.arrays_zip("xs", "kinds")).alias("pos", "e")).select("g", "m", "pos", F.col("e.xs").alias("x"), F.col("e.kinds").alias("kind"))
    placed = x.join(clusters.select("g", "m", "pos", "cluster", "label"), ["g", "m", "pos"])
    length = F.sqrt(sum(((F.col("x")[i + 3] - F.col("x")[i]) ** 2 for i in (1, 2)), (F.col("x")[3] - F.col("x")[0]) ** 2))
    spread = sum((F.coalesce(F.var_samp(F.col("x")[i]), F.lit(0.0)) for i in range(1, 6)), F.coalesce(F.var_samp(F.col("x")[0]), F.lit(0.0)))
    total = seqs.groupBy("g").agg(F.count("*").alias("members"))
    own = placed.groupBy("g", "cluster", "label").agg(F.min("kind").alias("kind"), F.count("*").alias("found_in"), F.coalesce(F.avg(F.when(length > 0, length)), F.lit(0.0)).alias("average_length"), spread.alias("coord_variance"))
    own = own.join(total, "g").withColumn("occurrence", F.col("found_in") / F.col("members"))
    if edges is None:
        return own.select("g", "cluster", "label", F.lit(0).alias("sheet_id"), "found_in", "occurrence", "average_length", "coord_variance")
    at = clusters.select("g", "m", F.col("pos").alias("i"), F.col("cluster").alias("a"))
    met = edges.join(at, ["g", "m", "i"]).join(at.withColumnRenamed("i", "j").withColumnRenamed("a", "b"), ["g", "m", "j"]).groupBy("g", "a", "b", "orient").agg(F.count("*").alias("n"))

    columns = ("label", "kind", "found_in", "occurrence", "average_length", "coord_variance")
    left = _dealt(own).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("cluster", *columns))).alias("own"))
    right = _dealt(met).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("a", "b", "orient", "n"))).alias("met"))

    def sheets(families: list[dict]) -> list[tuple]:
        rows = []
        for family in families:
            own = family["own"]
            at = {c["cluster"]: i for i, c in enumerate(own)}
            kept = kernels.strong_edges([float(c["found_in"]) for c in own], [(at[e["a"]], at[e["b"]], e["orient"], e["n"] / threshold) for e in family["met"] or []])
            part = list(range(len(own)))
            for u, v, *_ in kept:
                low, high = sorted((part[u], part[v]))
                part = [low if p == high else p for p in part]
            weight: dict[int, list[float]] = {}
            for p, c in zip(part, own, strict=True):
                if c["kind"] == "E":
                    weight.setdefault(p, []).append(c["occurrence"] * c["average_length"])
            order = {p: i + 1 for i, p in enumerate(sorted(weight, key=lambda p: (-round(math.fsum(weight[p]), 6), p)))}
            rows += [(family["g"], c["cluster"], c["label"], order[p] if c["kind"] == "E" else 0, c["found_in"], c["occurrence"], c["average_length"], c["coord_variance"]) for p, c in zip(part, own, strict=True)]
        return rows

    return _each_family(_fresh(left).join(_fresh(right), "g", "left"), sheets, "g long, cluster int, label string, sheet_id int, found_in long, occurrence double, average_length double, coord_variance double")


def dense_labels(df: DataFrame, label: str, name: str = "dense") -> DataFrame:
    """Labels renumbered from 0 without gaps, -1 kept. Distinct labels are ranked by range, then joined."""
    own = df.select(label).distinct().filter(F.col(label) >= 0).withColumn("_n", F.lit(1))
    ranked = running_total(own, label, "_n").select(label, (F.col("upto") - 1).cast("int").alias(name))
    return df.join(ranked, label, "left").withColumn(name, F.coalesce(name, F.lit(-1)))


def member_table(df: DataFrame, member: str, cluster: str, value: str) -> DataFrame:
    """One row for each member and cluster; several values in one cell are an error."""
    out = df.groupBy(member, cluster).agg(F.min(value).alias(value), F.count_distinct(value).alias("_n"))
    return out.select(member, cluster, F.when(F.col("_n") == 1, F.col(value)).otherwise(F.raise_error(F.lit("several elements in one cell")).cast(dict(df.dtypes)[value])).alias(value))


def strong_edges(vertices: DataFrame, edges: DataFrame, group: str, threshold: float = 0.5) -> DataFrame:
    """Greedy strong subgraph of each group: edges (group, a, b, orient, n) weigh their number by the threshold, vertices
    (group, v, n) their number."""

    def solve(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("v"), right.sort_values(["n", "a", "b", "orient"], ascending=[False, True, True, True])
        names = left.v.tolist()
        at = {v: i for i, v in enumerate(names)}
        kept = kernels.strong_edges(left.n.astype(float).tolist(), [(at[a], at[b], o, n / threshold) for a, b, o, n in zip(right.a, right.b, right.orient, right.n, strict=True)])
        return pd.DataFrame(sorted((key[0], names[u], names[v], o, w) for u, v, o, w in kept), columns=[group, "a", "b", "orient", "weight"])

    return _fresh(vertices).groupBy(group).cogroup(_fresh(edges).groupBy(group)).applyInPandas(solve, f"{group} long, a long, b long, orient int, weight double")


def minor_axes(df: DataFrame, group: str, axis: list[str], weight: str, major: list[str]) -> DataFrame:
    """Mean minor axis of each group, orthogonal to its mean major axis; null without axes."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.dropna(subset=axis).sort_values([*axis, weight])
        out = kernels.minor_axis(own[axis].to_numpy(float), own[weight].to_numpy(float), pdf[major].mean().to_numpy(float))
        return pd.DataFrame({group: [pdf[group].iloc[0]], "axis": [None if out is None else out.tolist()]})

    return df.groupBy(group).applyInPandas(solve, f"{group} long, axis array<double>")


def matched_agreement(counts: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the share of rows that agree under the best monotone matching of two label orders. counts: contingency
    (a, b, n), as large as the number of label pairs."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = sorted(set(pdf[a])), sorted(set(pdf[b]))
        m = np.zeros((len(x), len(y)))
        for p, q, n in zip(pdf[a], pdf[b], pdf.n, strict=True):
            m[x.index(p), y.index(q)] = n
        return pd.DataFrame({"agreement": [kernels.align(m)[0] / m.sum()]})

    return counts.groupBy().applyInPandas(solve, "agreement double")


def family_consensus(seqs: DataFrame) -> DataFrame:
    """(g, pos, x, y, z, share): the consensus points of each group and the share of members at each."""
    names, types = ["g", "pos", "x", "y", "z", "share"], [pa.int64(), pa.int32(), *[pa.float64()] * 4]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, POINT_FAMILIES):
                part = batch.slice(at, POINT_FAMILIES)
                members = part.column("members")
                xs = members.flatten().field("xs")
                rows = xs.flatten()
                first = rows.offsets.to_numpy()[:-1]
                values = rows.values.to_numpy(zero_copy_only=False)
                sizes, counts = (v.value_lengths().to_numpy(zero_copy_only=False).astype(int) for v in (xs, members))
                now, share, own = kernels.consensuses_of_points(np.stack([values[first + c] for c in range(3)]), sizes, counts)
                pos = np.arange(len(share)) - np.repeat(np.cumsum(own) - own, own)
                group = part.column("g").take(pa.array(np.repeat(np.arange(len(own)), own)))
                yield pa.RecordBatch.from_arrays([group, *[pa.array(c, t) for c, t in zip([pos, *now, share], types[1:], strict=True)]], names=names)

    return _family_rows(seqs, "xs").mapInArrow(solve, "g long, pos int, x double, y double, z double, share double")
