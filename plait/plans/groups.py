"""Queries of sequence alignment and consensus clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plait.functions import scalars
from plait.operators import clustering, graphs, stats

from .registry import query, table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members are the orders of a customer, elements their lines: place from numbers, kind from the line status."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    x = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return x.select(
        F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("m"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        F.when(F.col("l_linestatus") == "F", "H").otherwise("E").alias("kind"),
        F.col("l_linenumber").cast("double").alias("c0"), (F.col("l_partkey") % 17).cast("double").alias("c1"), (F.col("l_suppkey") % 13).cast("double").alias("c2"),
        (F.col("l_linenumber") + F.col("l_quantity") / 10).alias("c3"), (F.col("l_partkey") % 11).cast("double").alias("c4"), (F.col("l_suppkey") % 7).cast("double").alias("c5"),
    )


def _families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.sequences(_lines(spark, sf_dir), "g", "m", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], [f"c{i}" for i in range(6)], "kind")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The families by the start points of their elements alone, which what else orders _families() does not change."""
    return clustering.sequences(_lines(spark, sf_dir), "g", "m", ["l_linenumber", "l_partkey", "l_suppkey"], ["c0", "c1", "c2"])


@query()
def pair_alignment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.alignment_scores(_families(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query()
def pair_matchings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.matchings(_families(spark, sf_dir))


@query()
def edit_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.edit_distances(_families(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query()
def superposition_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.superposition_deviations(_families(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query()
def sliding_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.sliding_deviations(_families(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query()
def iterative_superposition_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.iterative_scores(_families(spark, sf_dir)).withColumn("value", F.round("value", 6))


def _links(families: DataFrame) -> DataFrame:
    """Edges between neighbouring strands of a member, parallel where the first lies at an even place."""
    both = F.filter(F.sequence(F.lit(0), F.size("kinds") - 1), lambda i: (F.get("kinds", i) == "E") & (F.get("kinds", i + 1) == "E"))
    return families.select("g", "m", F.explode(both).alias("i")).select("g", "m", "i", (F.col("i") + 1).alias("j"), F.when(F.col("i") % 2 == 0, 1).otherwise(-1).alias("orient"))


@query()
def guide_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.guide_trees(_families(spark, sf_dir))


@query()
def consensus_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clustering.consensus_structures(_families(spark, sf_dir))
    return out.select("g", "pos", F.transform("point", lambda x: F.round(x, 5)).alias("point"), F.round("occupancy", 6).alias("occupancy"))


def _clusters(families: DataFrame) -> DataFrame:
    return clustering.consensus_clusters(families, clustering.guide_trees(families), _links(families))


@query()
def consensus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(graphs._cut(_families(spark, sf_dir)))


@query()
def rematched_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = graphs._cut(_families(spark, sf_dir))
    return clustering.rematched_clusters(f, _clusters(f))


@query()
def consensus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheet, size, occurrence, length and variance of every cluster of every family."""
    f = graphs._cut(_families(spark, sf_dir))
    out = clustering.cluster_statistics(f, graphs._cut(_clusters(f)), _links(f))
    return out.withColumns({c: F.round(c, 6) for c in ("occurrence", "average_length", "coord_variance")})


@query("select vec_id, dense_rank() over (order by case when label % 3 = 0 then -1 else label * 5 end) - case when label % 3 = 0 then 2 else 2 end as dense from embeddings")
def dense_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("label") % 3 == 0, -1).otherwise(F.col("label") * 5).alias("label"))
    return clustering.dense_labels(e, "label").select("vec_id", F.col("dense").cast("long").alias("dense"))


@query("select l_orderkey, l_linenumber, min(l_partkey) as part from (select l_orderkey, l_linenumber, min(l_partkey) as l_partkey from lineitem group by 1, 2) group by 1, 2")
def member_cluster_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"))
    return clustering.member_table(one, "l_orderkey", "l_linenumber", "part")


@query()
def strong_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between classes of parts in five groups of orders: a class weighs its lines, an edge the suppliers' lines it shares."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 5).alias("g"), (F.col("l_partkey") % 12).alias("a"), (F.col("l_suppkey") % 12).alias("b"))
    vertices = li.select("g", F.col("a").alias("v")).union(li.select("g", F.col("b").alias("v"))).groupBy("g", "v").agg(F.count("*").alias("n"))
    e = li.groupBy("g", "a", "b").agg(F.count("*").alias("n")).filter("a < b").withColumn("orient", F.when((F.col("a") + F.col("b")) % 2 == 0, 1).otherwise(-1))
    return clustering.strong_edges(vertices, e, "g", 0.05)


@query()
def minor_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("g"), *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(6)], F.lit(1.0).alias("w"))
    out = clustering.minor_axes(e, "g", ["x0", "x1", "x2"], "w", ["x3", "x4", "x5"])
    return out.select("g", F.transform("axis", lambda v: F.round(v, 5)).alias("axis"))


@query()
def matched_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stats.contingency(table(spark, sf_dir, "embeddings").withColumn("other", F.col("vec_id") % 7), "label", "other")
    return clustering.matched_agreement(counts, "label", "other").select(F.round("agreement", 9).alias("agreement"))


_XYZ = "with p as (select vec_id, label, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings), "


@query(_XYZ + """w as (select vec_id, lag(x, 2) over w as x0, lag(y, 2) over w as y0, lag(z, 2) over w as z0, lag(x, 1) over w as x1, lag(y, 1) over w as y1, lag(z, 1) over w as z1, x as x2, y as y2, z as z2, lead(x, 1) over w as x3, lead(y, 1) over w as y3, lead(z, 1) over w as z3, lead(x, 2) over w as x4, lead(y, 2) over w as y4, lead(z, 2) over w as z4 from p window w as (partition by label order by vec_id)),
q as (select *, sqrt((x3 - x1)^2 + (y3 - y1)^2 + (z3 - z1)^2) as n, (x0 + x1 + x2 + x3 + x4) / 5 as mx, (y0 + y1 + y2 + y3 + y4) / 5 as my, (z0 + z1 + z2 + z3 + z4) / 5 as mz from w where x0 is not null and x4 is not null),
r as (select *, (x3 - x1) / n as ax, (y3 - y1) / n as ay, (z3 - z1) / n as az, 2 * x2 - x1 - x3 as tx, 2 * y2 - y1 - y3 as ty, 2 * z2 - z1 - z3 as tz from q),
s as (select *, tx - (ax * tx + ay * ty + az * tz) * ax as ux, ty - (ax * tx + ay * ty + az * tz) * ay as uy, tz - (ax * tx + ay * ty + az * tz) * az as uz from r),
t as (select *, ux / sqrt(ux * ux + uy * uy + uz * uz) as bx, uy / sqrt(ux * ux + uy * uy + uz * uz) as by_, uz / sqrt(ux * ux + uy * uy + uz * uz) as bz from s),
c as (select *, ay * bz - az * by_ as cx, az * bx - ax * bz as cy, ax * by_ - ay * bx as cz from t)
select vec_id, [round(ax * (x0 - mx) + ay * (y0 - my) + az * (z0 - mz), 6), round(bx * (x0 - mx) + by_ * (y0 - my) + bz * (z0 - mz), 6), round(cx * (x0 - mx) + cy * (y0 - my) + cz * (z0 - mz), 6), round(ax * (x1 - mx) + ay * (y1 - my) + az * (z1 - mz), 6), round(bx * (x1 - mx) + by_ * (y1 - my) + bz * (z1 - mz), 6), round(cx * (x1 - mx) + cy * (y1 - my) + cz * (z1 - mz), 6), round(ax * (x2 - mx) + ay * (y2 - my) + az * (z2 - mz), 6), round(bx * (x2 - mx) + by_ * (y2 - my) + bz * (z2 - mz), 6), round(cx * (x2 - mx) + cy * (y2 - my) + cz * (z2 - mz), 6), round(ax * (x3 - mx) + ay * (y3 - my) + az * (z3 - mz), 6), round(bx * (x3 - mx) + by_ * (y3 - my) + bz * (z3 - mz), 6), round(cx * (x3 - mx) + cy * (y3 - my) + cz * (z3 - mz), 6), round(ax * (x4 - mx) + ay * (y4 - my) + az * (z4 - mz), 6), round(bx * (x4 - mx) + by_ * (y4 - my) + bz * (z4 - mz), 6), round(cx * (x4 - mx) + cy * (y4 - my) + cz * (z4 - mz), 6)] as shape from c""")
def local_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plait.operators import windows

    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])
    out = windows.local_shapes(e, Window.partitionBy("label").orderBy("vec_id"), ["x", "y", "z"])
    return out.select("vec_id", F.transform("shape", lambda v: scalars.rounded(v, 6)).alias("shape"))


@query(_XYZ + """s as (select vec_id, lead(x, 1) over o - x as ux, lead(y, 1) over o - y as uy, lead(z, 1) over o - z as uz, lead(x, 2) over o - lead(x, 1) over o as vx, lead(y, 2) over o - lead(y, 1) over o as vy, lead(z, 2) over o - lead(z, 1) over o as vz, lead(x, 3) over o - lead(x, 2) over o as wx, lead(y, 3) over o - lead(y, 2) over o as wy, lead(z, 3) over o - lead(z, 2) over o as wz from p window o as (partition by label order by vec_id)),
n as (select *, uy * vz - uz * vy as px, uz * vx - ux * vz as py, ux * vy - uy * vx as pz, vy * wz - vz * wy as qx, vz * wx - vx * wz as qy, vx * wy - vy * wx as qz from s where wx is not null)
select vec_id, round(acos(greatest(-1, least(1, (ux * vx + uy * vy + uz * vz) / sqrt((ux * ux + uy * uy + uz * uz) * (vx * vx + vy * vy + vz * vz))))), 6) as alpha,
round(atan2((ux * qx + uy * qy + uz * qz) * sqrt(vx * vx + vy * vy + vz * vz), px * qx + py * qy + pz * qz), 6) as beta,
round(acos(greatest(-1, least(1, (vx * wx + vy * wy + vz * wz) / sqrt((vx * vx + vy * vy + vz * vz) * (wx * wx + wy * wy + wz * wz))))), 6) as gamma from n""")
def bond_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plait.operators import windows

    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])
    out = windows.bond_angles(e, Window.partitionBy("label").orderBy("vec_id"), "x", "y", "z")
    return out.select("vec_id", *[F.round(c, 6).alias(c) for c in ("alpha", "beta", "gamma")])


@query()
def family_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.family_consensus(_places(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query()
def orphans_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plait.operators import filters

    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    v = c.select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("v"), ((F.col("c_custkey") * 37 % 100) / 100.0).alias("occurrence"))
    e = o.select((F.col("o_orderkey") % 25).cast("int").alias("g"), F.col("o_custkey").alias("a"), ((F.col("o_custkey") * 3 + F.col("o_orderkey")) % 1500).alias("b"))
    return filters.without_orphans_in_order(v, e, "g", 0.6)
