"""Graph operators on edge tables. Loops write their frontier to the checkpoint folder, so lineage stays short."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scratch_path(spark: SparkSession) -> str:
    """A new path in the folder that all executors share."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        import tempfile

        found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="plait-"))
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def _cut(df: DataFrame) -> DataFrame:
    """The rows written and read again, until the driver ends. A checkpoint would keep the constraints of its plan, which
    double each round."""
    where = scratch_path(df.sparkSession)
    df.write.parquet(where)
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def normalise(edges: DataFrame) -> DataFrame:
    """Undirected edges (a, b) with a < b, once each; loops go."""
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return both.groupBy(F.col("a").alias("v")).agg(F.array_sort(F.collect_list("b")).alias("near"))


def components(edges: DataFrame) -> DataFrame:
    """(v, component): the smallest vertex reached, by turns of large and small stars: the larger neighbours of a vertex,
    then the smaller ones, are tied to the least vertex among it and its neighbours, until nothing moves. Least
    neighbours are found by sums before the shuffle, so a hub costs its edges only."""
    now = _cut(normalise(edges).select(F.col("b").alias("u"), F.col("a").alias("v")))  # u > v
    all_vertices = vertices(edges)
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = _cut(large.filter("u <> v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = _cut(small.distinct())
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            return all_vertices.join(now.select(F.col("u").alias("v"), F.col("v").alias("component")), "v", "left").withColumn("component", F.coalesce("component", "v"))
        seen = mark


def closure(edges: DataFrame, most: int = 64) -> DataFrame:
    """All (a, b) with a path from a to b, by doubling: after k rounds, paths of up to 2^k edges. A cycle shows as a
    pair (a, a)."""
    known = _cut(edges.select("a", "b").distinct())
    size = known.count()
    for _ in range(most):
        longer = known.select("a", F.col("b").alias("m")).join(known.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
        known = _cut(known.union(longer).distinct())
        grown = known.count()
        if grown == size:
            return known
        size = grown
    return known


def reduction(edges: DataFrame) -> DataFrame:
    """The fewest edges with the same closure; a cycle is an error."""
    whole = closure(edges)
    if not whole.filter("a = b").isEmpty():
        raise ValueError("the graph has a cycle")
    two = whole.select("a", F.col("b").alias("m")).join(whole.select(F.col("a").alias("m"), "b"), "m").select("a", "b").distinct()
    return whole.join(two, ["a", "b"], "left_anti")


def levels(edges: DataFrame) -> DataFrame:
    """(v, level): edges on the longest path that leads to v, from 0."""
    out = _cut(vertices(edges).withColumn("level", F.lit(0)))
    n = out.count()
    for _ in range(n + 1):
        up = edges.join(out.withColumnRenamed("v", "a"), "a").groupBy(F.col("b").alias("v")).agg((F.max("level") + 1).alias("up"))
        after = _cut(out.join(up, "v", "left").select("v", F.coalesce("up", F.lit(0)).alias("level"), F.col("level").alias("old")))
        done = after.filter("level <> old").isEmpty()
        out = after.select("v", "level")
        if done:
            return out
    raise ValueError("the graph has a cycle")


def topological_order(edges: DataFrame) -> DataFrame:
    """(v, position) by level, then vertex. Levels are counted first, so that ranks need no single-task sort of all
    vertices: rank within a level plus the vertices of lower levels."""
    own = levels(edges)
    sizes = own.groupBy("level").agg(F.count("*").alias("n"))
    before = sizes.select("level", (F.sum("n").over(Window.orderBy("level")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("level").orderBy("v"))
    return own.withColumn("_r", inside).join(before, "level").select("v", "level", (F.col("before") + F.col("_r") - 1).alias("position"))


def merge_vertices(left: DataFrame, right: DataFrame, matching: DataFrame) -> DataFrame:
    """(l, r, kind) for vertices only on the left, only on the right, and matched, in that order of kind."""
    x = left.select(F.col("v").alias("l")).join(matching, "l", "left")
    y = right.select(F.col("v").alias("r")).join(matching.select("r"), "r", "left_anti")
    return x.select("l", "r", F.when(F.col("r").isNull(), "left").otherwise("matched").alias("kind")).union(y.select(F.lit(None).cast("long").alias("l"), "r", F.lit("right").alias("kind")))


def edge_counts(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, orient, n): edges between labels, from edges (a, b, orient) of elements and their labels (v, label);
    unlabelled elements don't count."""
    known = labels.filter(F.col("label").isNotNull())
    x = edges.join(known.select(F.col("v").alias("a"), F.col("label").alias("la")), "a").join(known.select(F.col("v").alias("b"), F.col("label").alias("lb")), "b")
    return x.groupBy(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"), "orient").agg(F.count("*").alias("n"))


def path_edges(df: DataFrame, key: str, order: list[str], v: str) -> DataFrame:
    """The path graph of each sequence: (a, b) for neighbours."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.select(F.col(v).alias("a"), F.lead(v).over(w).alias("b")).filter("b is not null")


def local_edges(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """Edges (a, b) of global ids as (member, i, j) positions (v, member, pos); ends in two members are an error."""
    x = edges.join(positions.select(F.col("v").alias("a"), F.col("member").alias("ma"), F.col("pos").alias("i")), "a").join(positions.select(F.col("v").alias("b"), F.col("member").alias("mb"), F.col("pos").alias("j")), "b")
    return x.select(F.when(F.col("ma") == F.col("mb"), F.col("ma")).otherwise(F.raise_error(F.lit("an edge joins two members")).cast("long")).alias("member"), "i", "j")


def long_path_exists(edges: DataFrame) -> DataFrame:
    """Edges (a, b) beside which a longer path leads from a to b."""
    whole = closure(edges)
    two = edges.select("a", F.col("b").alias("m")).join(whole.select(F.col("a").alias("m"), "b"), "m").select("a", "b").distinct()
    return edges.join(two, ["a", "b"], "left_semi")


def incident_edges(edges: DataFrame) -> DataFrame:
    """(v, edges): ids of the edges (id, a, b) at each vertex, in order; a loop counts once."""
    ends = edges.select("id", F.explode(F.array("a", "b")).alias("v")).distinct()
    return ends.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("edges"))


def path_labels_unique(edges: DataFrame) -> DataFrame:
    """One row: whether no directed path of edges (a, b, label) has a label twice. Labels flow along the edges, each kept
    once a vertex, until nothing new arrives."""
    own = _cut(edges.select("a", "b", "label").distinct())
    known = _cut(own.select(F.col("b").alias("v"), "label").distinct())
    fresh = known
    while not fresh.isEmpty():
        further = fresh.join(own.select(F.col("a").alias("v"), "b"), "v").select(F.col("b").alias("v"), "label").distinct()
        fresh = _cut(further.join(known, ["v", "label"], "left_anti"))
        known = _cut(known.union(fresh))
    twice = own.join(known.withColumnRenamed("v", "a"), ["a", "label"], "left_semi")
    return twice.agg((F.count("*") == 0).alias("is_unique"))
