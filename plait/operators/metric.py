"""Metric-space search over vectors: nearest neighbours, ranges, pivots, greedy pairs.

Rows belong to the cell of their nearest pivot and to a ring around it. A search looks at its own cell first, which bounds
the distance of what it is after; by the triangle inequality only rings within that bound of the query's distance to a
pivot can hold more, and rows are joined with the query by cell and ring. Results are exact for any metric.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plait.functions import kernels
from plait.functions.scalars import array_distance
from plait.operators.graphs import _cut
from plait.operators.windows import running_total

Distance = Callable[[Column, Column], Column]
#: Pivots at most, about the square root of the rows below that; parts of a cell; rings around a pivot.
PIVOTS, PARTS, RINGS = 512, 8, 16
#: Bytes of vectors in a block of a search in which every row is asked; a task holds two blocks.
BLOCK = 32 << 20


def pivot_table(df: DataFrame, key: str, vec: str, pivots: int, source: DataFrame | None = None, distance: Distance = array_distance) -> DataFrame:
    """Rows with ``to``: distances to the pivots, the first rows of the source by key."""
    if pivots > PIVOTS:
        raise ValueError(f"{PIVOTS} pivots at most are sent to all tasks")
    source = df if source is None else source
    chosen = source.orderBy(key).limit(pivots).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(vec).alias("v")))).alias("_p"))  # one row
    return df.crossJoin(F.broadcast(chosen)).withColumn("to", F.transform("_p", lambda p: distance(p["v"], F.col(vec)))).drop("_p")


def distance_ranges(table_a: DataFrame, table_b: DataFrame, key: str, parts: int = PARTS) -> DataFrame:
    """(a, b, low, high) for a <> b: what the triangle inequality says of their distance by pivot tables alone. table_a
    holds the stated rows; it meets table_b part by part."""
    x = table_a.select(F.col(key).alias("a"), F.col("to").alias("ta"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    y = table_b.select(F.col(key).alias("b"), F.col("to").alias("tb"), F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"))
    low, high = F.array_max(F.zip_with("ta", "tb", lambda s, t: F.abs(s - t))), F.array_min(F.zip_with("ta", "tb", lambda s, t: s + t))
    return x.join(y, "part").filter("a <> b").select("a", "b", low.alias("low"), high.alias("high"))


def _cells(df: DataFrame, key: str, vec: str, pivots: int, source: DataFrame, distance: Distance) -> DataFrame:
    """(k, v, to, cell, r): each row's distances to the pivots, its nearest one and the distance to that."""
    t = pivot_table(df.select(F.col(key).alias("k"), F.col(vec).alias("v")), "k", "v", pivots, source.select(F.col(key).alias("k"), F.col(vec).alias("v")), distance)
    return t.withColumn("r", F.array_min("to")).withColumn("cell", (F.array_position("to", F.col("r")) - 1).cast("int"))


def _first(df: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("a").orderBy("d", "b")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


class _Rings:
    """The rows of a search by cell and ring, with the radius of each cell."""

    def __init__(self, data: DataFrame, key: str, vec: str, pivots: int | None, distance: Distance, bound: Distance | None, source: DataFrame | None = None):
        self.key, self.vec, self.distance, self.bound = key, vec, distance, bound
        self.source = data if source is None else source
        self.pivots = pivots or max(1, min(PIVOTS, math.isqrt(data.count())))
        self.rows = _cut(_cells(data, key, vec, self.pivots, self.source, distance).select(F.col("k").alias("b"), F.col("v").alias("vb"), "cell", "r"))
        radii = {r.cell: r.top for r in self.rows.groupBy("cell").agg(F.max("r").alias("top")).collect()}  # PIVOTS rows at most
        self.radii = [radii.get(c, -1.0) for c in range(self.pivots)]
        self.width = max(max(self.radii, default=0.0) / RINGS, 1e-12)

    def asked(self, queries: DataFrame) -> DataFrame:
        return _cells(queries, self.key, self.vec, self.pivots, self.source, self.distance).select(F.col("k").alias("a"), F.col("v").alias("va"), "to", "cell", "r")

    def _met(self, x: DataFrame, y: DataFrame, on: list[str], wanted: Column, most: Column | None = None) -> DataFrame:
        met = x.join(y, on).filter(wanted)
        if self.bound is not None and most is not None:
            met = met.filter(self.bound(F.col("va"), F.col("vb")) <= most)
        return met.withColumn("d", self.distance(F.col("va"), F.col("vb")))

    def near(self, asked: DataFrame, k: int, wanted: Column) -> DataFrame:
        """(a, u): the k-th distance among the rows of the query's own cell, missing where these are fewer."""
        x = asked.select("a", "va", "cell", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
        y = self.rows.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PARTS)).cast("int"))
        return _first(self._met(x, y, ["cell", "part"], wanted).select("a", "b", "d"), k).filter(F.col("rank") == k).select("a", F.col("d").alias("u"))

    def within(self, asked: DataFrame, wanted: Column) -> DataFrame:
        """(a, b, d) of all rows within u of each query (a, va, to, r, u), everything where u is null."""
        u = F.coalesce(F.col("u") + 1e-9, F.lit(float("inf")))
        radii, w = F.array(*[F.lit(x) for x in self.radii]), self.width

        def rings(far: Column, top: Column) -> Column:
            low, high = F.greatest(F.lit(0.0), far - u), F.least(top, far + u)
            near = (top >= 0) & (low <= high) & (far - F.col("r") <= 2 * u)  # a row of the cell is no nearer to another pivot
            return F.when(near, F.sequence(F.floor(low / w).cast("int"), F.floor(F.least(high, top) / w).cast("int"))).otherwise(F.array().cast("array<int>"))

        cells = F.posexplode(F.arrays_zip(F.col("to").alias("far"), radii.alias("top"))).alias("cell", "z")
        x = asked.select("a", "va", "r", "u", cells).withColumn("ring", F.explode(rings(F.col("z.far"), F.col("z.top")))).drop("z", "r")
        y = self.rows.withColumn("ring", F.floor(F.col("r") / w).cast("int")).drop("r")
        return self._met(x, y, ["cell", "ring"], wanted, u).filter(F.col("d") <= u).select("a", "b", "d")

    def nearest(self, queries: DataFrame, k: int, wanted: Column) -> DataFrame:
        asked = _cut(self.asked(queries))
        known = asked.join(self.near(asked, k, wanted), "a", "left")
        return _first(self.within(known, wanted), k)


def knn(queries: DataFrame, data: DataFrame, key: str, vec: str, k: int, pivots: int | None = None, distance: Distance = array_distance, bound: Distance | None = None) -> DataFrame:
    """(a, b, d, rank): the k nearest of each query other than itself, ties to the smaller key. Exact. bound: a cheap
    lower bound of the distance, asked before it."""
    return _Rings(data, key, vec, pivots, distance, bound).nearest(queries, k, F.col("a") != F.col("b"))


def knn_by_parts(queries: DataFrame, data: DataFrame, key: str, vec: str, k: int, parts: int = PARTS, distance: Distance = array_distance) -> DataFrame:
    """The same without an index, for measures that are no metric: stated queries meet all rows, part by part."""
    x = queries.select(F.col(key).alias("a"), F.col(vec).alias("va"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    y = data.select(F.col(key).alias("b"), F.col(vec).alias("vb"), F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"))
    return _first(x.join(y, "part").filter("a <> b").select("a", "b", distance(F.col("va"), F.col("vb")).alias("d")), k)


def range_query(queries: DataFrame, data: DataFrame, key: str, vec: str, radius: float, pivots: int | None = None, distance: Distance = array_distance, bound: Distance | None = None) -> DataFrame:
    """(a, b, d) of rows within the radius of each query, other than itself."""
    rings = _Rings(data, key, vec, pivots, distance, bound)
    asked = rings.asked(queries).withColumn("u", F.lit(float(radius)))
    return rings.within(asked, F.col("a") != F.col("b")).filter(F.col("d") <= radius)


def _older_by_blocks(data: DataFrame, key: str, vec: str, k: int) -> DataFrame:
    """(a, b, d): the k nearest rows of smaller key, by plain distance. Every row is asked, so rows are dealt into blocks
    of BLOCK bytes by key and each two blocks meet in one task: a row moves once a block, however little its distances
    to pivots rule out. A task prunes by parts of its blocks. Vectors that are null or hold null or non-finite
    components take no part."""
    whole = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    own = data.select(F.col(key).cast("long").alias("k"), F.col(vec).cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & whole)
    size = own.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("values")).first()
    blocks = max(1, -(-8 * size["values"] // BLOCK), min(4, -(-size["n"] // 4096)))
    dealt = _cut(own.repartitionByRange(blocks, "k").withColumn("block", F.spark_partition_id()))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    met = dealt.withColumn("_other", other).select(F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"), "block", "k", "v")

    def search(part: pa.Table) -> pa.Table:
        i, j = part.column("i")[0].as_py(), part.column("j")[0].as_py()
        block, keys, lists = part.column("block").to_numpy(), part.column("k").to_numpy(), part.column("v").combine_chunks()
        n = np.unique(np.diff(lists.offsets.to_numpy()))
        if len(n) != 1:
            raise ValueError("vectors differ in length")
        x = lists.flatten().to_numpy().reshape(len(keys), int(n[0]))
        late, early = block == j, block == i
        a, b, d = kernels.nearest_before(keys[late], x[late], keys[early], x[early], k)
        return pa.table({"a": a, "b": b, "d": d})

    found = met.groupBy("i", "j").applyInArrow(search, "a long, b long, d double")
    return _first(found, k).drop("rank")


def nearest_older(data: DataFrame, key: str, vec: str, pivots: int | None = None, distance: Distance = array_distance) -> DataFrame:
    """Each row's nearest row of smaller key: by blocks for the plain distance, else by cells and rings."""
    if distance is array_distance and pivots is None:
        return _older_by_blocks(data, key, vec, 1)
    rings = _Rings(data, key, vec, pivots, distance, None)
    return rings.nearest(data, 1, F.col("b") < F.col("a")).select("a", "b", "d")


def nearest_pairs(data: DataFrame, key: str, vec: str, rounds: int, distance: Distance = array_distance) -> DataFrame:
    """The closest pair, then the closest of the rest, and so on: (a, b, d, step). A pair is a row and one of its
    2 * rounds - 1 nearest of smaller key, as fewer rows have gone before it; each round is one aggregate over these."""
    most = 2 * rounds - 1
    older = _older_by_blocks(data, key, vec, most) if distance is array_distance else _Rings(data, key, vec, None, distance, None).nearest(data, most, F.col("b") < F.col("a"))
    near = _cut(older.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    out, used = [], []
    for step in range(rounds):
        rest = near.filter(~F.col("a").isin(*used) & ~F.col("b").isin(*used)) if used else near
        best = rest.agg(F.min(F.struct("d", "a", "b")).alias("m")).first().m
        if best is None:
            break
        out.append((best.a, best.b, best.d, step))
        used += [best.a, best.b]
    return data.sparkSession.createDataFrame(out, "a long, b long, d double, step int")


class MetricIndex:
    """Vectors in a folder that can be added to, taken from and searched: rows (k, v, cell, r) by the pivots of its
    beginning, and the keys that were taken out. Searches are exact for any metric that the folder is opened with."""

    def __init__(self, spark: SparkSession, path: str, distance: Distance = array_distance):
        self.spark, self.path, self.distance = spark, path, distance

    @classmethod
    def build(cls, data: DataFrame, key: str, vec: str, path: str, pivots: int | None = None, distance: Distance = array_distance) -> MetricIndex:
        out = cls(data.sparkSession, path, distance)
        own = data.select(F.col(key).cast("long").alias("k"), F.col(vec).cast("array<double>").alias("v"))
        n = pivots or max(1, min(PIVOTS, math.isqrt(own.count())))
        own.orderBy("k").limit(n).write.parquet(f"{path}/pivots")
        own.limit(0).withColumn("batch", F.lit(0)).write.parquet(f"{path}/rows")
        own.limit(0).select("k").withColumn("batch", F.lit(0)).write.parquet(f"{path}/gone")
        out.insert(own, "k", "v")
        return out

    def _batch(self) -> int:
        """Number of the next change; a row counts when no later change took its key."""
        tops = [self.spark.read.parquet(f"{self.path}/{t}").agg(F.max("batch").alias("n")).first().n for t in ("rows", "gone")]
        return 1 + max((t for t in tops if t is not None), default=0)

    def insert(self, data: DataFrame, key: str, vec: str) -> None:
        """A key that is there already is an error."""
        own = data.select(F.col(key).cast("long").alias("k"), F.col(vec).cast("array<double>").alias("v"))
        known = own.join(self.rows().select(F.col("k").alias("_k")), F.col("k") == F.col("_k"), "left")
        checked = known.select(F.when(F.col("_k").isNull(), F.col("k")).otherwise(F.raise_error(F.lit("a key is there already")).cast("long")).alias("k"), "v")
        checked.withColumn("batch", F.lit(self._batch())).write.mode("append").parquet(f"{self.path}/rows")

    def delete(self, keys: DataFrame, key: str) -> None:
        keys.select(F.col(key).cast("long").alias("k")).withColumn("batch", F.lit(self._batch())).write.mode("append").parquet(f"{self.path}/gone")

    def rows(self) -> DataFrame:
        gone = self.spark.read.parquet(f"{self.path}/gone").groupBy("k").agg(F.max("batch").alias("_gone"))
        return self.spark.read.parquet(f"{self.path}/rows").join(gone, "k", "left").filter("_gone is null or batch > _gone").select("k", "v")

    def __len__(self) -> int:
        return self.rows().count()

    def contains(self, keys: DataFrame, key: str) -> DataFrame:
        return keys.join(self.rows().select(F.col("k").alias(key), F.lit(True).alias("found")), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))

    def _rings(self, bound: Distance | None = None) -> _Rings:
        pivots = self.spark.read.parquet(f"{self.path}/pivots")
        return _Rings(self.rows(), "k", "v", pivots.count(), self.distance, bound, pivots)

    def knn(self, queries: DataFrame, key: str, vec: str, k: int, bound: Distance | None = None) -> DataFrame:
        own = queries.select(F.col(key).alias("k"), F.col(vec).alias("v"))
        return self._rings(bound).nearest(own, k, F.col("a") != F.col("b"))

    def within(self, queries: DataFrame, key: str, vec: str, radius: float, bound: Distance | None = None) -> DataFrame:
        rings = self._rings(bound)
        asked = rings.asked(queries.select(F.col(key).alias("k"), F.col(vec).alias("v"))).withColumn("u", F.lit(float(radius)))
        return rings.within(asked, F.col("a") != F.col("b")).filter(F.col("d") <= radius)

    def pop_nearest_pair(self) -> tuple[int, int, float] | None:
        """The closest pair, which leaves the index; None when there is none."""
        best = nearest_pairs(self.rows(), "k", "v", 1, self.distance).first()
        if best is None:
            return None
        self.delete(self.spark.createDataFrame([(best.a,), (best.b,)], "k long"), "k")
        return best.a, best.b, best.d

    def statistics(self, queries: DataFrame, key: str, vec: str, k: int) -> DataFrame:
        """One row: distances that a search for the k nearest computes, and that a scan would."""
        rings = self._rings()
        asked = _cut(rings.asked(queries.select(F.col(key).alias("k"), F.col(vec).alias("v"))))
        known = asked.join(rings.near(asked, k, F.col("a") != F.col("b")), "a", "left")
        rows = rings.rows.count()
        own = asked.groupBy("cell").agg(F.count("*").alias("q")).join(rings.rows.groupBy("cell").agg(F.count("*").alias("n")), "cell").agg(F.coalesce(F.sum(F.col("q") * F.col("n")), F.lit(0)).alias("n"))
        seen = rings.within(known.withColumn("u", F.col("u")), F.lit(True)).agg(F.count("*").alias("kept"))
        return own.crossJoin(F.broadcast(seen)).select((F.col("n") + F.lit(rings.pivots) * F.lit(asked.count())).alias("computed_first"), "kept", F.lit(rows * asked.count()).alias("scan"))


def triangle_violations(pairs: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """One row: how many (a, b, pivot) of measured pairs (a, b, d) and the pivots of the table break the inequality."""
    x = pairs.join(table.select(F.col(key).alias("a"), F.col("to").alias("ta")), "a").join(table.select(F.col(key).alias("b"), F.col("to").alias("tb")), "b")
    bad = F.filter(F.zip_with("ta", "tb", lambda s, t: (F.col("d") > s + t + 1e-9) | (F.abs(s - t) > F.col("d") + 1e-9)), lambda v: v)
    return x.agg(F.coalesce(F.sum(F.size(bad)), F.lit(0)).cast("long").alias("violations"), F.count("*").alias("pairs"))


def length_bins(asked: DataFrame, df: DataFrame, key: str, length: str, most: float, parts: int = PARTS) -> DataFrame:
    """Pairs of a stated row and another whose lengths differ by no more than 2 * most, found in bins of that width: the
    cheap bound half the difference in length, before any alignment. Lengths may be few, so the other rows of a bin are
    dealt into parts, in as many tasks as these have though little moves. They go first: a merge keeps the stated rows of
    a bin, and pairs come out by b, with the same few a again and again, which files store in less space."""
    width = 2 * most
    near = F.explode(F.array(*[F.floor(F.col(length) / width) + i for i in (-1, 0, 1)])).alias("bin")
    x = asked.select(F.col(key).alias("a"), F.col(length).alias("la"), near).select("a", "la", "bin", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    y = df.select(F.col(key).alias("b"), F.col(length).alias("lb"), F.floor(F.col(length) / width).alias("bin"), F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"))
    x, y = (z.repartition(4 * parts, "bin", "part") for z in (x, y))
    return y.join(x, ["bin", "part"]).filter((F.col("a") != F.col("b")) & (F.abs(F.col("la") - F.col("lb")) <= width)).select("a", "b", (F.abs(F.col("la") - F.col("lb")) / 2).alias("bound"))


def split_by_median(df: DataFrame, key: str, distance: Column) -> DataFrame:
    """Each row's half (0 near, 1 far) of the distances to a vantage point; rows at the median take turns by key. The
    median comes from the counts of values, which are summed before they are sorted."""
    d = df.withColumn("_d", distance)
    counts = d.groupBy("_d").agg(F.count("*").alias("n"))
    placed = running_total(counts, "_d", "n").withColumn("_all", F.lit(d.count()))
    low = placed.filter("upto >= (_all + 1) div 2").agg(F.min("_d").alias("_l"))
    high = placed.filter("upto >= _all div 2 + 1").agg(F.min("_d").alias("_h"))
    mid = low.crossJoin(high).select(((F.col("_l") + F.col("_h")) / 2).alias("_m"))  # one row
    w = Window.partitionBy("_d").orderBy(key)
    return d.crossJoin(F.broadcast(mid)).withColumn("half", F.when(F.col("_d") < F.col("_m"), 0).when(F.col("_d") > F.col("_m"), 1).otherwise((F.row_number().over(w) - 1) % 2)).drop("_d", "_m")
