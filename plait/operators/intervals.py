"""Inclusive integer intervals: parsing, overlap joins, coalescing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .filters import INT_MAX, INT_MIN


def parse(ranges: Column) -> Column:
    """"1:50,120:" to array<struct<start,end>>; a missing end is open, an empty text is everything."""
    part = F.split(F.coalesce(F.nullif(F.trim(ranges), F.lit("")), F.lit(":")), ",")

    def one(x: Column) -> Column:
        ends = F.split(x, ":")
        start, end = F.try_element_at(ends, F.lit(1)), F.try_element_at(ends, F.lit(-1))
        return F.struct(F.coalesce(start.try_cast("int"), F.lit(INT_MIN)).alias("start"), F.coalesce(end.try_cast("int"), F.lit(INT_MAX)).alias("end"))

    return F.transform(part, one)


def count(ranges: Column) -> Column:
    """Numbers in an array of ranges."""
    return F.aggregate(ranges, F.lit(0).cast("long"), lambda n, r: n + r["end"].cast("long") - r["start"].cast("long") + 1)


def overlap_join(left: DataFrame, right: DataFrame, key: str, width: int = 64) -> DataFrame:
    """Pairs of overlapping intervals (key, start, end, ...) with the overlap. An interval lies at the level whose bins,
    ``width`` numbers doubled level by level, are as long as it is, so in two of them at most; the shorter of a pair is
    sent up to the levels of longer ones. Open ends cost no more than others, and a pair is reported in the bin where
    its overlap begins."""

    def own(df: DataFrame, p: str) -> DataFrame:
        named = df.select(F.col(key), *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != key]).filter(F.col(f"{p}_start") <= F.col(f"{p}_end"))
        size = F.col(f"{p}_end").cast("long") - F.col(f"{p}_start") + 1
        return named.withColumn("_level", F.ceil(F.log2(F.greatest(size / width, F.lit(1.0)))).cast("int"))

    def bins(df: DataFrame, p: str) -> DataFrame:
        step = F.pow(F.lit(2.0), "_level") * width
        return df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(f"{p}_start") / step), F.floor(F.col(f"{p}_end") / step))))

    def up(df: DataFrame, p: str, strictly: bool) -> DataFrame:
        higher = F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x > F.col("_level") if strictly else x >= F.col("_level"))
        return bins(df.withColumn("_level", F.explode(higher)), p)

    x, y = own(left, "l"), own(right, "r")
    levels = sorted(r[0] for r in x.select("_level").union(y.select("_level")).distinct().collect())  # one for each power of two
    if not levels:
        levels = [0]
    on = [key, "_level", "_bin"]
    longer_left, longer_right = bins(x, "l").join(up(y, "r", False), on), up(x, "l", True).join(bins(y, "r"), on)
    both = longer_left.unionByName(longer_right)
    start, end = F.greatest("l_start", "r_start"), F.least("l_end", "r_end")
    first = F.floor(F.col("start") / (F.pow(F.lit(2.0), "_level") * width))
    return both.withColumn("start", start).withColumn("end", end).filter("start <= end").filter(F.col("_bin") == first).drop("_bin", "_level")


def coalesce(df: DataFrame, key: str, gap: int = 1) -> DataFrame:
    """Unions of intervals (key, start, end) that overlap or lie within ``gap``."""
    w = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= F.col("_before") + gap, 0).otherwise(1)).over(w)
    return df.select(key, "start", "end").withColumn("_before", before).withColumn("_island", island).groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def include_loops(df: DataFrame, key: str, order: str, max_loop: int) -> DataFrame:
    """Joins each interval, in the order given, to the one before when the loop between is short enough."""
    w = Window.partitionBy(key).orderBy(order)
    near = F.col("start") - F.lag("end").over(w) - 1 <= max_loop
    return df.withColumn("_new", F.when(near, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(w)).groupBy(key, "_island").agg(F.min_by("start", order).alias("start"), F.max_by("end", order).alias("end")).drop("_island")
