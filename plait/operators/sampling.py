"""Ordering, top-k and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def most_common(df: DataFrame, keys: list[str], k: int | None = None) -> DataFrame:
    """Groups by falling size, ties by key; sizes are compared as numbers."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)
    return out if k is None else out.limit(k)


def hash_sample(df: DataFrame, name: Column, size: int, tie: list[str]) -> DataFrame:
    """A sample that depends on the names alone: the first by their sha1. Larger samples contain smaller ones."""
    return df.orderBy(F.sha1(name.cast("binary")), *tie).limit(size)


def uniform_sample(df: DataFrame, size: int, order: list[str], seed: int = 0) -> DataFrame:
    """Rows without replacement, in their own order; all rows if there are fewer."""
    return df.orderBy(F.xxhash64(F.lit(seed), *order), *order).limit(size).orderBy(*order)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column | str], k: int) -> DataFrame:
    """The first k rows of each group; Spark limits them before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def centre(pairs: DataFrame, how: str = "sum") -> DataFrame:
    """The member with the least summed (or largest) score over pairs (a, b, score) of both orders, ties to the smaller."""
    both = pairs.select("a", "score").union(pairs.select(F.col("b").alias("a"), "score"))
    total = both.groupBy("a").agg((F.max("score") if how == "minmax" else F.sum("score")).alias("total"))
    return total.orderBy("total", "a").limit(1)


def median_member(df: DataFrame, length: str, key: str) -> DataFrame:
    """The member of median length (the lower of two), by rank: one row."""
    n = df.count()
    return df.orderBy(length, key).offset((n - 1) // 2).limit(1)
