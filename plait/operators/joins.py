"""Mapping joins: numbering schemes, accession mappings, positions under gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def convert_numbering(ranges: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Ranges (key, start, end) from one numbering to the other by mapping (key, number, other); numbers with an
    insertion mark (ins not null) don't count. A missing end keeps null."""
    own = mapping.filter("ins is null").select(key, "number", "other")
    s = own.select(key, F.col("number").alias("start"), F.col("other").alias("new_start"))
    e = own.select(key, F.col("number").alias("end"), F.col("other").alias("new_end"))
    return ranges.join(s, [key, "start"], "left").join(e, [key, "end"], "left")


def flatten_mapping(df: DataFrame, owner: str, codes: str) -> DataFrame:
    """(owner, code, n, warning) of rows with an array of codes: one row a code; none or several are noted."""
    n = F.size(F.coalesce(F.col(codes), F.array().cast("array<string>")))
    warning = F.when(n == 0, "no code").when(n > 1, "several codes")
    return df.select(owner, F.explode_outer(codes).alias("code"), n.alias("n"), warning.alias("warning"))


def under_first_code(df: DataFrame, owner: str, code: str, item: str) -> DataFrame:
    """Items of each owner under its least code: (code, items in order, owners, several)."""
    own = df.groupBy(owner).agg(F.min(code).alias("code"), (F.count_distinct(code) > 1).alias("several"))
    return df.select(owner, item).distinct().join(own, owner).groupBy("code").agg(F.array_sort(F.collect_set(item)).alias("items"), F.count_distinct(owner).alias("owners"), F.max("several").alias("several"))


def duplicity(pairs: DataFrame, shared: str, a: str, b: str) -> DataFrame:
    return pairs.withColumn("duplicity", F.col(shared) / F.least(a, b))


def path_scores(matches: DataFrame, group: list[str], squared: str, single: str, gap: float) -> DataFrame:
    """Summed squared distances of matched positions plus a penalty for each unmatched one, and their deviation."""
    return matches.groupBy(*group).agg((F.sum(F.when(F.col(single), gap).otherwise(F.col(squared)))).alias("score"), F.sqrt(F.avg(F.when(~F.col(single), F.col(squared)))).alias("rmsd"))


def by_keys(df: DataFrame, index: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with the value that the index has for their composite key; a key that it lacks is an error."""
    found = df.join(index.select(*keys, F.col(value).alias("_v"), F.lit(True).alias("_there")), keys, "left")
    checked = F.when(F.col("_there"), F.col("_v")).otherwise(F.raise_error(F.concat(F.lit("unknown key "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))).cast(dict(index.dtypes)[value]))
    return found.withColumn(value, checked).drop("_v", "_there")


def each_to_each(stated: DataFrame, others: DataFrame, on: list[str], f, name: str = "value") -> DataFrame:
    """f over pairs of a stated row and each other row of its block (the columns in on): as many rows as pairs, so blocks
    are to be small or the stated rows few."""
    x = stated.select(*on, *[F.col(c).alias(f"a_{c}") for c in stated.columns if c not in on])
    y = others.select(*on, *[F.col(c).alias(f"b_{c}") for c in others.columns if c not in on])
    return x.join(y, on).withColumn(name, f)


def with_labels(df: DataFrame, key: str, manual: DataFrame, label: str) -> DataFrame:
    """Rows with a label given by hand where there is one, else their own key."""
    return df.join(manual.select(key, F.col(label).alias("_l")), key, "left").withColumn(label, F.coalesce("_l", F.col(key).cast("string"))).drop("_l")


def substitution_scores(pairs: DataFrame, table: DataFrame, a: str, b: str, default: float = 0.0) -> DataFrame:
    """Pairs of letters with their score from a table (x, y, score) of either order; a table of letters is small."""
    both = table.select("x", "y", "score").union(table.select("y", "x", "score")).groupBy("x", "y").agg(F.max("score").alias("score"))
    return pairs.join(both.select(F.col("x").alias(a), F.col("y").alias(b), "score"), [a, b], "left").withColumn("score", F.coalesce("score", F.lit(default)))


def name_occurrence(points: DataFrame, member: str, name: str) -> DataFrame:
    """(name, found_in, share) of point names over members, to match them by name."""
    total = points.agg(F.count_distinct(member).alias("_n"))
    return points.groupBy(name).agg(F.count_distinct(member).alias("found_in")).crossJoin(F.broadcast(total)).select(name, "found_in", (F.col("found_in") / F.col("_n")).alias("share"))
