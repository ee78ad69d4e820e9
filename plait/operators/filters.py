"""Row selection: membership, inclusive ranges, null-safe negation, first model, traces, occurrence thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

INT_MIN, INT_MAX = -(1 << 31), (1 << 31) - 1


def equals_any(col: Column, values: Sequence) -> Column:
    return col.isin(*values) if values else F.lit(False)


def in_ranges(col: Column, ranges: Sequence[tuple[int | None, int | None]]) -> Column:
    """Inclusive ranges joined by or, open where an end is None; null values and an empty list select nothing."""
    out = F.lit(False)
    for start, end in ranges:
        out = out | col.between(INT_MIN if start is None else start, INT_MAX if end is None else end)
    return F.coalesce(out, F.lit(False))


def in_range_array(col: Column, ranges: Column) -> Column:
    """The same against a column array<struct<start,end>>."""
    return F.coalesce(F.exists(ranges, lambda r: (col >= r["start"]) & (col <= r["end"])), F.lit(False))


def negate(predicate: Column) -> Column:
    """The complement of what the predicate selects: rows where it is null are selected."""
    return ~F.coalesce(predicate, F.lit(False))


def is_missing(col: Column) -> Column:
    """The two null marks of the tag-value format."""
    return col.isin(".", "?")


def polymer(number: Column) -> Column:
    """Rows of polymers are those with a residue number."""
    return number.isNotNull()


def heavy_atoms(symbol: Column, alternative: Column) -> Column:
    """No hydrogen, and of alternative places the first."""
    return (symbol != "H") & F.coalesce(alternative.isin(".", "A"), F.lit(True))


def selected(df: DataFrame, selector: str, group: str, order: str, chain: str, number: str) -> DataFrame:
    """Rows of each group that a selector names: "A" a chain's first unbroken stretch of rows, "A:10" that stretch from
    the first row with the number on, "A:10:B:50" everything from the first row of the one to the rows of the other that
    follow each other, over chains between them."""
    part = selector.split(":")
    w = Window.partitionBy(group).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    begins = F.col(chain) == part[0]
    if len(part) > 1:
        begins = begins & (F.col(number) == int(part[1]))
    out = df.withColumn("_in", F.max(F.when(begins, 1).otherwise(0)).over(upto))
    if len(part) < 4:
        ends = (F.col("_in") == 1) & ~F.coalesce(F.col(chain) == part[0], F.lit(False))
        out = out.withColumn("_out", F.max(F.when(ends, 1).otherwise(0)).over(upto))
    else:
        last = (F.col("_in") == 1) & (F.col(chain) == part[2]) & (F.col(number) == int(part[3]))
        out = out.withColumn("_last", F.coalesce(last, F.lit(False)))
        passed = F.lag("_last").over(w) & ~F.col("_last")
        out = out.withColumn("_out", F.max(F.when(passed, 1).otherwise(0)).over(upto))
    return out.filter("_in = 1 and _out = 0").drop("_in", "_out", "_last")


def first_index_where(df: DataFrame, group: str, order: str, wanted: Column) -> DataFrame:
    """(group, place): the place from 0 of each group's first wanted row, null where there is none."""
    w = Window.partitionBy(group).orderBy(order)
    own = df.withColumn("_i", F.row_number().over(w) - 1)
    return own.groupBy(group).agg(F.min(F.when(wanted, F.col("_i"))).alias("place"))


def by_row_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def first_model(df: DataFrame, group: str, model: str, row: str) -> DataFrame:
    """Rows of each group's first model, the one of its first row."""
    first = df.groupBy(group).agg(F.min_by(F.struct(model), row).alias("_first"))
    return df.join(first, group).filter(F.col(model).eqNullSafe(F.col("_first")[model])).drop("_first")


def trace(df: DataFrame, group: str, order: list[str], number: str, wanted: Column) -> DataFrame:
    """Wanted rows without consecutive repeats of number."""
    w = Window.partitionBy(group).orderBy(*order)
    kept = df.filter(wanted & F.col(number).isNotNull())
    return kept.withColumn("_before", F.lag(number).over(w)).filter(~F.col("_before").eqNullSafe(F.col(number))).drop("_before")


def by_length(df: DataFrame, kind: str, length: Column, least: dict[str, int], default: int = 0) -> DataFrame:
    """Rows at least as long as the threshold of their type."""
    limit = F.lit(default)
    for k, v in least.items():
        limit = F.when(F.col(kind) == k, v).otherwise(limit)
    return df.filter(length >= limit)


def occurrence_filter(vertices: DataFrame, edges: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Vertices (v, occurrence) that reach the threshold, and edges (a, b, ...) between them."""
    kept = vertices.filter(F.col("occurrence") >= least)
    a, b = kept.select(F.col("v").alias("a")), kept.select(F.col("v").alias("b"))
    return kept, edges.join(a, "a", "left_semi").join(b, "b", "left_semi")


def without_orphans(vertices: DataFrame, edges: DataFrame, least: float) -> DataFrame:
    """occurrence_filter() where a kept vertex whose neighbours are all left out brings its most frequent one (ties:
    the smaller); one pass, all vertices at a time."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a <> b").distinct()
    kept = vertices.filter(F.col("occurrence") >= least).select("v")
    near = both.join(kept.withColumnRenamed("v", "a"), "a", "left_semi").join(vertices.withColumnRenamed("v", "b"), "b")
    best = near.groupBy("a").agg(F.max("occurrence").alias("top"), F.min(F.struct((-F.col("occurrence")).alias("o"), F.col("b").alias("b"))).alias("best"))
    return kept.union(best.filter(F.col("top") < least).select("best.b")).distinct()


def bridge(edges: DataFrame, active: DataFrame, closure: DataFrame) -> DataFrame:
    """Edges between active vertices where paths may lead through others: the closure restricted to active vertices."""
    a, b = active.select(F.col("v").alias("a")), active.select(F.col("v").alias("b"))
    return closure.join(a, "a", "left_semi").join(b, "b", "left_semi")


def submatrix(matrix: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """A long matrix (r, c, value) at rows (r, nr) and cols (c, nc), renumbered."""
    return matrix.join(rows, "r").join(cols, "c").select(F.col("nr").alias("r"), F.col("nc").alias("c"), "value")


def put_submatrix(matrix: DataFrame, part: DataFrame) -> DataFrame:
    """The matrix with the cells of part (r, c, value) in place of its own, or beside them."""
    return matrix.join(part.select("r", "c"), ["r", "c"], "left_anti").select("r", "c", "value").unionByName(part.select("r", "c", "value"))


def single(df: DataFrame, group: list[str], col: str) -> DataFrame:
    """The only value of col in each group; an error where there are several."""
    out = df.groupBy(*group).agg(F.min(col).alias("value"), F.max(col).alias("_top"), F.count_distinct(col).alias("_n"))
    checked = F.when(F.col("_n") <= 1, F.col("value")).otherwise(F.raise_error(F.concat(F.lit(f"several values of {col} in one group"))).cast(dict(df.dtypes)[col]))
    return out.select(*group, checked.alias(col))


def without_orphans_in_order(vertices: DataFrame, edges: DataFrame, group: str, least: float) -> DataFrame:
    """without_orphans() one vertex after another, in order: what an earlier vertex brought counts for later ones. Runs
    on a group (group, v, occurrence) at a time, with its edges (group, a, b)."""
    import pandas as pd

    def solve(key: tuple, own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        share = dict(zip(own.v, own.occurrence, strict=True))
        near: dict = {}
        for a, b in zip(links.a, links.b, strict=True):
            if a != b and a in share and b in share:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        kept = {v for v, x in share.items() if x >= least}
        for v in sorted(kept):
            if (around := near.get(v)) and not around & kept:
                kept.add(min(around, key=lambda u: (-share[u], u)))
        return pd.DataFrame({group: key[0], "v": sorted(kept)})

    kinds = dict(vertices.dtypes)
    return vertices.groupBy(group).cogroup(edges.groupBy(group)).applyInPandas(solve, f"{group} {kinds[group]}, v {kinds['v']}")
