"""Positional operators over ordered sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from plait.operators.graphs import _cut

#: The smoothing taps, out of 65536.
TAPS = (6980, 16384, 18808, 16384, 6980)
SHORT_CHUNK = 6


def over(key: str, *order) -> WindowSpec:
    return Window.partitionBy(key).orderBy(*order)


def running_name(df: DataFrame, keys: list[str], order: list[str], name: str = "name") -> DataFrame:
    """key_key_NN with a running number from 0 in each group."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn(name, F.concat_ws("_", *[F.col(k).cast("string") for k in keys], F.lpad(number.cast("string"), 2, "0")))


def drop_consecutive(df: DataFrame, w: WindowSpec, col: str) -> DataFrame:
    return df.withColumn("_same", F.lag(F.struct(col)).over(w).eqNullSafe(F.struct(col))).filter(~F.col("_same")).drop("_same")


def step_length(w: WindowSpec, coords: list[Column]) -> Column:
    """Distance from the point before, null for the first."""
    return F.sqrt(sum(((c - F.lag(c).over(w)) ** 2 for c in coords[1:]), (coords[0] - F.lag(coords[0]).over(w)) ** 2))


def islands(df: DataFrame, w: WindowSpec, step: Column, limit: float, name: str = "chunk") -> DataFrame:
    """Chunk numbers from 1; a step beyond the limit begins a new chunk."""
    return df.withColumn("_cut", F.when(step > limit, 1).otherwise(0)).withColumn(name, F.sum("_cut").over(w) + 1).drop("_cut")


def smooth(df: DataFrame, key: str, order: list[str], col: str, mode: str = "original", name: str = "smooth") -> DataFrame:
    """Five-tap smoothing within chunks. Ends: "original" keeps their values, "mirror" reflects the chunk, "straight"
    extrapolates from the two next smoothed values, "trim" drops them. Chunks of under SHORT_CHUNK points stay as they
    are in mode "straight"."""
    w = Window.partitionBy(key).orderBy(*order)
    n = F.count("*").over(Window.partitionBy(key))
    i = F.row_number().over(w)
    value = F.col(col)
    taps = [F.lag(value, 2).over(w), F.lag(value, 1).over(w), value, F.lead(value, 1).over(w), F.lead(value, 2).over(w)]
    if mode == "mirror":
        taps[0] = F.coalesce(taps[0], F.when(i == 2, value), taps[4])
        taps[1] = F.coalesce(taps[1], taps[3])
        taps[4] = F.coalesce(taps[4], F.when(i == n - 1, value), F.lag(value, 2).over(w))
        taps[3] = F.coalesce(taps[3], F.lag(value, 1).over(w))
    mean = sum((t * k for t, k in zip(taps[1:], TAPS[1:], strict=True)), taps[0] * TAPS[0]) / sum(TAPS)
    out = df.withColumn("_i", i).withColumn("_n", n).withColumn("_m", mean)
    inner = (F.col("_i") > 2) & (F.col("_i") <= F.col("_n") - 2)
    if mode == "trim":
        out = out.filter(inner).withColumn(name, F.col("_m"))
    elif mode == "straight":
        m = F.when(inner, F.col("_m"))
        out = out.withColumn("_m", m)
        ahead = [F.lead("_m", k).over(w) for k in (1, 2, 3)]
        behind = [F.lag("_m", k).over(w) for k in (1, 2, 3)]
        ends = F.when(F.col("_i") == 2, 2 * ahead[0] - ahead[1]).when(F.col("_i") == 1, 3 * ahead[1] - 2 * ahead[2]).when(F.col("_i") == F.col("_n") - 1, 2 * behind[0] - behind[1]).when(F.col("_i") == F.col("_n"), 3 * behind[1] - 2 * behind[2])
        out = out.withColumn(name, F.when(F.col("_n") < SHORT_CHUNK, value).otherwise(F.coalesce("_m", ends)))
    elif mode == "mirror":
        out = out.withColumn(name, F.coalesce("_m", value))
    else:
        out = out.withColumn(name, F.when(inner, F.col("_m")).otherwise(value))
    return out.drop("_i", "_n", "_m")


def renumber(df: DataFrame, w: WindowSpec, number: str, name: str = "renumbered") -> DataFrame:
    """Numbers from 1 that skip one at every gap."""
    gap = F.when(F.col(number) - F.lag(number).over(w) > 1, 1).otherwise(0)
    return df.withColumn("_gap", gap).withColumn(name, F.sum(1 + F.col("_gap")).over(w)).drop("_gap")


def fragments(df: DataFrame, w: WindowSpec, number: str, name: str = "fragment") -> DataFrame:
    """Fragment numbers; one begins where the number jumps by more than 1. A decrease is an error."""
    jump = F.col(number) - F.lag(number).over(w)
    begins = F.when(jump < 0, F.raise_error(F.lit(f"{number} decreases")).cast("int")).when(jump.isNull() | (jump > 1), 1).otherwise(0)
    return df.withColumn("_begin", begins).withColumn(name, F.sum("_begin").over(w)).drop("_begin")


def runs_in_first_seen_order(df: DataFrame, region: str, key: str, row: str, name: str = "run") -> DataFrame:
    """Numbers of the keys of a region, in order of their first rows."""
    first = F.min(row).over(Window.partitionBy(region, key))
    return df.withColumn("_first", first).withColumn(name, F.dense_rank().over(Window.partitionBy(region).orderBy("_first"))).drop("_first")


def spectrum(df: DataFrame, size: str, order: list[str], name: str = "rainbow") -> DataFrame:
    """Midpoints from 100 to 900 of cumulative shares, in order. For summaries: one row each class."""
    total = df.agg(F.sum(size).alias("_total"))
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    share = F.col(size) / F.col("_total")
    return df.crossJoin(F.broadcast(total)).withColumn(name, F.floor(100 + 800 * (F.sum(share).over(w) - share / 2) + 1e-9).cast("int")).drop("_total")


def local_shapes(df: DataFrame, w: WindowSpec, coords: list[str], name: str = "shape") -> DataFrame:
    """The five points around each inner point in coordinates of their own, x, y and z of one point after another: from
    their mean, along the step from the second to the fourth point, towards the middle one and across both. Where these
    have no length (equal points, points on one line), coordinates are NaN, as 0 / 0 is in floating point."""
    points = [F.struct(*[F.lag(c, -k).over(w).alias(c) for c in coords]) for k in range(-2, 3)]
    out = df.withColumn("_p", F.array(*points)).filter(F.col("_p")[0][coords[0]].isNotNull() & F.col("_p")[4][coords[0]].isNotNull())
    p = [[F.col("_p")[i][c] for c in coords] for i in range(5)]
    mean = [sum((p[i][c] for i in range(1, 5)), p[0][c]) / 5 for c in range(3)]
    dot = lambda u, v: u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
    vector = lambda n: [F.col(n)[c] for c in range(3)]

    def unit(n: str) -> Column:
        v = vector(n)
        size = F.sqrt(dot(v, v))
        return F.array(*[F.when(size == 0, x * float("inf")).otherwise(x / size) for x in v])

    out = out.withColumn("_x", F.array(*[p[3][c] - p[1][c] for c in range(3)])).withColumn("_x", unit("_x"))
    out = out.withColumn("_y", F.array(*[2 * p[2][c] - p[1][c] - p[3][c] for c in range(3)]))
    along = dot(vector("_x"), vector("_y"))
    out = out.withColumn("_y", F.array(*[F.col("_y")[c] - along * F.col("_x")[c] for c in range(3)])).withColumn("_y", unit("_y"))
    x, y = vector("_x"), vector("_y")
    out = out.withColumn("_z", F.array(x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0]))
    own = [[p[i][c] - mean[c] for c in range(3)] for i in range(5)]
    return out.withColumn(name, F.array(*[dot(vector(n), own[i]) for i in range(5) for n in ("_x", "_y", "_z")])).drop("_p", "_x", "_y", "_z")


def bond_angles(df: DataFrame, w: WindowSpec, x: str, y: str, z: str) -> DataFrame:
    """Angles (alpha, beta, gamma) of four points in a row: the two bends and the turn between the two planes."""

    def step(k: int) -> list[Column]:
        return [F.lead(c, k + 1).over(w) - F.lead(c, k).over(w) if k else F.lead(c, 1).over(w) - F.col(c) for c in (x, y, z)]

    out = df.withColumn("_a", F.array(*step(0))).withColumn("_b", F.array(*step(1))).withColumn("_c", F.array(*step(2)))
    dot = lambda u, v: sum((u[i] * v[i] for i in (1, 2)), u[0] * v[0])
    cross = lambda u, v: [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    a, b, c = (F.col(n) for n in ("_a", "_b", "_c"))
    unit = lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v))
    bend = lambda u, v: F.acos(unit(dot(u, v) / F.sqrt(dot(u, u) * dot(v, v))))
    p, q = cross(a, b), cross(b, c)
    turn = F.atan2(dot(a, q) * F.sqrt(dot(b, b)), dot(p, q))
    return out.filter(F.col("_c")[0].isNotNull()).select(*df.columns, bend(a, b).alias("alpha"), turn.alias("beta"), bend(b, c).alias("gamma"))


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")


def range_index(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First and last row number of each key in sorted order, from counts alone: keys are summed, not numbered by row."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return running_total(counts, key, "n", "last").select(key, (F.col("last") - F.col("n") + 1).alias("first"), "last")


def positions_by(df: DataFrame, value: str, tie: str, name: str = "position") -> DataFrame:
    """Places from 0 in order of value, equal values in order of tie. Counts of values are summed by range first, so no
    task numbers all rows."""
    counts = running_total(df.groupBy(value).agg(F.count("*").alias("_n")), value, "_n", "_upto")
    inside = F.row_number().over(Window.partitionBy(value).orderBy(tie))
    return df.withColumn("_r", inside).join(counts, value).withColumn(name, F.col("_upto") - F.col("_n") + F.col("_r") - 1).drop("_r", "_n", "_upto")


def running_total(df: DataFrame, order: str, n: str, name: str = "upto") -> DataFrame:
    """df with the sum of n up to and with each row, in order of distinct values: rows are dealt by range, summed in each
    range, and the ranges' sums (as many as partitions) added."""
    dealt = _cut(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy("_range").agg(F.sum(n).alias("_sum"))
    before = sums.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_before"))
    inside = F.sum(n).over(Window.partitionBy("_range").orderBy(order))
    return dealt.withColumn("_in", inside).join(F.broadcast(before), "_range").withColumn(name, F.col("_in") + F.col("_before")).drop("_in", "_before", "_range")


def row_before(df: DataFrame, col: str, order: list[str], name: str) -> DataFrame:
    """df with the value of col in the row before, over all rows in one order: rows are dealt by range, and the first of
    a range takes the last value of the ranges before (as many as partitions)."""
    dealt = _cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    lasts = dealt.groupBy("_range").agg(F.max_by(F.struct(col), F.struct(*order)).alias("_last"))
    before = lasts.select("_range", F.lag("_last").over(Window.orderBy("_range")).alias("_last"))
    w = Window.partitionBy("_range").orderBy(*order)
    out = dealt.withColumn("_own", F.lag(F.struct(col)).over(w)).join(F.broadcast(before), "_range")
    return out.withColumn(name, F.coalesce("_own", "_last")[col]).drop("_own", "_last", "_range")
