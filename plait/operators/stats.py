"""Aggregates over clusters of elements: moments, distributions, correlation, separation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def covariance(df: DataFrame, group: str, coords: list[str]) -> DataFrame:
    """Sample covariances in long form (group, i, j, cov), 0 in groups of one."""
    pairs = [(i, j) for i in range(len(coords)) for j in range(len(coords))]
    wide = df.groupBy(group).agg(*[F.coalesce(F.covar_samp(coords[i], coords[j]), F.lit(0.0)).alias(f"c{i}_{j}") for i, j in pairs])
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{i}_{j}").alias("cov")) for i, j in pairs])
    return wide.select(group, F.explode(cells).alias("x")).select(group, "x.*")


def moments(df: DataFrame, group: str, coords: list[str]) -> DataFrame:
    """Size, means and the trace of the covariance of each group."""
    trace = sum((F.coalesce(F.var_samp(c), F.lit(0.0)) for c in coords[1:]), F.coalesce(F.var_samp(coords[0]), F.lit(0.0)))
    return df.groupBy(group).agg(F.count("*").alias("size"), *[F.avg(c).alias(f"mean_{c}") for c in coords], trace.alias("variance"))


def average_positive(df: DataFrame, group: list[str], length: str) -> DataFrame:
    """Mean of the positive lengths, 0 without any."""
    return df.groupBy(*group).agg(F.coalesce(F.avg(F.when(F.col(length) > 0, F.col(length))), F.lit(0.0)).alias("average_length"), F.sum(F.when(F.col(length) > 0, 1).otherwise(0)).cast("long").alias("found_in"))


def cdf_steps(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, p): the share of values up to each distinct value. Counts are summed first, so the window sees
    distinct values only."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return counts.select(group, value, (F.sum("n").over(w) / F.sum("n").over(Window.partitionBy(group))).alias("p"))


#: Items of a dense table (clusters, classes) at most; a table that is dense in both directions is for few of them.
FEW = 4096


def _few(df: DataFrame, what: str) -> DataFrame:
    """One row with all rows of df in an array, when there are FEW at most; an error beyond."""
    checked = F.when(F.count("*") <= FEW, F.array_sort(F.collect_list(F.struct(*df.columns)))).otherwise(F.raise_error(F.lit(f"more than {FEW} {what}")))
    kind = f"array<struct<{','.join(f'`{n}`:{t}' for n, t in df.dtypes)}>>"
    return df.agg(checked.cast(kind).alias("_all"))


def occurrence_matrix(df: DataFrame, item: str, member: str) -> DataFrame:
    """(item, member, n) for every item and member, 0 where absent: present cells are counted, and zeros are filled in
    when each member's row is written out."""
    cells = df.groupBy(item, member).agg(F.count("*").alias("n"))
    rows = cells.groupBy(member).agg(F.map_from_entries(F.collect_list(F.struct(item, "n"))).alias("_own"))
    items = _few(cells.select(item).distinct(), "items")
    wide = rows.crossJoin(F.broadcast(items)).select(member, "_own", F.explode("_all").alias("_i"))
    return wide.select(F.col("_i")[item].alias(item), member, F.coalesce(F.try_element_at("_own", F.col("_i")[item]), F.lit(0)).cast("long").alias("n"))


def occurrence_correlation(df: DataFrame, item: str, member: str) -> DataFrame:
    """Correlation of the 0/1 occurrence of items over members, from joint counts; 0 where an item never varies. Items that
    never meet get their value when the table is written out."""
    present = df.select(item, member).distinct()
    total = present.agg(F.count_distinct(member).alias("total"))
    own = present.groupBy(F.col(item).alias("i")).agg(F.count("*").alias("n"))
    joint = present.select(F.col(item).alias("a"), member).join(present.select(F.col(item).alias("b"), member), member).groupBy("a", "b").agg(F.count("*").alias("both"))
    cells = _few(own, "items").crossJoin(F.broadcast(total)).select("total", "_all", F.explode("_all").alias("x")).select("total", "x", F.explode("_all").alias("y"))
    all_ = cells.select("total", F.col("x.i").alias("a"), F.col("x.n").alias("na"), F.col("y.i").alias("b"), F.col("y.n").alias("nb")).join(joint, ["a", "b"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    below = F.col("na") * (F.col("total") - F.col("na")) * F.col("nb") * (F.col("total") - F.col("nb"))
    top = F.col("total") * F.col("both") - F.col("na") * F.col("nb")
    return all_.select("a", "b", F.when(below == 0, 0.0).otherwise(top / F.sqrt(below.cast("double"))).alias("r"))


def anova_f(df: DataFrame, label: str, coords: list[str], key: str) -> DataFrame:
    """F ratio over all coordinates; rows without a label are classes of their own. Null without degrees of freedom."""
    cls = F.coalesce(F.col(label).cast("string"), F.concat(F.lit("#"), F.col(key).cast("string")))
    own = df.withColumn("_c", cls)
    parts = own.groupBy("_c").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in coords], sum((F.sum(F.col(c) * F.col(c)) for c in coords[1:]), F.sum(F.col(coords[0]) * F.col(coords[0]))).alias("q"))
    between = sum((F.col(f"s_{c}") * F.col(f"s_{c}") for c in coords[1:]), F.col(f"s_{coords[0]}") * F.col(f"s_{coords[0]}")) / F.col("n")
    one = parts.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("q").alias("q"), F.sum(between).alias("b"), *[F.sum(f"s_{c}").alias(f"s_{c}") for c in coords])
    grand = sum((F.col(f"s_{c}") * F.col(f"s_{c}") for c in coords[1:]), F.col(f"s_{coords[0]}") * F.col(f"s_{coords[0]}")) / F.col("n")
    f = (F.col("b") - grand) * (F.col("n") - F.col("k")) / ((F.col("q") - F.col("b")) * (F.col("k") - 1))
    return one.select(F.when((F.col("n") > F.col("k")) & (F.col("k") > 1), f).alias("f"))


def self_classification(df: DataFrame, label: str, kind: str, coords: list[str]) -> DataFrame:
    """(row..., p): the probability of each row's own class under one round Gaussian a class, among classes of its type.
    The classes of a type (FEW at most) come to each row as one array, so rows are neither multiplied nor grouped."""
    spread = sum((F.var_pop(c) for c in coords[1:]), F.var_pop(coords[0]))
    means = [F.avg(c).alias(f"m_{c}") for c in coords]
    classes = df.filter(F.col(label).isNotNull()).groupBy(kind, label).agg(F.count("*").alias("n"), F.sqrt(spread + 1e-9).alias("s"), *means)
    one = F.struct(F.col(label).alias("c"), "n", "s", *[f"m_{c}" for c in coords])
    held = F.when(F.count("*") <= FEW, F.collect_list(one)).otherwise(F.raise_error(F.lit(f"more than {FEW} classes of a type")))
    kinds = dict(df.dtypes)
    shape = f"array<struct<c:{kinds[label]},n:bigint,s:double,{','.join(f'm_{c}:double' for c in coords)}>>"
    packed = classes.groupBy(kind).agg(held.cast(shape).alias("_classes"))

    def weight(c):
        far = sum(((F.col(x) - c[f"m_{x}"]) ** 2 for x in coords[1:]), (F.col(coords[0]) - c[f"m_{coords[0]}"]) ** 2)
        return c["n"] / c["s"] * F.exp(-far / (2 * c["s"] * c["s"]))

    add = lambda total, x: total + x
    all_ = F.aggregate(F.transform("_classes", weight), F.lit(0.0), add)
    mine = F.aggregate(F.transform(F.filter("_classes", lambda c: c["c"] == F.col(label)), weight), F.lit(0.0), add)
    p = F.when(F.col(label).isNull(), 0.0).otherwise(F.coalesce(mine / all_, F.lit(0.0)))
    return df.join(packed, kind, "left").select(*df.columns, p.alias("p"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def strict_agreement(df: DataFrame, a: str, b: str, both_unlabelled: bool = False) -> DataFrame:
    """Share of rows whose labels are equal; null is unlabelled and agrees only when asked for."""
    same = (F.col(a) == F.col(b)) if not both_unlabelled else F.col(a).eqNullSafe(F.col(b))
    return df.agg((F.sum(F.when(same, 1).otherwise(0)) / F.count("*")).alias("agreement"))


def importance_rank(df: DataFrame, sheet: str, occurrence: str, length: str) -> DataFrame:
    """New sheet numbers by falling sum of occurrence times length; sheet 0 stays 0."""
    total = df.groupBy(sheet).agg(F.sum(F.col(occurrence) * F.col(length)).alias("importance"))
    w = Window.orderBy(F.when(F.col(sheet) == 0, 0).otherwise(1), F.round(F.col("importance"), 6).desc(), sheet)
    first = F.max(F.when(F.col(sheet) == 0, 1).otherwise(0)).over(Window.partitionBy())
    return total.select(sheet, "importance", (F.row_number().over(w) - first).cast("int").alias("rank"))


def presence_profile(df: DataFrame, key: str, snapshot: str) -> DataFrame:
    """(key, profile, kind): a 0/1 text over all snapshots in order; static, addition, deletion or fluctuating."""
    days = df.select(snapshot).distinct().agg(F.array_sort(F.collect_set(snapshot)).alias("days"))  # snapshots are few
    held = df.groupBy(key).agg(F.collect_set(snapshot).alias("held"))
    text = F.array_join(F.transform("days", lambda d: F.when(F.array_contains("held", d), "1").otherwise("0")), "")
    kind = F.when(F.col("profile").rlike("^1+$"), "static").when(F.col("profile").rlike("^0+1+$"), "addition").when(F.col("profile").rlike("^1+0+$"), "deletion").otherwise("fluctuating")
    return held.crossJoin(F.broadcast(days)).select(key, text.alias("profile")).withColumn("kind", kind)


def join_segments(df: DataFrame, domain: str, chain: str, ranges: str, order: str) -> DataFrame:
    """One row a domain with its ranges in order; a domain on several chains is an error."""
    own = df.groupBy(domain).agg(F.min(chain).alias(chain), F.max(chain).alias("_top"), F.transform(F.array_sort(F.collect_list(F.struct(order, ranges))), lambda x: x[ranges]).alias("_r"))
    checked = F.when(F.col(chain) == F.col("_top"), F.col(chain)).otherwise(F.raise_error(F.concat(F.col(domain).cast("string"), F.lit(" lies on several chains"))).cast(dict(df.dtypes)[chain]))
    return own.select(domain, checked.alias(chain), F.array_join(F.transform("_r", lambda x: x.cast("string")), ",").alias("ranges"))


def weighted_merge(df: DataFrame, group: list[str], coords: list[str], weight: str) -> DataFrame:
    return df.groupBy(*group).agg(*[(F.sum(F.col(c) * F.col(weight)) / F.sum(weight)).alias(c) for c in coords], F.sum(weight).alias(weight))


def rmsd(df: DataFrame, group: list[str], squared: str) -> DataFrame:
    return df.groupBy(*group).agg(F.sqrt(F.avg(squared)).alias("rmsd"))


def average_min_distance(pairs: DataFrame, member_a: str, element_a: str, member_b: str, distance: str) -> DataFrame:
    """Mean over elements of a of the least distance to an element of b."""
    least = pairs.groupBy(member_a, member_b, element_a).agg(F.min(distance).alias("_d"))
    return least.groupBy(member_a, member_b).agg(F.avg("_d").alias("distance"))


def column_centroids(df: DataFrame, column: str, coords: list[str], gap: float, n: int) -> DataFrame:
    """Columns worth keeping: summed squared distance to the centroid below gap times the members present."""
    own = df.groupBy(column).agg(F.count("*").alias("present"), *[F.avg(c).alias(f"m_{c}") for c in coords], sum((F.var_pop(c) * F.count(c) for c in coords[1:]), F.var_pop(coords[0]) * F.count(coords[0])).alias("spread"))
    return own.withColumn("keep", F.col("spread") < gap * F.col("present")).withColumn("gaps", F.lit(n) - F.col("present"))


def core_columns(df: DataFrame, column: str, member: str, coords: list[str], n: int, diameter: float) -> DataFrame:
    """Columns that all n members fill, with no two further apart than the diameter. Members of a column are joined by
    column; columns are as wide as a family has members."""
    a, b = df.select(column, F.col(member).alias("_a"), *[F.col(c).alias(f"a_{c}") for c in coords]), df.select(column, F.col(member).alias("_b"), *[F.col(c).alias(f"b_{c}") for c in coords])
    far = F.sqrt(sum(((F.col(f"a_{c}") - F.col(f"b_{c}")) ** 2 for c in coords[1:]), (F.col(f"a_{coords[0]}") - F.col(f"b_{coords[0]}")) ** 2))
    full = df.groupBy(column).agg(F.count_distinct(member).alias("n")).filter(F.col("n") == n).select(column)
    wide = a.join(full, column, "left_semi").join(b, column).groupBy(column).agg(F.max(far).alias("widest"))
    return wide.filter(F.col("widest") <= diameter)
