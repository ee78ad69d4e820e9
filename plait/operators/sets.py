"""Set operators and small relational helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plait.operators.windows import row_before


def ordered_unique(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First rows of distinct keys, in order."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r").orderBy(order)


def all_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: whether keys are unique."""
    return df.groupBy(*keys).count().agg(F.coalesce(F.max("count") <= 1, F.lit(True)).alias("is_unique"))


def id_sets(a: DataFrame, b: DataFrame) -> dict[str, DataFrame]:
    """Union, intersection and difference of sets of ids."""
    return {"union": a.union(b).distinct(), "intersect": a.intersect(b), "minus": a.subtract(b)}


def full_merge(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of both sides by key, marked left, right or both."""
    x, y = a.withColumn("_a", F.lit(True)), b.withColumn("_b", F.lit(True))
    side = F.when(F.col("_a").isNull(), "right").when(F.col("_b").isNull(), "left").otherwise("both")
    return x.join(y, key, "full_outer").withColumn("side", side).drop("_a", "_b")


def lookup(df: DataFrame, index: DataFrame, key: str, query: str) -> DataFrame:
    """Exact spellings for case-insensitive keys: rows (query, found sorted array, empty when there is none)."""
    spelled = index.groupBy(F.upper(key).alias("_u")).agg(F.array_sort(F.collect_set(key)).alias("found"))
    return df.withColumn("_u", F.upper(F.trim(query))).join(spelled, "_u", "left").select(query, F.coalesce("found", F.array().cast("array<string>")).alias("found"))


def search(queries: DataFrame, query: str, sources: list[tuple[str, DataFrame, str]], exact_first: bool = True) -> DataFrame:
    """Hits of the first source that knows the query: rows (query, source, hits, outcome) with outcome redirect (1 hit),
    list (several) or empty. The first source is matched as spelled, the others without case."""
    found = None
    for rank, (name, df, col) in enumerate(sources):
        exact = exact_first and rank == 0
        side = df.select(F.col(col).alias("_k")).distinct().select("_k", (F.col("_k") if exact else F.upper("_k")).alias("_u"))
        own = queries.select(F.col(query)).distinct().withColumn("_u", F.trim(query) if exact else F.upper(F.trim(query)))
        hit = own.join(side, "_u").groupBy(query).agg(F.array_sort(F.collect_set("_k")).alias("hits")).select(query, F.lit(rank).alias("_rank"), F.lit(name).alias("source"), "hits")
        found = hit if found is None else found.union(hit)
    best = found.groupBy(query).agg(F.min_by(F.struct("source", "hits"), "_rank").alias("_b"))
    out = queries.select(query).distinct().join(best, query, "left").select(query, F.col("_b.source").alias("source"), F.coalesce("_b.hits", F.array().cast("array<string>")).alias("hits"))
    n = F.size("hits")
    return out.withColumn("outcome", F.when(n == 0, "empty").when(n == 1, "redirect").otherwise("list"))


def prefix_index(df: DataFrame, col: str, most: int) -> DataFrame:
    """Every prefix of every distinct text, to ``most`` characters, with the number of texts below it."""
    texts = df.select(col).distinct()
    return texts.select(col, F.explode(F.sequence(F.lit(1), F.least(F.length(col), F.lit(most)))).alias("_n")).select(F.expr(f"substring({col}, 1, _n)").alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))


def changed_only(df: DataFrame, key: str, order: list[str], name: str = "shown") -> DataFrame:
    """The key where it differs from the row before, else an empty text (reports); a first row shows its key."""
    marked = row_before(df.withColumn("_there", F.struct(key)), "_there", order, "_before")
    return marked.withColumn(name, F.when(F.col("_before").eqNullSafe(F.col("_there")), "").otherwise(F.col(key))).drop("_before", "_there")
