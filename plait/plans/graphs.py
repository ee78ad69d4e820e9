"""Queries of graph and metric-space operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plait.operators import filters, graphs, metric
from plait.operators.graphs import scratch_path

from .registry import ORACLE_SQL, query, table


def _dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to the nations and nations to regions, and on: an acyclic graph of a few levels."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    a = s.select((F.col("s_suppkey") + 1000).alias("a"), (F.col("s_nationkey") + 100).cast("long").alias("b"))
    b = n.select((F.col("n_nationkey") + 100).cast("long").alias("a"), F.col("n_regionkey").cast("long").alias("b"))
    c = n.filter("n_nationkey % 5 < 4").select((F.col("n_nationkey") + 100).cast("long").alias("a"), (F.col("n_nationkey") + 101).cast("long").alias("b"))
    return a.union(b).union(c).distinct()


_DAG = """dag as (select distinct * from (select s_suppkey + 1000 as a, (s_nationkey + 100)::bigint as b from supplier union all select (n_nationkey + 100)::bigint, n_regionkey::bigint from nation
union all select (n_nationkey + 100)::bigint, (n_nationkey + 101)::bigint from nation where n_nationkey % 5 < 4))"""
_CLOSURE = f"with recursive {_DAG}, c as (select a, b from dag union select c.a, dag.b from c join dag on c.b = dag.a)"


@query(f"{_CLOSURE} select a, b from c")
def transitive_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.closure(_dag(spark, sf_dir))


@query(f"{_CLOSURE} select a, b from c where not exists (select 1 from c x join c y on x.b = y.a where x.a = c.a and y.b = c.b)")
def transitive_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.reduction(_dag(spark, sf_dir))


_LEVELS = f"with recursive {_DAG}, v as (select a as v from dag union select b from dag), l as (select v, 0 as level from v union select dag.b, l.level + 1 from l join dag on dag.a = l.v), m as (select v, max(level) as level from l group by 1)"


@query(f"{_LEVELS} select v, level from m")
def dag_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.levels(_dag(spark, sf_dir))


@query(f"{_LEVELS} select v, level, row_number() over (order by level, v) - 1 as position from m")
def topological_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.topological_order(_dag(spark, sf_dir))


@query(f"""{_CLOSURE} select a, b from dag where exists (select 1 from dag x join c y on x.b = y.a where x.a = dag.a and y.b = dag.b)""")
def edges_beside_longer_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.long_path_exists(_dag(spark, sf_dir))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's customer and key."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b")).filter("a <> b")


_LINKS = "links as (select o_custkey as a, o_orderkey as b from orders where o_custkey <> o_orderkey), both_ways as (select a, b from links union select b, a from links)"


@query()
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.components(_links(spark, sf_dir))


@query(f"with {_LINKS} select a as v, string_agg(b::varchar, ',' order by b) as near from both_ways group by 1")
def adjacency_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.adjacency(_links(spark, sf_dir)).select("v", F.array_join(F.transform("near", lambda x: x.cast("string")), ",").alias("near"))


@query(f"with {_LINKS} select distinct least(a, b) as a, greatest(a, b) as b from links")
def normalised_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.normalise(_links(spark, sf_dir))


@query(f"with {_LINKS} select v from (select a as v from links union select b from links)")
def edge_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.vertices(_links(spark, sf_dir))


@query(f"""with {_LINKS}, v as (select c_custkey as v, case when c_custkey % 7 = 0 then null else c_nationkey end as label from customer),
e as (select a, b, case when (a + b) % 2 = 0 then 1 else -1 end as orient from links)
select least(x.label, y.label) as a, greatest(x.label, y.label) as b, orient, count(*) as n from e join v x on x.v = e.a join v y on y.v = e.b where x.label is not null and y.label is not null group by 1, 2, 3""")
def edge_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("v"), F.when(F.col("c_custkey") % 7 == 0, F.lit(None).cast("int")).otherwise(F.col("c_nationkey")).alias("label"))
    edges = _links(spark, sf_dir).withColumn("orient", F.when((F.col("a") + F.col("b")) % 2 == 0, 1).otherwise(-1))
    return graphs.edge_counts(edges, labels)


@query("select a, b from (select event_id as a, lead(event_id) over (partition by user_id order by ts, event_id) as b from events) where b is not null")
def path_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.path_edges(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_id")


@query("""with p as (select event_id as v, user_id as member, row_number() over (partition by user_id order by ts, event_id) - 1 as pos from events) select member, pos as i, pos + 1 as j from p x where exists (select 1 from p y where y.member = x.member and y.pos = x.pos + 1)""")
def local_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plait.operators.windows import over

    e = table(spark, sf_dir, "events")
    w = over("user_id", "ts", "event_id")
    positions = e.select(F.col("event_id").alias("v"), F.col("user_id").alias("member"), (F.row_number().over(w) - 1).cast("long").alias("pos"))
    return graphs.local_edges(graphs.path_edges(e, "user_id", ["ts", "event_id"], "event_id"), positions)


@query("""with m as (select s_suppkey as l, s_suppkey * 3 as r from supplier where s_suppkey % 4 = 0)
select s_suppkey as l, m.r, case when m.r is null then 'left' else 'matched' end as kind from supplier left join m on m.l = s_suppkey
union all select null, c_custkey, 'right' from customer where c_custkey not in (select r from m)""")
def merged_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    matching = s.filter("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("l"), (F.col("s_suppkey") * 3).alias("r"))
    right = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("v"))
    return graphs.merge_vertices(s.select(F.col("s_suppkey").alias("v")), right, matching)


@query(f"""with {_LINKS}, v as (select c_custkey as v, (c_custkey * 37 % 100) / 100.0::double as occurrence from customer), k as (select v from v where occurrence >= 0.6),
e as (select b.a, v.v as b, v.occurrence as o from both_ways b join v on v.v = b.b where b.a in (select v from k)),
t as (select a, max(o) as top from e group by 1), p as (select a, b from (select *, row_number() over (partition by a order by o desc, b) as r from e) where r = 1)
select v from k union select b from p join t using (a) where top < 0.6""")
def no_orphan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.without_orphans(_shares(spark, sf_dir), _links(spark, sf_dir), 0.6)


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("v"), ((F.col("c_custkey") * 37 % 100) / 100.0).alias("occurrence"))


@query(f"""with {_LINKS}, k as (select c_custkey as v from customer where (c_custkey * 37 % 100) / 100.0::double >= 0.3) select a, b from links where a in (select v from k) and b in (select v from k)""")
def frequent_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.occurrence_filter(_shares(spark, sf_dir), _links(spark, sf_dir), 0.3)[1].select("a", "b")


@query(f"{_CLOSURE}, k as (select v from (select a as v from dag union select b from dag) where v % 3 <> 1) select a, b from c where a in (select v from k) and b in (select v from k)")
def bridged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    dag = _dag(spark, sf_dir)
    active = graphs.vertices(dag).filter("v % 3 <> 1")
    return filters.bridge(dag, active, graphs.closure(dag))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries: rows whose id is divisible by 50."""
    return _vectors(spark, sf_dir).filter("vec_id % 50 = 0")


_D = "list_distance(a.embedding::double[], b.embedding::double[])"
_KNN = f"select a, b, round(d, 6) as d, rank from (select *, row_number() over (partition by a order by d, b) as rank from (select a.vec_id as a, b.vec_id as b, {_D} as d from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0)) where rank <= 5"


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("a", "b", F.round("d", 6).alias("d"), F.col("rank").cast("long").alias("rank"))


@query(_KNN)
def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(metric.knn_by_parts(_asked(spark, sf_dir), _vectors(spark, sf_dir), "vec_id", "vec", 5))


@query(_KNN)
def pivot_pruned_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(metric.knn(_asked(spark, sf_dir), _vectors(spark, sf_dir), "vec_id", "vec", 5))


def _block(a: Column, b: Column) -> Column:
    """The largest difference of one component: a metric, and a lower bound of the plain distance."""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


@query(_KNN)
def bounded_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cheap lower bound asked before the distance."""
    return _ranked(metric.knn(_asked(spark, sf_dir), _vectors(spark, sf_dir), "vec_id", "vec", 5, bound=_block))


@query(_KNN.replace(_D, "list_max([abs(x[1]::double - x[2]::double) for x in list_zip(a.embedding, b.embedding)])"))
def chebyshev_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under another metric."""
    return _ranked(metric.knn(_asked(spark, sf_dir), _vectors(spark, sf_dir), "vec_id", "vec", 5, distance=_block))


@query(_KNN.replace("embeddings b on a.vec_id <> b.vec_id", "embeddings b on a.vec_id <> b.vec_id and b.vec_id % 7 <> 3"))
def indexed_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a stored index that was built with half of the rows, then got the others and lost some."""
    v = _vectors(spark, sf_dir)
    index = metric.MetricIndex.build(v.filter("vec_id % 2 = 0"), "vec_id", "vec", scratch_path(spark))
    index.insert(v.filter("vec_id % 2 = 1"), "vec_id", "vec")
    index.delete(v.filter("vec_id % 7 = 3"), "vec_id")
    return _ranked(index.knn(_asked(spark, sf_dir), "vec_id", "vec", 5))


@query(f"select a.vec_id as a, b.vec_id as b, round({_D}, 6) as d from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0 and {_D} <= 0.7")
def range_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric.range_query(_asked(spark, sf_dir), _vectors(spark, sf_dir), "vec_id", "vec", 0.7).withColumn("d", F.round("d", 6))


@query(f"select a, b, round(d, 6) as d from (select *, row_number() over (partition by a order by d, b) as r from (select a.vec_id as a, b.vec_id as b, {_D} as d from embeddings a join embeddings b on b.vec_id < a.vec_id)) where r = 1")
def nearest_older(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric.nearest_older(_vectors(spark, sf_dir), "vec_id", "vec").withColumn("d", F.round("d", 6))


@query(f"select a.vec_id as a, b.vec_id as b, round({_D}, 6) as d, 0 as step from embeddings a join embeddings b on a.vec_id < b.vec_id order by {_D}, a, b limit 1")
def nearest_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric.nearest_pairs(_vectors(spark, sf_dir), "vec_id", "vec", 1).withColumn("d", F.round("d", 6))


@query(f"""with p as (select vec_id as k from embeddings order by 1 limit 3), t as (select a.vec_id as v, b.vec_id as p, {_D} as d from embeddings a, embeddings b where b.vec_id in (select k from p)),
m as (select a.vec_id as a, b.vec_id as b, {_D} as d from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
n as (select * from (select *, row_number() over (partition by a order by d, b) as r from m) where r <= 20)
select count(*) filter (n.d > x.d + y.d + 1e-9 or abs(x.d - y.d) > n.d + 1e-9)::bigint as violations, count(distinct (n.a, n.b)) as pairs from n join t x on x.v = n.a join t y on y.v = n.b and y.p = x.p""")
def triangle_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    pairs = metric.knn(_asked(spark, sf_dir), v, "vec_id", "vec", 20).select("a", "b", "d")
    return metric.triangle_violations(pairs, metric.pivot_table(v, "vec_id", "vec", 3), "vec_id")


@query(f"""with p as (select vec_id as k from embeddings order by 1 limit 3), t as (select a.vec_id as v, b.vec_id as p, {_D} as d from embeddings a, embeddings b where b.vec_id in (select k from p))
select x.v as a, y.v as b, round(max(abs(x.d - y.d)), 6) as low, round(min(x.d + y.d), 6) as high from t x join t y on x.p = y.p and x.v <> y.v where x.v % 50 = 0 group by 1, 2""")
def distance_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    asked = metric.pivot_table(_asked(spark, sf_dir), "vec_id", "vec", 3, v)
    return metric.distance_ranges(asked, metric.pivot_table(v, "vec_id", "vec", 3), "vec_id").select("a", "b", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("""with c as (select o_custkey as k, count(*)::double as n from orders group by 1) select x.k as a, y.k as b, abs(x.n - y.n) / 2 as bound from c x join c y on x.k <> y.k and abs(x.n - y.n) <= 4 where x.k % 50 = 0""")
def length_binned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").cast("double").alias("n"))
    return metric.length_bins(c.filter("k % 50 = 0"), c, "k", "n", 2.0)


@query("""with m as (select median(s_acctbal) as m from supplier) select s_suppkey, case when s_acctbal < m then 0 when s_acctbal > m then 1 else (row_number() over (partition by s_acctbal = m order by s_suppkey) - 1) % 2 end as half from supplier, m""")
def median_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric.split_by_median(table(spark, sf_dir, "supplier"), "s_suppkey", F.col("s_acctbal")).select("s_suppkey", F.col("half").cast("long").alias("half"))
