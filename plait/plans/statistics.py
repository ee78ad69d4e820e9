"""Queries of aggregates over clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plait.operators import stats

from .registry import query, table


def _points(spark: SparkSession, sf_dir: str, n: int = 6) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", (F.col("label") % 2).alias("kind"), *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(n)])


_POINTS = "(select vec_id, label, label % 2 as kind, " + ", ".join(f"embedding[{i + 1}]::double as x{i}" for i in range(6)) + " from embeddings)"


@query(f"""select label, count(*) as size, round(count(*) / (select count(*) from embeddings), 6) as occurrence,
  {", ".join(f"round(avg(x{i}), 6) + 0.0 as mean_x{i}" for i in range(6))},
  round({" + ".join(f"coalesce(var_samp(x{i}), 0)" for i in range(6))}, 6) as variance from {_POINTS} group by label""")
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    total = p.agg(F.count("*").alias("n"))
    out = stats.moments(p, "label", [f"x{i}" for i in range(6)]).crossJoin(F.broadcast(total))  # one row
    return out.select("label", "size", F.round(F.col("size") / F.col("n"), 6).alias("occurrence"), *[(F.round(f"mean_x{i}", 6) + 0.0).alias(f"mean_x{i}") for i in range(6)], F.round("variance", 6).alias("variance"))


@query("with p as " + _POINTS + " " + " union all ".join(f"select label, {i} as i, {j} as j, round(coalesce(covar_samp(x{i}, x{j}), 0), 7) + 0.0 as cov from p group by label" for i in range(6) for j in range(6)))
def cluster_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.covariance(_points(spark, sf_dir), "label", [f"x{i}" for i in range(6)])
    return out.select("label", "i", "j", (F.round("cov", 7) + 0.0).alias("cov"))


@query("select l_returnflag, l_linestatus, round(coalesce(avg(case when l_quantity - 10 > 0 then l_quantity - 10 end), 0), 6) as average_length, cast(count(*) filter (l_quantity - 10 > 0) as bigint) as found_in from lineitem group by 1, 2")
def avg_positive_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("length", F.col("l_quantity") - 10)
    return stats.average_positive(li, ["l_returnflag", "l_linestatus"], "length").withColumn("average_length", F.round("average_length", 6))


@query("select distinct l_returnflag, l_quantity, round(cume_dist() over (partition by l_returnflag order by l_quantity), 9) as p from lineitem")
def length_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cdf_steps(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity").withColumn("p", F.round("p", 9))


@query("""select t.event_type, u.user_id, count(e.event_id) as n from (select distinct event_type from events) t cross join (select distinct user_id from events) u
left join events e on e.event_type = t.event_type and e.user_id = u.user_id group by 1, 2""")
def occurrence_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.occurrence_matrix(table(spark, sf_dir, "events"), "event_type", "user_id")


@query("""with p as (select distinct event_type as i, user_id as u from events where value > 60), t as (select count(distinct u) as n from p), o as (select i, count(*) as n from p group by 1),
j as (select a.i as a, b.i as b, count(*) as n from p a join p b on a.u = b.u group by 1, 2)
select x.i as a, y.i as b, round(case when x.n * (t.n - x.n) * y.n * (t.n - y.n) = 0 then 0 else (t.n * coalesce(j.n, 0) - x.n * y.n) / sqrt((x.n * (t.n - x.n) * y.n * (t.n - y.n))::double) end, 6) + 0.0 as r
from o x cross join o y cross join t left join j on j.a = x.i and j.b = y.i""")
def occurrence_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.occurrence_correlation(table(spark, sf_dir, "events").filter("value > 60"), "event_type", "user_id")
    return out.select("a", "b", (F.round("r", 6) + 0.0).alias("r"))


@query(f"""with p as (select *, case when vec_id % 50 = 0 then '#' || vec_id else label::varchar end as c from {_POINTS}),
m as (select c, count(*) as n, {", ".join(f"avg(x{i}) as m{i}" for i in range(6))} from p group by c), g as (select {", ".join(f"avg(x{i}) as g{i}" for i in range(6))} from p),
w as (select sum({" + ".join(f"(x{i} - m{i}) ** 2" for i in range(6))}) as ssw from p join m using (c)), b as (select sum(n * ({" + ".join(f"(m{i} - g{i}) ** 2" for i in range(6))})) as ssb, sum(n) as n, count(*) as k from m, g)
select round(ssb * (n - k) / (ssw * (k - 1)), 5) as f from w, b""")
def anova_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir).withColumn("label", F.when(F.col("vec_id") % 50 == 0, F.lit(None).cast("int")).otherwise(F.col("label")))
    return stats.anova_f(p, "label", [f"x{i}" for i in range(6)], "vec_id").select(F.round("f", 5).alias("f"))


@query(f"""with p as {_POINTS}, c as (select kind, label, count(*) as n, sqrt({" + ".join(f"var_pop(x{i})" for i in range(6))} + 1e-9) as s, {", ".join(f"avg(x{i}) as m{i}" for i in range(6))} from p group by 1, 2),
f as (select p.vec_id, p.label = c.label as own, c.n / c.s * exp(-({" + ".join(f"(x{i} - m{i}) ** 2" for i in range(6))}) / (2 * c.s * c.s)) as f from p join c on c.kind = p.kind)
select vec_id, round(sum(case when own then f else 0 end) / sum(f), 6) as p from f group by 1""")
def self_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.self_classification(_points(spark, sf_dir), "label", "kind", [f"x{i}" for i in range(6)])
    return out.select("vec_id", F.round("p", 6).alias("p"))


@query("select round(avg(case when label = vec_id % 10 then 1.0 else 0.0 end), 9) as agreement from embeddings")
def labelling_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("other", F.col("vec_id") % 10)
    return stats.strict_agreement(e, "label", "other").select(F.round("agreement", 9).alias("agreement"))


@query("select label, vec_id % 4 as other, count(*) as n from embeddings group by 1, 2")
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.contingency(table(spark, sf_dir, "embeddings").withColumn("other", F.col("vec_id") % 4), "label", "other")


@query("""select o_custkey, count(*) as n_atoms, round(avg(o_totalprice), 1) as x, min(c_name) as name, min(o_orderstatus) as status from orders join customer on o_custkey = c_custkey group by 1""")
def chain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    only = F.when(F.min("c_name") == F.max("c_name"), F.min("c_name")).otherwise(F.raise_error(F.lit("several names")).cast("string"))
    return o.groupBy("o_custkey").agg(F.count("*").alias("n_atoms"), F.round(F.avg("o_totalprice"), 1).alias("x"), only.alias("name"), F.min("o_orderstatus").alias("status"))


@query("""select l_orderkey, l_returnflag, count(*) as atoms, round(max(case when l_linestatus = 'O' then l_extendedprice end), 2) as trace, count(*) filter (l_quantity > 25) as heavy from lineitem group by 1, 2""")
def residue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("atoms"), F.round(F.max(F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice"))), 2).alias("trace"), F.count_if(F.col("l_quantity") > 25).alias("heavy"))


@query("""with s as (select p_size % 6 as sheet, round(sum(p_retailprice * p_size), 6) as importance from part group by 1)
select sheet, importance, row_number() over (order by case when sheet = 0 then 0 else 1 end, importance desc, sheet) - 1 as rank from s""")
def sheet_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("sheet", F.col("p_size") % 6)
    out = stats.importance_rank(p, "sheet", "p_retailprice", "p_size")
    return out.select("sheet", F.round("importance", 6).alias("importance"), F.col("rank").cast("long").alias("rank"))


@query("""with d as (select distinct cast(ts as date) as d from events), u as (select distinct user_id from events), p as (select distinct user_id, cast(ts as date) as d from events),
s as (select u.user_id, string_agg(case when p.d is null then '0' else '1' end, '' order by d.d) as profile from u cross join d left join p on p.user_id = u.user_id and p.d = d.d group by 1)
select user_id, profile, case when regexp_full_match(profile, '1+') then 'static' when regexp_full_match(profile, '0+1+') then 'addition' when regexp_full_match(profile, '1+0+') then 'deletion' else 'fluctuating' end as kind from s""")
def presence_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.presence_profile(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), "user_id", "day")


@query("select o_custkey, string_agg(o_orderkey::varchar, ',' order by o_orderkey) as keys, count(*) as n from orders group by 1")
def group_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    return own.select("o_custkey", F.array_join(F.transform("keys", lambda k: k.cast("string")), ",").alias("keys"), F.size("keys").cast("long").alias("n"))


@query("select o_custkey, o_orderkey from orders")
def group_ungroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("keys")).select("o_custkey", F.explode("keys").alias("o_orderkey"))


@query("""select o_orderkey as domain, min(o_custkey) as chain, string_agg(l_linenumber || ':' || l_partkey, ',' order by l_linenumber, l_partkey, l_suppkey, l_shipdate) as ranges from orders join lineitem on l_orderkey = o_orderkey group by 1""")
def join_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    own = x.select(F.col("o_orderkey").alias("domain"), F.col("o_custkey").alias("chain"), F.concat_ws(":", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("ranges"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("pos"))
    return stats.join_segments(own, "domain", "chain", "ranges", "pos")


@query("select label, round(sum(embedding[1]::double * (vec_id % 5 + 1)) / sum(vec_id % 5 + 1), 6) + 0.0 as x, sum(vec_id % 5 + 1)::bigint as w from embeddings group by 1")
def weighted_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"), (F.col("vec_id") % 5 + 1).alias("w"))
    return stats.weighted_merge(e, ["label"], ["x"], "w").select("label", (F.round("x", 6) + 0.0).alias("x"), "w")


@query("""with p as (select vec_id, label, embedding[1]::double as x, embedding[2]::double as y from embeddings),
d as (select a.label as la, b.label as lb, a.vec_id, min(sqrt((a.x - b.x)^2 + (a.y - b.y)^2)) as d from p a join p b on a.label <> b.label where a.vec_id % 50 = 0 group by 1, 2, 3) select la, lb, round(avg(d), 6) as distance from d group by 1, 2""")
def average_min_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the stated rows, whose id is divisible by 50, to the rows of every other label, part by part."""
    p = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    a = p.filter("vec_id % 50 = 0").select(F.col("label").alias("la"), "vec_id", F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("part"))
    b = p.select(F.col("label").alias("lb"), F.col("x").alias("bx"), F.col("y").alias("by"), F.pmod(F.xxhash64("vec_id"), F.lit(8)).cast("int").alias("part"))
    pairs = a.join(b, "part").filter("la <> lb").withColumn("d", F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2))
    return stats.average_min_distance(pairs, "la", "vec_id", "lb", "d").withColumn("distance", F.round("distance", 6))


@query("""with p as (select vec_id % 40 as col, embedding[1]::double as x, embedding[2]::double as y from embeddings)
select col, count(*) as present, round(var_pop(x) * count(x) + var_pop(y) * count(y), 6) as spread, var_pop(x) * count(x) + var_pop(y) * count(y) < 0.03 * count(*) as keep from p group by 1""")
def column_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 40).alias("col"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return stats.column_centroids(p, "col", ["x", "y"], 0.03, 13).select("col", "present", F.round("spread", 6).alias("spread"), "keep")


@query("""with p as (select vec_id // 8 as col, vec_id % 8 as m, embedding[1]::double as x, embedding[2]::double as y from embeddings)
select a.col, round(max(sqrt((a.x - b.x)^2 + (a.y - b.y)^2)), 6) as widest from p a join p b on a.col = b.col group by 1 having count(distinct a.m) = 8 and max(sqrt((a.x - b.x)^2 + (a.y - b.y)^2)) <= 0.45""")
def core_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("col"), (F.col("vec_id") % 8).alias("m"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return stats.core_columns(p, "col", "m", ["x", "y"], 8, 0.45).withColumn("widest", F.round("widest", 6))


@query("select label, round(sqrt(avg(embedding[1]::double ** 2)), 6) as rmsd from embeddings group by 1")
def rmsd_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("sq", F.col("embedding")[0].cast("double") ** 2)
    return stats.rmsd(e, ["label"], "sq").withColumn("rmsd", F.round("rmsd", 6))


@query("select l_returnflag, min(l_quantity) as least, max(l_quantity) as most, round(avg(l_quantity), 6) as mean, count(distinct l_partkey) as parts, count(*) filter (l_linestatus = 'F') as done from lineitem group by 1")
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.count_distinct("l_partkey").alias("parts"), F.count_if(F.col("l_linestatus") == "F").alias("done"))


@query("""with c as (select distinct l_returnflag as f, l_quantity as v, cume_dist() over (partition by l_returnflag order by l_quantity) as p from lineitem)
select f, cast(2 + 2 * count(*) as bigint) as points, round(sum((1 - p) * v), 4) as area from c group by 1""")
def cdf_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of length distributions, by number of points and a checksum."""
    from plait.functions import scalars

    steps = stats.cdf_steps(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity").withColumnRenamed("l_quantity", "value")
    own = steps.groupBy(F.col("l_returnflag").alias("f")).agg(scalars.cdf_polygon(F.array_sort(F.collect_list(F.struct("value", "p")))).alias("outline"))
    area = F.aggregate("outline", F.lit(0.0), lambda s, x: s + x[0] * F.abs(x[1]))
    return own.select("f", F.size("outline").cast("long").alias("points"), F.round(area, 4).alias("area"))
