"""Queries of filters, joins, intervals, windows, sampling, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plait.functions import scalars
from plait.operators import filters, intervals, sampling, sets, windows

from .registry import query, table

LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
_LINES = ", ".join(LINE)


@query("""select l_orderkey, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem
where l_returnflag in ('A', 'R') and (l_partkey between 1 and 50 or l_partkey between 120 and 150 or l_partkey >= 1900) group by 1""")
def multi_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    kept = li.filter(filters.equals_any(F.col("l_returnflag"), ["A", "R"]) & filters.in_ranges(F.col("l_partkey"), [(1, 50), (120, 150), (1900, None)]))
    return kept.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""select o_orderkey, case when o_orderstatus = 'F' then null else o_totalprice end as price from orders
where not coalesce(case when o_orderstatus = 'F' then null else o_totalprice end > 100000, false)""")
def null_safe_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("price", F.when(F.col("o_orderstatus") == "F", F.lit(None).cast("double")).otherwise(F.col("o_totalprice")))
    return o.filter(filters.negate(F.col("price") > 100000)).select("o_orderkey", "price")


@query("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000)")
def semi_join_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return filters.by_row_ids(table(spark, sf_dir, "customer"), big, "c_custkey").select("c_custkey", "c_name")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def anti_join_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query("""select coalesce(a.k, b.k) as k, a.n as a_n, b.n as b_n, case when a.k is null then 'right' when b.k is null then 'left' else 'both' end as side
from (select l_partkey % 700 as k, count(*) as n from lineitem where l_partkey % 700 < 500 group by 1) a
full join (select l_suppkey * 7 as k, count(*) as n from lineitem group by 1) b on a.k = b.k""")
def full_outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    a = li.select((F.col("l_partkey") % 700).alias("k")).filter("k < 500").groupBy("k").agg(F.count("*").alias("a_n"))
    b = li.groupBy((F.col("l_suppkey") * 7).alias("k")).agg(F.count("*").alias("b_n"))
    return sets.full_merge(a, b, "k").select("k", "a_n", "b_n", "side")


@query("""select c.c_custkey, n.n_name, r.r_name, s.total from customer c join nation n on c.c_nationkey = n.n_nationkey
left join region r on n.n_regionkey = r.r_regionkey and r.r_name <> 'ASIA' left join (select o_custkey, round(sum(o_totalprice), 2) as total from orders group by 1) s on s.o_custkey = c.c_custkey""")
def dictionary_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r, o = (table(spark, sf_dir, t) for t in ("customer", "nation", "region", "orders"))
    total = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    named = c.join(n, c.c_nationkey == n.n_nationkey).join(r.filter("r_name <> 'ASIA'"), n.n_regionkey == r.r_regionkey, "left")
    return named.join(total, "c_custkey", "left").select("c_custkey", "n_name", "r_name", "total")


def _spans(spark: SparkSession, sf_dir: str, step: int) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.filter(F.col("o_orderkey") % 2 == step).select((F.col("o_custkey") % 40).alias("k"), (F.col("o_orderkey") * 7 % 20011).alias("start"), (F.col("o_orderkey") * 7 % 20011 + F.col("o_orderkey") % 37).alias("end"))


_SPANS = "select o_custkey % 40 as k, o_orderkey * 7 % 20011 as start, o_orderkey * 7 % 20011 + o_orderkey % 37 as \"end\" from orders where o_orderkey % 2 = {}"


@query(f"""select a.k, greatest(a.start, b.start) as start, least(a."end", b."end") as "end", count(*) as n from ({_SPANS.format(0)}) a join ({_SPANS.format(1)}) b on a.k = b.k
where a.start <= b."end" and b.start <= a."end" group by 1, 2, 3""")
def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlap_join(_spans(spark, sf_dir, 0), _spans(spark, sf_dir, 1), "k").groupBy("k", "start", "end").agg(F.count("*").alias("n"))


@query(f"""with s as ({_SPANS.format(0)} union all {_SPANS.format(1)}), m as (select *, max("end") over (partition by k order by start, "end" rows between unbounded preceding and 1 preceding) as before from s),
g as (select *, sum(case when start <= before + 1 then 0 else 1 end) over (partition by k order by start, "end" rows unbounded preceding) as island from m)
select k, min(start) as start, max("end") as "end" from g group by k, island""")
def coalesce_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.coalesce(_spans(spark, sf_dir, 0).union(_spans(spark, sf_dir, 1)), "k")


@query("""with s as (select o_custkey as k, o_orderkey as start, o_orderkey + o_custkey % 50 as "end" from orders),
g as (select *, sum(case when start - lag_end - 1 <= 400 then 0 else 1 end) over (partition by k order by start rows unbounded preceding) as island from (select *, lag("end") over (partition by k order by start) as lag_end from s))
select k, min(start) as start, arg_max("end", start) as "end" from g group by k, island""")
def include_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + F.col("o_custkey") % 50).alias("end"), F.col("o_orderkey").alias("pos"))
    return intervals.include_loops(o, "k", "pos", 400)


@query("""select o_orderkey, (o_orderkey % 90 + 1) + case when o_orderkey % 4 = 0 then 11 else 0 end as numbers, o_orderkey % 100 between 5 and 5 + o_orderkey % 90 or (o_orderkey % 4 = 0 and o_orderkey % 100 between 200 and 210) as inside from orders""")
def parsed_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    text = F.concat(F.lit("5:"), (F.col("o_orderkey") % 90 + 5).cast("string"), F.when(F.col("o_orderkey") % 4 == 0, ",200:210").otherwise(""))
    parsed = o.withColumn("r", intervals.parse(text))
    return parsed.select("o_orderkey", intervals.count(F.col("r")).alias("numbers"), filters.in_range_array(F.col("o_orderkey") % 100, F.col("r")).alias("inside"))


@query("""select o_orderkey, o_custkey || '_' || o_orderstatus || '_' || lpad(cast(row_number() over (partition by o_custkey, o_orderstatus order by o_orderkey) - 1 as varchar), 2, '0') as name from orders""")
def running_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.running_name(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], ["o_orderkey"]).select("o_orderkey", "name")


@query("""select event_id, user_id, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as before from events) where before is distinct from event_type""")
def dedup_consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.drop_consecutive(table(spark, sf_dir, "events"), windows.over("user_id", "ts", "event_id"), "event_type").select("event_id", "user_id", "event_type")


@query("""with d as (select *, abs(value - lag(value) over (partition by user_id order by ts, event_id)) as step from events)
select event_id, round(step, 6) as step, 1 + sum(case when step > 40 then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as chunk from d""")
def islands_by_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.over("user_id", "ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("step", windows.step_length(w, [F.col("value")]))
    return windows.islands(e, w, F.col("step"), 40).select("event_id", F.round("step", 6).alias("step"), F.col("chunk").cast("long").alias("chunk"))


@query("""with w as (select *, row_number() over p as i, count(*) over (partition by user_id) as n, lag(value, 2) over p as a, lag(value, 1) over p as b, lead(value, 1) over p as d, lead(value, 2) over p as e from events window p as (partition by user_id order by ts, event_id))
select event_id, round(case when i > 2 and i <= n - 2 then (a * 6980 + b * 16384 + value * 18808 + d * 16384 + e * 6980) / 65536 else value end, 6) as smooth from w""")
def smooth_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.smooth(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", F.round("smooth", 6).alias("smooth"))


@query("""with w as (select *, o_orderkey - lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as jump from orders)
select o_orderkey, sum(1 + case when jump > 1000 then 1 else 0 end) over p as renumbered, sum(case when jump is null or jump > 1000 then 1 else 0 end) over p as fragment from w window p as (partition by o_custkey order by o_orderkey rows unbounded preceding)""")
def renumber_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.over("o_custkey", "o_orderkey")
    o = table(spark, sf_dir, "orders")
    jump = F.col("o_orderkey") - F.lag("o_orderkey").over(w)
    # Distances of up to 1000 count as neighbours here: number by steps of that width.
    stepped = o.withColumn("_j", jump).withColumn("number", F.sum(F.when(F.col("_j") > 1000, 2).otherwise(1)).over(w))
    out = windows.fragments(windows.renumber(stepped, w, "number"), w, "number")
    return out.select("o_orderkey", F.col("renumbered").cast("long").alias("renumbered"), F.col("fragment").cast("long").alias("fragment"))


@query("""with f as (select *, min(l_orderkey * 10 + l_linenumber) over (partition by l_suppkey, l_partkey) as first from lineitem)
select l_suppkey, l_partkey, dense_rank() over (partition by l_suppkey order by first) as run, count(*) as n from f group by l_suppkey, l_partkey, first""")
def runs_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("row", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    first = li.groupBy("l_suppkey", "l_partkey").agg(F.min("row").alias("row"), F.count("*").alias("n"))
    return windows.runs_in_first_seen_order(first, "l_suppkey", "l_partkey", "row").select("l_suppkey", "l_partkey", F.col("run").cast("int").cast("long").alias("run"), "n")


@query("""with s as (select event_type, count(*) as n from events group by 1), c as (select *, sum(n) over (order by event_type rows unbounded preceding) as cum, sum(n) over () as total from s)
select event_type, cast(floor(100 + 800 * (cum::double / total - n::double / total / 2) + 1e-9) as bigint) as rainbow,
 's' || lpad(cast(cast(floor(n * (0.25 + ln(2) / 16) * 1000) as bigint) % 1000 as varchar), 3, '0') as hash from c""")
def spectrum_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return windows.spectrum(s, "n", ["event_type"]).select("event_type", F.col("rainbow").cast("long").alias("rainbow"), scalars.hash_color(F.col("n")).alias("hash"))


@query("select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as r from orders) where r = 1")
def unique_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.first_per_key(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""select l_partkey, cast(sum(n) over (order by l_partkey rows unbounded preceding) - n + 1 as bigint) as first, cast(sum(n) over (order by l_partkey rows unbounded preceding) as bigint) as last from (select l_partkey, count(*) as n from lineitem group by 1)""")
def range_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.range_index(table(spark, sf_dir, "lineitem"), "l_partkey", LINE)


@query("""select l_orderkey, rank, l_extendedprice from (select l_orderkey, l_extendedprice, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber, l_partkey, l_suppkey) as rank from lineitem) where rank <= 2""")
def top_two_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sampling.top_per_group(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), "l_linenumber", "l_partkey", "l_suppkey"], 2)
    return out.select("l_orderkey", F.col("rank").cast("long").alias("rank"), "l_extendedprice")


@query("select p_type, count(*) as n from part group by 1 order by n desc, p_type limit 4")
def most_common_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.most_common(table(spark, sf_dir, "part"), ["p_type"], 4)


@query("select c_custkey, c_name from customer order by sha1(c_name), c_custkey limit 100")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.hash_sample(table(spark, sf_dir, "customer"), F.col("c_name"), 100, ["c_custkey"]).select("c_custkey", "c_name")


@query()
def uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.uniform_sample(table(spark, sf_dir, "customer"), 50, ["c_custkey"]).select("c_custkey")


@query("select s_suppkey, s_acctbal from supplier order by s_acctbal, s_suppkey limit 1 offset (select (count(*) - 1) // 2 from supplier)")
def median_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.median_member(table(spark, sf_dir, "supplier"), "s_acctbal", "s_suppkey").select("s_suppkey", "s_acctbal")


@query("""select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by event_id) as r from events) where r = 1""")
def ordered_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.ordered_unique(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@query("""with a as (select distinct l_partkey as k from lineitem where l_returnflag = 'A' and l_quantity > 40), b as (select distinct l_partkey as k from lineitem where l_returnflag = 'R' and l_quantity > 40)
select 'union' as op, k from (select k from a union select k from b) union all select 'intersect', k from (select k from a intersect select k from b) union all select 'minus', k from (select k from a except select k from b)""")
def id_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter("l_quantity > 40")
    a, b = (li.filter(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k")) for f in "AR")
    parts = [df.select(F.lit(name).alias("op"), "k") for name, df in sets.id_sets(a, b).items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("""select 'customers' as what, count(*) = count(distinct c_name) as is_unique from customer union all select 'line numbers', count(*) = count(distinct (l_orderkey, l_linenumber)) from lineitem""")
def uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = sets.all_unique(table(spark, sf_dir, "customer"), ["c_name"]).select(F.lit("customers").alias("what"), "is_unique")
    return a.union(sets.all_unique(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]).select(F.lit("line numbers").alias("what"), "is_unique"))


@query("""with q as (select n_name as spelled, lower(n_name) as q from nation union all select null, 'nowhere') select q, case when spelled is null then '' else spelled end as found from q""")
def case_insensitive_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    asked = n.select(F.lower("n_name").alias("q")).union(spark.range(1).select(F.lit("nowhere").alias("q")))
    return sets.lookup(asked, n, "n_name", "q").select("q", F.array_join("found", ",").alias("found"))


@query("""with q as (select r_name as q from region union all select lower(n_name) from nation union all select ' Supplier#000000001 ' union all select 'zzz'),
h as (select q, 0 as rank, 'region' as source, r_name as k from q join region on trim(q) = r_name union all select q, 1, 'nation', n_name from q join nation on upper(trim(q)) = upper(n_name)
 union all select q, 2, 'supplier', s_name from q join supplier on upper(trim(q)) = upper(s_name)),
b as (select q, rank, source, string_agg(k, ',' order by k) as hits, count(*) as n from h group by 1, 2, 3), t as (select * from (select *, row_number() over (partition by q order by rank) as r from b) where r = 1)
select distinct q.q, t.source, coalesce(t.hits, '') as hits, case when t.n is null then 'empty' when t.n = 1 then 'redirect' else 'list' end as outcome from q left join t on t.q = q.q""")
def search_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    more = spark.createDataFrame([(" Supplier#000000001 ",), ("zzz",)], "q string")
    asked = r.select(F.col("r_name").alias("q")).union(n.select(F.lower("n_name"))).union(more)
    out = sets.search(asked, "q", [("region", r, "r_name"), ("nation", n, "n_name"), ("supplier", s, "s_name")])
    return out.select("q", "source", F.array_join("hits", ",").alias("hits"), "outcome")


@query("select substring(p_name, 1, i) as prefix, count(*) as n from (select distinct p_name from part) p, range(1, 7) r(i) where i <= length(p_name) group by 1")
def prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.prefix_index(table(spark, sf_dir, "part"), "p_name", 6)


@query("""select s_suppkey, case when lag(s_nationkey) over (order by s_nationkey, s_suppkey) = s_nationkey then '' else cast(s_nationkey as varchar) end as shown from supplier""")
def grouped_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumn("nation", F.col("s_nationkey").cast("string"))
    return sets.changed_only(s, "nation", ["s_nationkey", "s_suppkey"]).select("s_suppkey", "shown")


@query("""with p as (select vec_id, label, label % 2 as kind, embedding[1]::double as x1, embedding[2]::double as y1, embedding[3]::double as z1, embedding[4]::double as x2, embedding[5]::double as y2, embedding[6]::double as z2 from embeddings),
d as (select a.vec_id as a, b.vec_id as b, sqrt((a.x1 - b.x1)^2 + (a.y1 - b.y1)^2 + (a.z1 - b.z1)^2) + sqrt((a.x2 - b.x2)^2 + (a.y2 - b.y2)^2 + (a.z2 - b.z2)^2) as d from p a join p b on a.kind = b.kind and a.vec_id <> b.vec_id where a.vec_id % 50 = 0)
select a, b, round(d, 6) as d, round(30 - d, 6) as linear, round((-(d - 29.4) + sqrt((d - 29.4) * (d - 29.4) + 4 * 29.7 * 0.3)) / 59.4, 6) as ramp, round(exp(-d / 30), 6) as soft from d""")
def type_restricted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated rows, whose id is divisible by 50, against all rows of their kind."""
    e = table(spark, sf_dir, "embeddings")
    p = e.select("vec_id", (F.col("label") % 2).alias("kind"), *[F.col("embedding")[i].cast("double").alias(f"c{i}") for i in range(6)])
    a = p.select(F.col("vec_id").alias("a"), "kind", *[F.col(f"c{i}").alias(f"a{i}") for i in range(6)])
    b = p.select(F.col("vec_id").alias("b"), "kind", *[F.col(f"c{i}").alias(f"b{i}") for i in range(6)])
    cols = lambda s, r: [F.col(f"{s}{i}") for i in r]
    d = scalars.element_distance(cols("a", range(3)), cols("a", range(3, 6)), cols("b", range(3)), cols("b", range(3, 6)))
    pairs = a.filter("a % 50 = 0").join(b, "kind").filter("a <> b").select("a", "b", d.alias("d"))
    same = F.lit(True)
    return pairs.select("a", "b", F.round("d", 6).alias("d"), F.round(scalars.linear_score(F.col("d"), same), 6).alias("linear"), F.round(scalars.smoothed_ramp(F.col("d")), 6).alias("ramp"), F.round(scalars.exp_score(F.col("d")), 6).alias("soft"))


@query("""select c_custkey, cast(coalesce(nullif(regexp_extract(c_name, '([0-9]+)$', 1), ''), '0') as bigint) as suffix, sha1(c_name) as hash, case when c_mktsegment = 'BUILDING' then null else c_custkey % 7 end as number,
round(exp(-c_acctbal / 50000), 6) as heat, upper(substring(c_name, 1, 3)) || '-' || lpad(cast(c_nationkey as varchar), 3, '0') as code from customer""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    text = F.when(F.col("c_mktsegment") == "BUILDING", " All ").otherwise((F.col("c_custkey") % 7).cast("string"))
    return c.select(
        "c_custkey",
        scalars.integer_suffix(F.col("c_name")).alias("suffix"),
        F.sha1(F.col("c_name").cast("binary")).alias("hash"),
        scalars.int_or_all(text).cast("long").alias("number"),
        F.round(scalars.heat(F.col("c_acctbal") / 1000), 6).alias("heat"),
        F.concat(F.upper(F.substring("c_name", 1, 3)), F.lit("-"), F.lpad(F.col("c_nationkey").cast("string"), 3, "0")).alias("code"),
    )


@query("""select p_partkey, case when p_size % 3 = 0 then 'H' else 'E' end as kind, case when p_size % 4 = 0 then 'A' when p_size % 4 = 1 then 'W' else 'X' end as letter,
(p_size % 3) || '.|' || (p_size % 3) || '.' || (p_size % 5) || '.|' || (p_size % 3) || '.' || (p_size % 5) || '.' || (p_size % 7) || '.|' || (p_size % 3) || '.' || (p_size % 5) || '.' || (p_size % 7) || '.10' as prefixes,
case when p_size <= 20 then p_size else 9 end as bounded from part""")
def code_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    size = F.col("p_size")
    raw = F.when(size % 3 == 0, F.element_at(F.array(*[F.lit(x) for x in "GHIh"]), size % 4 + 1)).otherwise(F.element_at(F.array(*[F.lit(x) for x in "EBe"]), size % 3))
    three = F.when(size % 4 == 0, "ala").when(size % 4 == 1, "TRP").otherwise("???")
    code = F.concat_ws(".", *[(size % k).cast("string") for k in (3, 5, 7)], F.lit("10"))
    return p.select("p_partkey", scalars.collapse_type(raw).alias("kind"), scalars.one_letter(three).alias("letter"), F.array_join(scalars.hierarchy_prefixes(code), "|").alias("prefixes"), scalars.bounded_int(size.cast("string"), 0, 20, 9).cast("long").alias("bounded"))


@query("""select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as shown, cast(date_trunc('day', ts + interval 14 day) as timestamp) as expires, cast(extract(epoch from date_trunc('second', ts)) as bigint) % 100 as seconds, cast(props->>'$.k' as bigint) as k from events""")
def timestamps_and_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("shown"), F.date_trunc("day", F.col("ts") + F.expr("interval 14 days")).alias("expires"), (F.floor(F.unix_timestamp("ts")) % 100).alias("seconds"), F.from_json("props", "k long")["k"].alias("k"))


@query("""select distinct l_returnflag, l_linestatus from lineitem where l_quantity >= case when l_linestatus = 'F' then 45 else 48 end""")
def length_filter_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.by_length(table(spark, sf_dir, "lineitem"), "l_linestatus", F.col("l_quantity"), {"F": 45}, 48).select("l_returnflag", "l_linestatus").distinct()


@query("""with f as (select l_orderkey, arg_min(l_returnflag, l_extendedprice * 1000000 + l_partkey) as first from lineitem group by 1)
select l.l_orderkey, l.l_returnflag, count(*) as n from lineitem l join f on l.l_orderkey = f.l_orderkey and l.l_returnflag = f.first group by 1, 2""")
def first_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("row", F.col("l_extendedprice") * 1000000 + F.col("l_partkey"))
    return filters.first_model(li, "l_orderkey", "l_returnflag", "row").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))


@query("""with k as (select * from lineitem where l_quantity > 10 and l_partkey is not null), b as (select *, lag(l_suppkey) over (partition by l_orderkey order by """ + _LINES + """) as before from k)
select l_orderkey, count(*) as n, sum(l_suppkey) as suppliers from b where before is distinct from l_suppkey group by 1""")
def trace_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = filters.trace(table(spark, sf_dir, "lineitem"), "l_orderkey", LINE, "l_suppkey", F.col("l_quantity") > 10)
    return kept.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_suppkey").alias("suppliers"))


@query("""select r.nr as r, c.nc as c, m.value from (select l_suppkey as r, l_partkey % 20 as c, count(*) as value from lineitem group by 1, 2) m
join (select s_suppkey as r, row_number() over (order by s_suppkey desc) as nr from supplier where s_suppkey % 10 = 3) r on r.r = m.r join (select i as c, 20 - i as nc from range(5, 12) t(i)) c on c.c = m.c""")
def submatrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("r"), (F.col("l_partkey") % 20).alias("c")).agg(F.count("*").alias("value"))
    rows = table(spark, sf_dir, "supplier").filter("s_suppkey % 10 = 3").select(F.col("s_suppkey").alias("r"), F.row_number().over(Window.orderBy(F.desc("s_suppkey"))).cast("long").alias("nr"))
    return filters.submatrix(m, rows, spark.range(5, 12).select(F.col("id").alias("c"), (20 - F.col("id")).alias("nc")))
