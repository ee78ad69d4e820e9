"""Queries of element, path and vector functions, selections and lookups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plait.functions import layout, scalars
from plait.operators import filters, graphs, joins, sampling, stats, windows
from plait.streaming import jobs

from .graphs import _DAG, _dag
from .registry import query, table


@query("select l_orderkey, sum(l_partkey - l_linenumber + 1)::bigint as residues, min(l_partkey - l_linenumber + 1) as shortest from lineitem group by 1")
def element_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("length", scalars.element_length(F.col("l_linenumber"), F.col("l_partkey")))
    return li.groupBy("l_orderkey").agg(F.sum("length").alias("residues"), F.min("length").alias("shortest"))


@query("""select l_returnflag, l_linestatus, count(*) as n from lineitem where l_quantity <> 7 and case when l_returnflag = 'A' then 'H' else 'C' end <> 'H' and case when l_linestatus = 'F' then '.' else 'B' end in ('.', 'A') group by 1, 2""")
def heavy_polymer_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    number = F.when(F.col("l_quantity") != 7, F.col("l_linenumber"))
    symbol, alternative = F.when(F.col("l_returnflag") == "A", "H").otherwise("C"), F.when(F.col("l_linestatus") == "F", ".").otherwise("B")
    return li.filter(filters.polymer(number) & filters.heavy_atoms(symbol, alternative)).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("""with i as (select l_orderkey, l_linenumber, l_partkey, min(l_suppkey) as id from lineitem group by 1, 2, 3) select l.l_orderkey, count(*) as n, sum(i.id)::bigint as ids from lineitem l join i using (l_orderkey, l_linenumber, l_partkey) group by 1""")
def annotated_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    index = li.groupBy(*keys).agg(F.min("l_suppkey").alias("id"))
    return joins.by_keys(li.select(*keys), index, keys, "id").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("select p_partkey, row_number() over (order by p_retailprice, p_partkey) - 1 as position from part")
def price_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.positions_by(table(spark, sf_dir, "part"), "p_retailprice", "p_partkey").select("p_partkey", "position")


@query("""with e as (select vec_id, label, [embedding[i]::double for i in range(1, 16)] as s from embeddings), p as (select a.vec_id as a, b.vec_id as b, list_distance(a.s, b.s) as d, a.label as x, b.label as y from e a join e b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % 50 = 0)
select a, b, round((10 - d * d) / 10, 6) as squared, round(greatest(0, (2 - d / sqrt(5)) / 2), 6) as shape from p""")
def shape_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated rows, whose id is divisible by 50, with all rows of their label, as shapes of five points."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.slice(F.col("embedding").cast("array<double>"), 1, 15).alias("s"))
    pairs = joins.each_to_each(e.filter("vec_id % 50 = 0"), e, ["label"], scalars.array_distance(F.col("a_s"), F.col("b_s")), "d").filter("a_vec_id <> b_vec_id")
    return pairs.select(F.col("a_vec_id").alias("a"), F.col("b_vec_id").alias("b"), F.round(scalars.square_score(F.col("d") * F.col("d")), 6).alias("squared"), F.round(scalars.shape_score(F.col("a_s"), F.col("b_s")), 6).alias("shape"))


@query("""with t(x, y, score) as (values ('A', 'R', 2.5), ('A', 'A', 4.0), ('N', 'N', 6.0)), b as (select x, y, max(score) as score from (select * from t union all select y, x, score from t) group by 1, 2),
p as (select l_returnflag as x, lead(l_returnflag) over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) as y from lineitem)
select p.x, p.y, coalesce(b.score, 0)::double as score, count(*) as n from p left join b on b.x = p.x and b.y = p.y where p.y is not null group by 1, 2, 3""")
def letter_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("x"), F.lead("l_returnflag").over(w).alias("y")).filter("y is not null")
    scores = spark.createDataFrame([("A", "R", 2.5), ("A", "A", 4.0), ("N", "N", 6.0)], "x string, y string, score double")
    return joins.substitution_scores(pairs, scores, "x", "y").groupBy("x", "y", "score").agg(F.count("*").alias("n"))


@query("""with p as (select vec_id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z, embedding[4]::double as u, embedding[5]::double as v, embedding[6]::double as w from embeddings)
select vec_id, round(x * u + y * v + z * w, 6) + 0.0 as dot, round(y * w - z * v, 6) + 0.0 as cx, round(z * u - x * w, 6) + 0.0 as cy, round(x * v - y * u, 6) + 0.0 as cz, round(sqrt(x * x + y * y + z * z), 6) as norm,
round(-y + u, 6) + 0.0 as tx, round(x + v, 6) + 0.0 as ty, round(z + w, 6) + 0.0 as tz from p""")
def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = [F.col("embedding")[i].cast("double") for i in range(6)]
    a, b = c[:3], c[3:]
    moved = scalars.transform_point([[0, -1, 0], [1, 0, 0], [0, 0, 1]], [0, 0, 0], a)
    r6 = lambda x, n: (F.round(x, 6) + 0.0).alias(n)
    return table(spark, sf_dir, "embeddings").select("vec_id", r6(scalars.dot(a, b), "dot"), *[r6(x, f"c{n}") for x, n in zip(scalars.cross(a, b), "xyz", strict=True)], F.round(scalars.norm(a), 6).alias("norm"), *[r6(m + s, f"t{n}") for m, s, n in zip(moved, b, "xyz", strict=True)])


@query("""with m as (select vec_id, [embedding[i]::double for i in range(1, 17)] as m from embeddings)
select vec_id, round(m[1] * m[13] + m[2] * m[14] + m[3] * m[15] + m[4], 6) + 0.0 as x, round(m[5] * m[13] + m[6] * m[14] + m[7] * m[15] + m[8], 6) + 0.0 as y, round(m[7], 6) + 0.0 as r12, 16::bigint as n, round(m[9] * m[13] + m[10] * m[14] + m[11] * m[15] + m[12], 6) + 0.0 as back from m""")
def split_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.slice(F.col("embedding").cast("array<double>"), 1, 16)
    own = table(spark, sf_dir, "embeddings").select("vec_id", *[x.alias(n) for x, n in zip(scalars.split_transform(m), ("rotation", "shift"), strict=True)])
    joined = own.withColumn("flat", scalars.join_transform(F.col("rotation"), F.col("shift")))
    r6 = lambda x, n: (F.round(x, 6) + 0.0).alias(n)
    return joined.select("vec_id", r6(F.col("shift")[0], "x"), r6(F.col("shift")[1], "y"), r6(F.col("rotation")[1][2], "r12"), F.size("flat").cast("long").alias("n"), r6(F.col("flat")[11], "back"))


@query("""select p_partkey, case when p_size % 3 = 0 then 'a=1,new=9,b=2,c=3' when p_size % 3 = 1 then 'a=1,b=2,c=3,new=9' else 'a=1,b=2,c=3,new=9' end as entries from part""")
def inserted_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda k, v: F.struct(F.lit(k).alias("key"), F.lit(v).alias("value"))
    after = F.element_at(F.array(F.lit("a"), F.lit("c"), F.lit("none")), (F.col("p_size") % 3 + 1).cast("int"))
    out = scalars.insert_after(F.array(one("a", 1), one("b", 2), one("c", 3)), after, one("new", 9))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(out, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("entries"))


@query(f"with recursive {_DAG}, e as (select a, b, (a + 3 * b) % 11 as label from dag), r as (select a, b from dag union select r.a, dag.b from r join dag on r.b = dag.a) select not exists (select 1 from e x join e y on x.label = y.label where x.b = y.a or exists (select 1 from r where r.a = x.b and r.b = y.a)) as is_unique")
def unique_path_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.path_labels_unique(_dag(spark, sf_dir).withColumn("label", (F.col("a") + 3 * F.col("b")) % 11))


@query("""with l as (select l_returnflag as f, l_quantity - 20 as v from lineitem) select f, coalesce(min(v) filter (v > 0), 0) as least, coalesce(max(v) filter (v > 0), 0) as most from l group by 1""")
def length_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("value", F.col("l_quantity") - 20)
    steps = stats.cdf_steps(li, "l_returnflag", "value").groupBy(F.col("l_returnflag").alias("f")).agg(F.array_sort(F.collect_list(F.struct("value", "p"))).alias("steps"))
    least, most = scalars.length_extent(F.col("steps"))
    return steps.select("f", least.alias("least"), most.alias("most"))


@query("select c_custkey, case when c_nationkey % 4 = 0 then n_name else c_nationkey::varchar end as label from customer join nation on n_nationkey = c_nationkey")
def manual_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    manual = table(spark, sf_dir, "nation").filter("n_nationkey % 4 = 0").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("label"))
    return joins.with_labels(table(spark, sf_dir, "customer"), "c_nationkey", manual, "label").select("c_custkey", "label")


@query(f"with {_DAG}, e as (select a, b, a * 10000 + b as id from dag) select v, string_agg(id::varchar, ',' order by id) as edges from (select a as v, id from e union select b, id from e) group by 1")
def incident_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graphs.incident_edges(_dag(spark, sf_dir).withColumn("id", F.col("a") * 10000 + F.col("b")))
    return out.select("v", F.array_join(F.transform("edges", lambda x: x.cast("string")), ",").alias("edges"))


@query("""with p as (select p_partkey, p_size, case when p_size % 4 = 0 then p_size::varchar || '%' when p_size % 4 = 1 then (p_size / 10.0)::varchar when p_size % 4 = 2 then 'x' end as t from part)
select p_partkey, case when p_size % 4 = 0 and p_size <= 40 then round(p_size * 0.01::double, 6) when p_size % 4 = 1 and p_size <= 4 then round(p_size / 10.0::double, 6) else 0.25 end as share from p""")
def bounded_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    text = F.when(size % 4 == 0, F.concat(size.cast("string"), F.lit("%"))).when(size % 4 == 1, (size / 10).cast("string")).when(size % 4 == 2, "x")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(scalars.bounded_float(text, 0.0, 0.4, 0.25, percent=True), 6).alias("share"))


@query("""with x as (select c_custkey, exp(-abs(c_acctbal) / 5000) as x from customer), y as (select c_custkey, case when x <= 0.5 then [255.0, x / 0.5 * 200, x / 0.5 * 255] else [(1 - x) / 0.5 * 255, (1 - x) / 0.5 * 200, 255.0] end as c from x)
select c_custkey, '#' || list_aggregate([lpad(lower(to_hex(floor(v + 1e-9)::int)), 2, '0') for v in c], 'string_agg', '') as color from y""")
def heat_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.exp(-F.abs(F.col("c_acctbal")) / 5000)
    parts = [scalars.interpolate(x, [(i / 2, scalars.HEAT[i][c]) for i in range(3)]) for c in range(3)]
    own = F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(F.floor(p + 1e-9).cast("int"))), 2, "0") for p in parts])
    return table(spark, sf_dir, "customer").select("c_custkey", own.alias("color"))


@query("""with l as (select *, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) as r from lineitem),
s as (select l_suppkey, min(r) as first from l where l_returnflag = 'N' and l_linenumber = 2 group by 1), e as (select l.l_suppkey, min(r) as last from l join s using (l_suppkey) where r >= first and l_returnflag = 'R' and l_linenumber = 3 group by 1),
n as (select l.l_suppkey, min(r) as after from l join e using (l_suppkey) where r > last and not (l_returnflag = 'R' and l_linenumber = 3) group by 1)
select l.l_suppkey, count(*) as n, min(r) as first, max(r) as last from l join s using (l_suppkey) left join n using (l_suppkey) where r >= s.first and (n.after is null or r < n.after) group by 1""")
def selected_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    li = table(spark, sf_dir, "lineitem").withColumn("r", F.row_number().over(w).cast("long"))
    return filters.selected(li, "N:2:R:3", "l_suppkey", "r", "l_returnflag", "l_linenumber").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.min("r").alias("first"), F.max("r").alias("last"))


@query("select user_id, min(i) filter (event_type = 'error') as place from (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) - 1 as i from events) group by 1")
def first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return filters.first_index_where(e, "user_id", "at", F.col("event_type") == "error").select("user_id", F.col("place").cast("long").alias("place"))


@query("""with m as (select l_suppkey % 20 as r, l_partkey % 20 as c, count(*) as value from lineitem group by 1, 2), p as (select s_suppkey % 25 as r, s_nationkey % 20 as c, -count(*) as value from supplier group by 1, 2)
select coalesce(m.r, p.r) as r, coalesce(m.c, p.c) as c, coalesce(p.value, m.value) as value from m full join p on p.r = m.r and p.c = m.c""")
def patched_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("r"), (F.col("l_partkey") % 20).alias("c")).agg(F.count("*").alias("value"))
    p = table(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 25).alias("r"), (F.col("s_nationkey") % 20).cast("long").alias("c")).agg((-F.count("*")).alias("value"))
    return filters.put_submatrix(m, p)


@query("select o_custkey, min(c_name) as c_name from orders join customer on c_custkey = o_custkey group by 1")
def single_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return filters.single(x, ["o_custkey"], "c_name")


@query("select c_mktsegment, count(*) filter (c_custkey % 3 < 2) as missing from customer group by 1")
def missing_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.element_at(F.array(F.lit("."), F.lit("?"), F.lit("x")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count_if(filters.is_missing(mark)).alias("missing"))


@query("""with h as (select p_partkey, ((p_size % 12) / 12.0::double) * 6 as h from part), s as (select p_partkey, floor(h)::int as s, h - floor(h) as f from h)
select p_partkey, '#' || lpad(lower(to_hex(r)), 2, '0') || lpad(lower(to_hex(g)), 2, '0') || lpad(lower(to_hex(b)), 2, '0') as color from (select p_partkey,
 case s when 0 then 255 when 1 then floor(255 * (1 - f)) when 2 then 0 when 3 then 0 when 4 then floor(255 * f) else 255 end::int as r, case s when 0 then floor(255 * f) when 1 then 255 when 2 then 255 when 3 then floor(255 * (1 - f)) else 0 end::int as g,
 case s when 0 then 0 when 1 then 0 when 2 then floor(255 * f) when 3 then 255 when 4 then 255 else floor(255 * (1 - f)) end::int as b from s)""")
def spectrum_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", scalars.spectrum_hex((F.col("p_size") % 12) / F.lit(12.0)).alias("color"))


@query("""with x as (select c_custkey, exp(-pi() / sqrt(6) * (c_acctbal / 1000) - 0.5772156649015329) as x from customer) select c_custkey, round(case when x < 1e-6 then ln(x) else ln(-(exp(-x) - 1)) end, 6) as log_p from x""")
def score_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(scalars.z_to_log_p(F.col("c_acctbal") / 1000), 6).alias("log_p"))


@query("""with w as (select l_orderkey, l_linenumber, l_partkey, l_quantity / 50 as a, l_discount * 10 as b, l_partkey % 30 as r from lineitem)
select l_orderkey, round(sum(0.5 * a + 0.5 * b - (1 - exp(-r / 10.0::double)) * least(a, b) - 0.5 * abs(a - b)), 5) as score from w group by 1""")
def weighted_point_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = scalars.point_score((F.col("l_partkey") % 30).cast("double"), F.col("l_quantity") / 50, F.col("l_discount") * 10)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(score), 5).alias("score"))


@query("select event_id, case when event_id % 5000 < 5 then 5 when event_id % 5000 < 10 then 10 when event_id % 5000 < 30 then 30 when event_id % 5000 < 60 then 60 when event_id % 5000 < 300 then 300 when event_id % 5000 < 600 then 600 else 3600 end as wait from events")
def refresh_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", scalars.refresh_after(F.col("event_id") % 5000).alias("wait"))


@query("""with n as (select l_suppkey % 30 as a, l_partkey % 30 as b, count(*) as shared from lineitem group by 1, 2), t as (select l_suppkey % 30 as k, count(*) as n from lineitem group by 1), u as (select l_partkey % 30 as k, count(*) as n from lineitem group by 1)
select n.a, n.b, round(shared / least(t.n, u.n), 6) as duplicity from n join t on t.k = n.a join u on u.k = n.b""")
def duplicities(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 30).alias("a"), (F.col("l_partkey") % 30).alias("b"))
    n = li.groupBy("a", "b").agg(F.count("*").alias("shared"))
    x = n.join(li.groupBy("a").agg(F.count("*").alias("na")), "a").join(li.groupBy("b").agg(F.count("*").alias("nb")), "b")
    return joins.duplicity(x, "shared", "na", "nb").select("a", "b", F.round("duplicity", 6).alias("duplicity"))


@query("select l_orderkey, round(sum(case when l_returnflag = 'R' then 16 else l_quantity * l_quantity end), 4) as score, round(sqrt(avg(l_quantity * l_quantity) filter (l_returnflag <> 'R')), 6) as rmsd from lineitem group by 1")
def matched_path_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_quantity") * F.col("l_quantity")).alias("sq"), (F.col("l_returnflag") == "R").alias("single"))
    out = joins.path_scores(li, ["l_orderkey"], "sq", "single", 16.0)
    return out.select("l_orderkey", F.round("score", 4).alias("score"), F.round("rmsd", 6).alias("rmsd"))


@query("""with p as (select a.n_nationkey as a, b.n_nationkey as b, abs(a.n_nationkey * 7 % 25 - b.n_nationkey * 7 % 25)::double as s from nation a join nation b on a.n_nationkey < b.n_nationkey), t as (select a, s from p union all select b, s from p)
select a::bigint as a, total, how from (select a, sum(s) as total, 'sum' as how from t group by 1 order by total, a limit 1) union all select a::bigint, total, how from (select a, max(s) as total, 'minmax' as how from t group by 1 order by total, a limit 1)""")
def central_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), (F.col("n_nationkey") * 7 % 25).alias("v"))
    pairs = n.select(F.col("k").alias("a"), F.col("v").alias("va")).join(n.select(F.col("k").alias("b"), F.col("v").alias("vb")), F.col("a") < F.col("b")).withColumn("score", F.abs(F.col("va") - F.col("vb")).cast("double"))
    return sampling.centre(pairs).withColumn("how", F.lit("sum")).union(sampling.centre(pairs, "minmax").withColumn("how", F.lit("minmax")))


@query("with p as (select distinct l_orderkey as m, l_linenumber as name from lineitem) select name, count(*) as found_in, round(count(*) / (select count(distinct m) from p), 6) as share from p group by 1")
def point_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = joins.name_occurrence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")
    return out.select(F.col("l_linenumber").alias("name"), "found_in", F.round("share", 6).alias("share"))


@query()
def dag_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the graph's vertices in the plane; the graph of a picture is one task's."""

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        edges = {(int(a), int(b)) for a, b in zip(pdf.a, pdf.b, strict=True)}
        vertices = sorted({v for e in edges for v in e})
        box = layout.embed(vertices, edges, {v: (1.0, 1.0 + v % 3) for v in vertices}, 1.0, 0.5)
        return pd.DataFrame([(v, x, y) for v, (x, y) in sorted(box.at.items())], columns=["v", "x", "y"])

    return graphs.reduction(_dag(spark, sf_dir)).groupBy().applyInPandas(place, "v long, x double, y double")


@query("select 'succeeded' as outcome, count(*) as n from lineitem where l_returnflag <> 'R' union all select 'failed', count(*) from lineitem where l_returnflag = 'R'")
def collected_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes streamed in micro-batches into a table of successes and one of failures."""
    root = graphs.scratch_path(spark)
    stream = spark.readStream.schema(table(spark, sf_dir, "lineitem").schema).parquet(f"{sf_dir}/lineitem.parquet*")
    q = jobs.collect_outcomes(stream.select("l_orderkey", (F.col("l_returnflag") != "R").alias("ok")), f"{root}/succeeded", f"{root}/failed", f"{root}/state")
    q.awaitTermination()
    count = lambda name: spark.read.parquet(f"{root}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("outcome"), "n")
    return count("succeeded").union(count("failed"))
