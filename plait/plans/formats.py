"""Queries of text formats and job states, over texts made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plait.operators import joins
from plait.sources import readers, sinks
from plait.streaming import jobs

from .registry import query, table
from .steps import isolated


@query("""select l_orderkey as line_no, 'p' || l_suppkey as pdb, 'c' || l_returnflag as chain_id, ':' as ranges, 'p' || l_suppkey || '_c' || l_returnflag || '_' || lpad(cast(row_number() over (partition by l_suppkey, l_returnflag order by l_orderkey) - 1 as varchar), 2, '0') as domain
from (select l_orderkey, min(l_suppkey) as l_suppkey, min(l_returnflag) as l_returnflag from lineitem group by 1)""")
def named_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s"), F.min("l_returnflag").alias("f"))
    text = li.select(F.col("l_orderkey").alias("line_no"), F.concat(F.lit("p"), F.col("s").cast("string"), F.lit(", c"), F.col("f"), F.when(F.col("l_orderkey") % 2 == 0, " # note").otherwise("")).alias("line"))
    return readers.named_members(text)


@query("""select c_custkey as line_no, lower(case when c_custkey % 3 = 0 then 'x' else '1' end || 'A' || lpad(cast(c_nationkey as varchar), 2, '0')) as pdb, case when c_custkey % 5 = 0 then '' else 'A' end as chain_id, case when c_custkey % 7 = 0 then 'bad' else '1:50' end as ranges,
case when c_custkey % 3 = 0 then 'bad id' when c_custkey % 5 = 0 then 'no chain' when c_custkey % 7 = 0 then 'bad ranges' end as error from customer""")
def validated_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    text = F.concat(F.when(k % 3 == 0, "x").otherwise("1"), F.lit("A"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit(","), F.when(k % 5 == 0, "").otherwise("A"), F.lit(","), F.when(k % 7 == 0, "bad").otherwise("1:50"), F.lit(" # x"))
    return readers.validate_submission(c.select(k.alias("line_no"), text.alias("line")))


@query("""with m as (select n_name as row, r_name as col, count(c_custkey) as value from nation cross join region left join customer on c_nationkey = n_nationkey and c_custkey % 5 = r_regionkey group by 1, 2)
select '3' || row as n, row || chr(9) || string_agg(value::varchar, chr(9) order by col) as line from m group by row union all select '0', '#dtype=int64' union all select '1', '#shape=' || (select count(*) from nation) || ',' || (select count(*) from region)
union all select '2', chr(9) || string_agg(r_name, chr(9) order by r_name) from region""")
def matrix_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r, c = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    cells = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("c_custkey") % 5 == F.col("r_regionkey")).groupBy(F.col("n_name").alias("row"), F.col("r_name").alias("col")).agg(F.count("*").alias("value"))
    names = sorted(x.r_name for x in r.select("r_name").collect())  # column names of a report
    every = n.select(F.col("n_name").alias("row")).withColumn("col", F.lit(names[0])).withColumn("value", F.lit(None).cast("long"))
    return sinks.matrix_lines(cells.unionByName(every), names, "int64")


@query("""select s_suppkey as n, 's' || s_suppkey || ' ' || case when s_suppkey % 4 = 0 then '?' else '''two words''' end as line from supplier union all select -3, 'loop_' union all select -2, '_sup.name' union all select -1, '_sup.note'""")
def category_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    rows = s.select("s_suppkey", F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("name"), F.when(F.col("s_suppkey") % 4 != 0, "two words").alias("note"))
    return sinks.category_lines(rows, "sup", "s_suppkey")


@query("select p_partkey, lpad(p_partkey::varchar, 8, ' ') || rpad(p_brand, 12, ' ') || lpad(p_size::varchar, 4, ' ') as line from part")
def fixed_width_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", sinks.fixed_width([(F.col("p_partkey"), 8, "right"), (F.col("p_brand"), 12, "left"), (F.col("p_size"), 4, "right")]).alias("line"))


@query("select '<tr><td>' || s_suppkey || '</td><td>' || s_name || '</td></tr>' as line, (select count(*) from supplier) as total from supplier order by s_suppkey limit 50")
def html_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.html_rows(table(spark, sf_dir, "supplier"), ["s_suppkey", "s_name"], ["s_suppkey"])


@query("select c_custkey as k, case when c_custkey % 3 = 0 then c_name when c_custkey % 3 = 1 then c_mktsegment end as content, case when c_custkey % 3 = 0 then 'names' when c_custkey % 3 = 1 then 'segments' end as source from customer where c_custkey % 3 < 2")
def first_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "k")
    a, b = c.filter("k % 3 = 0").withColumn("content", F.col("c_name")), c.filter("k % 3 < 2").withColumn("content", F.col("c_mktsegment"))
    return readers.first_available(c, [("names", a), ("segments", b)], "k")[0]


@query("select c_custkey, case when c_custkey % 4 = 0 then 'none' else c_name end as content, c_custkey % 4 = 0 as missing from customer")
def archive_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return sinks.archive_list(c, c.filter("c_custkey % 4 <> 0").withColumn("content", F.col("c_name")), "c_custkey", "none")


@query("""select user_id, case when sum(case when event_type = 'error' then 1 else 0 end) > 15 then 'Failed' when count(*) > 60 then 'Completed' else 'Nonexistent' end as status from events group by 1""")
def resolved_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("e"), F.count("*").alias("n"))
    return own.select("user_id", jobs.resolve([("Failed", F.col("e") > 15), ("Completed", F.col("n") > 60)]).alias("status"))


@query()
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    to = F.element_at(F.array(*[F.lit(x) for x in ("Pending", "Running", "Completed", "Failed", "Archived")]), (F.col("event_id") % 5 + 1).cast("int"))
    return jobs.replay(e.select(F.col("user_id").cast("string").alias("job"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"), to.alias("to")).select("job", (F.col("us") / 1e6).alias("at"), "to"))


@query("""select l_suppkey, case when max(l_discount) <= 0.1 and l_suppkey % 10 <> 3 then count(*)::varchar end as payload, l_suppkey % 10 <> 3 as ok from lineitem group by 1""")
def isolated_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    def count(pdf):
        if pdf.l_suppkey.iloc[0] % 10 == 3:
            raise ValueError("this group fails")
        return len(pdf)

    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey")
    return isolated(li, "l_suppkey", "l_suppkey long, ok boolean, error string, payload string", count).select("l_suppkey", "payload", "ok")


@query("""with m as (select l_orderkey as k, l_linenumber as number, min(l_partkey) as other from lineitem where l_returnflag <> 'R' group by 1, 2), r as (select o_orderkey as k, 1 + o_orderkey % 3 as start, 4 + o_orderkey % 3 as "end" from orders)
select r.k, r.start, r."end", a.other as new_start, b.other as new_end from r left join m a on a.k = r.k and a.number = r.start left join m b on b.k = r.k and b.number = r."end" """)
def converted_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    kept = li.filter("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("number")).agg(F.min("l_partkey").alias("other")).withColumn("ins", F.lit(None).cast("string"))
    marked = li.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("number"), F.col("l_partkey").alias("other"), F.lit("A").alias("ins"))
    ranges = o.select(F.col("o_orderkey").alias("k"), (1 + F.col("o_orderkey") % 3).alias("start"), (4 + F.col("o_orderkey") % 3).alias("end"))
    return joins.convert_numbering(ranges, kept.union(marked), "k").select("k", "start", "end", "new_start", "new_end")


@query("""select c_custkey, s.code, cast(case when c_custkey % 4 = 0 then 0 else c_custkey % 4 end as integer) as n, case when c_custkey % 4 = 0 then 'no code' when c_custkey % 4 > 1 then 'several codes' end as warning from customer left join (select i, 'u' || i as code from range(1, 4) t(i)) s on s.i <= c_custkey % 4""")
def flattened_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    codes = F.when(F.col("c_custkey") % 4 == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1).cast("long"), F.col("c_custkey") % 4), lambda i: F.concat(F.lit("u"), i.cast("string"))))
    return joins.flatten_mapping(c.withColumn("codes", codes), "c_custkey", "codes")


@query("""with o as (select o_custkey, min(o_orderpriority) as code, count(distinct o_orderpriority) > 1 as several from orders group by 1)
select o.code, count(distinct x.o_orderstatus) as statuses, count(distinct x.o_custkey) as owners, bool_or(several) as several from orders x join o using (o_custkey) group by 1""")
def under_first_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = joins.under_first_code(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderstatus")
    return out.select("code", F.size("items").cast("long").alias("statuses"), "owners", "several")


@query("""select s_suppkey as rank, lower('1AB' || s_suppkey % 10) as pdb, 'C' as chain_id, s_nationkey + 0.5::double as z, 's' || s_suppkey as description from supplier where s_suppkey % 3 <> 0""")
def parsed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    line = F.when(k % 3 == 0, "# note").otherwise(F.format_string("  %d: 1AB%d-C %d.5 2.1 100 140 17 s%d", k, k % 10, F.col("s_nationkey"), k))
    return readers.parse_hits(s.select(line.alias("line"))).select(F.col("rank").cast("long").alias("rank"), "pdb", "chain_id", "z", "description")


@query("""select 'f' || s_suppkey || '.gz' as name, s_suppkey * 10 as size, timestamp '2022-01-18 10:00:00' + to_minutes(cast(s_suppkey % 60 as integer)) as modified from supplier""")
def parsed_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    lines = s.select(F.format_string("-rw-r--r-- 1 u g %d 2022-01-18 10:%02d:00.000 +0000 f%d.gz", k * 10, k % 60, k).alias("line")).union(spark.range(1).select(F.lit("./sub:").alias("line")))
    return readers.parse_listing(lines).withColumn("modified", F.col("modified").cast("timestamp_ntz"))
