"""Aggregates, set operations, rankings and quality gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import quality
from factloom.plans.registry import query, table


@query("""select 'no_items' as gate, o_orderkey::varchar as subject from orders where o_orderkey not in (select l_orderkey from lineitem)
union all select 'negative_price', o_orderkey::varchar from orders where o_totalprice < 0
union all select 'large_discount', p_partkey::varchar from (select l_partkey as p_partkey, max(l_discount) as m from lineitem group by 1) where m > 0.09
union all select 'duplicate_name', p_name from (select p_name, count(*) as n from part group by 1) where n > 60""")
def quality_gates(spark: SparkSession, d: str) -> DataFrame:
    o, l, p = table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "part")  # noqa: E741
    missing = o.select("o_orderkey").join(l.select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    top = l.groupBy("l_partkey").agg(F.max("l_discount").alias("m"))
    names = p.groupBy("p_name").agg(F.count(F.lit(1)).alias("n"))
    return quality.gates([("no_items", missing, F.lit(True)), ("negative_price", o, F.col("o_totalprice") < 0), ("large_discount", top, F.col("m") > 0.09), ("duplicate_name", names, F.col("n") > 60)])


@query("""with s as (select source, n_chars < 400 as found, quality = 0 as truth from documents join labels using (doc_id)), c as (select source, count(*) filter (found and truth) as exact, count(*) filter (found and not truth) as wrong, count(*) filter (not found and truth) as missing from s group by source)
select *, case when exact + wrong > 0 then exact / (exact + wrong)::double end as precision, case when exact + missing > 0 then exact / (exact + missing)::double end as recall from c""")
def precision_recall(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return quality.score(s, ["source"], F.col("n_chars") < 400, F.col("quality") == 0)


@query("""with a as (select l_partkey, l_returnflag, count(*) as n from lineitem where l_linenumber <= 2 group by all), b as (select l_partkey, l_returnflag, count(*) as n from lineitem where l_linenumber > 2 group by all)
select l_partkey, l_returnflag, least(coalesce(a.n, 0), coalesce(b.n, 0)) as shared, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) as only_a, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) as only_b from a full join b using (l_partkey, l_returnflag)""")
def multiset_difference(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")  # noqa: E741
    return quality.multiset_difference(l.filter("l_linenumber <= 2"), l.filter("l_linenumber > 2"), ["l_partkey", "l_returnflag"])


@query("select lang, source, count(*) as n, sum(n_chars) as chars from documents group by rollup (lang, source)")
def counts_by_category(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("select p_brand, count(*) filter (p_size < 10) as low, count(*) filter (p_size between 10 and 29) as medium, count(*) filter (p_size >= 30) as high from part group by p_brand")
def counts_by_level(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    return table(spark, d, "part").groupBy("p_brand").agg(F.count_if(s < 10).alias("low"), F.count_if(s.between(10, 29)).alias("medium"), F.count_if(s >= 30).alias("high"))


@query("select l_orderkey, array_to_string(list_sort(list(distinct l_returnflag || l_linestatus)), ',') as flags from lineitem group by l_orderkey")
def flag_sets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.concat_ws(",", F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus")))).alias("flags"))


@query("with c as (select l_suppkey, l_partkey, count(*) as n from lineitem group by all) select l_suppkey, first(l_partkey order by n desc, l_partkey) as best, max(n) as n from c group by l_suppkey")
def best_candidate(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("l_suppkey").agg(F.max_by("l_partkey", F.struct("n", -F.col("l_partkey"))).alias("best"), F.max("n").alias("n"))


@query("select source, sum(n_chars) as chars, sum(octet_length(encode(text))) as bytes, round(sum(octet_length(encode(text))) / sum(n_chars)::double, 6) as ratio from documents group by source")
def size_ratios(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("chars"), F.sum(F.octet_length("text")).alias("bytes"))
    return s.withColumn("ratio", F.round(F.try_divide("bytes", "chars"), 6))


@query("select event_type, round(sum(value * (event_id % 7 + 1)) / sum(event_id % 7 + 1), 6) as weighted, max(value) as peak from events group by event_type")
def weighted_means(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("event_id") % 7 + 1
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.sum(F.col("value") * w) / F.sum(w), 6).alias("weighted"), F.max("value").alias("peak"))


@query("select case when l_discount < 0.02 then 'under_2' when l_discount < 0.06 then '2_to_6' else '6_or_more' end as band, count(*) as n, min(l_discount) as least from lineitem group by 1")
def banded_histogram(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("l_discount")
    return table(spark, d, "lineitem").groupBy(F.when(x < 0.02, "under_2").when(x < 0.06, "2_to_6").otherwise("6_or_more").alias("band")).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("least"))


@query("""select l_returnflag, l_linestatus, arg_max(l_quantity, l_orderkey * 10 + l_linenumber) filter (l_linenumber = 1) as q1, arg_max(l_quantity, l_orderkey * 10 + l_linenumber) filter (l_linenumber = 2) as q2,
arg_max(l_quantity, l_orderkey * 10 + l_linenumber) filter (l_linenumber = 3) as q3 from (select l_orderkey, l_linenumber, l_returnflag, l_linestatus, max(l_quantity) as l_quantity from lineitem group by all) group by all""")
def pivot_matrix(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus").agg(F.max("l_quantity").alias("q"))  # noqa: E741
    out = l.groupBy("l_returnflag", "l_linestatus").pivot("l_linenumber", [1, 2, 3]).agg(F.max_by("q", F.col("l_orderkey") * 10 + F.col("l_linenumber")))
    return out.select("l_returnflag", "l_linestatus", *[F.col(str(k)).alias(f"q{k}") for k in (1, 2, 3)])


@query("""select doc_id, regexp_matches(text, '(^|[^0-9.])' || (doc_id % 10)::varchar || '([^0-9]|$)') and regexp_matches(text, '(^|[^0-9.])3([^0-9]|$)') as witnessed from documents""")
def witness_check(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", quality.witnessed(F.array((F.col("doc_id") % 10).cast("string"), F.lit("3")), F.col("text")).alias("witnessed"))


@query("""with e as (select p_partkey, p_size * 2 as want from part where p_partkey % 10 = 0), f as (select l_partkey, max(l_quantity) as got from lineitem group by 1)
select p_partkey, coalesce(abs(want - got) <= 0.005 * greatest(want, got), false) as met from e left join f on l_partkey = p_partkey""")
def known_answers(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "part").filter("p_partkey % 10 = 0").select("p_partkey", (F.col("p_size") * 2).alias("want"))
    f = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.max("l_quantity").alias("got"))
    return e.join(f, F.col("l_partkey") == F.col("p_partkey"), "left").select("p_partkey", F.coalesce(F.abs(F.col("want") - F.col("got")) <= 0.005 * F.greatest("want", "got"), F.lit(False)).alias("met"))


@query("""with e as (select p_partkey, p_size * 2 as want from part), f as (select l_partkey, max(l_quantity) as got from lineitem group by 1)
select p_partkey, coalesce(abs(want - got) <= 0.005 * greatest(want, got), false) as met from e left join f on l_partkey = p_partkey""")
def known_answers_all(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 2).alias("want"))
    f = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.max("l_quantity").alias("got"))
    return e.join(f, F.col("l_partkey") == F.col("p_partkey"), "left").select("p_partkey", F.coalesce(F.abs(F.col("want") - F.col("got")) <= 0.005 * F.greatest("want", "got"), F.lit(False)).alias("met"))


@query("""select p_brand, p_type from part where p_size < 25 intersect select p_brand, p_type from part where p_size >= 25""")
def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.filter("p_size < 25").select("p_brand", "p_type").intersect(p.filter("p_size >= 25").select("p_brand", "p_type"))


@query("""select l_suppkey, l_returnflag from lineitem where l_linenumber % 2 = 1 except all select l_suppkey, l_returnflag from lineitem where l_linenumber % 2 = 0""")
def multiset_except(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")  # noqa: E741
    return l.filter("l_linenumber % 2 = 1").select("l_suppkey", "l_returnflag").exceptAll(l.filter("l_linenumber % 2 = 0").select("l_suppkey", "l_returnflag"))


@query("""select c_custkey as id, c_name as name, c_acctbal as balance, null as nation from customer union all select s_suppkey, s_name, null, s_nationkey from supplier""")
def union_of_extractors(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return a.unionByName(b, allowMissingColumns=True)


@query("select doc_id, n_chars, rank() over (order by n_chars desc, doc_id) as place from documents order by n_chars desc, doc_id limit 10")
def worst_ten(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    top = table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(10)
    return top.withColumn("place", F.rank().over(Window.orderBy(F.desc("n_chars"), "doc_id")))


@query("select o_orderkey, case o_orderstatus when 'P' then 0 when 'O' then 1 else 2 end as op_rank, row_number() over (partition by o_custkey order by case o_orderstatus when 'P' then 0 when 'O' then 1 else 2 end, o_orderkey) as place from orders")
def custom_order(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    r = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return table(spark, d, "orders").withColumn("op_rank", r).select("o_orderkey", "op_rank", F.row_number().over(Window.partitionBy("o_custkey").orderBy("op_rank", "o_orderkey")).alias("place"))


@query("""with e as (select a.doc_id, a.n_chars as was, b.n_chars as now from documents a join documents b on b.doc_id = a.doc_id + 1), s as (select doc_id, case when was = 0 then 0 else greatest(was - now, 0) / was::double end as lost from e)
select case when lost < 0.1 then 'under_10' when lost < 0.5 then '10_to_50' else '50_or_more' end as band, count(*) as n from s group by 1""")
def lost_content_bands(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("was"))
    e = a.join(table(spark, d, "documents").select((F.col("doc_id") - 1).alias("doc_id"), F.col("n_chars").alias("now")), "doc_id")
    lost = F.coalesce(F.try_divide(F.greatest(F.col("was") - F.col("now"), F.lit(0)), F.col("was")), F.lit(0.0))
    return e.groupBy(quality.band(lost).alias("band")).agg(F.count(F.lit(1)).alias("n"))
