"""Record matching over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import matching
from factloom.plans.registry import query, table


@query("""with a as (select c_custkey as k, unnest([c_nationkey, (c_nationkey + 7) % 25]) as match, unnest([0, 1]) as kp from customer),
e as (select s_nationkey as match, s_suppkey as pos, (s_acctbal > 1000)::int + (s_suppkey % 3 = 0)::int as rich from supplier), r as (select k, match, rich, pos, row_number() over (partition by k order by rich desc, kp, pos) as rn from a join e using (match))
select k, match, rich, pos from r where rn = 1""")
def export_match_richest(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_nationkey")
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.array(n, (n + 7) % 25).alias("keys"))
    exports = table(spark, d, "supplier").select(F.col("s_nationkey").alias("match"), F.col("s_suppkey").alias("pos"), ((F.col("s_acctbal") > 1000).cast("int") + (F.col("s_suppkey") % 3 == 0).cast("int")).alias("rich"))
    return matching.richest_match(docs, "keys", "k", exports)


@query("""with x as (select p_partkey as k, p_size as doc_value from part where p_partkey % 3 <> 0), y as (select p_partkey as k, p_size + 1 as export_value from part where p_partkey % 4 <> 0)
select coalesce(x.k, y.k) as k, doc_value, export_value, x.k is null as inserted from x full outer join y on x.k = y.k""")
def params_full_outer(spark: SparkSession, d: str) -> DataFrame:
    p, k = table(spark, d, "part"), F.col("p_partkey")
    x = p.filter(k % 3 != 0).select(k.alias("k"), F.col("p_size").alias("doc_value"))
    y = p.filter(k % 4 != 0).select(k.alias("k"), (F.col("p_size") + 1).alias("export_value"))
    return x.join(y, "k", "full").select("k", "doc_value", "export_value", F.col("doc_value").isNull().alias("inserted"))


@query("""with k as (select p_partkey, unnest([p_brand, p_type]) as key, unnest([0, 1]) as kp from part), o as (select * from (values ('Brand#12', 1.5), ('PROMO', 2.5), ('Brand#3', 3.5)) t(key, value))
select p_partkey, arg_min(value, kp)::double as override from (select p_partkey from part) left join k using (p_partkey) left join o using (key) group by p_partkey""")
def override_first_key(spark: SparkSession, d: str) -> DataFrame:
    o = spark.createDataFrame([("Brand#12", 1.5), ("PROMO", 2.5), ("Brand#3", 3.5)], "key string, value double")
    keys = table(spark, d, "part").select("p_partkey", F.posexplode(F.array("p_brand", "p_type")).alias("kp", "key"))
    return keys.join(F.broadcast(o), "key", "left").groupBy("p_partkey").agg(F.min_by("value", F.when(F.col("value").isNotNull(), F.col("kp"))).alias("override"))


_PREFIXES = [("Brand#1", "north"), ("Brand#12", "south"), ("Brand#2", "east"), ("Brand#25", "west"), ("Brand", "any")]


@query(f"""with x as (select * from (values {', '.join(str(p) for p in _PREFIXES)}) t(prefix, owner)) select p_partkey, arg_max(owner, length(prefix)) as owner from part join x on starts_with(p_brand, prefix) group by p_partkey""")
def longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    return matching.longest_prefix(table(spark, d, "part"), "p_brand", "p_partkey", spark.createDataFrame(_PREFIXES, "prefix string, owner string"))


_RULES = [("(^| )red ", "warm"), ("ring$", "round"), ("(small|tiny)", "little"), ("widget", "device")]


@query("select p_partkey, case " + " ".join(f"when regexp_matches(p_name, '{p}') then '{v}'" for p, v in _RULES) + " else 'unknown' end as kind from part")
def keyword_first_match(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", matching.first_rule(F.col("p_name"), _RULES).alias("kind"))


@query("""select p_partkey, case when p_type = 'PROMO' and p_size < 10 then 'weak' when p_type in ('SMALL', 'MEDIUM', 'LARGE') then lower(p_type) when regexp_matches(p_name, 'ring') then 'ring' else 'unknown' end as product,
case when p_type = 'PROMO' and p_size < 10 then 'override' when p_type in ('SMALL', 'MEDIUM', 'LARGE') then 'category' when regexp_matches(p_name, 'ring') then 'keyword' else 'none' end as decided_by from part""")
def product_cascade(spark: SparkSession, d: str) -> DataFrame:
    t, by = F.col("p_type"), lambda v, b: F.struct(v.alias("product"), F.lit(b).alias("decided_by"))
    first = F.coalesce(F.when((t == "PROMO") & (F.col("p_size") < 10), by(F.lit("weak"), "override")), F.when(t.isin("SMALL", "MEDIUM", "LARGE"), by(F.lower(t), "category")), F.when(F.col("p_name").rlike("ring"), by(F.lit("ring"), "keyword")), by(F.lit("unknown"), "none"))
    return table(spark, d, "part").select("p_partkey", first.alias("x")).select("p_partkey", "x.product", "x.decided_by")


@query("""with x as (select l_orderkey, l_quantity, l_linenumber, row_number() over (partition by l_orderkey, l_quantity order by l_linenumber) as k from lineitem where l_linenumber <= 3),
y as (select l_orderkey, l_quantity, l_linenumber, row_number() over (partition by l_orderkey, l_quantity order by l_linenumber) as k from lineitem where l_linenumber >= 2)
select x.l_orderkey, x.l_quantity, x.l_linenumber, y.l_linenumber as other_l_linenumber from x join y using (l_orderkey, l_quantity, k)""")
def corroborated_rows(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_linenumber")  # noqa: E741
    return matching.kth_pairs(l.filter("l_linenumber <= 3"), l.filter("l_linenumber >= 2"), ["l_orderkey", "l_quantity"], "l_linenumber")


@query()
def greedy_match(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("long").alias("pos"), F.col("l_returnflag").alias("symbol"), F.col("l_linestatus").alias("label"), F.col("l_discount").alias("min"), F.lit(None).cast("double").alias("typ"), F.col("l_tax").alias("max"))  # noqa: E741
    return matching.greedy_pairs(l.filter("pos <= 3"), l.filter("pos >= 2"), ["page"])


@query("select l_orderkey, l_linenumber, l_partkey from lineitem join part on l_partkey = p_partkey and l_quantity between p_size - 2 and p_size + 2")
def range_containment(spark: SparkSession, d: str) -> DataFrame:
    l, p = table(spark, d, "lineitem"), table(spark, d, "part").select("p_partkey", "p_size")  # noqa: E741
    return l.join(p, (F.col("l_partkey") == F.col("p_partkey")) & F.col("l_quantity").between(F.col("p_size") - 2, F.col("p_size") + 2)).select("l_orderkey", "l_linenumber", "l_partkey")


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def unfinished(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("""with c as (select user_id, count(*) as covered from events group by user_id), r as (select user_id, count(*) as recorded from events where event_id % 5 <> 0 group by user_id)
select user_id, covered, coalesce(recorded, 0) as recorded from c left join r using (user_id) where covered > coalesce(recorded, 0)""")
def coverage_stale(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    # one pass counts both
    n = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("covered"), F.count_if(F.col("event_id") % 5 != 0).alias("recorded"))
    return n.filter("covered > recorded")


@query("""select p_partkey from part where not (p_size % 4 = p_size % 8 and p_type = upper(p_type) and p_partkey % 2 = 0)""")
def uncorrected(spark: SparkSession, d: str) -> DataFrame:
    want = F.create_map(F.lit("size"), (F.col("p_size") % 4).cast("string"), F.lit("type"), F.col("p_type"), F.lit("even"), F.lit("0"))
    done = F.create_map(F.lit("even"), (F.col("p_partkey") % 2).cast("string"), F.lit("type"), F.upper("p_type"), F.lit("size"), (F.col("p_size") % 8).cast("string"))
    return table(spark, d, "part").filter(~F.array_sort(F.map_entries(want)).eqNullSafe(F.array_sort(F.map_entries(done)))).select("p_partkey")


@query(r"""with l as (select page_id, unnest(list_distinct(regexp_extract_all(html, '<a href="/([^"]+)"', 1))) as old from pages), n as (select * from (values ('The', 'article'), ('of', 'preposition'), ('DE', 'german')) t(name, new))
select page_id, l.old, new from l join n on lower(l.old) = lower(name)""")
def link_rewrite(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([("The", "article"), ("of", "preposition"), ("DE", "german")], "old string, new string")
    return matching.rewrite_links(table(spark, d, "pages"), "html", "page_id", F.broadcast(names), '<a href="/([^"]+)"')


@query("select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and abs(l_extendedprice - o_totalprice) <= 0.5 * o_totalprice)")
def row_identity_any(spark: SparkSession, d: str) -> DataFrame:
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")  # noqa: E741
    return o.join(l, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.abs(F.col("l_extendedprice") - F.col("o_totalprice")) <= 0.5 * F.col("o_totalprice")), "left_semi").select("o_orderkey")


@query("""with m as (select c_custkey, c_nationkey, c_mktsegment, count(*) over (partition by c_nationkey) as n_kin, count(distinct c_mktsegment) over (partition by c_nationkey) as kinds, min(c_mktsegment) over (partition by c_nationkey) as one from customer)
select c_custkey, case when kinds = 1 then one end as folder, n_kin from m""")
def folder_of_kin(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    kin = c.groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("s"), F.count(F.lit(1)).alias("n_kin"))
    return c.join(kin, "c_nationkey").select("c_custkey", F.when(F.size("s") == 1, F.element_at("s", 1)).alias("folder"), "n_kin")
