"""The derived relational schema as SQL views, and SQL over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import evidence
from factloom.plans.evidence import _FUSED, readings
from factloom.plans.registry import query, table
from factloom.sources import database


def views(spark: SparkSession, d: str, *names: str) -> None:
    """Rebuild the named ones of documents_v, params, readings and pages_v in the shared folder, and register them."""
    r = readings(spark, d)
    long = r.select(F.col("k").alias("doc"), F.inline(F.array(*[F.struct(F.lit(s).alias("source"), F.col(f"{s}_min").alias("min"), F.col(f"{s}_max").alias("max")) for s in ("prose", "roc", "page1")]))).filter("min is not null or max is not null")
    params = evidence.fuse(r).select(F.col("k").alias("doc"), F.when(F.col("k") % 2 == 0, "vin").otherwise("iq").alias("key"), "min", "max", "confidence", (F.col("confidence") == "low").alias("contested"), F.lit(None).cast("string").alias("verified_by"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.sha2("text", 256).alias("sha256"), F.size(F.split("text", "\n")).alias("pages"), F.col("lang").alias("category"), F.left(F.col("text"), F.lit(40)).alias("title"), F.to_json(F.array("source")).alias("parts"))
    made = {"params": params, "readings": long, "documents_v": docs, "pages_v": table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("page", "text"))}
    database.rebuild(spark, database.scratch(spark, "db"), {n: made[n] for n in names})


_PARAMS = _FUSED + ", params as (select k as doc, case when k % 2 = 0 then 'vin' else 'iq' end as key, min, max, confidence, confidence = 'low' as contested, null::varchar as verified_by from fused)"


@query(_PARAMS + " select doc, min, max from params where key = 'vin' and max >= 24 and confidence = 'high'")
def sql_params(spark: SparkSession, d: str) -> DataFrame:
    views(spark, d, "params")
    return spark.sql("select doc, min, max from params where key = 'vin' and max >= 24 and confidence = 'high'")


@query(_PARAMS + " select doc, key from params where contested and verified_by is null")
def sql_contested(spark: SparkSession, d: str) -> DataFrame:
    views(spark, d, "params")
    return spark.sql("select doc, key from params where contested and verified_by is null")


@query(_PARAMS + """ select p.doc, key, r.source, r.min, r.max from params p join (select k, 'prose' as source, prose_min as min, prose_max as max from readings union all select k, 'roc', roc_min, roc_max from readings union all select k, 'page1', page1_min, page1_max from readings) r on r.k = p.doc
where (r.min is not null or r.max is not null) and p.doc = 17""")
def sql_readings(spark: SparkSession, d: str) -> DataFrame:
    views(spark, d, "params", "readings")
    return spark.sql("select p.doc, key, source, r.min, r.max from params p join readings r on r.doc = p.doc where p.doc = 17")


@query(_PARAMS + """ select p.doc, key, r.source, r.min, r.max from params p join (select k, 'prose' as source, prose_min as min, prose_max as max from readings union all select k, 'roc', roc_min, roc_max from readings union all select k, 'page1', page1_min, page1_max from readings) r on r.k = p.doc
where (r.min is not null or r.max is not null)""")
def sql_readings_all(spark: SparkSession, d: str) -> DataFrame:
    views(spark, d, "params", "readings")
    return spark.sql("select p.doc, key, source, r.min, r.max from params p join readings r on r.doc = p.doc")


@query("select doc_id as doc, len(string_split(text, chr(10))) as pages, left(text, 40) as title from documents where left(text, 40) ilike '%the%' and lang = 'en'")
def sql_title_filter(spark: SparkSession, d: str) -> DataFrame:
    views(spark, d, "documents_v")
    return spark.sql("select doc, pages, title from documents_v where title ilike '%the%' and category = 'en'")


@query(_PARAMS + " select key, confidence, count(*) as n, count(*) filter (contested) as contested, min(min) as least from params group by key, confidence having count(*) > 1")
def sql_aggregate(spark: SparkSession, d: str) -> DataFrame:
    views(spark, d, "params")
    return spark.sql("select key, confidence, count(*) as n, count_if(contested) as contested, min(min) as least from params group by key, confidence having count(*) > 1")


@query("""select p_partkey as k, array_to_string(list_sort(list_filter([case when p_size > 20 then 'big' end, case when p_type = 'PROMO' then 'promo' end, case when p_name like '%red%' then 'red' end], lambda x: x is not null)), ',') as marks, p_size > 20 as is_big, p_type = 'PROMO' as is_promo from part
where p_size > 20 or (p_type = 'PROMO' and p_name like '%r%')""")
def card_projection(spark: SparkSession, d: str) -> DataFrame:
    big, promo = F.col("p_size") > 20, F.col("p_type") == "PROMO"
    marks = F.array_sort(F.filter(F.array(F.when(big, F.lit("big")), F.when(promo, F.lit("promo")), F.when(F.col("p_name").contains("red"), F.lit("red"))), lambda x: x.isNotNull()))
    return table(spark, d, "part").filter(big | (promo & F.col("p_name").contains("r"))).select(F.col("p_partkey").alias("k"), F.concat_ws(",", marks).alias("marks"), big.alias("is_big"), promo.alias("is_promo"))


@query("""select event_id, (props->>'k')::bigint as k, coalesce(props->>'missing', 'none') as other from events""")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("other"))


@query("""with e as (select p_partkey as k, unnest(['brand', 'size', 'type']) as field, unnest([p_brand, case when p_partkey % 3 = 0 then 'unmapped' else p_size::varchar end, p_type]) as value from part) select k, field, value from e""")
def map_merge(spark: SparkSession, d: str) -> DataFrame:
    """Mapped and unmapped fields as one map, in which the unmapped win; then one row for each field."""
    mapped = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"), F.lit("type"), F.col("p_type"))
    other = F.when(F.col("p_partkey") % 3 == 0, F.create_map(F.lit("size"), F.lit("unmapped"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(mapped, lambda k, v: ~F.map_contains_key(other, k)), other)
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.explode(merged).alias("field", "value"))


@query("select c_mktsegment, count(*) as n, sum(case when has_order then 1 else 0 end) as active from (select c_mktsegment, c_custkey in (select o_custkey from orders) as has_order from customer) group by c_mktsegment")
def sql_existence(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    seen = table(spark, d, "orders").select("o_custkey").distinct().withColumn("has", F.lit(1))
    return c.join(seen, c.c_custkey == seen.o_custkey, "left").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.count("has").alias("active"))
