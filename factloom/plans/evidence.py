"""Fusion, reconciliation and verification over readings derived from `part`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import evidence
from factloom.plans.registry import query, table

_READ = """with readings as (select p_partkey as k,
  case when p_partkey % 3 <> 0 then p_size::double end as prose_min, case when p_partkey % 7 <> 0 and p_partkey % 3 <> 0 then p_size * 2.0::double end as prose_max,
  case when p_partkey % 4 <> 1 then p_size + p_size * (p_partkey % 4) / 50.0::double end as roc_min, case when p_partkey % 7 <> 0 and p_partkey % 4 <> 1 then p_size * 2.0::double end as roc_max,
  case when p_partkey % 5 <> 2 then p_size::double end as page1_min, case when p_partkey % 5 <> 2 then p_size * 2 + p_size * (p_partkey % 5) / 25.0::double end as page1_max from part)"""


def readings(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size").cast("double")
    return table(spark, d, "part").select(
        k.alias("k"), F.when(k % 3 != 0, s).alias("prose_min"), F.when((k % 7 != 0) & (k % 3 != 0), s * 2).alias("prose_max"),
        F.when(k % 4 != 1, s + s * (k % 4) / 50.0).alias("roc_min"), F.when((k % 7 != 0) & (k % 4 != 1), s * 2).alias("roc_max"),
        F.when(k % 5 != 2, s).alias("page1_min"), F.when(k % 5 != 2, s * 2 + s * (k % 5) / 25.0).alias("page1_max"),
    )


def _end(a: str, b: str) -> str:
    return f"(({a} is null and {b} is null) or coalesce(abs({a} - {b}) <= 0.05::double * greatest(abs({a}), abs({b})), false))"


def _h(x: str) -> str:
    return f"({x}_min is not null or {x}_max is not null)"


def _a(x: str, y: str) -> str:
    return f"({_h(x)} and {_h(y)} and {_end(x + '_min', y + '_min')} and {_end(x + '_max', y + '_max')})"


_P, _R, _G = "prose", "roc", "page1"
_FUSED = f"""{_READ}, v as (select *, case when {_a(_P, _R)} then 1 when {_a(_P, _G)} then 2 when {_a(_R, _G)} then 3 when {_h(_P)} and ({_h(_R)} or {_h(_G)}) then 4 when {_h(_P)} then 5
  when {_h(_R)} and {_h(_G)} then 6 when {_h(_R)} then 7 when {_h(_G)} then 8 else 9 end as rule from readings),
fused as (select k, case when rule in (1, 2, 4, 5) then 'prose' when rule in (3, 6, 7) then 'roc' when rule = 8 then 'page1' end as source,
  case when rule <= 3 then 'high' when rule in (5, 7) then 'medium' when rule = 9 then 'none' else 'low' end as confidence,
  case rule when 1 then case when {_h(_G)} and not {_a(_P, _G)} then 'page1' end when 2 then case when {_h(_R)} and not {_a(_P, _R)} then 'roc' end when 3 then case when {_h(_P)} and not {_a(_R, _P)} then 'prose' end
    when 4 then concat_ws(',', case when {_h(_R)} then 'roc' end, case when {_h(_G)} then 'page1' end) when 6 then 'page1' end as dissent,
  case when rule in (1, 2, 4, 5) then prose_min when rule in (3, 6, 7) then roc_min when rule = 8 then page1_min end as min,
  case when rule in (1, 2, 4, 5) then prose_max when rule in (3, 6, 7) then roc_max when rule = 8 then page1_max end as max from v)"""


@query(_FUSED + " select * from fused")
def evidence_fusion(spark: SparkSession, d: str) -> DataFrame:
    return evidence.fuse(readings(spark, d)).select("k", "source", "confidence", "dissent", "min", "max")


@query(f"{_READ} select k, coalesce(roc_min, page1_min) as table_min, coalesce(roc_max, page1_max) as table_max, {_h(_R)} and {_h(_G)} and not {_a(_R, _G)} as readers_disagree from readings")
def reader_preference(spark: SparkSession, d: str) -> DataFrame:
    return evidence.prefer_reader(readings(spark, d), "roc", "page1", "table").select("k", "table_min", "table_max", "readers_disagree")


@query("""with r as (select p_partkey as k, (p_size % 7)::double as lo, (p_partkey % 5)::double as hi from part)
select k, case when lo <= hi then lo end as min, case when lo <= hi then hi end as max, concat_ws(',', case when lo > hi then 'inverted_range' end, case when lo = 0 then 'zero_minimum' end) as flags from r""")
def range_sanity(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") % 7).cast("double").alias("min"), (F.col("p_partkey") % 5).cast("double").alias("max"))
    return evidence.sane(r).withColumn("flags", F.concat_ws(",", "flags"))


@query(_FUSED + """ , l as (select k % 50 as doc, list_min(list_transform(list(confidence) filter (confidence <> 'none'), lambda x: list_position(['none', 'low', 'medium', 'high'], x))) as r, count(*) as n from fused group by all)
select doc, coalesce((['none', 'low', 'medium', 'high'])[r], 'none') as confidence, n from l""")
def overall_confidence(spark: SparkSession, d: str) -> DataFrame:
    fused = evidence.fuse(readings(spark, d)).groupBy((F.col("k") % 50).alias("doc")).agg(F.collect_set("confidence").alias("levels"), F.count(F.lit(1)).alias("n"))
    return fused.select("doc", evidence.least_level(F.col("levels")).alias("confidence"), "n")


_RECON = """with f as (select k, min as doc_min, max as doc_max, confidence as doc_confidence from fused), e as (select f.*, case when k % 6 <> 0 then p_size::double end as export_min,
  case when k % 4 <> 0 then p_size * 2 + (k % 3)::double end as export_max, case when k % 97 = 0 then 42.0::double end as override from f join part on p_partkey = k),
g as (select *, (doc_min is not null or doc_max is not null) as d, (export_min is not null or export_max is not null) as x,
  (doc_min is null or export_min is null or abs(doc_min - export_min) <= greatest(0.02::double * greatest(abs(doc_min), abs(export_min)), 1e-6::double)) and
  (doc_max is null or export_max is null or abs(doc_max - export_max) <= greatest(0.02::double * greatest(abs(doc_max), abs(export_max)), 1e-6::double)) as fits from e),
o as (select *, case when override is not null then 'override' when d and x and fits then 'agree' when d and x then 'conflict' when x then 'export_only' when d then 'doc_only' else 'none' end as outcome from g)
select k, outcome, case when outcome = 'override' then override when outcome = 'export_only' or (outcome = 'conflict' and doc_confidence <> 'high') then export_min else coalesce(doc_min, export_min) end as value_min,
  case when outcome = 'override' then override when outcome = 'export_only' or (outcome = 'conflict' and doc_confidence <> 'high') then export_max else coalesce(doc_max, export_max) end as value_max,
  case when outcome in ('override', 'agree') then 'high' when outcome in ('conflict', 'export_only') then 'medium' when outcome = 'doc_only' then doc_confidence else 'none' end as confidence, outcome = 'conflict' as contested from o"""


@query(_FUSED + ", " + _RECON.removeprefix("with "))
def reconcile_export(spark: SparkSession, d: str) -> DataFrame:
    fused = evidence.fuse(readings(spark, d)).select("k", F.col("min").alias("doc_min"), F.col("max").alias("doc_max"), F.col("confidence").alias("doc_confidence"))
    k, s = F.col("p_partkey"), F.col("p_size").cast("double")
    export = table(spark, d, "part").select(k.alias("k"), F.when(k % 6 != 0, s).alias("export_min"), F.when(k % 4 != 0, s * 2 + k % 3).alias("export_max"), F.when(k % 97 == 0, F.lit(42.0)).alias("override"))
    return evidence.reconcile(fused.join(export, "k")).select("k", "outcome", "value_min", "value_max", "confidence", "contested")


@query("""with was as (select p_partkey as k, p_retailprice as verified from part where p_partkey % 3 = 0), now as (select p_partkey as k, case when p_partkey % 9 = 0 then p_retailprice + 1 else p_retailprice end as value from part)
select now.k, coalesce(verified, value) as shown, verified is not null and verified <> value as changed from now left join was using (k)""")
def sticky_verification(spark: SparkSession, d: str) -> DataFrame:
    k, v = F.col("p_partkey"), F.col("p_retailprice")
    was = table(spark, d, "part").filter(k % 3 == 0).select(k.alias("k"), v.alias("verified"))
    now = table(spark, d, "part").select(k.alias("k"), F.when(k % 9 == 0, v + 1).otherwise(v).alias("value"))
    return now.join(was, "k", "left").select("k", F.coalesce("verified", "value").alias("shown"), (F.col("verified").isNotNull() & (F.col("verified") != F.col("value"))).alias("changed"))
