"""Scalar functions over cells made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import scalars
from factloom.plans.registry import query, table


@query(r"select p_partkey, upper(regexp_replace(regexp_replace(p_name || '-' || p_brand || case when p_partkey % 2 = 0 then ' (1)' else '' end, '\s*\([0-9]{1,2}\)\s*$', ''), '[^A-Za-z0-9]', '', 'g')) as part from part")
def part_normal(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.col("p_name"), F.lit("-"), F.col("p_brand"), F.when(F.col("p_partkey") % 2 == 0, " (1)").otherwise(""))
    return table(spark, d, "part").select("p_partkey", scalars.norm_part(name).alias("part"))


_NUM = "case p_partkey % 6 when 0 then '−' || p_size::varchar when 1 then '– ' || p_size::varchar when 2 then '1,' || (100 + p_size)::varchar || '.5' when 3 then 'TBD' when 4 then p_size::varchar || ' V' else p_size::varchar end"


@query(rf"with c as (select p_partkey, trim(regexp_replace(translate({_NUM}, '−–,', '--'), '^-\s+', '-')) as c from part) select p_partkey, case when regexp_matches(c, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') then c::double end as number from c")
def strict_numbers(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    cell = F.when(k % 6 == 0, F.concat(F.lit("−"), s)).when(k % 6 == 1, F.concat(F.lit("– "), s)).when(k % 6 == 2, F.concat(F.lit("1,"), (F.col("p_size") + 100).cast("string"), F.lit(".5"))).when(k % 6 == 3, "TBD").when(k % 6 == 4, F.concat(s, F.lit(" V"))).otherwise(s)
    return table(spark, d, "part").select("p_partkey", scalars.to_number(cell).alias("number"))


@query("""with c as (select p_partkey as k, p_size as s, (['', 'k', 'm', 'u'])[p_partkey % 4 + 1] as p, (['V', 'Hz', 'A'])[p_partkey % 3 + 1] as u from part)
select k, round_even(s * case p when 'k' then 1e3 when 'm' then 1e-3 when 'u' then 1e-6 else 1.0 end::double * case when u = 'Hz' then 1e-3::double else 1.0::double end, 6) as value, case when u = 'Hz' then 'kHz' else u end as unit from c""")
def quantity_values(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % n + 1).cast("int"))
    text = F.concat(F.lit("typ "), F.col("p_size").cast("string"), F.lit(" "), pick(["", "k", "m", "u"], 4), pick(["V", "Hz", "A"], 3))
    return table(spark, d, "part").select(k.alias("k"), scalars.value_of(text).alias("x")).select("k", "x.value", "x.unit")


NUMBER = r"([-+]?[0-9]*\.?[0-9]+)\s*([pnuµμmkKMG])?(?:\s|$|[VAWH])"
PREFIX = "case x[2] when 'p' then 1e-12 when 'n' then 1e-9 when 'u' then 1e-6 when 'µ' then 1e-6 when 'μ' then 1e-6 when 'm' then 1e-3 when 'k' then 1e3 when 'K' then 1e3 when 'M' then 1e6 when 'G' then 1e9 else 1.0 end::double"


def numbers_sql(text: str, scale: str = "1.0::double") -> str:
    plain = f"translate({text}, '−–', '- ')"
    zipped = f"list_zip(regexp_extract_all({plain}, '{NUMBER}', 1), regexp_extract_all({plain}, '{NUMBER}', 2))"
    return f"list_transform({zipped}, lambda x: round_even(x[1]::double * {PREFIX} * {scale}, 6))"


@query(f"with n as (select doc_id, {numbers_sql('text')} as n from documents) select doc_id, len(n)::bigint as n, list_max(n) as top, list_min(n) as low from n where len(n) > 0")
def numbers_in_text(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", scalars.numbers_in(F.col("text")).alias("n")).filter(F.size("n") > 0)
    return rows.select("doc_id", F.size("n").cast("long").alias("n"), F.array_max("n").alias("top"), F.array_min("n").alias("low"))


@query("select p_partkey, '0x' || case when p_partkey % 200 < 16 then '0' else '' end || printf('%X', p_partkey % 200) as address, 4096 + p_partkey % 200 as absolute from part")
def register_addresses(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey") % 200
    shown = F.when(n % 3 == 0, F.concat(F.hex(n), F.lit("h"))).when(n % 3 == 1, F.concat(F.lit("0x"), F.hex(n))).otherwise(n.cast("string"))
    address = scalars.hex_normal(shown)
    return table(spark, d, "part").select("p_partkey", address.alias("address"), scalars.absolute_address(F.lit("0x1000"), address).alias("absolute"))


@query(r"""with f as (select doc_id, unnest(string_split_regex(text, '[.;]\s+')) as x from documents) select doc_id, count(*) as n from f where length(trim(x)) >= 9 group by doc_id""")
def sentence_fragments(spark: SparkSession, d: str) -> DataFrame:
    x = F.filter(F.split("text", "[.;]\\s+"), lambda f: F.length(F.trim(f)) >= 9)
    return table(spark, d, "documents").select("doc_id", F.size(x).cast("long").alias("n")).filter("n > 0")


_CLAIMS = [("license", "(MIT|Apache|GNU)"), ("token", "token = \"([0-9a-f]+)\""), ("mail", "([a-z0-9.]+@[a-z0-9.]+)"), ("license", "(rights reserved)")]


@query("with c as (" + " union all ".join(f"select doc_id, {i} as pos, '{k}' as key, regexp_extract(text, '{p}', 1) as value from documents where regexp_matches(text, '{p}')" for i, (k, p) in enumerate(_CLAIMS)) + ") select doc_id, key, arg_min(value, pos) as value, count(*) as n from c group by doc_id, key")
def claim_extraction(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").select("doc_id", F.inline(scalars.claims(F.col("text"), _CLAIMS)))
    return c.groupBy("doc_id", "key").agg(F.min_by("value", "pos").alias("value"), F.count(F.lit(1)).alias("n"))


@query(r"""with t as (select o_orderkey, 'see 10.' || (1000 + o_custkey)::varchar || '/abc.' || o_orderkey::varchar || ' arXiv:' || lpad((o_orderkey % 10000)::varchar, 4, '0') || '.12345 of ' || year(o_orderdate)::varchar || ' end' as t from orders)
select o_orderkey, regexp_extract(t, '(10\.[0-9]{4,9}/[^\s"<>]+)', 1) as doi, regexp_extract(t, 'arXiv:([0-9]{4}\.[0-9]{4,5})', 1) as arxiv from t""")
def paper_identifiers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    t = F.concat(F.lit("see 10."), (F.col("o_custkey") + 1000).cast("string"), F.lit("/abc."), k.cast("string"), F.lit(" arXiv:"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit(".12345 of "), F.year("o_orderdate").cast("string"), F.lit(" end"))
    return table(spark, d, "orders").select("o_orderkey", scalars.identifiers(t).alias("x")).select("o_orderkey", "x.doi", "x.arxiv")


@query(r"""with n as (select p_partkey, replace(p_name, ' ', case when p_partkey % 2 = 0 then '  ' else '_' end) || '_v' || (p_size % 9)::varchar || '.' || (p_size % 4)::varchar || '_DS' || case when p_partkey % 3 = 0 then ' (2)' else '' end as n from part)
, c as (select p_partkey, regexp_replace(regexp_replace(regexp_replace(n, '(?i)\s*(\([0-9]+\)|- copy|_copy)$', ''), '[\s_]+', '_', 'g'), '(?i)_(v[0-9.]+)_(ds|um)$', '_\2_\1') as c from n)
select p_partkey, c as name, regexp_replace(c, '(?i)[_-]?(v|rev)[0-9.]+$', '') as family, regexp_extract(c, '(?i)(?:v|rev)\.?\s*([0-9]+(?:\.[0-9]+)*)$', 1) as revision from c""")
def name_cleaning(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    n = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.when(k % 2 == 0, "  ").otherwise("_")), F.lit("_v"), (s % 9).cast("string"), F.lit("."), (s % 4).cast("string"), F.lit("_DS"), F.when(k % 3 == 0, " (2)").otherwise(""))
    c = scalars.clean_name(n)
    return table(spark, d, "part").select("p_partkey", c.alias("name"), scalars.family(c).alias("family"), scalars.revision(c).alias("revision"))


@query(r"select doc_id, length(regexp_replace(regexp_replace(text, '(?m)^(#{1,5}) ', '#\1 ', 'g'), '\[\[', '\\[\\[', 'g')) as n, regexp_replace(regexp_replace(text, '([a-z])-\n([a-z])', '\1\2', 'g'), '\s*\.{4,}\s*', ' ', 'g') = text as whole from documents")
def text_repairs(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.length(F.regexp_replace(scalars.demote_headings(t), "\\[\\[", "\\\\[\\\\[")).alias("n"), (scalars.join_hyphens(t) == t).alias("whole"))


@query()
def column_streams(spark: SparkSession, d: str) -> DataFrame:
    """Down the page: the segments of every line, numbered from 1."""
    lines = table(spark, d, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("i", "x"))
    line = F.concat_ws("     ", "x", F.lit("right side"), "source")
    return lines.select("doc_id", (F.col("i") + 1).alias("line_no"), F.inline(scalars.column_streams(line)))
