"""Filing, journals, corrections and outlines over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import dedup, filing
from factloom.plans.registry import query, table

_PLAN = """with n as (select doc_id as key, text as digest, case when n_chars >= 500 then left(text, 60) end as print, source || lang as family, doc_id % 40 as version, source as name from documents where doc_id % 2 = 1),
l as (select text as digest, case when n_chars >= 500 then left(text, 60) end as print, source || lang as family, doc_id % 40 as version, lang as folder from documents where doc_id % 2 = 0 and source not in ('src3', 'src4', 'src5')),
s as (select digest, min(folder) as same from l group by 1), t as (select print, min(folder) as twin from l where print is not null group by 1), k as (select family, max(version) as kv, min(folder) as kf from l group by 1),
j as (select n.*, same, twin, kv, kf, row_number() over (partition by n.digest order by key) = 1 as first from n left join s using (digest) left join t using (print) left join k using (family)),
c as (select *, case when same is not null then 1 when not first then 2 when twin is not null then 3 when version <= kv then 4 when version > kv then 5 when regexp_matches(name, '[34]$') then 6 else 7 end as c from j)
select key, case c when 4 then 'superseded' when 5 then 'file' when 6 then 'file' when 7 then 'look' else 'duplicate' end as action, case c when 1 then same when 3 then twin when 4 then kf when 5 then kf when 6 then 'ruled' end as folder,
(['content', 'batch', 'print', 'not newer', 'newer', 'rule', 'none'])[c] as reason from c"""


@query(_PLAN)
def filing_plan(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(
        F.col("doc_id").alias("key"), F.sha2("text", 256).alias("digest"), F.when(F.col("n_chars") >= 500, F.left(F.col("text"), F.lit(60))).alias("print"),
        F.concat("source", "lang").alias("family"), (F.col("doc_id") % 40).alias("version"), F.col("source").alias("name"), F.col("lang").alias("folder"),
    )
    library = rows.filter("key % 2 = 0 and name not in ('src3', 'src4', 'src5')")
    return filing.plan(rows.filter("key % 2 = 1").drop("folder"), library, [("[34]$", "ruled")])


_LINES = "len(string_split(text, chr(10)))::varchar"
_PRINT = rf"case when length(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ +| +$', '', 'g')) >= 500 then {_LINES} || ':' || sha256(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ +| +$', '', 'g')) end"
_ALL = _PLAN.replace("case when n_chars >= 500 then left(text, 60) end", _PRINT).replace("doc_id % 2 = 0 and source not in ('src3', 'src4', 'src5')", "doc_id % 2 = 0")
assert _ALL.count(_PRINT) == 2 and "src3" not in _ALL


@query(_ALL)
def filing_plan_all(spark: SparkSession, d: str) -> DataFrame:
    """Every odd document against every even one; the print is the number of lines and the digest of the whole normalised text."""
    lines = F.size(F.split("text", "\n")).cast("string")
    rows = table(spark, d, "documents").select(
        F.col("doc_id").alias("key"), F.sha2("text", 256).alias("digest"), F.concat(lines, F.lit(":"), dedup.fingerprint(F.col("text"))).alias("print"),
        F.concat("source", "lang").alias("family"), (F.col("doc_id") % 40).alias("version"), F.col("source").alias("name"), F.col("lang").alias("folder"),
    )
    return filing.plan(rows.filter("key % 2 = 1").drop("folder"), rows.filter("key % 2 = 0"), [("[34]$", "ruled")])


@query("""select o_orderkey, unnest(list_filter([case when o_totalprice > 400000 then 'too_large' end, case when o_orderpriority = '5-LOW' and o_orderstatus = 'P' then 'low_pending' end, case when o_custkey % 10 = 0 then 'round_customer' end], lambda x: x is not null)) as refused from orders""")
def plan_violations(spark: SparkSession, d: str) -> DataFrame:
    checks = {"too_large": F.col("o_totalprice") > 400000, "low_pending": (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P"), "round_customer": F.col("o_custkey") % 10 == 0}
    return filing.violations(table(spark, d, "orders"), "o_orderkey", checks)


@query("select user_id as path, arg_max(event_type, event_id) as state from events group by user_id")
def journal_replay(spark: SparkSession, d: str) -> DataFrame:
    return filing.replay(table(spark, d, "events").select(F.col("event_id").alias("op_seq"), F.col("event_type").alias("op"), F.col("user_id").alias("path")))


@query("select o_orderkey as op_seq, case o_orderstatus when 'F' then 'delete' when 'O' then 'create' else 'move' end as op, o_custkey as path, row_number() over (order by o_orderkey desc) as step from orders where o_custkey = 7")
def journal_undo(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("o_orderstatus") == "F", "create").when(F.col("o_orderstatus") == "O", "delete").otherwise("move")
    return filing.undo(table(spark, d, "orders").filter("o_custkey = 7").select(F.col("o_orderkey").alias("op_seq"), op.alias("op"), F.col("o_custkey").alias("path")))


@query("select o_orderkey as op_seq, case o_orderstatus when 'F' then 'delete' when 'O' then 'create' else 'move' end as op, o_custkey as path, row_number() over (order by o_orderkey desc) as step from orders")
def journal_undo_all(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("o_orderstatus") == "F", "create").when(F.col("o_orderstatus") == "O", "delete").otherwise("move")
    return filing.undo(table(spark, d, "orders").select(F.col("o_orderkey").alias("op_seq"), op.alias("op"), F.col("o_custkey").alias("path")))


_FIX = "case l_linenumber % 5 when 0 then 'nothing' when 1 then ' Size = ' || l_quantity::int::varchar when 2 then '= 3' when 3 then 'type =' else 'price = ' || l_suppkey::varchar end"


@query(f"""with f as (select l_orderkey as key, l_linenumber * 1000000 + l_partkey as pos, min({_FIX}) as fix from lineitem group by 1, 2), x as (select key, pos, fix, lower(trim(regexp_extract(fix, '^([^=]*)=', 1))) as field, trim(regexp_extract(fix, '^[^=]*=(.*)$', 1)) as value from f)
select key, pos, field, value, case when not contains(fix, '=') then 'no sign' when field = '' then 'no field' when value = '' then 'no value' when field not in ('size', 'type') then 'unknown field' when row_number() over (partition by key, field order by pos) > 1 then 'repeated' end as problem from x""")
def card_corrections(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber") % 5
    fix = F.when(n == 0, "nothing").when(n == 1, F.concat(F.lit(" Size = "), F.col("l_quantity").cast("int").cast("string"))).when(n == 2, "= 3").when(n == 3, "type =").otherwise(F.concat(F.lit("price = "), F.col("l_suppkey").cast("string")))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("pos"), fix.alias("fix")).groupBy("key", "pos").agg(F.min("fix").alias("fix"))
    return filing.corrections(rows, ["size", "type"])


@query("""with c as (select doc_id, len(string_split(text, chr(10))) as n from documents), r as (select doc_id, n, unnest(range(1, n + 1, 20)) as first from c)
select doc_id, first::int as first, least(first + 19, n)::int as last from r where not (first = 1 and doc_id % 3 = 0)""")
def chunk_plan(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("n"))
    return filing.chunks(docs, "doc_id", "n", 20, docs.filter("doc_id % 3 = 0").select("doc_id", F.lit(1).alias("first")))


@query("""with x as (select l_orderkey, l_linenumber as pos, max(l_quantity) as a, max(l_discount) as b, max(l_tax) as c from lineitem group by all), left_over as (select * from x where not exists (select 1 from x y where y.l_orderkey = x.l_orderkey and y.a = x.a and y.c = x.b and y.b = x.c)), p as (select x.l_orderkey, x.pos, y.pos as other, list_sort([x.a, x.b, x.c]) = list_sort([y.a, y.c, y.b]) as shift from left_over x join x y using (l_orderkey)),
r as (select *, row_number() over (partition by l_orderkey, pos order by not shift, other) as rn from p) select l_orderkey, pos, other, case when shift then 'column_shift' else 'readers_disagree' end as flag from r where rn = 1""")
def nearest_twin(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("pos")).agg(F.max("l_quantity").alias("min"), F.max("l_discount").alias("typ"), F.max("l_tax").alias("max"))
    y = x.select("l_orderkey", "pos", "min", F.col("max").alias("typ"), F.col("typ").alias("max"))
    return filing.nearest_twin(x, y, ["l_orderkey"])


@query(r"""with t as (select page_id, regexp_extract_all(html, '<(h1|b)>([^<]*)', 2) as h from pages), u as (select page_id, unnest(range(len(h))) as i, unnest(h) as title from t), k as (select page_id, i, title from u where len(string_split(trim(title), ' ')) <= 12)
select page_id, title, min(i) as seq from k group by page_id, title""")
def heading_outline(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<(h1|b)>([^<]*)"), F.lit(2))).alias("i", "title"))
    return h.filter(F.size(F.split(F.trim("title"), " ")) <= 12).groupBy("page_id", "title").agg(F.min("i").alias("seq"))


@query(r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as x from documents), p as (select doc_id, regexp_extract_all(x, '([0-9]{1,3}) +([A-Za-z]+)', 1) as i, regexp_extract_all(x, '([0-9]{1,3}) +([A-Za-z]+)', 2) as s from l),
e as (select doc_id, unnest(i)::int as idx, unnest(s) as signal from p) select doc_id, idx, signal, count(*) as n from e where idx between 1 and 512 group by all""")
def index_pairs(spark: SparkSession, d: str) -> DataFrame:
    g = lambda k: F.regexp_extract_all("x", F.lit("([0-9]{1,3}) +([A-Za-z]+)"), F.lit(k))
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("x"))
    pairs = lines.select("doc_id", F.inline(F.arrays_zip(g(1).alias("i"), g(2).alias("signal")))).withColumn("idx", F.col("i").cast("int"))
    return pairs.filter("idx between 1 and 512").groupBy("doc_id", "idx", "signal").agg(F.count(F.lit(1)).alias("n"))


@query(r"""with l as (select doc_id, unnest(range(len(string_split(text, chr(10))))) as i, unnest(string_split(text, chr(10))) as x from documents)
select doc_id, i + 1 as line_no, regexp_extract(x, '^([A-Z][a-z]+)[ ,]', 1) as chapter from l where regexp_matches(x, '^([A-Z][a-z]+)[ ,]') and length(x) < 200""")
def contents_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x"))
    return lines.filter(F.col("x").rlike("^([A-Z][a-z]+)[ ,]") & (F.length("x") < 200)).select("doc_id", (F.col("i") + 1).alias("line_no"), F.regexp_extract("x", "^([A-Z][a-z]+)[ ,]", 1).alias("chapter"))
