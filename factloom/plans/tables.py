"""Table typing over cells made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import tables
from factloom.plans.registry import query, table

_CELLS = """with c as (select p_partkey as k, case p_partkey % 4 when 0 then p_size::varchar when 1 then p_size::varchar || ' ' || (p_size + 1)::varchar when 2 then p_size::varchar || '  ' || (p_size + 1)::varchar || ' ' || (p_size + 2)::varchar else p_size::varchar || ' x' end as vals,
case p_partkey % 3 when 0 then 'V' when 1 then 'V A' else 'mA' end as units from part)"""


def cells(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), lambda n: (F.col("p_size") + n).cast("string")
    values = F.when(k % 4 == 0, s(0)).when(k % 4 == 1, F.concat_ws(" ", s(0), s(1))).when(k % 4 == 2, F.concat(s(0), F.lit("  "), s(1), F.lit(" "), s(2))).otherwise(F.concat(s(0), F.lit(" x")))
    return table(spark, d, "part").select(k.alias("k"), values.alias("vals"), F.when(k % 3 == 0, "V").when(k % 3 == 1, "V A").otherwise("mA").alias("units"))


@query(_CELLS + """, t as (select k, regexp_split_to_array(vals, '\\s+') as v, string_split(units, ' ') as u, vals, units from c), f as (select *, len(v) > 1 and (len(u) = 1 or len(u) = len(v)) as fits from t),
x as (select k, fits, u, units, unnest(case when fits then range(len(v)) else [0] end) as part, unnest(case when fits then v else [vals] end) as value from f)
select k, part, value, case when not fits then units when len(u) = 1 then u[1] else u[part + 1] end as unit from x""")
def merged_row_split(spark: SparkSession, d: str) -> DataFrame:
    return tables.split_merged(cells(spark, d), "vals", "units").select("k", "part", "value", "unit")


@query(_CELLS + """, n as (select k, regexp_extract_all(vals, '-?[0-9]+(?:\\.[0-9]+)?') as n, k % 5 = 0 as taken from c)
select k, case when taken then 1.0 when len(n) >= 2 then n[1]::double end as min, case when not taken and len(n) = 3 then n[2]::double when taken then 2.0 end as typ, case when not taken and len(n) >= 2 then n[len(n)]::double end as max from n""")
def packed_values(spark: SparkSession, d: str) -> DataFrame:
    taken = F.col("k") % 5 == 0
    x = tables.unpack_triple(F.col("vals"), F.when(taken, F.lit(1.0)), F.when(taken, F.lit(2.0)), F.lit(None).cast("double"))
    return cells(spark, d).select("k", x.alias("x")).select("k", "x.min", "x.typ", "x.max")


@query("""with r as (select l_orderkey, l_linenumber * 1000000 + l_partkey as seq, max(l_returnflag) as symbol, max(case when l_quantity > 25 then l_linestatus end) as unit from lineitem group by all)
select l_orderkey, seq, symbol, coalesce(unit, case when lag(symbol) over w = symbol then lag(unit) over w end, case when lead(symbol) over w = symbol then lead(unit) over w end) as unit from r window w as (partition by l_orderkey order by seq)""")
def neighbour_units(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "lineitem").groupBy("l_orderkey", (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("seq")).agg(F.max("l_returnflag").alias("symbol"), F.max(F.when(F.col("l_quantity") > 25, F.col("l_linestatus"))).alias("unit"))
    return tables.unit_from_neighbours(r, ["l_orderkey"], "seq")


_UNITS = "case p_partkey % 5 when 0 then 'A' when 1 then 'uA' when 2 then case when p_size > 30 then 'mA' else 'uV' end when 3 then 'V' else 'W' end"


@query(f"""with r as (select p_partkey as k, p_brand as page, {_UNITS} as unit from part), n as (select page, right(unit, 1) as kind, count(*) filter (starts_with(unit, 'u')) as micro, count(*) filter (regexp_matches(unit, '^[kmM][AVW]$')) as plain from r group by all),
f as (select k, page, unit, case when length(unit) = 1 and micro > 0 and plain > 0 then 'unit_unclear' when length(unit) = 1 and micro > 0 then 'unit_repaired' end as flag from r join n using (page) where kind = right(unit, 1))
select k, page, case when flag = 'unit_repaired' then 'u' || unit else unit end as unit, flag from f""")
def unit_repair(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    unit = F.when(k % 5 == 0, "A").when(k % 5 == 1, "uA").when(k % 5 == 2, F.when(F.col("p_size") > 30, "mA").otherwise("uV")).when(k % 5 == 3, "V").otherwise("W")
    r = table(spark, d, "part").select(k.alias("k"), F.col("p_brand").alias("page"), unit.alias("unit"))
    return tables.repair_units(r, ["page"]).select("k", "page", "unit", "flag")


@query("""select conv_id, turn, role, last_value(case when role = 'user' then left(text, 20) end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) as section from conversations""")
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return tables.carry_forward(c, ["conv_id"], "turn", F.when(F.col("role") == "user", F.left(F.col("text"), F.lit(20))), "section").select("conv_id", "turn", "role", "section")


@query("""select user_id, event_id, sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by event_id rows unbounded preceding) as chain from events""")
def continuation_chains(spark: SparkSession, d: str) -> DataFrame:
    return tables.islands(table(spark, d, "events"), ["user_id"], "event_id", F.col("event_type") == "signup", "chain").select("user_id", "event_id", "chain")


@query("""with i as (select user_id, event_id as seq, case when event_type = 'signup' then 'heading' else 'field' end as kind, (event_id % 8) as top, (event_id % 3) as low from events), h as (select *, sum(case when kind = 'heading' then 1 else 0 end) over (partition by user_id order by seq rows unbounded preceding) as h from i),
f as (select *, first_value(top) over w as first, lag(low) over w as before from h where h > 0 and kind = 'field' window w as (partition by user_id, h order by seq)),
g as (select *, sum(case when before = 0 and top >= first then 1 else 0 end) over (partition by user_id, h order by seq rows unbounded preceding) as again from f), b as (select user_id, h, again, count(*) as fields from g group by all),
n as (select user_id, h, 'r' || seq::varchar as name from h where kind = 'heading')
select n.user_id, case when coalesce(again, 0) = 0 then name else name || '+' || again::varchar end as register, coalesce(fields, 0) as fields from n left join b using (user_id, h)""")
def register_assembly(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    items = table(spark, d, "events").select("user_id", e.alias("seq"), F.when(F.col("event_type") == "signup", "heading").otherwise("field").alias("kind"), F.concat(F.lit("r"), e.cast("string")).alias("text"), (e % 8).alias("top"), (e % 3).alias("low"))
    return tables.assemble_registers(items, "user_id")


@query("""with a as (select doc_id, string_split(text, chr(10)) as x from documents), b as (select a.doc_id, a.x as x, b.x as y from a join a b on b.doc_id = a.doc_id + 1), z as (select doc_id, unnest(range(least(len(x), len(y)))) as part, x, y from b)
select doc_id, part, length(x[part + 1]) as n_left, length(y[part + 1]) as n_right from z where not regexp_matches(y[part + 1], '^[-–—]*$')""")
def zipped_cells(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "documents").select("doc_id", F.col("text").alias("x"))
    b = a.join(a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("x").alias("y")), "doc_id")
    return tables.zip_cells(b, "x", "y").select("doc_id", "part", F.length("left").alias("n_left"), F.length("right").alias("n_right"))


@query("""with h as (select p_partkey, list_transform(string_split(p_name || ' ' || lower(p_type), ' '), lambda x: lower(trim(x))) as h from part)
select p_partkey, coalesce(list_position(list_transform(h, lambda x: x in ('red', 'small')), true), 0)::int as adjective, coalesce(list_position(list_transform(h, lambda x: x in ('ring', 'widget')), true), 0)::int as thing from h""")
def header_typing(spark: SparkSession, d: str) -> DataFrame:
    x = tables.typed_columns(F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " "), {"adjective": ["red", "small"], "thing": ["ring", "widget"]})
    return table(spark, d, "part").select("p_partkey", x.alias("x")).select("p_partkey", "x.adjective", "x.thing")
