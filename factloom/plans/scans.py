"""Tables that go on over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.operators import scans
from factloom.plans.registry import query, table

# A page for each event of a user: some without tables, some with headings, some that go on.
_PAGES = """select user_id % 41 as doc, event_id as page, cast(case when event_id % 5 = 0 then 0 else event_id % 4 end as int) as tables, event_id % 7 < 3 as continued,
  case when event_id % 3 = 0 then 1 when event_id % 11 = 0 then 2 else 0 end as n, event_type from events"""


@query(f"""with recursive p as (select *, row_number() over (partition by doc order by page) as k from ({_PAGES}) as p),
q as (select doc, page, k, tables, continued, case n when 0 then []::varchar[] when 1 then [event_type] else [event_type, 'second ' || event_type] end as heads from p),
r as (select *, case when continued then greatest(tables - len(heads), 0) else 0 end as first, least(len(heads), tables - case when continued then greatest(tables - len(heads), 0) else 0 end) as used from q),
w(doc, k, before, after) as (
  select distinct doc, 0::bigint, null::struct(section varchar, begun bigint), null::struct(section varchar, begun bigint) from r
  union all
  select r.doc, r.k, w.after, case when tables = 0 then case when continued then w.after end when used > 0 then {{'section': heads[used], 'begun': page}} else coalesce(w.after, {{'section': 'Unknown', 'begun': page}}) end
  from w join r on r.doc = w.doc and r.k = w.k + 1),
t as (select r.*, coalesce(w.before, {{'section': 'Unknown', 'begun': page}}) as old, unnest(range(tables)) as i from r join w on w.doc = r.doc and w.k = r.k where tables > 0),
s as (select doc, page, i, case when i < first then old when i - first < used then {{'section': heads[i - first + 1], 'begun': page}} when used > 0 then {{'section': heads[used], 'begun': page}} else old end as x from t)
select doc, page, i::int as "at", x.section as section, x.begun as begun from s""")
def continued_tables(spark: SparkSession, d: str) -> DataFrame:
    """The section of every table, pages being composed by partition."""
    table(spark, d, "events").createOrReplaceTempView("events")
    pages = spark.sql(f"select doc, page, tables, continued, case n when 0 then cast(array() as array<string>) when 1 then array(event_type) else array(event_type, concat('second ', event_type)) end as heads from ({_PAGES}) as p")
    return scans.continued_tables(pages)


_LINES = "select l_suppkey % 53 as doc, l_orderkey * 8 + l_linenumber as seq, min(l_partkey) as p, min(l_quantity) as q, min(l_returnflag) as f from lineitem group by 1, 2"
_TABLES = f"""select doc, seq, cast(q % 3 + 2 as int) as columns, case when p % 4 = 0 then cast(p % 3 as int) end as address, f <> 'N' as mnemonic from ({_LINES}) as l"""


@query(f"""with t as ({_TABLES}), b as (select *, last_value(case when address is not null then {{'c': columns, 'a': address}} end ignore nulls) over (partition by doc order by seq rows between unbounded preceding and 1 preceding) as b from t)
select doc, seq, columns, address, mnemonic, coalesce(address, case when b.c = columns and mnemonic then b.a end) as layout from b""")
def summary_layouts(spark: SparkSession, d: str) -> DataFrame:
    """The address column of register summaries, those that go on without a header included."""
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    # a task groups the rows of a stretch or two, not those of a file
    lines.repartition(max(spark.sparkContext.defaultParallelism, -(-lines.count() // (2 * scans.STRETCH)))).createOrReplaceTempView("lineitem")
    return scans.summary_layouts(spark.sql(_TABLES))
