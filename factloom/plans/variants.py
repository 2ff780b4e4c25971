"""A second reading of spec rows against the first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.operators import variants
from factloom.plans.registry import query, table

# Rows of both readings: the second loses some, names some otherwise, finds some on the next page and reads some otherwise.
_BASE = """select l_orderkey % 997 as doc, l_linenumber as page, concat(l_returnflag, '_', l_linestatus) as symbol, cast(null as varchar(9)) as parameter,
  cast(l_quantity as double) as "min", case when l_partkey % 3 = 0 then round(l_discount * 100, 0) end as typ, case when l_partkey % 4 > 0 then round(l_tax * 100, 0) end as "max", l_partkey, l_suppkey
from lineitem"""
_VARIANT = f"""select doc, case when l_partkey % 7 = 0 then page + 1 else page end as page, case when l_partkey % 13 = 0 then 'Other' else symbol end as symbol,
  case when l_partkey % 17 = 0 then 'Vin' end as parameter, "min", typ, case when l_partkey % 5 = 0 then "max" + 1 else "max" end as "max"
from ({_BASE}) as b where l_partkey % 11 <> 0"""
_PAGES = f"""select doc, page, string_agg(cast(cast("min" as int) as varchar(9)) || ', ' || coalesce(cast(cast("max" as int) as varchar(9)), '-'), ' ') as text from ({_BASE}) as b where l_suppkey % 3 > 0 group by doc, page"""


def _plain(sql: str) -> str:
    return sql.replace('"', "`")


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    table(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    pages = _plain(_PAGES).replace("string_agg(", "listagg(")
    return spark.sql(_plain(_BASE)), spark.sql(_plain(_VARIANT)), spark.sql(pages)


_ENTRIES = f"""r as (select doc, page, symbol, parameter, "min", typ, "max", 1 as a, 0 as b from ({_BASE}) as x union all select doc, page, symbol, parameter, "min", typ, "max", 0, 1 from ({_VARIANT}) as y),
e as (select doc, page, regexp_replace(lower(case when coalesce(symbol, '') <> '' then symbol else coalesce(parameter, '') end), '[^a-z0-9]', '', 'g') as name, "min", typ, "max", sum(a)::bigint as base, sum(b)::bigint as variant from r group by all),
s0 as (select *, least(base, variant) as same, base - least(base, variant) as a, variant - least(base, variant) as b from e),"""


def _step(out: str, of: str, name: str, by: str, order: str, ok: str = "true") -> str:
    """SQL of one step: what it takes of each entry, and what it leaves."""
    order = order.replace(", ", " nulls first, ")
    before = f"over (partition by {by} order by {order} nulls first rows between unbounded preceding and 1 preceding)"
    both = f"least(sum(a) over (partition by {by}), sum(b) over (partition by {by}))"
    take = {s: f"case when {ok} then least({s}, greatest({both} - coalesce(sum({s}) {before}, 0), 0)) else 0 end" for s in "ab"}
    return f"{out} as (select * exclude (a, b), {name}_a, {name}_b, a - {name}_a as a, b - {name}_b as b from (select *, {take['a']} as {name}_a, {take['b']} as {name}_b from {of}))"


_STEPS = ",\n".join([
    _step("s1", "s0", "agree", 'doc, page, "min", typ, "max"', "name"), "s2 as (select *, a as only_a, b as only_b from s1)", _step("s3", "s2", "moved", 'doc, name, "min", typ, "max"', "page", "name <> ''"),
    _step("s4", "s3", "changed", "doc, page, name", '"min", typ, "max"', "name <> ''"),
])
_SUMS = ", ".join(f"sum({c}) as {c}" for c in ("base", "variant", "same", "agree_a", "only_a", "only_b", "moved_a", "changed_a"))
_SEEN = """coalesce("min", typ, "max") is not null and list_bool_and(list_transform(list_filter(["min", typ, "max"], lambda v: v is not null), lambda v: regexp_matches(coalesce(text, ''),
  '(^|[^0-9.])' || replace(regexp_replace(v::varchar, '\\.0$', ''), '.', '\\.') || '($|[^0-9])')))"""
_COUNTED = f"""k as (select doc, page, "min", typ, "max", {_SUMS} from s4 group by all),
w as (select k.*, ({_SEEN})::int as seen from k left join ({_PAGES}) as p on p.doc = k.doc and p.page = k.page),
c as (select doc, sum(base) as rows_base, sum(variant) as rows_variant, sum(same + agree_a) as agree, sum(same) as same_symbol, sum(only_a) as only_base, sum(only_b) as only_variant, sum(moved_a) as moved,
  sum(changed_a) as changed, sum(case when only_a > 0 then base * seen else 0 end) as witnessed_base, sum(case when only_b > 0 then variant * seen else 0 end) as witnessed_variant from w group by doc)"""
_LIST = ", ".join(f"{c}::bigint as {c}" for c in variants.COUNTS)
_TOTAL = ", ".join(f"sum({c})::bigint as {c}" for c in variants.COUNTS)


@query(f"with {_ENTRIES}\n{_STEPS},\n{_COUNTED}\nselect doc, {_LIST} from c union all select null, {_TOTAL} from c")
def variant_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows, agreement, moved, changed and one-sided rows of two readings, by document and in all."""
    return variants.report(*_sides(spark, d))


@query(f"""with {_ENTRIES}\n{_STEPS},
x as (select doc, page, name, "min", typ, "max", unnest(range(changed_a::bigint)) as i from s4 where changed_a > 0),
y as (select doc, page, name, "min", typ, "max", unnest(range(changed_b::bigint)) as i from s4 where changed_b > 0),
f as (select *, row_number() over (partition by doc, page, name order by "min" nulls first, typ nulls first, "max" nulls first) as k from x),
g as (select *, row_number() over (partition by doc, page, name order by "min" nulls first, typ nulls first, "max" nulls first) as k from y)
select f.doc, f.page, f.name, f.k, f."min" as was_min, f.typ as was_typ, f."max" as was_max, g."min" as now_min, g.typ as now_typ, g."max" as now_max from f join g using (doc, page, name, k)""")
def variant_changes(spark: SparkSession, d: str) -> DataFrame:
    """Rows that one reading gives other values than the other, side by side."""
    base, variant, _ = _sides(spark, d)
    sides = [f"{s}.{v} as {s}_{v}" for s in ("was", "now") for v in variants.VALUES]
    return variants.changes(base, variant).selectExpr("doc", "page", "name", "k", *sides)
