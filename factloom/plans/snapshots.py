"""Versions of a table, and readers by how far they came."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import snapshots
from factloom.plans.registry import query, table
from factloom.sources.database import Table, scratch

_FACTS = "doc long, original_name string, n long"
_ONE = "select c_custkey as doc, concat('file', cast(c_custkey as varchar(12))) as original_name, cast(c_nationkey as bigint) as n from customer where c_custkey % 3 <> 0"
_TWO = """select c_custkey as doc, concat('renamed', cast(c_custkey as varchar(12))) as original_name, cast(case when c_custkey % 5 = 0 then c_nationkey + 1 else c_nationkey end as bigint) as n,
  case when c_custkey % 7 = 0 then 'by hand' end as card_original_name from customer where c_custkey % 4 <> 0"""


def _two_versions(spark: SparkSession, d: str) -> tuple[Table, int, int]:
    table(spark, d, "customer").createOrReplaceTempView("customer")
    facts = Table(spark, scratch(spark, "facts"), keep=4)
    first = facts.replace(spark.sql(_ONE))
    second = facts.replace(snapshots.with_sticky(spark.sql(_TWO), facts.read(_FACTS, first), "doc", ["original_name"]).select("doc", "original_name", "n"))
    return facts, first, second


_STUCK = f"a as ({_ONE}), b as ({_TWO}), s as (select b.doc, coalesce(b.card_original_name, a.original_name, b.original_name) as original_name, b.n from b left join a on a.doc = b.doc)"


@query(f"with {_STUCK} select * from s")
def sticky_facts(spark: SparkSession, d: str) -> DataFrame:
    """A second version of a table, with what the first knew and a person said."""
    facts, _, second = _two_versions(spark, d)
    return facts.read(_FACTS, second)


@query(f"""with {_STUCK}
select coalesce(a.doc, s.doc) as doc, case when a.doc is null then 'added' when s.doc is null then 'removed' else 'changed' end as change, a.n as was, s.n as now
from a full join s on s.doc = a.doc where a.doc is null or s.doc is null or a.n <> s.n or a.original_name <> s.original_name""")
def table_changes(spark: SparkSession, d: str) -> DataFrame:
    """What two versions of a table don't have alike."""
    facts, first, second = _two_versions(spark, d)
    return facts.changes(_FACTS, "doc", first, second).select("doc", "change", F.col("was.n").alias("was"), F.col("now.n").alias("now"))


_READ = """select l_orderkey as doc, count(*) as pages, max(case when l_returnflag = 'N' then l_linenumber else l_linenumber - 1 end) as coverage, count(case when l_linestatus = 'F' then 1 end) as layout_n,
  count(case when l_partkey % 2 = 0 then 1 end) as fallback_n, max(l_suppkey) as code, max(l_discount) as scan from lineitem group by l_orderkey"""


@query(f"""with r as ({_READ}), w as (select *, coverage >= pages and scan < 0.1 as whole from r)
select doc, case when whole then layout_n else fallback_n end as fields, case when not whole then 'alt' || code when code % 3 = 0 then 'lm' || code when doc % 2 = 0 then 'doc' || doc end as part,
  case when whole and layout_n > 0 then 'layout' when not whole and fallback_n > 0 then 'fallback' end as by_registers, case when whole then 'layout' when pages % 2 = 0 then 'fallback' end as by_prose,
  whole and fallback_n > layout_n as fewer from w""")
def chosen_readers(spark: SparkSession, d: str) -> DataFrame:
    """Each order as a document: the layout reading where it is whole, else the fallback."""
    table(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    field = "struct(1 as bit)"
    made = lambda n: f"case when {n} > 0 then array(struct(array_repeat({field}, cast({n} as int)) as fields)) end"
    rows = spark.sql(f"""select doc, pages, coverage, scan >= 0.1 as recognised, case when doc % 2 = 0 then concat('doc', doc) else 'none' end as stem,
      struct({made('layout_n')} as registers, case when code % 3 = 0 then concat('lm', code) else 'Features' end as part, 'x' as prose) as layout,
      struct({made('fallback_n')} as registers, concat('alt', code) as part, case when pages % 2 = 0 then 'y' end as prose) as fallback from ({_READ}) as r""")
    out = snapshots.chosen_readers(rows)
    return out.select("doc", snapshots.field_count(F.col("registers")).cast("long").alias("fields"), "part", F.col("readers.registers").alias("by_registers"), F.col("readers.prose").alias("by_prose"), (F.size("flags") > 0).alias("fewer"))
