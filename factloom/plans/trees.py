"""Reading order of the nested elements of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators import trees
from factloom.plans.registry import query, table
from factloom.sources.html import html_nodes

_TOKENS = r"""t as (
  select page_id, unnest(l) as token, unnest(range(len(l))) as i
  from (select page_id, regexp_extract_all(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[^>]*>|[^<]+|<') as l from pages)),
u as (select *, lag(token) over (partition by page_id order by i) as before, token[1] <> '<' and trim(token, e' \t\n\r\x0b\x0c') <> '' as said from t),
s as (
  select page_id, i, trim(token, e' \t\n\r\x0b\x0c') as text, row_number() over (partition by page_id order by i) as seq,
    regexp_matches(before, '(?i)^<(title|h[1-6])\b') as head
  from u where said)"""


@query(rf"""with {_TOKENS}
select page_id, seq, md5(text) as text, coalesce(last_value(case when head then text end ignore nulls) over (partition by page_id order by seq), '') as section from s""")
def tree_order(spark: SparkSession, d: str) -> DataFrame:
    """Texts of pages in the order of a walk over their elements, each with the last title or heading; parents and places
    alone decide, the position in the file isn't kept."""
    nodes = html_nodes(table(spark, d, "pages"), "page_id")
    placed = trees.paths(nodes, ["page_id"])
    kinds = nodes.select("page_id", F.col("node").alias("parent"), F.col("kind").alias("within"))
    texts = placed.filter("kind = '#text'").join(kinds.hint("merge"), ["page_id", "parent"], "left")
    items = trees.in_sections(texts, ["page_id"], F.coalesce(F.col("within").rlike("^(title|h[1-6])$"), F.lit(False)))
    seq = F.row_number().over(Window.partitionBy("page_id").orderBy("path"))
    return items.select("page_id", seq.alias("seq"), F.md5("text").alias("text"), "section")
