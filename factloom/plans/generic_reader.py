"""First pages of documents: a head that is made of each row, and the row's text as the second page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import generic_reader
from factloom.plans.registry import query, table

_N, _M = "cast(n_chars % 31 + 1 as varchar(9))", "cast(n_chars % 31 + doc_id % 17 + 2 as varchar(9))"
_HEAD = f"""concat(case doc_id % 4 when 0 then 'Maker Ltd' when 1 then concat('LM', cast(doc_id as varchar(9)), 'x') when 2 then concat('all of TPS1', cast(doc_id as varchar(9)), ' at once') else 'plain line' end, chr(10),
  case when doc_id % 3 = 0 then 'SLVSCE0 - May' else 'another line' end, chr(10),
  case doc_id % 6 when 0 then concat('Input: ', {_N}, '.5 V to ', {_M}, ' V') when 1 then concat({_N}, 'V~', {_M}, 'V supply and output ', {_N}, ' to ', {_M}, ' V') when 2 then concat({_N}, ' - ', {_M}, ' V') when 3 then concat('max. ', {_M}, ' V')
    when 4 then concat('VOUT ', {_N}, 'V...', {_M}, 'V') else 'none' end, chr(10),
  case doc_id % 5 when 0 then concat({_N}, '.2 A peak current') when 1 then concat('output of ', {_M}, '-A') else 'x' end, chr(10), case doc_id % 3 when 0 then concat({_N}, '0 kHz, ', {_M}, '.4MHz') when 1 then concat('at ', {_M}, ' kHz') else 'y' end, chr(10),
  case doc_id % 4 when 0 then 'SOT-23-5 or SOT235, QFN16' when 1 then 'TSSOP-14' else 'z' end)"""
_STEM = "case doc_id % 3 when 0 then concat('2410121637_Maker-TPS1', cast(doc_id as varchar(9)), '_C99999') when 1 then concat('C84817 MT', cast(doc_id as varchar(9)), 'a_plain') else concat('scan ', cast(doc_id as varchar(9))) end"
_RANGE = r"([0-9]+(?:\.[0-9]+)?)\s*V?\s*(?:to|~|–|-|\.\.\.)\s*([0-9]+(?:\.[0-9]+)?)\s*V"


def _beside(words: str, k: int) -> str:
    after = rf"regexp_extract(regexp_extract(t, '(?i)(?:{words})(?:[^\n]{{0,39}}?[^0-9.\n])??{_RANGE}'), '(?i)(?:^|[^0-9.]){_RANGE}', {k})"
    before = rf"regexp_extract(t, '(?i)(?:^|[^0-9.]){_RANGE}[^\n]{{0,40}}?(?:{words})', {k})"
    return f"coalesce(nullif({after}, ''), nullif({before}, ''))"


_ANY = rf"nullif(regexp_extract(t, '(?i)(?:^|[^0-9.]){_RANGE}', {{}}), '')"
_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(coalesce({}, ''), '\(cid:[0-9]+\)', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'))"


@query(rf"""with d as (select doc_id, {_STEM} as stem, {_CLEAN.format(_HEAD)} as one, {_CLEAN.format('text')} as two from documents), p as (select *, one || chr(10) || chr(10) || two as t from d),
h as (select *, case doc_id % 3 when 0 then 'TPS1' || doc_id when 1 then 'MT' || doc_id || 'a' else stem end as hint from p)
select doc_id,
  case when doc_id % 4 = 1 then 'LM' || doc_id || 'x' when doc_id % 4 = 2 and doc_id % 3 = 0 then 'TPS1' || doc_id else hint end as part,
  coalesce({_beside('input|VIN|supply', 1)}, {_ANY.format(1)}) as vin_min,
  coalesce({_beside('input|VIN|supply', 2)}, {_ANY.format(2)}, nullif(regexp_extract(t, '(?i)(?:up\s+to|maximum|max\.?)\s*([0-9]+(?:\.[0-9]+)?)\s*V', 1), '')) as vin_max,
  {_beside('output|VOUT', 1)} as vout_min, {_beside('output|VOUT', 2)} as vout_max,
  try_cast(regexp_extract(f[-1], '^[0-9.]+') as double) * case when contains(lower(f[-1]), 'mhz') then 1000 else 1 end as freq_max,
  case doc_id % 4 when 0 then 2 when 1 then 1 else 0 end as packages, case when doc_id % 3 = 0 then 'vendor' else 'generic' end as reader
from (select *, regexp_extract_all(left(t, 3000), '(?i)[0-9]+(?:\.[0-9]+)?\s*[-–]?\s*[kM]Hz\b') as f from h)""")
def generic_readings(spark: SparkSession, d: str) -> DataFrame:
    """Each document's part, voltages, frequency and packages by the best candidate, and whose reader it is for."""
    table(spark, d, "documents").createOrReplaceTempView("documents")
    pages = spark.sql(f"select doc_id as doc, {_STEM} as stem, inline(array(named_struct('page', 1, 'text', {_HEAD}), named_struct('page', 2, 'text', text))) from documents")
    got = generic_reader.read(pages)
    values = [F.col(f"{c}.value").alias(c) for c in ("part", "vin_min", "vin_max", "vout_min", "vout_max")]
    return got.select(F.col("doc").alias("doc_id"), *values, F.col("freq_max.value").cast("double").alias("freq_max"), F.size("packages").alias("packages"), "reader")
