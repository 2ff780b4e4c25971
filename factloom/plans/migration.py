"""Migration of a folder tree: a file for each document, a note for each conversation, another file for each event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.operators import migration
from factloom.plans.registry import query, table

_CLEAN = r"regexp_replace(regexp_replace(regexp_replace({0}, '(?i)\s*(\([0-9]+\)|- copy|_copy)$', '', 'g'), '[\s_]+', '_', 'g'), '(?i)_(v[0-9.]+)_(ds|um)$', '_\2_\1', 'g')"
_DOCS = """select concat(coalesce(source, 'none'), case when doc_id % 6 = 0 then '/Attachments/' else '/' end, case doc_id % 5 when 0 then concat('C', cast(10000 + doc_id % 800 as varchar(9)))
  when 1 then concat('part', cast(doc_id % 300 as varchar(9)), '_v1.', cast(doc_id % 3 as varchar(9)), '_DS') when 2 then concat('SUPERSEDED - part', cast(doc_id as varchar(9)))
  when 3 then concat('lm', cast(doc_id % 500 as varchar(9)), ' (', cast(doc_id % 4 as varchar(9)), ')') else concat('tps', cast(doc_id as varchar(9))) end, case when doc_id % 7 = 0 then '.PDF' else '.pdf' end, '') as path,
  md5(coalesce(text, '')) as sha from documents"""
_FILES = f"select path, min(sha) as sha from ({_DOCS}) as d group by path"
_NOTES = """select concat('notes/', case when conv_id % 9 = 0 then 'Component Index' when conv_id % 3 = 0 then concat('tps', cast(conv_id * 5 + 4 as varchar(9))) when conv_id % 3 = 1 then concat('LM', cast(conv_id % 500 as varchar(9)))
  else concat('Meeting ', cast(conv_id as varchar(9))) end, '.md') as path,
  concat('tps', cast(conv_id * 5 + 4 as varchar(9)), '.pdf') as one, case when conv_id % 4 = 0 then concat('x/C', cast(10000 + (conv_id * 5) % 800 as varchar(9)), '.PDF') end as two, conv_id from conversations"""
_NOTED = f"select path, min(case when conv_id % 2 = 0 then one end) as one, min(two) as two from ({_NOTES}) as n group by path"
_OTHERS = """select distinct concat('misc/', event_type, '/', cast(user_id % 97 as varchar(9)), case event_id % 4 when 0 then '.PNG' when 1 then '.csv' when 2 then '.txt' else '' end) as path from events"""
_BASE = "regexp_extract({0}, '([^/]*)$', 1)"
_STEM = rf"case when strpos({_BASE}, '.') > 1 then regexp_replace({_BASE}, '\.[^.]*$', '') else {_BASE} end"
_PLAIN = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"


def _of(template: str, value: str) -> str:
    return template.replace("{0}", value)


_FOLDER = "case when lower(up[-1]) = 'attachments' then array_to_string(up[:-2], '/') else array_to_string(up, '/') end"


@query(rf"""with docs as ({_FILES}), notes0 as ({_NOTED}), others as ({_OTHERS}),
d as (select *, {_of(_BASE, 'path')} as base, {_of(_STEM, 'path')} as stem from docs),
known as (select lower(base) as low, max(path) as doc from d group by 1),
links as (select distinct path, lower({_of(_BASE, 'l')}) as low from (select path, unnest([one, two]) as l from notes0) where l is not null),
met as (select path, count(distinct doc) as n, max(doc) as doc from links join known using (low) group by path),
n0 as (select notes0.path, {_of(_STEM, 'notes0.path')} as stem, {_of(_BASE, 'notes0.path')} as base, coalesce(n, 0) as n, doc, {_of(_STEM, 'doc')} as dstem from notes0 left join met using (path)),
n1 as (select *, coalesce(regexp_full_match(trim(dstem), 'C[0-9]{{4,}}|[0-9_-]+'), false) as vague, {_of(_PLAIN, 'stem')} as a, {_of(_PLAIN, 'dstem')} as b from n0),
about as (select path, stem, base, n, coalesce(n = 1 and (a = b or (contains(b, a) and length(a) >= 5) or (contains(a, b) and length(a) - length(b) <= 3) or vague), false) as about, vague, doc from n1),
said as (select doc as path, arg_max(stem, path) as said from about where about and vague group by doc),
named as (select d.*, said, case when said is not null then {_of(_CLEAN, 'said')} when starts_with(stem, 'SUPERSEDED - ') or starts_with(stem, 'DUPLICATE - ') then stem else {_of(_CLEAN, 'stem')} end as name from d left join said using (path)),
kept as (select *, first_value(path) over (partition by sha order by said is null, {_of(_CLEAN, 'stem')} <> stem, length(base), path) as keep from named),
stay as (select *, string_split(path, '/')[:-2] as up from kept where path = keep),
alike as (select lower(name) as low, min(path) as apath, arg_min(name, path) as aname from stay group by 1),
nn as (select a.*, k.keep, s.name as kname, apath, aname, lower(a.stem) in ('component index', '#datasheets', 'datasheet parameter tables') as idx
  from about a left join kept k on a.about and k.path = a.doc left join stay s on s.path = k.keep left join alike on low = lower(a.stem)),
every as (
  select path, 0 as kind, 'move' as action, 'Library/' || name || '/' || name || lower(regexp_extract(base, '(\.[^.]*)$', 1)) as target, {_FOLDER} as category, case when name = stem then 'document' else 'document, renamed from ' || stem end as reason, null as into_ from stay
  union all select path, 1, case when idx then 'archive' when keep is not null or apath is not null then 'merge' else 'topic' end,
    case when idx then '0archive/' || base when keep is not null or apath is not null then 'Library/' || coalesce(kname, aname) || '/' || coalesce(kname, aname) || '.md' else 'Topics/' || base end, '',
    case when idx then 'an index by hand' when keep is not null then 'note about one document' when apath is not null then 'named like a document' else 'links ' || n || ' documents' end,
    case when idx then null else coalesce(keep, apath) end from nn
  union all select path, 2, case when k in ('png', 'csv') then 'move' else '?' end, case k when 'png' then 'Attachments/' || b when 'csv' then 'Parametrics/' || b else '' end, '',
    case k when 'png' then 'embedded file' when 'csv' then 'export of parameters' else 'another kind of file' end, null from (select path, {_of(_BASE, 'path')} as b, lower(regexp_extract(path, '\.([^./]*)$', 1)) as k from others)),
ranked as (select *, case when action in ('move', 'topic', 'archive') and target <> '' then lower({_of(_BASE, 'target')}) end as low from every),
clash as (select *, low is not null and row_number() over (partition by low order by kind, path) > 1 as later, first_value(target) over (partition by low order by kind, path) as taken from ranked),
settled as (select path, into_, category, case when later then '?' else action end as action, case when later then '' else target end as target, case when later then 'name is taken by ' || taken else reason end as reason from clash),
done as (select s.*, s.action = 'merge' and l.path is not null as orphan from settled s left join settled l on l.path = s.into_ and l.action = '?')
select path as source, case when orphan then '?' else action end as action, case when orphan then '' else target end as target, category, case when orphan then 'its document is to be decided' else reason end as reason from done
union all select path, 'delete', '', '', 'same content as ' || {_of(_BASE, 'keep')} from kept where path <> keep""")
def migration_plan(spark: SparkSession, d: str) -> DataFrame:
    """Every file's fate: documents with copies, notes, and other files."""
    for name in ("documents", "conversations", "events"):
        table(spark, d, name).createOrReplaceTempView(name)
    notes = spark.sql(_NOTED).selectExpr("path", "filter(array(one, two), x -> x is not null) as links")
    return migration.plan(spark.sql(_FILES), notes, spark.sql(_OTHERS))
