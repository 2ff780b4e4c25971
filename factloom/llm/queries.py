"""The queries of this subpackage and, where SQL can express one, its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversation_repair, exact_dedup, filter_audit, iblt, langid, mixing, packing, secrets, sharding, shingle_join, simhash_index, trie_lm, warc
from .shared import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


@_query
def op1_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@_query
def op2_paragraph_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprint_documents(documents(spark, sf_dir))


@_query
def op3_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.link_components(documents(spark, sf_dir))


@_query
def op4_bidirectional_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


@_query
def op5_proportional_fitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.calibrate_documents(documents(spark, sf_dir))


@_query
def op6_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


@_query
def op7_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(documents(spark, sf_dir)).drop("blob")


@_query
def op8_elias_fano_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_lm.score_documents(documents(spark, sf_dir))


@_query
def op9_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), shards=8)


@_query
def op10_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir)).drop("n_chunks")


@_query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_query
def op12_dial_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.damage_and_repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@_query
def op13_gray_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_index.near_components(documents(spark, sf_dir))


ORACLE["op10_chunk_recipes"] = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from n
"""

ORACLE["op3_token_groups"] = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
i as (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as k from w where len(w) > 0),
s as (select distinct doc_id, array_to_string(w[k : k + 4], ' ') as g from i),
n as (select w.doc_id, count(s.g) as n from w left join s using (doc_id) group by w.doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 75 * (a.n + b.n - c)),
r as (select doc_id as x, doc_id as y from documents union select r.x, l.y from r join l on l.x = r.y)
select r.x as doc_id, any_value(n.n) as n_shingles, min(r.y) as component_id from r join n on n.doc_id = r.x group by r.x
"""

ORACLE["op7_blob_ledger"] = r"""
with k(kind, rank, pattern, grp, least) as (values ('assign', 0, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6), ('access', 1, 'AKIA[A-Z0-9]+', 0, 20), ('hex', 2, '[0-9a-f]+', 0, 24)),
d as (select doc_id, coalesce(text, '') as t from documents),
m as (select doc_id, kind, rank, least, regexp_extract_all(t, pattern) as f, case when grp = 2 then regexp_extract_all(t, pattern, 2) else regexp_extract_all(t, pattern) end as h, regexp_split_to_array(t, pattern) as g from d, k where regexp_matches(t, pattern)),
u as (select doc_id, kind, rank, least, unnest(range(1, len(f) + 1)) as i, unnest(f) as f, unnest(h) as h, unnest(g[1 : len(f)]) as g from m),
p as (select doc_id, kind, rank, length(h) >= least as ok, sum(length(g) + length(f)) over (partition by doc_id, kind order by i) as e, length(f) as n from u),
x as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex, string_agg(kind || ':' || (e - n)::bigint || ':' || e::bigint, ',' order by e - n, rank) as s from p where ok group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(s, '')) as base_sha256, coalesce(s, '') as spans from d left join x using (doc_id)
"""

ORACLE["op1_warc_segments"] = """
with p as (select page_id, coalesce(html, '') as t, sha1(coalesce(html, '')) as h from pages)
select page_id, octet_length(encode(t))::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31)::bigint + 1, 1)), '') as payload_digest,
  case when page_id = min(page_id) over (partition by t) then 'response' else 'revisit' end as record_type,
  case when page_id <> min(page_id) over (partition by t) then min(page_id) over (partition by t) end as refers_to, null::varchar as problem
from p
"""

ORACLE["op11_filter_audit"] = r"""
with d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
m as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    (len(w) < 100)::int + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int
    + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(d.doc_id > min(d.doc_id) over (partition by t), false)::int as mask
  from d left join l using (doc_id)),
v as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by all),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as f, unnest([1, 2, 4, 8, 16]) as bit),
o as (
  select a.f || b.f || c.f || d.f || e.f as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from f a, f b, f c, f d, f e where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s as (select filter_order, k as step, bits[k] as bit, coalesce(list_sum(bits[1 : k - 1]), 0)::int as before from o, range(1, 6) r(k)),
r as (
  select part, filter_order, step, bit,
    sum(n) filter (mask & (before | bit) = 0) as kept, sum(n) filter (mask & bit > 0 and mask & before = 0) as removed,
    sum(n) filter (mask & bit > 0 and mask & before > 0) as redundant, sum(n) filter (mask = bit) as unique_fails,
    sum(good) filter (mask & bit > 0 and mask & before = 0) as good_lost, sum(toxic) filter (mask & bit > 0 and mask & before = 0) as toxic_lost
  from v, s group by all)
select part, filter_order, step::int as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed,
  coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost,
  coalesce(toxic_lost, 0)::bigint as toxic_lost, coalesce(sum(removed) over (partition by part, bit), 0)::bigint as shapley
from r
"""

# Forward by rows, with the cheapest cost and its least audit for each of the four states.
ORACLE["op12_dial_repair"] = r"""
with recursive crc_table as (
  select list(c order by i) as t from (
    select i, list_reduce(list_prepend(i::bigint, range(8)), lambda c, b: xor(c >> 1, 3988292384 * (c & 1))) as c from range(256) r(i))),
raw as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint) as bytes
  from conversations),
dealt as (
  select conv_id, turn, role, text,
    xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as kind
  from raw, crc_table),
damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case when kind = 3 then [1, 2] else [1] end) as copy
  from dealt where kind <> 0),
placed as (
  select conv_id, turn, role, text,
    row_number() over (partition by conv_id order by turn nulls first, sha256(length(role) || ':' || role || ':' || text), copy) as pos
  from damaged),
seen as (
  select *, not regexp_matches(text, '[^\x20\x09-\x0D]') as empty, row_number() over (partition by conv_id, role, text order by pos) > 1 as again,
    not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') as open, left(role, 1) as initial,
    lag(left(role, 1)) over (partition by conv_id order by pos) as before
  from placed),
faults as (
  select *, empty as blank, again and not empty as duplicate, open and not empty and not again as truncated, empty or again as gone,
    case when open and not empty and not again then 3 else 0 end as more
  from seen),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank,
    count(*) filter (duplicate) as duplicate, count(*) filter (truncated) as truncated,
    count(*) filter (pos > 1 and before || initial not in ('su', 'ua', 'au')) as illegal, max(pos) as n
  from faults group by conv_id),
walk(conv_id, pos, s0, s1, s2, s3) as (
  select conv_id, 0::bigint, {'c': 0, 'a': ''}, {'c': 999999999, 'a': ''}, {'c': 3, 'a': 'I'}, {'c': 6, 'a': 'II'} from counts
  union all
  select conv_id, pos, s0, s1, s2, list_min([s3, {'c': s2.c + 3, 'a': s2.a || 'I'}])
  from (
    select conv_id, pos, s0, s1, s3, list_min([s2, {'c': s0.c + 3, 'a': s0.a || 'I'}, {'c': s1.c + 3, 'a': s1.a || 'I'}, {'c': s3.c + 3, 'a': s3.a || 'I'}]) as s2
    from (
      select w.conv_id, f.pos, {'c': s0.c + 4, 'a': s0.a || 'D'} as s0,
        list_min([{'c': s1.c + 4, 'a': s1.a || 'D'}, {'c': case when gone or initial <> 's' then 999999999 else s0.c + more end, 'a': s0.a || 'K'}]) as s1,
        list_min(list_concat([{'c': s2.c + 4, 'a': s2.a || 'D'}], list_transform([s0, s1, s3], lambda s: list_min([
          {'c': case when gone or initial <> 'u' then 999999999 else s.c + more end, 'a': s.a || 'K'}, {'c': case when gone then 999999999 else s.c + 3 + more end, 'a': s.a || 'R'}])))) as s2,
        list_min([{'c': s3.c + 4, 'a': s3.a || 'D'}, {'c': case when gone or initial <> 'a' then 999999999 else s2.c + more end, 'a': s2.a || 'K'},
          {'c': case when gone then 999999999 else s2.c + 3 + more end, 'a': s2.a || 'R'}]) as s3
      from walk w join faults f on f.conv_id is not distinct from w.conv_id and f.pos = w.pos + 1))),
best as (
  select c.*, list_min([s0, s3]) as s from counts c join walk w on w.conv_id is not distinct from c.conv_id and w.pos = c.n),
letters as (
  select conv_id, k, s.a[k] as edit, k - length(replace(s.a[1:k], 'I', '')) as inserted, length(replace(s.a[1:k], 'D', '')) as made from best, range(1, length(s.a) + 1) r(k)),
kept as (
  select l.conv_id, l.k, l.edit, l.made, f.role, f.text, max(case when l.edit = 'K' and f.initial = 's' then 1 else 0 end) over (partition by l.conv_id) as system
  from letters l left join faults f on f.conv_id is not distinct from l.conv_id and f.pos = l.k - l.inserted where l.edit <> 'D'),
repaired as (
  select conv_id, sha256(string_agg(case edit when 'K' then role || ':' || text else case when (made - system) % 2 = 1 then 'user' else 'assistant' end || ':'
    || case edit when 'R' then text else '' end end, chr(10) order by k)) as sha
  from kept group by conv_id)
select a.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(b.s.c, 0)::bigint as cost, coalesce(b.s.a, '') as audit,
  coalesce(sha, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) a left join best b on b.conv_id is not distinct from a.conv_id
  left join repaired r on r.conv_id is not distinct from a.conv_id
"""
