"""Search, full text, duplicates and text mining over documents and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import containment, dedup, ranked, search
from factloom.plans.registry import query, table
from factloom.sources.database import written

_LINES = "with l as (select doc_id, string_split(text, chr(10)) as a from documents), u as (select doc_id, a, unnest(range(len(a))) as i from l)"
_TOK = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')"


@query(_LINES + """
select doc_id, i + 1 as line_no, a[i + 1] as line, array_to_string(a[greatest(i - 1, 0) + 1 : i], chr(10)) as before, array_to_string(a[i + 2 : i + 2], chr(10)) as after
from u where regexp_matches(a[i + 1], '(password|token|license)')""")
def search_context(spark: SparkSession, d: str) -> DataFrame:
    return search.find(table(spark, d, "documents"), "(password|token|license)", ["doc_id"])


@query(_LINES + """, h as (select doc_id, i + 1 as line_no from u where regexp_matches(a[i + 1], '[0-9]{4}'))
select doc_id, line_no, (select count(*) from h) as total from h order by doc_id, line_no limit 60""")
def hit_limit(spark: SparkSession, d: str) -> DataFrame:
    hits = search.find(table(spark, d, "documents"), "[0-9]{4}", ["doc_id"]).select("doc_id", "line_no")
    return hits.orderBy("doc_id", "line_no").limit(60).withColumn("total", F.lit(hits.count()).cast("long"))


@query(_LINES + """
select doc_id, i + 1 as line_no, coalesce((list_filter(list_transform(a[greatest(i - 5, 0) + 1 : i], lambda x: regexp_extract(x, '^[A-Z][a-z]{2,}')), lambda x: x <> ''))[-1], '<unnamed>') as owner
from u where regexp_matches(a[i + 1], '[0-9]{3}')""")
def look_back_five(spark: SparkSession, d: str) -> DataFrame:
    return search.look_back(table(spark, d, "documents"), "[0-9]{3}", "^[A-Z][a-z]{2,}", ["doc_id"])


@query("""with p as (select doc_id, text, string_split(text, chr(10)) as a from documents), u as (select doc_id, a, unnest(range(len(a))) as i from p)
select doc_id, (i + 1)::int as page, regexp_replace(regexp_replace(a[i + 1], '^\\s+', ''), '\\s+$', '') as text from u""")
def page_split(spark: SparkSession, d: str) -> DataFrame:
    marked = F.concat(F.lit("kind: text\n---\n"), F.array_join(F.transform(search.lines_of(F.col("text")), lambda x, i: F.concat(F.lit("=== PAGE "), i + 1, F.lit(" ===\n"), x, F.lit("\n"))), ""))
    return search.split_pages(table(spark, d, "documents").select("doc_id", marked.alias("text")), ["doc_id"])


@query(_LINES + """
select doc_id, i + 1 as line_no, length(a[i + 1]) as size from u
where length(a[i + 1]) >= 20 and (length(a[i + 1]) - length(replace(a[i + 1], ' ', '')))::double / length(a[i + 1]) < 0.06""")
def run_together(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(search.lines_of(F.col("text"))).alias("i", "line"))
    spaces = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit("")))
    return rows.filter((F.length("line") >= 20) & (spaces / F.length("line") < 0.06)).select("doc_id", (F.col("i") + 1).alias("line_no"), F.length("line").alias("size"))


def _index(spark: SparkSession, d: str) -> DataFrame:
    return search.stored_index(spark, f"{d}/documents.parquet", "doc_id")


@query(f"select doc_id from documents where list_contains({_TOK}, 'the') and list_contains({_TOK}, 'thing') and not list_contains({_TOK}, 'zz')")
def fts_all_terms(spark: SparkSession, d: str) -> DataFrame:
    return search.match_terms(_index(spark, d), "doc_id", ["the", "thing"])


@query(f"select doc_id from documents where len(list_filter({_TOK}, lambda x: starts_with(x, 'licen'))) > 0")
def fts_prefix(spark: SparkSession, d: str) -> DataFrame:
    return search.match_terms(_index(spark, d), "doc_id", ["licen*"])


@query(f"""with t as (select doc_id, {_TOK} as w from documents)
select doc_id, count(*) as hits from (select doc_id, term, lead(term) over (partition by doc_id order by i) as after from (select doc_id, unnest(range(len(w))) as i, unnest(w) as term from t))
where term = 'of' and after = 'the' group by doc_id""")
def fts_phrase(spark: SparkSession, d: str) -> DataFrame:
    return search.match_phrase(_index(spark, d), "doc_id", ["of", "the"])


@query(f"""with t as (select doc_id, {_TOK} as w from documents), p as (select doc_id, unnest(range(len(w))) as i, unnest(w) as term from t)
select distinct a.doc_id from p a join p b using (doc_id) where a.term = 'with' and b.term = 'from' and abs(a.i - b.i) - 1 <= 10""")
def fts_near(spark: SparkSession, d: str) -> DataFrame:
    return search.match_near(_index(spark, d), "doc_id", "with", "from")


@query(f"select doc_id from documents where (list_contains({_TOK}, 'license') or list_contains({_TOK}, 'token')) and not list_contains({_TOK}, 'und')")
def fts_or_not(spark: SparkSession, d: str) -> DataFrame:
    return search.match_terms(_index(spark, d), "doc_id", some=["license", "token"], none=["und"])


@query(f"select doc_id from documents where list_contains({_TOK}, 'with') and list_contains({_TOK}, 'near') and list_contains({_TOK}, 'from')")
def fts_near_is_a_word(spark: SparkSession, d: str) -> DataFrame:
    """Without brackets, NEAR is searched for like any other word."""
    return search.match_query(_index(spark, d), "doc_id", "with NEAR from")


@query(f"""with t as (select doc_id, {_TOK} as w from documents), p as (select doc_id, unnest(range(len(w))) as i, unnest(w) as term from t)
select distinct a.doc_id from p a join p b using (doc_id) where a.term = 'of' and b.term = 'and' and abs(a.i - b.i) - 1 <= 3""")
def fts_near_form(spark: SparkSession, d: str) -> DataFrame:
    return search.match_query(_index(spark, d), "doc_id", "NEAR(of and, 3)")


@query(f"""with t as (select doc_id, {_TOK} as w from documents), f as (select doc_id, len(w) as n, len(list_filter(w, lambda x: x = 'license')) as a, len(list_filter(w, lambda x: x = 'token')) as b from t),
s as (select count(*) as n, avg(n) as mean, count(*) filter (a > 0) as da, count(*) filter (b > 0) as db from f)
select doc_id, round(r, 6) as rank from (select doc_id, ln(1 + (s.n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * f.n / mean)) + ln(1 + (s.n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * f.n / mean)) as r from f, s) where r > 0""")
def fts_rank(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(_index(spark, d), "doc_id", ["license", "token"]).withColumn("rank", F.round("rank", 6))


@query(f"""with t as (select doc_id, {_TOK} as w from documents), f as (select doc_id, len(w) as n, len(list_filter(w, lambda x: x = 'license')) as a, len(list_filter(w, lambda x: x = 'token')) as b from t),
s as (select count(*) as n, avg(n) as mean, count(*) filter (a > 0) as da, count(*) filter (b > 0) as db from f)
select doc_id, round(r, 6) as rank from (select doc_id, ln(1 + (s.n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * f.n / mean)) + ln(1 + (s.n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * f.n / mean)) as r from f, s) where r > 0 order by r desc, doc_id limit 10""")
def fts_top_ten(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents, by blocks whose bound reaches them."""
    index = ranked.RankedIndex.build(table(spark, d, "documents"), "doc_id")
    return index.top(["license", "token"], 10).withColumn("rank", F.round("rank", 6))


@query()
def fts_snippet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", search.snippet(F.col("text"), "license").alias("snippet")).filter("snippet is not null")


@query("select doc_id, sha256(text) as digest, min(doc_id) over (partition by text) as first_id, count(*) over (partition by text) as copies from documents")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return dedup.first_of_copies(table(spark, d, "documents"), F.sha2("text", 256), "doc_id").select("doc_id", "digest", "first_id", "copies")


@query(r"""with t as (select doc_id, len(string_split(text, chr(10))) as n, trim(regexp_replace(text, '\s+', ' ', 'g')) as p from documents), f as (select *, min(doc_id) over (partition by n, p) as twin from t where length(p) >= 500)
select doc_id, twin from f where doc_id <> twin""")
def fingerprint_twins(spark: SparkSession, d: str) -> DataFrame:
    prints = table(spark, d, "documents").select("doc_id", F.size(search.lines_of(F.col("text"))).alias("n"), dedup.fingerprint(F.col("text")).alias("print"))
    return dedup.twins(written(prints, "prints"), F.col("n"), F.col("print"), "doc_id")


@query("""with v as (select o_orderkey, o_custkey as family, [month(o_orderdate), day(o_orderdate)] as version from orders)
select o_orderkey, family, array_to_string(version, '.') as version, version < max(version) over (partition by family) as superseded from v""")
def version_supersession(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("family"), dedup.version(F.concat_ws(".", F.month("o_orderdate"), F.dayofmonth("o_orderdate"))).alias("version"))
    return dedup.superseded(o, "family", "o_orderkey", "version").select("o_orderkey", "family", F.concat_ws(".", F.transform("version", lambda x: x.cast("string"))).alias("version"), "superseded")


@query(r"""with t as (select page_id, unnest(regexp_extract_all(html, '<a href="([^"]+)"', 1)) as link from pages) select link, count(*) as n, min(page_id) as first_page from t group by link""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]+)"'), F.lit(1))).alias("link"))
    return links.groupBy("link").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page"))


@query(r"""with t as (select distinct lower(unnest(regexp_extract_all(html, '<a href="/([^"]+)"', 1))) as link from pages), h as (select page_id, lower(regexp_extract(html, '<h1>(\w+)', 1)) as name from pages)
select page_id, name from h where name not in (select link from t)""")
def unlinked_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    links = pages.select(F.explode(F.regexp_extract_all(F.lower("html"), F.lit('<a href="/([^"]+)"'), F.lit(1))).alias("name")).distinct()
    return pages.select("page_id", F.lower(F.regexp_extract("html", "<h1>(\\w+)", 1)).alias("name")).join(links, "name", "left_anti")


@query(r"""with t as (select page_id, regexp_extract_all(html, '<(h1|p|title)>([^<]*)', 1) as k, regexp_extract_all(html, '<(h1|p|title)>([^<]*)', 2) as x from pages), u as (select page_id, unnest(range(len(k))) as i, unnest(k) as kind, unnest(x) as body from t)
select page_id, i as seq, kind, last_value(case when kind <> 'p' then body end ignore nulls) over (partition by page_id order by i rows unbounded preceding) as section, length(body) as size from u""")
def html_sections(spark: SparkSession, d: str) -> DataFrame:
    from factloom.operators import tables

    item = lambda g: F.regexp_extract_all("html", F.lit("<(h1|p|title)>([^<]*)"), F.lit(g))
    items = table(spark, d, "pages").select("page_id", F.posexplode(F.arrays_zip(item(1).alias("kind"), item(2).alias("body"))).alias("seq", "x")).select("page_id", "seq", "x.kind", "x.body")
    return tables.carry_forward(items, ["page_id"], "seq", F.when(F.col("kind") != "p", F.col("body")), "section").select("page_id", "seq", "kind", "section", F.length("body").alias("size"))


@query("""with c as (select user_id, dayofyear(ts) as place, count(*) as n from events group by all), a as (select *, max(n) over (partition by user_id) as top, first_value(place) over (partition by user_id order by n desc, place) as anchor from c),
k as (select *, place - row_number() over (partition by user_id order by place) as run from a where n >= 0.4 * top), o as (select *, max(case when place = anchor then run end) over (partition by user_id) as own from k)
select user_id, min(place) as first, max(place) as last, any_value(anchor) as anchor from o where run = own group by user_id""")
def island_around_anchor(spark: SparkSession, d: str) -> DataFrame:
    return search.dense_island(table(spark, d, "events").withColumn("place", F.dayofyear("ts")), "user_id", "place")


@query("""with c as (select doc_id, unnest(string_split(lower(text), '')) as ch from documents) select ch, count(*) as n from c where regexp_matches(ch, '^[a-z0-9]$') group by ch""")
def character_audit(spark: SparkSession, d: str) -> DataFrame:
    ch = table(spark, d, "documents").select(F.explode(F.split(F.lower("text"), "")).alias("ch"))
    return ch.filter(F.col("ch").rlike("^[a-z0-9]$")).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))


@query(r"""with t as (select doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+(?:\.[0-9]+)?'), lambda x: length(x) > 1)) as w from documents)
select a.doc_id, len(a.w) as n_tokens, len(a.w) - len(list_intersect(a.w, b.w)) as missing, len(a.w) >= 30 and (len(a.w) - len(list_intersect(a.w, b.w))) > 0.3 * len(a.w) as disagree from t a join t b on b.doc_id = a.doc_id + 1""")
def token_disagreement(spark: SparkSession, d: str) -> DataFrame:
    w = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+(?:\\.[0-9]+)?"), F.lit(0)), lambda x: F.length(x) > 1))
    t = table(spark, d, "documents").select("doc_id", w.alias("w"))
    both = t.join(t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("other")), "doc_id")
    n, gone = F.size("w"), F.size(F.array_except("w", "other"))
    return both.select("doc_id", n.alias("n_tokens"), gone.alias("missing"), ((n >= 30) & (gone > 0.3 * n)).alias("disagree"))


@query(r"""with b as (select item_id, left(regexp_replace(lower(text), '\s+', ' ', 'g'), 40) as head from benchmark), t as (select doc_id, regexp_replace(lower(text), '\s+', ' ', 'g') as p from documents)
select item_id, count(*) as n_docs, min(doc_id) as first_doc from b join t on contains(p, head) group by item_id""")
def contamination_find(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items whose first 40 characters stand in documents."""
    heads = table(spark, d, "benchmark").select(F.col("item_id").alias("item"), F.substring(containment.squeezed(F.col("text")), 1, 40).alias("head"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    hits = containment.passages_found(docs, heads).select(F.col("item").alias("item_id"), F.col("doc").alias("doc_id"))
    return hits.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"))
