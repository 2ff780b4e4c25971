"""Queries of the grid, line and file readers, over part rows whose cells are picked from fixed lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import readers as r
from factloom.plans.classification import lit, pick
from factloom.plans.records import at, lines, made
from factloom.plans.registry import query, table


def _part(spark: SparkSession, d: str, **cells: str) -> DataFrame:
    return table(spark, d, "part").selectExpr("p_partkey", *[f"{v} as {k}" for k, v in cells.items()])


def _sql(**cells: str) -> str:
    return "select p_partkey, " + ", ".join(f"{v} as {k}" for k, v in cells.items()) + " from part"


_HEADERS = pick(["Parameter|MIN|TYP|MAX|UNIT", " Value |units", "Bit|Field|Type", "bit|x", "PART NUMBER|PACKAGE (1)|BODY SIZE", "Bits|Name", "min|max", "", "bit|unit|typ|reset"])


@query(f"""with h as ({_sql(h=_HEADERS)}), w as (select p_partkey, upper(replace(h, '|', ' ')) as j, list_transform(string_split(h, '|'), lambda x: lower(trim(x))) as w from h)
select p_partkey, case when list_has_any(w, ['min', 'max', 'typ', 'nom', 'value']) and list_has_any(w, ['unit', 'units']) then 'specs' when list_contains(w, 'bit') and len(list_distinct(list_filter(w, lambda x: x in ('bit', 'field', 'type', 'reset', 'access', 'r/w')))) >= 2 then 'bits'
 when contains(j, 'PART') and contains(j, 'PACKAGE') then 'package' end as kind from w""")
def table_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _part(spark, d, h=_HEADERS).select("p_partkey", r.table_kind(F.split("h", r"\|")).alias("kind"))


_GRID = dict(a=pick(["", "Supply", None, "a  b"]), b=pick(["I Q(VIN)", "", "VIN", " Δ x", "Vo ut"]), c=pick(["", "Input   voltage", " "]), m=pick(["1", "", None, " 2 "]), n=pick(["3", "4", "", "5", "6", "7", "8"]), u=pick(["V", ""]))


def _clean(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))"


@query(rf"""with g as ({_sql(**_GRID)}) select p_partkey, nullif(regexp_replace({_clean('b')}, '^([A-Za-zΔθτηψα])\s+([A-Za-z0-9(])', '\1\2'), '') as symbol, coalesce(nullif({_clean('c')}, ''), nullif({_clean('a')}, '')) as parameter,
 coalesce(nullif({_clean('m')}, ''), nullif({_clean('n')}, '')) as min, nullif({_clean('u')}, '') as unit from g""")
def grid_records(spark: SparkSession, d: str) -> DataFrame:
    cells = F.array(*[F.col(c) for c in _GRID])
    rows = _part(spark, d, **_GRID).select("p_partkey", r.cell_record(cells, [None, "symbol", "parameter", "min", "min", "unit"]).alias("x"))
    return rows.select("p_partkey", *[F.try_element_at("x", F.lit(k)).alias(k) for k in ("symbol", "parameter", "min", "unit")])


_ORPHANS = lines(
    6, doc="p_partkey", seq="seq", symbol=at(["VIN", "", None, "", "IQ", "", "FSW", None], 3), parameter=at(["input", None, "", "", "", None, "late", ""], 5),
    conditions=at(["TA = 25 C", "TA = 25  c, no load", "TA = 85", "TA = 85, full", None, "TA = 25", "x"], 2), unit=at(["V", "", None, "A", ""], 1),
)


def _prefix(a: str, b: str) -> str:
    x, y = f"lower({_clean(a)})", f"lower({_clean(b)})"
    n = f"least(length({x}), length({y}))"
    return f"coalesce(list_min(list_filter(range(1, {n} + 1), lambda i: substr({x}, i, 1) <> substr({y}, i, 1))) - 1, {n})"


@query(f"""with f as (select *, coalesce(symbol, '') <> '' or coalesce(parameter, '') <> '' as ok from {_ORPHANS}),
n as (select f.*, (select max(g.seq) from f g where g.doc = f.doc and g.ok and g.seq < f.seq) as u, (select min(g.seq) from f g where g.doc = f.doc and g.ok and g.seq > f.seq) as w from f),
j as (select n.*, a.symbol as us, a.parameter as up, a.unit as uu, b.symbol as ws, b.parameter as wp, b.unit as wu, {_prefix('n.conditions', 'a.conditions')} as pu, {_prefix('n.conditions', 'b.conditions')} as pw from n left join f a on a.doc = n.doc and a.seq = n.u left join f b on b.doc = n.doc and b.seq = n.w),
k as (select *, case when ok or (u < seq - 1 and w > seq + 1) then null when u is not null and (w is null or pu >= pw) then 'up' when w is not null then 'down' end as side from j)
select doc, seq, case side when 'up' then coalesce(nullif(us, ''), symbol) when 'down' then coalesce(nullif(ws, ''), symbol) else symbol end as symbol, case side when 'up' then coalesce(nullif(up, ''), parameter) when 'down' then coalesce(nullif(wp, ''), parameter) else parameter end as parameter,
 case when side is not null and coalesce(unit, '') = '' then coalesce(case side when 'up' then uu else wu end, unit) else unit end as unit, side as labelled_from from k""")
def orphan_labels(spark: SparkSession, d: str) -> DataFrame:
    return r.label_orphans(made(spark, d, _ORPHANS), ["doc"], "seq").drop("conditions")


_SUMMARY = lines(5, doc="p_partkey", seq="seq", mnemonic=at(["CTRL", "STAT", "status", "ID", "CTRL", "STAT", None], 2), raw=at(["2Eh", "0x10", None, "0x11", "none", "12 (rw)", "0xff", "6", "0xG", "1Ah x"], 3))
_OPEN = lines(3, doc="p_partkey", pos="seq", mnemonic=at(["CTRL", "STAT", "ID", "NMI"], 1), address=at([None, None, "0x01", None, None], 2))


@query(rf"""with w as (select doc, seq, mnemonic, string_split_regex(raw, '\s+')[1] as x from {_SUMMARY} where regexp_matches(mnemonic, '^[A-Z][A-Z0-9_]+$') and raw is not null),
b as (select *, regexp_replace(regexp_replace(x, '^0[xX]', ''), '[hH]$', '') as body, regexp_matches(x, '(?i)^0x|h$|[a-f]') as is_hex from w),
n as (select *, case when is_hex then try_cast('0x' || body as bigint) else try_cast(body as bigint) end as n from b where regexp_full_match(body, '[0-9A-Fa-f]+')),
f as (select doc, mnemonic, arg_min('0x' || case when n < 16 then '0' else '' end || upper(printf('%x', n)), seq) as found from n where n is not null group by doc, mnemonic)
select doc, pos, mnemonic, coalesce(address, found) as address from {_OPEN} left join f using (doc, mnemonic)""")
def summary_addresses(spark: SparkSession, d: str) -> DataFrame:
    return r.register_addresses(made(spark, d, _OPEN), made(spark, d, _SUMMARY), ["doc"])


_BIT_HEAD = pick(["Bit|Field|Type|Reset|Description", "BITS|NAME|R/W|x|Default", "Signal|Bits"])
_BIT_ROW = pick(["7:4|EN|R/W|0h|enables", "Bit|Field|Type|Reset|Description", "||x|y", "3| MODE |R|1|", "bits||a|b|c"])


@query(rf"""with g as ({_sql(h=_BIT_HEAD, c=_BIT_ROW)}), s as (select p_partkey, string_split(h, '|') as h, string_split(c, '|') as c from g),
t as (select p_partkey, c, """ + ", ".join(f"list_position(list_transform(h, lambda x: regexp_matches(lower(x), '{p}')), true) as i_{k}" for k, p in (("bits", r"\bbits?\b"), ("name", r"\b(field|name|signal)\b"), ("access", r"\btype\b|r/?w|access"), ("reset", r"\b(reset|default)\b"), ("description", r"\bdesc"))) + """ from s),
u as (select p_partkey, """ + ", ".join(f"coalesce(trim(case when i_{k} > 0 then c[i_{k}] end), '') as {k}" for k in ("bits", "name", "access", "reset", "description")) + """ from t)
select * from u where (bits <> '' or name <> '') and not (lower(bits) in ('bit', 'bits') and lower(name) in ('field', 'name', ''))""")
def bit_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = _part(spark, d, h=_BIT_HEAD, c=_BIT_ROW).withColumn("at", r.bit_columns(F.split("h", r"\|")))
    found = rows.select("p_partkey", r.bit_field(F.split("c", r"\|"), F.col("at")).alias("x")).filter("x is not null")
    return found.select("p_partkey", "x.*")


def _lines(values: list[str]) -> str:
    """pick, with / for a line break."""
    return f"replace({pick(values)}, '/', chr(10))"


_COND = _lines([" VIN = 12 V, //TA = 25/PARAMETER  MIN  MAX/1 2", "a/b/c/d/e/f/g", "Unit first/x", "minimum load/maximum/typ 3", " /", "all lines stay"])


@query(rf"""with t as ({_sql(t=_COND)}), l as (select p_partkey, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:6] as l from t),
s as (select p_partkey, l, coalesce(list_position(list_transform(l, lambda x: regexp_matches(x, '(?i)\b(PARAMETER|TEST CONDITIONS|MIN|MAX|TYP|UNIT)\b')), true), 0) as s from l)
select p_partkey, coalesce(array_to_string(case when s > 0 then l[1:s - 1] else l end, ' '), '') as conditions from s""")
def test_conditions(spark: SparkSession, d: str) -> DataFrame:
    return _part(spark, d, t=_COND).select("p_partkey", r.section_conditions(F.col("t")).alias("conditions"))


_SUBSCRIPTS = _lines(["I/Q_BAT_ON", "Electrostatic/discharge", "V/IN/max", " /x/", "__/a", "V IN/x", "t/(on)", "a  b/c", "θ/JA", ""])


@query(rf"""with t as ({_sql(t=_SUBSCRIPTS)}), l as (select p_partkey, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') as l from t)
select p_partkey, case when len(l) = 0 then '' else trim(regexp_replace(list_reduce(l, lambda a, x: a || case when regexp_matches(a, '^[\p{{L}}\p{{N}}_]{{1,3}}$') and regexp_matches(a, '[\p{{L}}\p{{N}}]') and regexp_matches(x, '^[\p{{L}}\p{{N}}]') then '_' else ' ' end || x), ' {{2,}}', ' ', 'g')) end as cell from l""")
def subscript_cells(spark: SparkSession, d: str) -> DataFrame:
    return _part(spark, d, t=_SUBSCRIPTS).select("p_partkey", r.subscript_cell(F.col("t")).alias("cell"))


_CODES, _SIZES = pick(["QFN (29)", "RGV (VQFN, 16)", "WQFN-HR", "SOT-23 (1000)", "DBV (1, 6)", "(8)"]), _lines(["4.0 mm x 4.0 mm", "2.6 mm x 2.0 mm x/1.2 mm/(max height)", "2.5mm×3.5mm", "max 3 mm X  4 mm", ""])


@query(f"""with t as ({_sql(c=_CODES, s=_SIZES)}),
u as (select p_partkey, string_split(c, '(') as o, string_split(coalesce(string_split(c, '(')[2], ''), ')')[1] as i, string_split(s, '(') as b from t),
v as (
  select p_partkey, o, i, string_split(replace(i, ',', ' '), ' ') as k,
    list_transform(list_filter(string_split_regex(array_to_string(list_transform(b, lambda x, n: case when n > 1 and contains(x, ')') then substr(x, strpos(x, ')') + 1) else x end), ''), '\\s+'), lambda w: w <> ''),
      lambda w: case when w in ('x', 'X') then '×' else w end) as w
  from u)
select p_partkey, case when len(k) > 1 and regexp_full_match(k[1], '[A-Za-z]+') then k[1] else trim(o[1]) end as type,
  list_filter(list_transform(string_split_regex(i, '[^0-9]+'), lambda n: try_cast(n as int)), lambda n: n between 2 and 512)[1] as pins,
  trim(list_reduce(list_prepend('', w), lambda a, x: a || case when starts_with(x, 'mm') and contains('0123456789', right(a, 1)) and a <> '' then '' else ' ' end || x)) as size
from v""")
def packages(spark: SparkSession, d: str) -> DataFrame:
    return _part(spark, d, c=_CODES, s=_SIZES).select("p_partkey", r.package(F.col("c"), F.col("s")).alias("x")).select("p_partkey", "x.*")


_LISTS = _lines(["1 Features /• wide input  range/• short/• low quiescent/ current/2 Applications/• motor drives", "applications then features • not a bullet here", "FEATURES • one bullet point • another point", "no marker • at all in this", "Features•  • nine chars"])


@query(rf"""with t as ({_sql(t=_LISTS)}), p as (select *, strpos(lower(t), 'features') as a, strpos(lower(t), 'applications') as b from t),
s as (select p_partkey, case when a = 0 then '' when b > 0 then substr(t, a + 8, greatest(b - a - 8, 0)) else substr(t, a + 8, 3000) end as s from p)
select p_partkey, array_to_string(list_filter(list_transform(string_split(s, '•'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) > 8), '|') as bullets from s""")
def feature_bullets(spark: SparkSession, d: str) -> DataFrame:
    return _part(spark, d, t=_LISTS).select("p_partkey", F.array_join(r.bullets(F.col("t"), "features", "applications"), "|").alias("bullets"))


@query()
def author_lines(spark: SparkSession, d: str) -> DataFrame:
    """Names of page-1 lines; tests/test_readers.py has what they must be."""
    lines = pick(["John Smith, Mary Jones† and Li Wei", "Anna Lee1, Bob Ray2 Institute of Power, Rome", "Abstract John Smith, Mary Jones", "One Name only", "Keywords: a, B", None, "Jean-Luc Roy · Eva Berg (1) Universität"])
    rows = _part(spark, d, t=lines)
    cores = spark.sparkContext.defaultParallelism
    dealt = rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
    # exploded rather than filtered: a filter would be pushed below and compute each name twice
    return dealt.select("p_partkey", F.explode(F.array_compact(F.array(r.author_line(F.col("t"))))).alias("authors"))


@query()
def sensitivity_rows(spark: SparkSession, d: str) -> DataFrame:
    """Receiver rows of a page; tests/test_readers.py has what they must be."""
    page = _lines([
        "  RXSLF1HP7   Sensitivity LoRa,   BWL = 125 kHz, SF = 7   -   -125.5   -   dBm/  RXSLHF8   BWL = 812.5 kHz, SF=12   -   -130   -   dBm/text", "  RXSLHF12HP3  RxBoosted = 1  BWL = 500 kHz, SF = 5  -  -110  -  dBm",
        "  RXSLHF3  BWL = 203 kHz  -  -99  -  dBm", "nothing",
    ])
    return _part(spark, d, t=page).select("p_partkey", F.inline(r.sensitivities(F.col("t"))))


_MAPS = _lines(["8.6 Register Maps", "x/  Table 3-2. Register list", "see Table 3. Registers", "the INTERNAL REGISTERS hold", "no registers", None])


_PHRASES = " or ".join(f"contains(lower(t), {lit(x)})" for x in r.MAP_PHRASES)


@query(f"""with t as ({_sql(t=_MAPS)}),
l as (select p_partkey, t, list_transform(string_split(lower(t), chr(10)), lambda x: trim(x)) as l from t)
select p_partkey, coalesce({_PHRASES} or len(list_filter(l, lambda x: regexp_matches(x, '^table [0-9-]+[.] *register'))) > 0, false) as named from l""")
def register_maps_named(spark: SparkSession, d: str) -> DataFrame:
    return _part(spark, d, t=_MAPS).select("p_partkey", r.register_map_named(F.col("t")).alias("named"))


_FILES = pick(["a.pdf", "B.PDF", "DUPLICATE - a.pdf", "SUPERSEDED - b.pdf", "REVIEW - c.pdf", "duplicate - d.pdf", "~$x.pdf", ".syncthing.y.pdf", "z.pdf.part", "w.tmp", "note.md"])
_SKIPS = dict(name=_FILES, size_mb="case when p_size % 5 <> 0 then cast(p_size as double) end", pages="p_partkey % 900", cached="p_partkey % 6 = 0")


@query(rf"""select p_partkey, name, case when cached then 'cached' when size_mb > 40 then 'size' when pages > 600 then 'pages' end as skipped from ({_sql(**_SKIPS)})
where lower(name) like '%.pdf' and not (starts_with(name, 'DUPLICATE - ') or starts_with(name, 'SUPERSEDED - ') or starts_with(name, 'REVIEW - ')) and not regexp_matches(name, '(?i)^(\.syncthing\.|~syncthing~|\.~|~\$)|\.(tmp|part|crdownload)$')""")
def inbox_files(spark: SparkSession, d: str) -> DataFrame:
    return r.inbox(_part(spark, d, **_SKIPS)).select("p_partkey", "name", r.skip_reason(F.col("size_mb"), F.col("pages"), F.col("cached"), 40, 600).alias("skipped"))


_WORDS = "case l_suppkey % 5 when 0 then concat('pin ', l_returnflag) when 1 then '80%' when 2 then concat(' axis  ', l_linestatus, ' ') when 3 then 'legend ..... x' else cast(l_suppkey as varchar(9)) end"


@query(rf"""with w as (select l_orderkey, l_linenumber, regexp_replace({_clean('t')}, '(?:\s?\.){{4,}}\s?', ' … ', 'g') as w from (select l_orderkey, l_linenumber, {_WORDS} as t from lineitem)), f as (select l_orderkey, w, min(l_linenumber) as o from w where regexp_matches(w, '[A-Za-z]') group by l_orderkey, w)
select l_orderkey, string_agg(w, '|' order by o, w) as words from f group by l_orderkey""")
def figure_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_WORDS} as text")
    return r.figure_words(rows, ["l_orderkey"], "l_linenumber").select("l_orderkey", F.array_join("words", "|").alias("words"))


_NOTES, _STEMS = pick(["BQ24074", "TPS55287 Design Equations", "tps", "LM-5176", "lm5176 a"]), pick(["bq24074", "tps55287", "C28646261", "2024_11-03", "tps55287_ds", "LM5176", "lm5176"])
_A, _B = "regexp_replace(lower(note), '[^a-z0-9]', '', 'g')", "regexp_replace(lower(stem), '[^a-z0-9]', '', 'g')"


@query(f"select p_partkey, {_A} = {_B} or (contains({_B}, {_A}) and length({_A}) >= 5) or (contains({_A}, {_B}) and length({_A}) - length({_B}) <= 3) as same, regexp_full_match(stem, 'C[0-9]{{4,}}|[0-9_-]+') as opaque from ({_sql(note=_NOTES, stem=_STEMS)})")
def name_kinship(spark: SparkSession, d: str) -> DataFrame:
    return _part(spark, d, note=_NOTES, stem=_STEMS).select("p_partkey", r.same_part(F.col("note"), F.col("stem")).alias("same"), r.opaque_name(F.col("stem")).alias("opaque"))


_PATHS = pick(["lib/a/a.pdf", "lib", "lib/", "library/a", "lib/../x", "lib/a..b", "/lib/a", "lib/a/.."])


@query(f"select p_partkey, not regexp_matches(path, '(^|/)\\.\\.(/|$)') and starts_with(rtrim(path, '/') || '/', 'lib/') as inside from ({_sql(path=_PATHS)})")
def paths_inside(spark: SparkSession, d: str) -> DataFrame:
    return _part(spark, d, path=_PATHS).select("p_partkey", r.inside(F.col("path"), F.lit("lib")).alias("inside"))


_SPANS = dict(a="case when p_size % 4 <> 0 then cast(p_size as double) end", b="case when p_size % 3 <> 0 then p_size / 2.0 end")


@query(f"with s as ({_sql(**_SPANS)}), t as (select p_partkey, coalesce(regexp_replace(a::double::varchar, '\\.0$', ''), '?') as a, coalesce(regexp_replace(b::double::varchar, '\\.0$', ''), '?') as b from s) select p_partkey, 'page1=' || a || '–' || b || ' vs ROC=' || b || '–' || a as note from t")
def conflict_notes(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    return _part(spark, d, **_SPANS).select("p_partkey", r.conflict_note("page1", a, b, "ROC", b, a).alias("note"))
