"""Queries of record classification, over part rows whose texts are picked from fixed lists by coprime cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import classification as c
from factloom.plans.registry import query, table


def lit(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def pick(values: list[str | None], key: str = "p_partkey") -> str:
    """SQL of both dialects: one of values by key."""
    return f"case {key} % {len(values)} " + " ".join(f"when {i} then {lit(v)}" for i, v in enumerate(values) if v is not None) + " end"


_FIELDS = {
    "stem": pick(["tps55287", "XB3306D", "note on power", "IP5310", "cn3791", "rk3588 guide", "plain", "LMR33630"]),
    "original_name": pick([None, "2410121637_XySemi-XB3306D_C2759992.pdf", "2410121637_TECH-PUBLIC-AO3400_C1.pdf", "datasheet.pdf", "2410121637_XI-AN-Aerosemi-Tech-MT3608_C84817.pdf"]),
    "source_file": pick(["a.pdf", "XB3306D.pdf", None, "other.pdf", "CN3791.PDF", "lmr.pdf", "b.pdf", "c.pdf", "Ina701.pdf", "e.pdf", "f.pdf"]),
    "category": pick(["Power", "RF/LoRa", "Misc/MCUs/old", None, "Solar and MPPT", "", "Application Notes/x"]),
    "part": pick([None, "TPS55287", "sn_74lvc", "BQ24074", "unknown", "RV-8803", "", "ADP1613", "TPSM8", "mic2800", "ZZ1", "LT3652", "DW01A"]),
    "doc_id": pick(["", "SLVSCE0", None, None, "ds40002204A", "DS12", None, None, None, None, None, None, None, None, None, None, None]),
    "title": pick([
        "60-V step-down converter", "Protection of Charger Reverse", "Low-dropout linear regulator", "buck and boost controller", "Four-switch design", "How to use a fuel gauge", "Sub-GHz transceiver", None, "Holtek timer", "Battery charger",
        "Cortex-A vision processor", "linear charger by Semtech", "N-ch MOSFET", "RJ45 magjack", "USB Type-C to serial", "comparator", "Solar tracker", "nothing said", "ideal diode",
    ]),
    "description": pick([None, "by Texas Instruments", "boost", "", "Analog Devices part", "op amp", "see ti.com", "eFuse", "plain", "LoRa", "an AVR", "x", "dc/dc", "y", "z", "w", "v", "u", "t", "s", "r", "q", "Maxim"]),
    "export_category": pick([None, "", "Amplifiers", None, "DC/DC converters", None, "Battery management ICs", "Other", None, None, "Digital power monitors", None, None, None, "Amplifiers", None, None, None, None, None, None, None, None, None, None, None, None, None, None]),
    "export_subcategory": pick(["", "Battery charger ICs", None, "Linear regulators", "x", "Comparators"]),
    "export_function": pick([None, "Charger", "monitor", "solar charger", ""]),
    "export_topology": pick([None, "", None, None, "Buck", None, None, "Buck/Boost", None, None, None, "Boost", None, "Linear", None, None, None, "Flyback", None, None, None, None, None, None, None, None, None, None, None, None, None]),
    "text_topology": pick([None, "linear", None, "", None, None, "sepic", None, None]),
    "parse_error": pick([None, None, "timeout"]),
}
_ENDS = "cast(p_size % 13 as double) as vin_min, case when p_size % 4 <> 0 then cast(p_size % 9 as double) end as vout_max"
_FIXTURE = "select p_partkey, " + ", ".join(f"{v} as {k}" for k, v in _FIELDS.items()) + f", {_ENDS} from part"
_INDEX = """(values (1, 1, '# Datasheets'), (1, 2, '[[early.pdf]]'), (1, 3, '## Battery chargers (CN / TP / other) '), (1, 4, '- [[CN3791.pdf|solar]] and [[TP4056]]'), (1, 5, 'plain line'), (1, 6, '## Unknown section'), (1, 7, '[[lost.pdf]]'),
 (1, 8, '## Protection, Supervisors & eFuses'), (1, 9, '[[XB3306D.pdf#page=2]] [[XB3306D.pdf]] [[tp4056]]'), (1, 10, '## Current Sensors'), (1, 11, '* [[ INA701.pdf ]]'), (1, 12, '## Buck-Boost Converters'), (1, 13, '[[LMR.pdf]], [[e]]'), (1, 14, '### [[f]]')) as t(doc, line_no, line)"""
_SECTIONS = "(values " + ", ".join(f"({lit(k)}, {lit(v[0])}, {lit(v[1])})" for k, v in c.SECTIONS.items()) + ") as s(section, curated_type, curated_topology)"
_PART_INDEX = """(select p_partkey as doc, 16 * p_partkey + seq as line_no, case seq
  when 1 then concat('[[early', p_partkey, '.pdf]]') when 2 then case p_partkey % 6 when 0 then '## Battery chargers (CN / TP / other) ' when 1 then '## Protection, Supervisors & eFuses' when 2 then '## Current Sensors' when 3 then '## Buck-Boost Converters' when 4 then '## Unknown section' else '# Datasheets' end
  when 3 then concat('- [[CN', p_partkey, '.pdf|solar]] and [[TP', p_partkey % 50, ']]') when 4 then 'plain line' when 5 then case p_partkey % 5 when 0 then '## Current Sensors' when 1 then '## Unknown section' else '### [[f]]' end
  else concat('* [[ INA', p_partkey % 70, '.pdf ]], [[XB', p_partkey, '.pdf#page=2]] [[cn', p_partkey - 1, ']]') end as line
 from part, (values (1), (2), (3), (4), (5), (6)) as s(seq)) as t"""


def _index_sql(lines: str) -> str:
    return rf"""h as (
  select *, starts_with(line, '## ') as head,
    last_value(case when starts_with(line, '## ') then lower(trim(line[4:])) end ignore nulls) over (partition by doc order by line_no) as section
  from {lines}),
o as (select line_no, section, unnest(string_split(line, '[[')[2:]) as x from h where not head),
l as (select line_no, section, string_split(string_split(x, ']]')[1], '|')[1] as link from o where contains(x, ']]')),
l2 as (select line_no, section, lower(trim(link)) as name from l where link <> '' and not contains(link, '#')),
n as (select line_no, section, name from l2 union select line_no, section, regexp_replace(name, '\.pdf$', '') from l2),
curated as (select name, arg_max(curated_type, line_no) as curated_type, arg_max(curated_topology, line_no) as curated_topology from n join {_SECTIONS} using (section) group by name)"""


_INDEX_SQL = _index_sql(_INDEX)


def _rows(spark: SparkSession, d: str) -> DataFrame:
    made = [f"{v} as {k}" for k, v in _FIELDS.items()]
    return table(spark, d, "part").selectExpr("p_partkey", *made, "cast(p_size % 13 as double) as vin_min", "case when p_size % 4 <> 0 then cast(p_size % 9 as double) end as vout_max")


def _index(spark: SparkSession) -> DataFrame:
    return c.curated_index(spark.sql(f"select * from {_INDEX.replace(chr(92), chr(92) * 2)}"), "doc", "line_no", "line")


@query(f"with {_index_sql(_PART_INDEX)} select * from curated")
def curated_sections(spark: SparkSession, d: str) -> DataFrame:
    """What hand-made indexes, one of six lines for each part row, say of the files that they link; the last mention counts."""
    table(spark, d, "part").createOrReplaceTempView("part")
    return c.curated_index(spark.sql(f"select * from {_PART_INDEX}"), "doc", "line_no", "line")


def _case(text: str, rules: list[tuple[str, str]]) -> str:
    return "case " + " ".join(f"when regexp_matches({text}, {lit('(?i)' + p)}) then {lit(v)}" for v, p in rules) + " end"


def _map(key: str, values: dict[str, str]) -> str:
    return f"case {key} " + " ".join(f"when {lit(k)} then {lit(v)}" for k, v in values.items()) + " end"


_BOTH, _DOWN, _UP, _LINEAR = (lit("(?i)" + p) for p in c.TITLE_TOPOLOGY)


def _shape(t: str) -> str:
    return f"case when regexp_matches({t}, {_BOTH}) or (regexp_matches({t}, {_DOWN}) and regexp_matches({t}, {_UP})) then 'buck-boost' when regexp_matches({t}, {_DOWN}) then 'buck' when regexp_matches({t}, {_UP}) then 'boost' when regexp_matches({t}, {_LINEAR}) then 'linear' end"


_MAKERS = "(values " + ", ".join(f"({lit(k)}, {lit(v)})" for k, v in c.PART_PREFIXES.items()) + ") as m(prefix, owner)"
_SUPPLIERS = "case " + " ".join(f"when starts_with(middle, {lit(p)}) then {lit(v)}" for p, v in c.SUPPLIER_PREFIXES) + " end"
_CLASSIFIED = rf"""with {_INDEX_SQL}, f as ({_FIXTURE}),
e as (select p_partkey, vin_min, vout_max, {", ".join(f"coalesce({k}, '') as {k}" for k in _FIELDS)} from f),
k as (select e.*, coalesce(a.curated_type, b.curated_type, '') as ct, coalesce(case when a.name is not null then a.curated_topology else b.curated_topology end, '') as cs, lower(export_category) as cat, concat_ws(' ', part, title, description, stem) as blob,
  regexp_replace(case when original_name <> '' then original_name else stem end, '\.[^.]*$', '') as file, {_map("lower(export_category)", c.CATEGORIES)} as plain, {_map("lower(export_subcategory)", c.SUBCATEGORIES)} as sub,
  list_filter(list_transform(list_reverse(string_split(lower(category), '/')), lambda p: {_map("p", c.FOLDERS)}), lambda t: t is not null)[1] as folder from e left join curated a on lower(source_file) = a.name left join curated b on lower(stem) = b.name),
p as (select *, {_case("blob", c.KEYWORDS)} as word, lower(trim(regexp_extract(file, '(?i){c.SUPPLIER_NAME}', 1))) as middle, replace(upper(case when part <> '' then part else file end), '_', '') as pn, concat_ws(' ', title, description, file) as mblob, concat_ws(' ', title, description) as tblob from k),
b as (select p_partkey, max_by(owner, length(prefix)) as owner from p join {_MAKERS} on starts_with(pn, prefix) group by p_partkey),
q as (select p.*, {_case("doc_id", c.DOC_IDS)} as numbered, nullif({_SUPPLIERS}, '') as supplier, owner, {_case("mblob", c.MAKER_WORDS)} as said, {_shape("export_topology")} as exported, {_shape("tblob")} as titled from p left join b using (p_partkey)),
r as (select p_partkey, vin_min, vout_max,
  case when cat = 'amplifiers' and ct <> '' then ct when plain is not null then coalesce(sub, case when contains(lower(export_function), 'charger') then 'charger' end, plain) when ct <> '' then ct else coalesce(folder, word, case when parse_error <> '' then 'reference-manual' end, 'unknown') end as product_type,
  case when cat = 'amplifiers' and ct <> '' then 'curated-index (over TI Amplifiers)' when plain is not null then case when sub is not null then 'ti-subcategory' when contains(lower(export_function), 'charger') then 'ti-function' else 'ti-category' end
    when ct <> '' then 'curated-index' when folder is not null then 'folder' when word is not null then 'keyword' when parse_error <> '' then 'parse-error' else 'none' end as classified_by,
  case when export_category <> '' then 'Texas Instruments' else coalesce(numbered, supplier, owner, said) end as manufacturer,
  case when export_category <> '' then 'ti-export' when numbered is not null then 'doc-id' when supplier is not null then 'lcsc-filename' when owner is not null then 'part-prefix' when said is not null then 'text' else 'none' end as manufacturer_by,
  coalesce(exported, nullif(cs, ''), nullif(text_topology, ''), titled) as topology_class,
  case when exported is not null then 'ti-topology' when cs <> '' then 'curated-index' when text_topology <> '' then 'prose' when titled is not null then 'title' else 'none' end as topology_by from q)"""


@query(_CLASSIFIED + """ select p_partkey, product_type, classified_by, manufacturer, manufacturer_by, topology_class, topology_by, coalesce(vin_min > vout_max and vout_max > 0, false) as steps_down,
 product_type in ('converter', 'charger', 'ldo', 'power-bank-soc', 'solar-mppt') as converts_voltage, coalesce(topology_class in ('buck', 'buck-boost'), false) as is_buck, coalesce(topology_class in ('boost', 'buck-boost'), false) as is_boost,
 coalesce(topology_class = 'buck-boost', false) as is_buck_boost, coalesce(topology_class = 'linear', false) as is_linear, coalesce(topology_class in ('buck', 'boost', 'buck-boost', 'flyback', 'sepic', 'inverting'), false) as is_switching from r""")
def record_classes(spark: SparkSession, d: str) -> DataFrame:
    """Type, maker and topology of every part row, each with the signal that decided."""
    out = c.classified(c.with_curated(_rows(spark, d), _index(spark)))
    return out.select("p_partkey", "product_type", "classified_by", "manufacturer", "manufacturer_by", "topology_class", "topology_by", "steps_down", "converts_voltage", "is_buck", "is_boost", "is_buck_boost", "is_linear", "is_switching")


@query(_CLASSIFIED + " select product_type, classified_by, count(*) as n, min(p_partkey) as example from r group by product_type, classified_by")
def class_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many records each signal put into each type."""
    out = c.classified(c.with_curated(_rows(spark, d), _index(spark)))
    return out.groupBy("product_type", "classified_by").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("example"))


_SENTENCES = [
    pick(["A buck stage", "Unlike a boost converter", "A SEPIC input", "Step-up mode", "Nothing"]),
    pick(["smaller vs. an LDO", "an isolated dc/dc brick", "a low dropout pass", "linear Li charging", "a charge pump", "step up/down", "plain"]),
    pick(["boost output", None, "inverting buck regulator", "other devices use flyback"]),
]
_PROSE = "select p_partkey, concat_ws('. ', " + ", ".join(_SENTENCES) + ") as text from part"


@query(f"""with f as (select p_partkey, string_split(text, '. ') as s from ({_PROSE})), u as (select p_partkey, unnest(s) as x, generate_subscripts(s, 1) as i from f), v as (select * from u where not regexp_matches(x, {lit('(?i)' + c.COMPARISONS)})),
w as (""" + " union all ".join(f"select p_partkey, min(i) as pos, {i} as rank, {lit(v)} as term from v where regexp_matches(x, {lit('(?i)' + p)}) group by p_partkey" for i, (v, p) in enumerate(c.TOPOLOGIES)) + """),
g as (select p_partkey, list(term order by pos, rank) as found from w group by p_partkey), h as (select p_partkey, coalesce(found, []) as found from f left join g using (p_partkey))
select p_partkey, case when list_contains(found, 'buck-boost') or (list_contains(found, 'buck') and list_contains(found, 'boost')) then 'buck-boost' when list_contains(found, 'buck') then 'buck' when list_contains(found, 'boost') then 'boost' when list_contains(found, 'linear') then 'linear' else coalesce(found[1], '') end as derived,
 array_to_string(found, ',') as found from h""")
def prose_topologies(spark: SparkSession, d: str) -> DataFrame:
    text = "concat_ws('. ', " + ", ".join(_SENTENCES) + ")"
    rows = table(spark, d, "part").selectExpr("p_partkey", f"{text} as text")
    return rows.select("p_partkey", c.prose_topology(F.split("text", r"\. ")).alias("x")).select("p_partkey", "x.derived", F.array_join("x.found", ",").alias("found"))
