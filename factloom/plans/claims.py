"""Quantities that texts state: documents, each with sentences about numbers of its own row after its text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.operators import claims
from factloom.plans.registry import query, table

#: Sentences with a (0 to 36) and b (larger), dealt by doc_id.
_SAID = (
    "It is a {b}-V, {a}.5-A buck converter", "up to {b} V input voltage is allowed", "{a}V to {b}V wide input voltage", "Input voltage range: {a}.8 V to {b} V",
    "VIN from {a} V to {b} V", "programmable from {a}.8V to {b}V by pins", "output voltage range of {a}V to {b}V; 5 V to 9 V input-voltage", "{a} V to {b} V with trimmed output voltage",
    "set in {b}-mV steps", "gives {a}.2 A continuous output current", "runs at {b}0 kHz to {a}.2 MHz", "a {a}.1-MHz switching part, fixed {b}0-kHz switching",
    "delivering {b} W from a {a}-V cell", "with a {a}-bit DAC • {b} µA quiescent current ▪ 12-bit ADC", "Absolute maximum {b} V input voltage up to {b} V input voltage", "{a} V rising minimum input voltage for start",
    "supply voltage {a} V to {b} V\npowered from {a}.5 V to {b} V", "{b} A fast charge at –{a} °C to +{b} °C", "{b}0 kHz or {a} MHz, maximum of {a} MHz", "needs {b} V minimum input; VOUT is {a} V to {b} V",
)
_A, _B = "cast(n_chars % 37 as varchar(9))", "cast(n_chars % 37 + doc_id % 11 + 1 as varchar(9))"


def _sentence(shift: int) -> str:
    """SQL of the sentence that doc_id and shift deal."""
    said = []
    for i, s in enumerate(_SAID):
        parts = s.replace("{a}", "\0A\0").replace("{b}", "\0B\0").split("\0")
        said.append(f"when {i} then concat(" + ", ".join(_A if p == "A" else _B if p == "B" else "'" + p.replace("\n", "@") + "'" for p in parts if p) + ")")
    return f"replace(case (doc_id * 7 + {shift}) % {len(_SAID)} {' '.join(said)} end, '@', chr(10))"


_TEXT = "concat(coalesce(text, ''), '. ', " + ", '. ', ".join(_sentence(k) for k in (0, 3, 8)) + ")"


def _quoted(pattern: str) -> str:
    return "'(?i)" + pattern.replace("'", "''") + "'"


def _rules(rules: tuple[claims.Rule, ...]) -> str:
    """A row for each key of each rule: rule, part, key, pattern, group, factor, whether a unit follows, sign, reading."""
    rows = [
        f"({i}, {k}, '{key}', {_quoted(r.pattern)}, {r.number(k)}, {r.factors[k]}, {r.units}, {-1 if r.minus and not k else 1}, '{r.group}')"
        for i, r in enumerate(rules) for k, key in enumerate(r.keys)
    ]
    return f"(values {', '.join(rows)}) as r(rule, part, key, pattern, number, factor, units, sign, reading)"


def _groups(of: str) -> str:
    """SQL that reads a rule's numbers; group numbers are constants in this dialect."""
    g = lambda add: f"case number when 1 then regexp_extract({of}, pattern, {1 + add}) when 2 then regexp_extract({of}, pattern, {2 + add}) when 3 then regexp_extract({of}, pattern, {3 + add}) end"
    unit = f"case when units then case lower({g(1)}) when 'mhz' then 1000.0 when 'hz' then 0.001 else 1.0 end else 1.0 end"
    return f"try_cast({g(0)} as double) * factor * {unit} * sign"


_FRAGMENTS = rf"""d as (select doc_id, {_TEXT} as text from documents),
c as (select doc_id, string_split(regexp_replace(regexp_replace(text, '([.;])\s+', '\1' || chr(1), 'g'), '\s*[•▪·\x{{FFFD}}]\s*', chr(1), 'g'), chr(1)) as l from d),
e as (select doc_id, unnest(range(len(l))) as frag_no, trim(regexp_replace(unnest(l), '\s+', ' ', 'g')) as fragment from c),
f as (select * from e where length(fragment) >= 8 and regexp_matches(fragment, '[0-9]') and not regexp_matches(fragment, {_quoted(claims.OTHER)})),
h as (select doc_id, frag_no, fragment, rule, part, key, {_groups('fragment')} as value from f, {_rules(claims.PROSE)} where regexp_matches(fragment, pattern))"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").selectExpr("doc_id", f"{_TEXT} as text")


@query(f"with {_FRAGMENTS} select doc_id, frag_no, rule, key, value from h where value is not null")
def claims_all(spark: SparkSession, d: str) -> DataFrame:
    """Every claim of sixteen ordered patterns."""
    found = claims.hits(claims.fragments(_docs(spark, d), "doc_id"), claims.PROSE)
    return found.select("doc_id", "frag_no", "rule", "key", "value")


@query(f"""with {_FRAGMENTS}
select doc_id, key, arg_min(value, [frag_no, rule, part]) as value, arg_min(rule, [frag_no, rule, part]) as rule, md5(left(arg_min(fragment, [frag_no, rule, part]), 180)) as evidence
from h where value is not null group by doc_id, key""")
def claims_first(spark: SparkSession, d: str) -> DataFrame:
    """The reading of each key: its first claim, with what said so."""
    found = claims.hits(claims.fragments(_docs(spark, d), "doc_id"), claims.PROSE)
    return claims.first_of_each(found, ["doc_id"]).selectExpr("doc_id", "key", "value", "rule", "md5(evidence) as evidence")


@query(f"""with d as (select doc_id, {_TEXT} as text from documents),
h as (select doc_id, rule, key, reading, {_groups('text')} as value from d, {_rules(claims.PAGE)} where regexp_matches(text, pattern)),
m as (select *, min(rule) over (partition by doc_id, reading) as first from h)
select doc_id, key as name, value, rule from m where rule = first""")
def claims_page(spark: SparkSession, d: str) -> DataFrame:
    """What a first page states, by groups of patterns: a range, else a single value."""
    return claims.page_readings(_docs(spark, d), "doc_id")
