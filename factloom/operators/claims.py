"""Claims: quantities that prose states, by ordered patterns that run only where they can match.

A rule's pattern needs a number with a unit and one of the rule's words. So a text is looked at once for a number with any
rule's unit; only those that have one are cut into fragments; a fragment gets a mask of the words it holds; and a rule
runs its pattern behind its bits of that mask. What a pattern costs is paid on fragments that hold its words, and groups
are read from the few characters that matched. All hits are kept; the first by fragment, rule and key is the reading.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import scalars

_NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
_GAP = r"\s?[-–]?\s?"
#: Factors to the unit of a key by the unit that a pattern found (fixed values).
FACTORS = {"": 1.0, "khz": 1.0, "mhz": 1e3, "hz": 1e-3}
#: Units that some rule reads (fixed values).
ANY_UNIT = rf"[0-9]{_GAP}(?:m?V|A|W|[kM]?Hz|bit|[uµμ]A|°C)"
#: Fragments of this kind state something else, and shorter ones nothing (fixed values).
OTHER = r"abs(?:olute)?\s*max|storage temp|junction temp|\besd\b|\border\b|package (?:code|drawing)|see section"
SHORTEST, EVIDENCE = 8, 180


def _more(unit: str) -> str:
    """A quantity within a pattern."""
    return rf"{_NUMBER}{_GAP}{unit}\b"


def _one(unit: str) -> str:
    """A quantity that begins a pattern: no digits before it."""
    return rf"(?:^|[^0-9.]){_more(unit)}"


def _span(unit: str, to: str | None = None) -> str:
    return rf"{_one(unit)}\s+to\s+{_more(to or unit)}"


_FREQUENCY = rf"{_NUMBER}{_GAP}([kM]Hz)\b"


@dataclass(frozen=True)
class Rule:
    """keys: what the pattern's groups are, in order. words: a match holds one of them, in any case. factors: to a key's
    unit. units: each number's group is followed by one of its unit. minus: the first number is below zero in any case.
    group: rules of one group give one reading, by the first that matches."""

    keys: tuple[str, ...]
    words: tuple[str, ...]
    pattern: str
    factors: tuple[float, ...] = (1.0, 1.0)
    units: bool = False
    minus: bool = False
    group: str = ""

    def number(self, k: int) -> int:
        """The group of key k's number."""
        return 2 * k + 1 if self.units else k + 1


#: What sentences of a description state, most telling first.
PROSE = (
    Rule(("vin_max", "iout_max"), ("converter", "regulator", "buck", "boost"), rf"{_one('V')}\s?,\s?{_more('A')}[^.]{{0,40}}(?:converter|regulator|buck|boost)"),
    Rule(("vin_max",), ("input voltage",), rf"up to\s+{_more('V')}\s+input voltage"),
    Rule(("vin_min", "vin_max"), ("input",), rf"{_span('V')}\s+(?:wide\s+)?input[ -]voltage"),
    Rule(("vin_min", "vin_max"), ("input voltage",), rf"input voltage range(?:\s?:|\s+of)?\s+{_more('V')}\s+to\s+{_more('V')}"),
    Rule(("vin_min", "vin_max"), ("vin",), rf"\bVIN(?:\s?[:=]|\s+from)?\s+{_more('V')}\s+to\s+{_more('V')}"),
    Rule(("vout_min", "vout_max"), ("program", "output", "regulat"), rf"(?:programm(?:ed|able)|output(?:ting)?|regulat[a-z]+)\s+(?:from\s+)?{_more('V')}\s+to\s+{_more('V')}"),
    Rule(("vout_min", "vout_max"), ("output voltage",), rf"output voltage range(?:\s?:|\s+of)?\s+(?:\([a-z]+\)\s+)?{_more('V')}\s+to\s+{_more('V')}"),
    Rule(("vout_min", "vout_max"), ("output voltage",), rf"{_span('V')}[^.]{{0,30}}output voltage"),
    Rule(("vout_step_mv",), ("step",), rf"{_one('mV')}\s+steps?\b"),
    Rule(("iout_max",), ("output current",), rf"{_one('A')}[, ]{{0,3}}(?:continuous\s+)?output current"),
    Rule(("fsw_min_khz", "fsw_max_khz"), ("khz",), _span("kHz", "MHz"), (1.0, 1e3)),
    Rule(("fsw_max_khz",), ("switching",), rf"{_one('MHz')}\s+switching", (1e3,)),
    Rule(("fsw_fixed_khz",), ("fixed",), rf"fixed\s+{_more('kHz')}\s+switching"),
    Rule(("boost_power_w", "boost_from_v"), ("deliver",), rf"deliver(?:s|ing)?\s+{_more('W')}\s+from\s+(?:an?\s+)?{_more('V')}"),
    Rule(("resolution_bits",), ("bit",), _one("bit")),
    Rule(("iq_typ_ua",), ("quiescent",), rf"{_one('[uµμ]A')}\s+quiescent"),
)

#: What a first page states, by groups of rules.
PAGE = (
    Rule(("vin_startup",), ("start",), rf"{_one('V')}(?:\s+rising)?[^\n]{{0,20}}minimum\s+input\s+voltage\s+for\s+start", group="vin_startup"),
    Rule(("vin_startup",), ("minimum",), rf"{_one('V')}\s+minimum\s+input", group="vin_startup"),
    Rule(("vin_min", "vin_max"), ("input",), rf"{_span('V')}[^\n]{{0,40}}?input", group="vin"),
    Rule(("vin_min", "vin_max"), ("input", "vin"), rf"(?:input|VIN)[^\n]{{0,40}}?{_span('V')}", group="vin"),
    Rule(("vout_min", "vout_max"), ("output", "vout"), rf"{_span('V')}[^\n]{{0,40}}?(?:output|VOUT)", group="vout"),
    Rule(("vout_min", "vout_max"), ("output", "vout"), rf"(?:output|VOUT)[^\n]{{0,60}}?{_span('V')}", group="vout"),
    Rule(("vsupply_min", "vsupply_max"), ("supply",), rf"(?:power[- ]supply|supply\s+voltage)[^\n]{{0,20}}{_span('V')}", group="vsupply"),
    Rule(("vsupply_min", "vsupply_max"), ("powered",), rf"powered\s+from[^\n]{{0,30}}{_span('V')}", group="vsupply"),
    Rule(("iout_max",), ("output", "charg", "fast", "peak", "average"), rf"{_one('A')}\s+(?:output|charg|fast|peak|average\s+inductor)", group="iout"),
    Rule(("freq_min_khz", "freq_max_khz"), ("hz",), rf"(?:^|[^0-9.]){_FREQUENCY}\s+(?:or|to|-)\s+{_FREQUENCY}", units=True, group="freq"),
    Rule(("freq_max_khz",), ("up to", "maximum"), rf"(?:up\s+to|maximum)[^\n]{{0,20}}[^0-9.]{_FREQUENCY}", units=True, group="freq"),
    Rule(("freq_max_khz",), ("switch", "frequency"), rf"(?:^|[^0-9.]){_FREQUENCY}\s+(?:switch|frequency)", units=True, group="freq"),
    Rule(("temp_min_c", "temp_max_c"), ("°c",), r"[-–−]?([0-9]+)\s?°C\s+to\s+\+?([0-9]+)\s?°C", minus=True, group="temp"),
)


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?i){pattern}")


def states_something(text: Column) -> Column:
    """Whether a text has a number with a unit of some rule."""
    return F.coalesce(_has(text, ANY_UNIT), F.lit(False))


def fragments(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, frag_no, fragment: sentences and bullets of texts that state something, white space as one space; without
    short ones and those that state something else."""
    cut = F.regexp_replace(F.regexp_replace(text, r"([.;])\s+", "$1\u0001"), r"\s*[•▪·�]\s*", "\u0001")
    parts = docs.filter(states_something(F.col(text))).select(key, F.posexplode(F.split(cut, "\u0001")).alias("frag_no", "fragment"))
    plain = parts.withColumn("fragment", F.trim(F.regexp_replace("fragment", r"\s+", " ")))
    return plain.filter((F.length("fragment") >= SHORTEST) & ~_has(F.col("fragment"), OTHER))


def _value(found: Column, rule: Rule, k: int) -> Column:
    pattern = f"(?i){rule.pattern}"
    value = F.regexp_extract(found, pattern, rule.number(k)).try_cast("double") * rule.factors[k]
    if rule.units:
        unit = F.lower(F.regexp_extract(found, pattern, rule.number(k) + 1))
        value = value * functools.reduce(lambda c, u: c.when(unit == u, FACTORS[u]), list(FACTORS)[1:], F.when(unit == "", FACTORS[""]))
    return -value if rule.minus and not k else value


def hits(parts: DataFrame, rules: tuple[Rule, ...], text: str = "fragment") -> DataFrame:
    """parts with rule, key, value for everything that a rule reads from text; its other columns stay."""
    words = sorted({w for r in rules for w in r.words})
    bits = {w: 1 << i for i, w in enumerate(words)}
    wanted = [sum(bits[w] for w in r.words) for r in rules]
    mask = lambda low: functools.reduce(lambda a, b: a.bitwiseOR(b), [F.when(low.contains(w), F.lit(b)).otherwise(F.lit(0)) for w, b in bits.items()])

    def found(t: Column, held: Column) -> Column:
        return F.array(*[F.when(held.bitwiseAND(F.lit(m)) != 0, F.regexp_extract(t, f"(?i){r.pattern}", 0)).otherwise("") for r, m in zip(rules, wanted)])

    def made(f: Column) -> Column:
        each = [
            F.when(f[i] != "", F.struct(F.lit(i).alias("rule"), F.lit(k).alias("part"), F.lit(key).alias("key"), _value(f[i], r, k).alias("value")))
            for i, r in enumerate(rules) for k, key in enumerate(r.keys)
        ]
        return F.filter(F.array(*each), lambda x: x.isNotNull() & x["value"].isNotNull())

    read = scalars.once(F.col(text), lambda t: F.when(states_something(t), scalars.once(scalars.once(F.lower(t), mask), lambda held: scalars.once(found(t, held), made))))
    # outer: an inner one would have the whole expression a second time, in a filter of its own
    return parts.select(*parts.columns, F.inline_outer(read)).filter("rule is not null")


def first_of_each(found: DataFrame, by: list[str], text: str = "fragment") -> DataFrame:
    """by, key, value, rule, evidence: of each key the first hit by fragment, rule and place in it."""
    first = F.min_by(F.struct("value", "rule", F.left(F.col(text), F.lit(EVIDENCE)).alias("evidence")), F.struct("frag_no", "rule", "part"))
    return found.groupBy(*by, "key").agg(first.alias("_x")).select(*by, "key", "_x.*")


def page_readings(pages: DataFrame, key: str, text: str = "text", rules: tuple[Rule, ...] = PAGE) -> DataFrame:
    """key, name, value, rule: of each group of rules what the first that matches states, over a page's whole text."""
    groups = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (i, r.group)])
    found = hits(pages.select(key, text), rules, text).withColumn("_group", groups[F.col("rule")])
    first = found.groupBy(key, "_group").agg(F.min("rule").alias("_first"))
    return found.join(first, [key, "_group"]).filter("rule = _first").select(key, F.col("key").alias("name"), "value", "rule")
