"""Scalar functions over text cells: numbers, units, addresses, names, identifiers. All are column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: SI prefixes and their factors (fixed values).
SI = {"p": 1e-12, "n": 1e-9, "u": 1e-6, "µ": 1e-6, "μ": 1e-6, "m": 1e-3, "": 1.0, "k": 1e3, "K": 1e3, "M": 1e6, "G": 1e9}
#: Factors of units; frequencies come out in kHz (fixed values).
UNITS = {"V": 1.0, "A": 1.0, "W": 1.0, "HZ": 1e-3, "KHZ": 1.0, "MHZ": 1e3, "GHZ": 1e6}
#: Cells that stand for no value (fixed values).
PLACEHOLDERS = ("", "-", "--", "n/a", "na", "tbd")


#: Parts of a quantity: digits with or without a point, an SI prefix.
_DIGITS, _PREFIX = "[0-9]*\\.?[0-9]+", f"([{''.join(SI)}])"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use has it: as the variable of a lambda, which no rule of the
    optimizer copies into its places."""
    return F.element_at(F.transform(F.array(value), use), 1)


def norm_part(name: Column) -> Column:
    """A part number without a trailing (1), punctuation and case."""
    return F.upper(F.regexp_replace(F.regexp_replace(name, "\\s*\\([0-9]{1,2}\\)\\s*$", ""), "[^A-Za-z0-9]", ""))


def to_number(cell: Column) -> Column:
    """The number that a whole cell is; null for anything else."""
    c = F.trim(F.regexp_replace(F.translate(cell, "−–,", "--"), "^-\\s+", "-"))
    return F.when(~F.lower(c).isin(*PLACEHOLDERS) & c.rlike("^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"), c.try_cast("double"))


def _factor(table: dict[str, float], key: Column) -> Column:
    """table[key], 1 for what it lacks."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(1.0))


def unit_scale(unit: Column) -> Column:
    return _factor(UNITS, F.upper(F.trim(F.coalesce(unit, F.lit("")))))


def value_of(text: Column, hint: str = "") -> Column:
    """struct(value, unit) of the first number, null without one: signed, with an SI prefix applied, frequencies in kHz,
    rounded to six places. A unit is taken in any case; without one the hint counts."""
    pattern = f"(?i)([-+−]?{_DIGITS})\\s*{_PREFIX}?\\s*({'|'.join(UNITS)})?"
    g = lambda k: F.regexp_extract(text, pattern, k)
    unit = F.upper(F.when(g(3) != "", g(3)).otherwise(hint))
    value = F.translate(g(1), "−", "-").try_cast("double") * _factor(SI, g(2)) * _factor(UNITS, unit)
    return F.when(text.rlike(pattern), F.struct(F.bround(value, 6).alias("value"), F.when(unit.endswith("HZ"), "kHz").otherwise(unit).alias("unit")))


#: A number with an SI prefix, and what must follow it. What follows can't begin a number, so it may be consumed.
_NUMBER = f"([-+]?{_DIGITS})\\s*{_PREFIX}?(?:\\s|$|[VAWH])"


def numbers_in(text: Column, unit_factor: Column | None = None) -> Column:
    """Every signed number that white space, a unit letter or the end follows, its SI prefix applied, scaled, rounded to
    six places. An en dash separates; a minus sign is a sign."""
    plain = F.translate(text, "−–", "- ")
    found = F.arrays_zip(*[F.regexp_extract_all(plain, F.lit(_NUMBER), F.lit(k)).alias(n) for k, n in ((1, "raw"), (2, "prefix"))])
    f = F.lit(1.0) if unit_factor is None else unit_factor
    return F.transform(found, lambda x: F.bround(x["raw"].try_cast("double") * _factor(SI, x["prefix"]) * f, 6))


def hex_normal(text: Column) -> Column:
    """2Eh, 0x10h and 6 as 0x2E, 0x10 and 0x06; decimal unless 0x, h or a letter says otherwise."""
    c = F.trim(text)
    body = F.regexp_replace(F.regexp_replace(c, "^0[xX]", ""), "[hH]$", "")
    is_hex = c.rlike("(?i)^0x|h$|[a-f]")
    n = F.when(is_hex, F.conv(body, 16, 10)).otherwise(body).try_cast("bigint")
    return F.when(body.rlike("^[0-9A-Fa-f]+$"), F.concat(F.lit("0x"), F.when(n < 16, F.lit("0")).otherwise(F.lit("")), F.hex(n)))


def absolute_address(base: Column, offset: Column) -> Column:
    """0xNN + 0xNN as a number."""
    whole = lambda c: F.conv(F.regexp_replace(c, "^0[xX]", ""), 16, 10).try_cast("bigint")
    return whole(base) + whole(offset)


def general(x: Column) -> Column:
    """A number as text, without a fraction of zero."""
    return F.regexp_replace(x.cast("string"), "\\.0$", "")


def plain_glyphs(text: Column) -> Column:
    """One spelling of micro, ohm, minus, degree and quotes."""
    return F.translate(F.translate(text, "μΩ−‐‑", "µΩ---"), "“”‘’", "\"\"''")


def fragments(text: Column, least: int = 8) -> Column:
    """Sentences and bullets of at least `least` characters."""
    return F.filter(F.transform(F.split(text, "(?<=[.;])\\s+|[•▪·�]"), lambda x: F.trim(x)), lambda x: F.length(x) >= least)


def claims(text: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(pos, key, value) for each rule (key, pattern) that matches, in the rules' order."""
    made = [F.when(text.rlike(p), F.struct(F.lit(i).alias("pos"), F.lit(k).alias("key"), F.regexp_extract(text, p, 1).alias("value"))) for i, (k, p) in enumerate(rules)]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def identifiers(text: Column) -> Column:
    """struct(doi, arxiv, year) of a first page."""
    g = lambda p: F.regexp_extract(text, p, 1)
    some = lambda c, name: F.nullif(c, F.lit("")).alias(name)
    # a DOI goes up to white space, quotes and separators of the sentence around it
    doi = g("\\b(10\\.[0-9]{4,9}/[^\\s\"<>|,;)]+)")
    return F.struct(some(doi, "doi"), some(g("arXiv: *([0-9]{4}\\.[0-9]{4,5}(?:v[0-9]+)?)"), "arxiv"), some(g("\\b((?:19|20)[0-9]{2})\\b"), "year"))


def demote_headings(text: Column) -> Column:
    return F.regexp_replace(text, "(?m)^(#{1,5}) ", "#$1 ")


def join_hyphens(text: Column) -> Column:
    """Words that a line break cut, whole again; dot leaders as one space."""
    return F.regexp_replace(F.regexp_replace(text, "([a-z])-\\n([a-z])", "$1$2"), "\\s*\\.{4,}\\s*", " ")


def escape_wiki(text: Column) -> Column:
    """[[ and # that aren't links and headings, escaped."""
    return F.regexp_replace(F.regexp_replace(text, "\\[\\[", "\\\\[\\\\["), "(?m)(?<=[^#\\n])#", "\\\\#")


def clean_name(name: Column) -> Column:
    """A file stem without download suffixes and stamps, single underscores, and the version before the kind."""
    c = F.regexp_replace(name, "(?i)\\s*(\\([0-9]+\\)|- copy|_copy)$", "")
    c = F.regexp_replace(c, "[\\s_]+", "_")
    return F.regexp_replace(c, "(?i)_(v[0-9.]+)_(ds|um)$", "_$2_$1")


def family(name: Column) -> Column:
    return F.regexp_replace(name, "(?i)[_-]?(v|rev)[0-9.]+$", "")


def revision(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, "(?i)(?:v|rev)\\.?\\s*([0-9]+(?:\\.[0-9]+)*)$", 1), F.lit(""))


def column_streams(line: Column, width: int = 20) -> Column:
    """struct(bucket, text) of a line's segments between runs of three spaces or more; buckets round half to even."""
    parts = F.split(line, " {3,}")
    gaps = F.regexp_extract_all(line, F.lit(" {3,}"), F.lit(0))
    size = F.transform(parts, lambda p, i: F.length(p) + F.coalesce(F.length(F.try_element_at(gaps, i + 1)), F.lit(0)))
    start = F.transform(parts, lambda p, i: F.aggregate(F.slice(size, F.lit(1), i), F.lit(0), lambda a, x: a + x))
    both = F.arrays_zip(start.alias("s"), parts.alias("t"))
    return F.filter(F.transform(both, lambda x: F.struct(F.bround(x.s / width).cast("int").alias("bucket"), F.trim(x.t).alias("text"))), lambda x: x.text != "")
