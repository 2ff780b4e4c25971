"""The pattern engine against every pattern on every fragment."""

import re

import pytest

from factloom.operators import claims
from factloom.plans.claims import _SAID

SAID = [s.format(a=a, b=b) for s in _SAID for a, b in ((3, 12), (0, 36))] + [
    "", "12 V", "The 12.5 V, 3 A boost", "1.2.3V to 4V input voltage", "from 2.4V to 22V\tinput voltage; up to 9V INPUT VOLTAGE", "100 kHz to 2 MHz and 16-Bit", "no numbers: input voltage, switching",
    "5 to 10 °C", "−40 °C to 85 °C", "2 A peak", "up to 2.1MHz", "order 5 V to 9 V input voltage", "regulating 1V to 2V",
]


def plain(text, rules):
    out = []
    for i, r in enumerate(rules):
        m = re.search(r.pattern, text, re.I)
        for k, key in enumerate(r.keys if m else ()):
            value = float(m[r.number(k)]) * r.factors[k] * (claims.FACTORS[m[r.number(k) + 1].lower()] if r.units else 1)
            out.append((i, k, key, -value if r.minus and not k else value))
    return out


@pytest.mark.parametrize("rules", [claims.PROSE, claims.PAGE], ids=["prose", "page"])
def test_prefilter_loses_nothing(spark, rules):
    parts = spark.createDataFrame([(i, s) for i, s in enumerate(SAID)], "n int, fragment string")
    got = sorted(tuple(r) for r in claims.hits(parts, rules).select("n", "rule", "part", "key", "value").collect())
    assert got == sorted((n, *x) for n, s in enumerate(SAID) for x in plain(s, rules))
    assert {r for _, r, *_ in got} == set(range(len(rules))), "a rule that nothing here matches"


def test_fragments_and_first(spark):
    text = "Input voltage range of 2 V to 5 V. It has 3 V to 9 V input voltage;  tiny. • 4 A output current ▪ Absolute maximum 7 V to 9 V input voltage"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "no numbers at all here. none"), (5, "9 V to 12 V input voltage " * 5000)], "doc int, text string")
    got = sorted(tuple(r) for r in claims.first_of_each(claims.hits(claims.fragments(docs, "doc"), claims.PROSE), ["doc"]).select("doc", "key", "value", "rule").collect())
    assert got == [(1, "iout_max", 4.0, 9), (1, "vin_max", 5.0, 3), (1, "vin_min", 2.0, 3), (5, "vin_max", 12.0, 2), (5, "vin_min", 9.0, 2)]


def test_page_groups_take_the_first_rule(spark):
    page = "PART\n3.3 V minimum input\n4 V to 18 V input, VOUT is 1 V to 5 V\n2 A charge at 400 kHz to 2.2 MHz, up to 3 MHz\n40 °C to 125 °C"
    got = {r.name: (r.value, r.rule) for r in claims.page_readings(spark.createDataFrame([(1, page)], "doc int, text string"), "doc").collect()}
    assert got == {
        "vin_startup": (3.3, 1), "vin_min": (4.0, 2), "vin_max": (18.0, 2), "vout_min": (4.0, 4), "vout_max": (18.0, 4), "iout_max": (2.0, 8), "freq_min_khz": (400.0, 9), "freq_max_khz": (2200.0, 9),
        "temp_min_c": (-40.0, 12), "temp_max_c": (125.0, 12),
    }
