"""The reader of first pages: every field with its evidence."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import generic_reader as g

PAGE = """XySemi
X B 3 3 0 6 D  \t
SLVSCE0B - MAY 2020
XB3306D one-cell lithium-ion charger
Input: 4.5 to 35V, output voltage 0.8V ~ 22 V
Features
• Wide supply (cid:12) of 2V - 9V
• wide supply   of 2V - 9V
- Low Quiescent current
■ short
n ADI style bullet here
Applications
• not a feature at all
3-A peak switch current at 400kHz or 2.2 MHz with I2C, SMBus and i2c; SOT-23-5, SOT23-5, QFN-16, TO-220F and XSOT-23
"""


def run(spark, rows):
    return {r.doc: r for r in g.read(spark.createDataFrame(rows, "doc int, stem string, page int, text string")).collect()}


def test_a_first_page(spark):
    got = run(spark, [(1, "2410121637_XySemi-XB3306D_C2759992", 1, PAGE), (1, "2410121637_XySemi-XB3306D_C2759992", 2, "up to 60 V; 1 MHz"), (1, "x", 4, "SPI 99 A output")])[1]
    assert (got.part.value, got.part.evidence, got.part.score) == ("XB3306D", "X B 3 3 0 6 D", 40)
    assert got.title.value == "XB3306D one-cell lithium-ion charger"
    assert (got.vin_min.value, got.vin_max.value, got.vin_max.score) == ("4.5", "35", 3) and "Input: 4.5 to 35V" in got.vin_min.evidence
    assert (got.vout_min.value, got.vout_max.value) == ("0.8", "22")
    assert (got.iout_max.value, got.freq_max.value) == ("3", "1000")
    assert [(p.code, p.type, p.pins) for p in got.packages] == [("SOT-23-5", "SOT", 5), ("QFN-16", "QFN", 16), ("TO-220F", "TO", None)]
    assert got.features == ["Wide supply of 2V - 9V", "Low Quiescent current", "ADI style bullet here"]
    assert got.interfaces == ["I2C", "SMBUS"] and got.doc_id is None and got.reader == "generic"


@pytest.mark.parametrize(("stem", "want"), [
    ("2410121637_HXY-MOSFET-IRF9358PBF-HXY_C12345", "IRF9358PBF"), ("C84817 MT3608_plain", "MT3608"), ("HT7833-Holtek Semiconductor", "HT7833"), ("XC6219B332MR", "XC6219B332MR"),
    ("data (LM317T) sheet", "LM317T"), ("C28646261", "C28646261"), ("", None), ("nothing here", "nothing here"),
])
def test_parts_of_names(spark, stem, want):
    got = spark.createDataFrame([(stem,)], "s string").select(g.part_of_stem(F.col("s")).alias("x")).first().x
    assert (got and got.value) == want


def test_fallbacks(spark):
    got = run(spark, [(1, "MT3608", 1, "www.a-long-address-of-a-maker.com\nStep-up converter for small boards\nsees (MT3608) twice\nmax 24V, at 2 to 5 V\nmaximum 4 A"), (2, "lm5", 1, None), (3, None, 1, "UMW\nSLUSDV2B rev\nlm317t"), (4, "tps1", 2, "only a second page, 5V to 9V")])
    assert got[1].part.value == "MT3608" and got[1].part.score == 20 and got[1].title.value == "sees (MT3608) twice"
    assert (got[1].vin_min.value, got[1].vin_max.value, got[1].vin_max.score, got[1].iout_max.value) == ("2", "5", 2, "4") and got[1].freq_max.value is None
    assert got[2].part.value == "lm5" and got[2].title.value == "lm5" and got[2].vin_min.value is None and got[2].packages == []
    assert (got[3].part.value, got[3].doc_id, got[3].reader) == ("lm317t", "SLUSDV2B", "vendor")
    assert (got[4].part.value, got[4].vin_max.value) == ("tps1", "9")
    assert run(spark, []) == {}
