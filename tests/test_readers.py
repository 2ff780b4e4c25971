"""Readers without SQL against what they must give."""

from pyspark.sql import functions as F

from factloom.functions import scalars
from factloom.operators import readers
from factloom.plans import registry

DATA = "/root/testdata/sf0.001"


def test_author_lines(spark):
    got = {r.authors for r in registry.QUERIES["author_lines"](spark, DATA).collect()}
    assert got == {"John Smith, Mary Jones and Li Wei", "Anna Lee, Bob Ray", "Jean-Luc Roy· Eva Berg"}


def test_fragments_keep_digits(spark):
    got = spark.createDataFrame([("10 V input range; 0 to 20 A output. x",)], "t string").select(scalars.fragments(F.col("t")).alias("f")).first()
    assert got.f == ["10 V input range;", "0 to 20 A output."]


def test_sensitivity_rows(spark):
    got = {tuple(r)[1:] for r in registry.QUERIES["sensitivity_rows"](spark, DATA).collect()}
    assert got == {("RXSLF1HP7", "Sub-GHz", 125.0, 7, True, -125.5), ("RXSLHF8", "2.4GHz", 812.5, 12, False, -130.0), ("RXSLHF12HP3", "L-Band", 500.0, 5, True, -110.0)}


def test_nulls_and_empties(spark):
    df = spark.createDataFrame([(None, None), ("", "")], "a string, b string")
    got = df.select(readers.subscript_cell(F.col("a")).alias("s"), readers.shared_prefix(F.col("a"), F.col("b")).alias("n"), readers.author_line(F.col("a")).alias("w")).collect()
    assert [tuple(r) for r in got] == [("", 0, None)] * 2


def test_identifiers_end_where_their_sentence_goes_on(spark):
    texts = ["see (10.1109/abc.2020.1), arXiv: 2001.01234v2 of 2020", "10.1109/abc;x arXiv:2101.0123", "10.12/short, v10.1234/x", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(scalars.identifiers(F.col("t")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in got] == [("10.1109/abc.2020.1", "2001.01234v2", "2020"), ("10.1109/abc", "2101.0123", None), (None, None, None), (None, None, None)]


def test_packages_and_maps(spark):
    rows = [("QFN (29)", "4.0 mm x 4.0 mm"), ("RGV (VQFN, 16)", "2.6 mm X 2.0mm x\n1.2 mm\n(max height)"), ("WQFN-HR", "2.5mm×3.5mm"), ("SOT (1000)", ""), (None, None)]
    got = spark.createDataFrame(rows, "c string, s string").select(readers.package(F.col("c"), F.col("s")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in got] == [("QFN", 29, "4.0mm × 4.0mm"), ("VQFN", 16, "2.6mm × 2.0mm × 1.2mm"), ("WQFN-HR", None, "2.5mm×3.5mm"), ("SOT", None, ""), (None, None, "")]
    said = ["8.6 Register Maps", "x\n Table 3-2.Register list", "Table 3. Values", "table x. register", "REGISTER SET SUMMARY", None, "registers"]
    got = spark.createDataFrame([(t,) for t in said], "t string").select(readers.register_map_named(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [True, True, False, False, True, False, False]


def test_author_lines_compute_their_words_once(spark):
    df = registry.QUERIES["author_lines"](spark, DATA)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # the marks are taken out of each text once; each use of a name used to do it anew
    assert plan.count(readers.MARKS) == 1
    assert len(df.collect()) == len({r.p_partkey for r in df.collect()})
