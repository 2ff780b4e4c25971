import io
import json
import zipfile

from pyspark.sql import functions as F

from factloom.functions import scalars
from factloom.operators import evidence, matching, search, tables
from factloom.sources import database, files
from factloom.streaming import ingest


def test_documents_and_their_tables(spark, tmp_path):
    doc = {"document": {"file": "a.pdf", "parts": ["A1"]}, "params": [{"key": "vin", "min": 1.0, "max": 2.0, "confidence": "high", "readings": [{"source": "roc", "min": 1.0, "max": 2.0}, {"source": "prose", "min": 1.0}]}],
           "registers": [{"name": "CTRL", "address": "0x00", "fields": [{"bits": "7:4", "name": "EN"}, {"bits": "3:0", "name": "X"}]}, {"name": "STAT", "address": "0x01", "fields": []}],
           "enrichment": {"export": {"file": "x.csv", "values": {"a": "1", "b": "2"}, "unmapped": {"b": "9"}}}}
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.data.json").write_text(json.dumps(doc))
    d = files.json_documents(spark, str(tmp_path)).cache()
    assert [(r.doc, r.key) for r in files.params(d).collect()] == [("a", "vin")]
    assert files.readings(d).count() == 2
    assert sorted((r.register, r.field) for r in files.register_fields(d).collect() if r.field) == [("CTRL", "EN"), ("CTRL", "X")] and files.register_fields(d).count() == 3
    assert {r.field: r.value for r in files.enrichment(d).collect()} == {"a": "1", "b": "9"}
    assert files.scan(spark, str(tmp_path), "*.json").count() == 1 and files.scan(spark, str(tmp_path), "*.json", (f"file:{tmp_path}",)).count() == 0


def test_pages_of_marked_text(spark, tmp_path):
    (tmp_path / "m.txt").write_text("kind: x\n---\n=== PAGE 1 ===\n  one \n=== PAGE 3 ===\nthree\nmore\n")
    assert [tuple(r) for r in files.text_pages(spark, str(tmp_path)).orderBy("page").collect()] == [("m", 1, "one"), ("m", 3, "three\nmore")]


def sheet(rows):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Part</t></si><si><t>V</t><t>in</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")
    return buf.getvalue()


def test_xlsx_and_exports(spark):
    rows = '<row><c r="A1" t="inlineStr"><is><t>Made by selector</t></is></c></row><row><c r="A2" t="s"><v>0</v></c><c r="AA2" t="s"><v>1</v></c></row><row><c r="A3"><f>HYPERLINK("u","ab-1 (1)")</f><v>0</v></c><c r="AA3"><v>3.5</v></c></row><row><c r="A4" t="inlineStr"><is><t>AB1</t></is></c><c r="AA4"><v>4</v></c></row>'
    cells = files.xlsx_rows(spark.createDataFrame([("f", bytearray(sheet(rows)))], "path string, content binary")).cache()
    got = {r.row: r.cells for r in cells.collect()}
    assert got[1][0] == "Part" and got[1][26] == "Vin" and got[2][0] == "ab-1 (1)" and {len(x) for x in got.values()} == {27}
    assert [(r.part, r.header, r.value) for r in files.export_rows(cells, "Part", "selector").collect() if r.header == "Vin"] == [("AB1", "Vin", "4")]
    assert files.export_rows(cells, "Part", "nothing").count() == 0


def test_cards_and_sections(spark):
    card = '---\ntitle: "A b"\nparts:\n  - x\n  - y\nempty:\n---\nbody\nnot: this\n'
    got = {r.field: r["values"] for r in files.frontmatter(spark.createDataFrame([(1, card)], "k int, t string"), "t", "k").collect()}
    assert got == {"title": ["A b"], "parts": ["x", "y"]}
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(["## Buck", "see [[A.pdf]] and [[B|b]]", "## LDO", "[[C]]"])], "doc int, n int, line string")
    assert [(r.section, r.link) for r in files.curated_sections(lines, "doc").orderBy("link").collect()] == [("Buck", "A"), ("Buck", "B"), ("LDO", "C")]
    m = spark.range(1).select(files.merge_card(F.create_map(F.lit("a"), F.lit("1"), F.lit("note"), F.lit("n")), F.create_map(F.lit("a"), F.lit("2"), F.lit("z"), F.lit("0")), ["a"]).alias("m"), files.markdown_rows(F.lit(1), F.lit(None)).alias("r")).first()
    assert m.m == {"a": "2", "note": "n"} and m.r == "| 1 |  |"


def test_writers_and_rebuilds(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    for _ in range(2):
        database.rebuild(spark, str(tmp_path / "db"), {"things": df}, {"things": ["k"]})
    assert spark.sql("select v from things where k = 2").collect()[0].v == "y"
    files.write_lines(df.select(F.col("v").alias("value")), str(tmp_path / "lines"))
    files.append_log(df, str(tmp_path / "log"))
    files.append_log(df, str(tmp_path / "log"))
    files.write_plan(df, str(tmp_path / "plan"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4 and spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "plan")).count() == 2
    for v in ("a", "b"):
        ingest.upsert(spark, spark.createDataFrame([(1, v, 1 if v == "a" else 2)], "k int, v string, n int"), str(tmp_path / "up"), "k", "n")
    assert [tuple(r) for r in database.Table(spark, str(tmp_path / "up")).read("k int, v string, n int").collect()] == [(1, "b", 2)]


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_scalars(spark):
    assert [one(spark, scalars.hex_normal(F.lit(x))) for x in ("2Eh", "0x10h", "6", "zz")] == ["0x2E", "0x10", "0x06", None]
    assert [one(spark, scalars.to_number(F.lit(x))) for x in ("− 0.3", "1,000", "3.0f", "-", "NaN")] == [-0.3, 1000.0, None, None, None]
    assert one(spark, scalars.clean_name(F.lit("ab  c_V1_DS (2)"))) == "ab_c_DS_V1"
    assert [x.text for x in one(spark, scalars.column_streams(F.lit("left part     right")))] == ["left part", "right"]
    assert one(spark, scalars.fragments(F.lit("Short. A longer sentence here; and another one."))) == ["A longer sentence here;", "and another one."]
    assert one(spark, search.snippet(F.lit("a b c License, d e"), "license", 1)) == "c [License,] d"
    assert one(spark, evidence.least_level(F.array(F.lit("high"), F.lit("low")))) == "low"
    assert one(spark, scalars.escape_wiki(F.lit("# h\na #b [[c"))) == "# h\na \\#b \\[\\[c"


def test_greedy_pairs_take_each_row_once(spark):
    left = spark.createDataFrame([(1, 1, "a", "l", 1.0, None, 2.0), (1, 2, "a", "l", 1.0, None, 2.0), (1, 3, "b", "m", None, None, None)], "page int, pos long, symbol string, label string, min double, typ double, max double")
    right = left.filter("pos != 2")
    assert [tuple(r) for r in matching.greedy_pairs(left, right, ["page"]).collect()] == [(1, 1, 1)]


def test_typed_columns(spark):
    x = spark.createDataFrame([(["Parameter", " Min ", "MAX", "Unit"],)], "h array<string>").select(tables.typed_columns(F.col("h"), {"min": ["min"], "max": ["max"], "typ": ["typ", "nom"]}).alias("x")).first().x
    assert (x.min, x.max, x.typ) == (2, 3, 0)


def test_tables_change_at_once(spark, tmp_path):
    at, schema = database.Table(spark, str(tmp_path / "t")), "k int, v string, n int"
    rows = lambda: sorted(tuple(r) for r in at.read(schema).collect())
    assert rows() == []
    at.merge(spark.createDataFrame([(k, "a", 1) for k in range(50)], schema), "k", "n", 8)
    before, was = at.manifest(), at.read(schema)
    at.merge(spark.createDataFrame([(3, "b", 2), (3, "old", 0)], schema), "k", "n", 8)
    after = at.manifest()
    assert sum(before[b] != after[b] for b in before) == 1 and (3, "b", 2) in rows() and len(rows()) == 50
    # a reader of the version before still has its files, and a write that never swapped its manifest changes nothing
    assert was.count() == 50
    spark.createDataFrame([(9, "lost", 9)], schema).write.parquet(f"{at.path}/v-crashed")
    assert (9, "lost", 9) not in rows()
    at.merge(spark.createDataFrame([(3, "b", 2)], schema), "k", "n", 8)
    at.vacuum(0)
    assert len(rows()) == 50 and not (tmp_path / "t" / "v-crashed").exists()


def test_one_writer_and_rounds(spark, tmp_path):
    at = str(tmp_path / "lock")
    with ingest.alone(spark, at) as first, ingest.alone(spark, at) as second:
        assert first and not second
    with ingest.alone(spark, at) as again:
        assert again
    left = [3, 2, 1, 0]
    assert ingest.until_quiet(lambda: left.pop(0)) == 3 and ingest.until_quiet(lambda: 1, 5) == 5
    done = spark.createDataFrame([(1, 5), (2, 5)], "doc int, n int")
    now = spark.createDataFrame([(1, 5), (2, 6), (3, 1)], "doc int, n int")
    assert sorted(r.doc for r in ingest.stale(done, now, "doc", "n").collect()) == [2, 3]
    assert [r.doc for r in ingest.unfinished(now, done, "doc").collect()] == [3]


def test_levels_and_twins(spark):
    from factloom.operators import filing

    levels = lambda *x: one(spark, evidence.least_level(F.array(*[F.lit(v) for v in x])))
    assert [levels("high", "none"), levels("none", "none"), levels("medium", "low", "none")] == ["high", "none", "low"]
    schema = "part string, pos int, min double, typ double, max double"
    left = spark.createDataFrame([("a", 1, 1.0, None, 2.0), ("a", 2, None, 1.0, 2.0), ("b", 1, 1.0, None, None), ("c", 1, None, None, None)], schema)
    right = spark.createDataFrame([("a", 1, 1.0, None, 2.0), ("b", 1, 5.0, None, None), ("c", 1, 1.0, None, None), ("a", 2, None, None, None)], schema)
    got = sorted(tuple(r) for r in filing.nearest_twin(left, right, ["part"]).collect())
    assert got == [("a", 2, 1, "column_shift"), ("b", 1, 1, "readers_disagree")]
