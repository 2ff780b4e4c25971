"""The data source of exports."""

import zipfile

from factloom.sources import exports

KEY, MARK = exports.KEY_HEADER, exports.MARKER


def book(path, rows):
    cells = lambda r, n: "".join(f'<c r="{chr(65 + i)}{n}" t="inlineStr"><is><t>{v}</t></is></c>' for i, v in enumerate(r))
    body = "".join(f'<row r="{n}">{cells(r, n)}</row>' for n, r in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="x"><sheetData>{body}</sheetData></worksheet>')


def folder(tmp_path):
    at = tmp_path / "in"
    at.mkdir()
    (at / "a.csv").write_text(f'{MARK},Bucks\nFile generated on,2026-02-03\n{KEY}, Vin ,,"I, out"\nlm-1 (2),5,x,"1,5"\nTPS 2,7\nlm1, 6 ,y,2\n,9\n', encoding="utf-8")
    (at / "b.csv").write_text(f"{KEY},Vin\nno,marker\n", encoding="utf-8")
    (at / "c.csv").write_text(f"{MARK}\n{KEY},Vin\nzz1,1\n", encoding="utf-8")
    (at / "d.csv").write_text(f"{MARK},Copy\n{KEY},Vin\nold1,0\n", encoding="utf-8")
    book(at / "d.xlsx", [[MARK, "Boosts"], [KEY, "Vin", "Pins"], ["new1", "3", "8"]])
    (at / "e.xlsx").write_bytes(b"no workbook")
    (at / "f.csv").write_bytes(b"\xff\xfe\x00")
    (at / "g.csv").write_text("\n" * 50 + f"{MARK}\n{KEY},Vin\nlate,1\n", encoding="utf-8")
    return str(at)


def test_cells_of_known_exports(spark, tmp_path):
    rows = exports.read_exports(spark, folder(tmp_path))
    got = {(r.file, r.category, r.date, r.part, r.header): r.value for r in rows.collect()}
    assert got == {
        ("a.csv", "Bucks", "2026-02-03", "LM1", KEY): "lm1", ("a.csv", "Bucks", "2026-02-03", "LM1", "Vin"): "6", ("a.csv", "Bucks", "2026-02-03", "LM1", "I, out"): "2",
        ("a.csv", "Bucks", "2026-02-03", "TPS2", KEY): "TPS 2", ("a.csv", "Bucks", "2026-02-03", "TPS2", "Vin"): "7", ("a.csv", "Bucks", "2026-02-03", "TPS2", "I, out"): "",
        ("c.csv", "c", "", "ZZ1", KEY): "zz1", ("c.csv", "c", "", "ZZ1", "Vin"): "1",
        ("d.xlsx", "Boosts", "", "NEW1", KEY): "new1", ("d.xlsx", "Boosts", "", "NEW1", "Vin"): "3", ("d.xlsx", "Boosts", "", "NEW1", "Pins"): "8",
    }


def test_a_partition_for_each_file_and_filters_reach_it(spark, tmp_path):
    rows = exports.read_exports(spark, folder(tmp_path))
    assert rows.rdd.getNumPartitions() == 7
    some = rows.filter("file = 'd.xlsx' and header = 'Pins'")
    assert some.rdd.getNumPartitions() == 1 and [r.value for r in some.collect()] == ["8"]
    assert rows.filter("part in ('LM1', 'NEW1') and header = 'Vin' and value > '3'").count() == 1
    assert rows.filter("part = 'nothing'").count() == 0


def test_columns_by_detection(spark, tmp_path):
    wide = exports.read_exports(spark, folder(tmp_path), wide="true")
    assert wide.columns == ["file", "category", "date", "part", KEY, "Vin", "I, out", "Pins"]
    got = {r.part: (r.Vin, r["I, out"], r.Pins) for r in wide.collect()}
    assert got == {"LM1": ("6", "2", None), "TPS2": ("7", "", None), "ZZ1": ("1", None, None), "NEW1": ("3", None, "8")}
    assert exports.read_exports(spark, str(tmp_path / "none")).count() == 0


def test_overrides(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"_note": [1], "LM-1": {"Vin": 36, "why": "title says so", "checked": "2026"}, "X": {"Vin": "text"}}')
    over = exports.read_overrides(spark, str(tmp_path / "o.json"))
    assert [tuple(r) for r in over.collect()] == [("LM1", "Vin", 36.0, "title says so", "2026")]
    values = spark.createDataFrame([("LM1", "Vin", 30.0), ("LM1", "Iout", 4.0)], "part string, field string, value double")
    got = sorted(tuple(r)[:4] for r in exports.with_overrides(values, over).collect())
    assert got == [("LM1", "Iout", 4.0, False), ("LM1", "Vin", 36.0, True)]
    assert exports.read_overrides(spark, str(tmp_path / "gone.json")).count() == 0
    (tmp_path / "bad.json").write_text("{")
    assert exports.read_overrides(spark, str(tmp_path / "bad.json")).count() == 0
