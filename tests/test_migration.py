"""Fates of files on a small tree."""

from factloom.operators import migration


def fates(spark, docs, notes=(), others=()):
    made = migration.plan(
        spark.createDataFrame(list(docs), "path string, sha string"), spark.createDataFrame(list(notes), "path string, links array<string>"), spark.createDataFrame([(x,) for x in others], "path string"),
    ).collect()
    assert len(made) == len({r.source for r in made}) == len(docs) + len(notes) + len(others), "each file has one fate"
    return {r.source: (r.action, r.target, r.reason) for r in made}


def test_copies_keep_the_best(spark):
    got = fates(spark, [("a/lm5176 (1).pdf", "x"), ("b/lm5176.pdf", "x"), ("c/lm5176_long.pdf", "x"), ("d/C28646261.pdf", "y"), ("e/tps.pdf", "y"), ("f/none.pdf", None), ("f/none2.pdf", None)], [("n/TPS55287.md", ["C28646261.PDF"])])
    assert got["b/lm5176.pdf"] == ("move", "Library/lm5176/lm5176.pdf", "document")
    assert got["a/lm5176 (1).pdf"][0] == got["c/lm5176_long.pdf"][0] == "delete"
    # a note names the copy whose own name says nothing, so that one stays
    assert got["d/C28646261.pdf"] == ("move", "Library/TPS55287/TPS55287.pdf", "document, renamed from C28646261")
    assert got["e/tps.pdf"] == ("delete", "", "same content as C28646261.pdf")
    assert got["n/TPS55287.md"] == ("merge", "Library/TPS55287/TPS55287.md", "note about one document")
    assert got["f/none.pdf"][0] == got["f/none2.pdf"][0] == "move"


def test_notes(spark):
    docs = [("a/bq24074.pdf", "1"), ("a/lm317.pdf", "2"), ("b/LM317.pdf", "2")]
    notes = [("n/BQ24074.md", ["bq24074.pdf"]), ("n/Chargers.md", ["bq24074.pdf", "lm317.pdf"]), ("n/Component Index.md", ["bq24074.pdf"]), ("n/lm317.md", []), ("n/About.md", ["gone.pdf"]), ("m/about.md", None)]
    got = fates(spark, docs, notes)
    assert got["n/BQ24074.md"][0] == "merge" and got["n/Chargers.md"] == ("topic", "Topics/Chargers.md", "links 2 documents")
    assert got["n/Component Index.md"][:2] == ("archive", "0archive/Component Index.md")
    assert got["n/lm317.md"][0] == "merge" and got["n/lm317.md"][2] == "named like a document"
    # the first of one name by path takes it
    assert got["m/about.md"][0] == "topic" and got["n/About.md"] == ("?", "", "name is taken by Topics/about.md")


def test_clashes_leave_what_depends_on_them(spark):
    docs = [("a/part.pdf", "1"), ("b/Part.pdf", "2"), ("b/Attachments/other.pdf", "3")]
    got = fates(spark, docs, [("n/other.md", ["other.pdf"])], ["x/part.PDF.png", "x/y.png", "z/Y.PNG", "t.csv", "u.txt", "v"])
    assert got["a/part.pdf"][0] == "move" and got["b/Part.pdf"] == ("?", "", "name is taken by Library/part/part.pdf")
    assert got["x/y.png"][0] == "move" and got["z/Y.PNG"][0] == "?" and got["t.csv"][1] == "Parametrics/t.csv" and got["u.txt"][0] == got["v"][0] == "?"
    lost = fates(spark, [("a/one.pdf", "1"), ("b/ONE.pdf", "2")], [("n/x.md", ["b/ONE.pdf"]), ("n/one.md", ["a/one.pdf"])])
    # of two documents of one name a link means the last by path, which the first leaves undecided
    assert {k: v[0] for k, v in lost.items()} == {"a/one.pdf": "move", "b/ONE.pdf": "?", "n/x.md": "topic", "n/one.md": "?"}
    assert lost["n/one.md"][2] == "its document is to be decided"


def test_a_large_group_of_copies_stays_dealt(spark):
    docs = spark.range(20_000).selectExpr("concat('f', id % 50, '/p', id, '.pdf') as path", "if(id % 3 = 0, 'same', cast(id as string)) as sha")
    made = migration.plan(docs, spark.createDataFrame([], "path string, links array<string>"), spark.createDataFrame([], "path string"))
    assert made.filter("action = 'delete'").count() == 6667 - 1 and made.count() == 20_000
    assert "Window" not in made._jdf.queryExecution().executedPlan().toString()
