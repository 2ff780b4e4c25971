"""Tokens of a full-text index, and ranked search by blocks."""

from pyspark.sql import functions as F

from factloom.operators import search


def test_tokens_lose_marks(spark):
    said = ["Café CAFÉ cafe", "Ångström İstanbul Łódź naïve", "V_IN 3.3V a-b", "ẹ̀kọ́ Việt Nam", "Straße ﬁ Ω", "Ελληνικά ά", "가나 ñ", "", None]
    got = [r.t for r in spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").select("i", search.tokens(F.col("s")).alias("t")).orderBy("i").collect()]
    assert got == [
        ["cafe", "cafe", "cafe"], ["angstrom", "istanbul", "łodz", "naive"], ["v", "in", "3", "3v", "a", "b"], ["eko", "viet", "nam"], ["straße", "ﬁ", "ω"], ["ελληνικα", "α"], ["가나", "n"], [], None,
    ]


def test_the_best_equal_the_full_ranking_with_fewer_postings_read(spark):
    import random

    from factloom.operators import ranked

    rnd = random.Random(8)
    words = [f"w{k}" for k in range(60)]
    texts = [(i, " ".join(rnd.choices(words, weights=[1 / (k + 1) for k in range(60)], k=rnd.randrange(3, 200)))) for i in range(3000)] + [(9000, None), (9001, "")]
    docs = spark.createDataFrame(texts, "doc int, text string")
    index = ranked.RankedIndex.build(docs, "doc")
    full = search.bm25(search.postings(docs, "doc"), "doc", ["w40", "w7"])
    want = [(r.doc, round(r["rank"], 9)) for r in full.orderBy(F.desc("rank"), "doc").limit(10).collect()]
    assert [(r.doc, round(r["rank"], 9)) for r in index.top(["w40", "w7"], 10).collect()] == want
    every = sum((t or "").split().count(w) > 0 for _, t in texts for w in ("w40", "w7"))
    assert 0 < index.read < every * 0.8, (index.read, every)
    assert index.top(["nowhere"], 10).count() == 0 and index.read == 0
    # all of them, where as many are wanted
    assert index.top(["w40"], 10_000).count() == sum("w40" in (t or "").split() for _, t in texts)


def test_an_index_is_cut_by_the_size_of_its_table(spark, tmp_path, monkeypatch):
    from factloom.sources.database import shared_folder

    path = f"{tmp_path}/docs"
    spark.createDataFrame([(i, f"w{i % 7} of the " * 20) for i in range(600)], "doc int, text string").coalesce(2).write.parquet(path)
    size = sum(f.stat().st_size for f in tmp_path.glob("docs/*.parquet"))
    monkeypatch.setattr(search, "TASK_BYTES", -(-size // 9), raising=False)
    index = search.stored_index(spark, path, "doc")
    assert index.filter("term = 'of'").count() == 600 * 20
    assert shared_folder(spark) in index.inputFiles()[0] and len(index.inputFiles()) == 9


def test_a_ranked_index_moves_texts_and_no_postings(spark, tmp_path, monkeypatch):
    from factloom.operators import ranked

    monkeypatch.setattr(ranked, "TOKENS", 1000, raising=False)
    docs = spark.createDataFrame([(i, f"w{i % 7} of the " * 20) for i in range(600)], "doc int, text string")
    ranked.RankedIndex.build(docs, "doc", path=f"{tmp_path}/index")
    stored = spark.read.parquet(f"{tmp_path}/index/blocks")
    # a block lies in one file, as its texts were dealt by it, and tasks are as many as the tokens need
    files = stored.select("block", F.input_file_name().alias("f")).distinct()
    assert files.groupBy("block").count().filter("count > 1").count() == 0
    assert files.select("f").distinct().count() > 4
    assert stored.agg(F.sum("docs")).first()[0] == 600 * 3
