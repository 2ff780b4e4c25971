"""Matching of awkward names, items and rows against brute force."""

from factloom.operators import matching, records
from factloom.plans import registry


def test_items_of_short_and_long_words(spark, tmp_path):
    items = ["internationalisation counterrevolutionaries incomprehensibilities and more", "alpha beta gamma", "two words", "one", "the quick brown fox jumps over the lazy dog tonight", None]
    texts = ["say: " + items[0] + " end", "alpha beta gamma", "pretwo  wordspost", "none", "THE QUICK brown\nfox jumps over the lazy dog tonight", "alpha beta", None, ""]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plain = lambda t: " ".join(t.lower().split())
    want = {}
    for i, t in enumerate(items):
        hits = [k for k, x in enumerate(texts) if t and x and plain(t)[:40] in plain(x)]
        if hits:
            want[i] = (len(hits), min(hits))
    got = registry.QUERIES["contamination_find"](spark, str(tmp_path)).collect()
    assert {r.item_id: (r.n_docs, r.first_doc) for r in got} == want


def test_prefixes_of_many_lengths(spark):
    long = "x" * 3000
    prefixes = spark.createDataFrame([(long[:n], f"o{n}") for n in range(1, 2500, 2)] + [("", "any")], "prefix string, owner string")
    names = spark.createDataFrame([(1, long), (2, "xxxx"), (3, "y"), (4, None), (5, "")], "k int, name string")
    got = {r.k: r.owner for r in matching.longest_prefix(names, "name", "k", prefixes).collect()}
    assert got == {1: "o2499", 2: "o3", 3: "any", 5: "any"}


def test_an_absent_reading_gives_nothing(spark):
    rows = spark.createDataFrame([(1, "V", None, None)], "seq int, symbol string, parameter string, section string").selectExpr("seq", "symbol", "parameter", "'x' as section", "'1' as min", "null as typ", "null as max", "'V' as unit", "1 as page", "1 as doc")
    assert records.section_range(rows, ["doc"], "V", "nothing", "recommended").count() == 0


def test_many_prefixes_meet_by_a_join(spark, monkeypatch):
    names = spark.createDataFrame([(i, n) for i, n in enumerate(["Brand#12", "Brand#1", "Brand", "Bra", "", None, "Brand#25x"])], "k int, name string")
    prefixes = spark.createDataFrame([("Brand#1", "a"), ("Brand#12", "b"), ("Brand", "c"), ("Brand#25", "d")], "prefix string, owner string")
    few = {r.k: r.owner for r in matching.longest_prefix(names, "name", "k", prefixes).collect()}
    monkeypatch.setattr(matching, "FEW_PREFIXES", 1)
    assert few == {r.k: r.owner for r in matching.longest_prefix(names, "name", "k", prefixes).collect()} == {0: "b", 1: "a", 2: "c", 6: "d"}
    assert matching.longest_prefix(names, "name", "k", prefixes.limit(0)).count() == 0
