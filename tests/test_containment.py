"""Passages in texts against a plain search, by literals and by joins."""

import random

import pytest

from factloom.operators import containment


@pytest.mark.parametrize("few", [0, 5_000])
def test_passages_equal_a_search(spark, monkeypatch, few):
    monkeypatch.setattr(containment, "FEW", few)
    rnd = random.Random(4)
    words = ["a", "bb", "ccc", "the", "of", "long-winded", "x1"]
    texts = [(i, " ".join(rnd.choices(words, k=rnd.randrange(0, 40)))) for i in range(60)] + [(100, None), (101, ""), (102, "A  BB\n\nccc THE of x1"), (103, "unbrokenrunofcharacters" * 3), (104, "'quote' of \\ the")]
    heads = [(i, " ".join(rnd.choices(words, k=rnd.randrange(1, 6)))) for i in range(40)] + [(50, "nbrokenrun"), (51, "kenrunofch"), (52, None), (53, "a bb"), (54, "zz a bb ccc zz"), (55, "b ccc the o"), (56, "quote' of \\ th"), (57, "ccc the o")]
    docs = spark.createDataFrame(texts, "doc int, text string")
    got = {(r.item, r.doc) for r in containment.passages_found(docs, spark.createDataFrame(heads, "item int, head string")).collect()}
    plain = lambda t: " ".join(t.lower().split())
    assert got == {(i, d) for i, h in heads for d, t in texts if h is not None and t is not None and h in plain(t)}


@pytest.mark.parametrize("few", [0, 5_000])
def test_nothing_and_empty_passages(spark, monkeypatch, few):
    monkeypatch.setattr(containment, "FEW", few)
    docs = spark.createDataFrame([(1, "one"), (2, None), (3, "")], "doc int, text string")
    none = spark.createDataFrame([], "item int, head string")
    assert containment.passages_found(docs, none).count() == 0
    empty = spark.createDataFrame([(7, "")], "item int, head string")
    assert containment.passages_found(docs, empty).count() == 0
    assert containment.passages_found(docs.limit(0), spark.createDataFrame([(7, "one")], "item int, head string")).count() == 0
