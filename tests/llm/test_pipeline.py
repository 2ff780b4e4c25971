import collections
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from factloom.llm import mixing
from tests.llm.brute import components
from tests.llm.cases import TEXTS, docs


def many(n=600):
    rng = random.Random(9)
    out = []
    for i in range(n):
        src = rng.choices(["src0", "a", "b", None], [60, 20, 15, 5])[0]
        lang = rng.choices(["en", "de", "fr"], [70, 20, 10])[0]
        text = " ".join("w%d" % rng.randrange(500) for _ in range(rng.randrange(1, 60))) + rng.choice(["", "", " a | b", " x@y"])
        out.append((i, text, lang, src, len(text), 1, 2, "x"))
    return out


@pytest.mark.parametrize("alone", [True, False])
def test_raking_matches_numpy(spark, alone):
    from tests.llm.cases import DOCS

    d = spark.createDataFrame(many(), DOCS)
    cells = mixing.targets(mixing.celled(d).groupBy(*mixing.DIMENSIONS).agg({"_tokens": "sum"}).withColumnRenamed("sum(_tokens)", "tokens"))
    if not alone:
        mixing.MOST_ROUNDS, kept = 20, mixing.MOST_ROUNDS
    got = {tuple(r[x] for x in mixing.DIMENSIONS): (r.tokens, r.weight) for r in mixing.rake(cells.cache(), alone).collect()}
    if not alone:
        mixing.MOST_ROUNDS = kept
    names = [sorted({k[i] for k in got}) for i in range(3)]
    w = np.zeros([len(x) for x in names])
    for k, (t, _) in got.items():
        w[tuple(n.index(v) for n, v in zip(names, k))] = t
    total = w.sum()
    sides = [w.sum(axis=tuple(j for j in range(3) if j != i)) for i in range(3)]
    want = [np.minimum((s**mixing.TEMPER) / (s**mixing.TEMPER).sum(), mixing.LIFT * s / s.sum()) for s in sides]
    want = [s / s.sum() for s in want]
    w /= total
    for _ in range(300):
        for i in range(3):
            side = w.sum(axis=tuple(j for j in range(3) if j != i))
            w *= (want[i] / side).reshape([-1 if j == i else 1 for j in range(3)])
    for k, (_, x) in got.items():
        assert x == pytest.approx(w[tuple(n.index(v) for n, v in zip(names, k))], abs=1e-4 if alone else 3e-3)


def test_sample_meets_targets_and_repeats(spark):
    from tests.llm.cases import DOCS

    d = spark.createDataFrame(many(4000), DOCS)
    wanted = {"source": {"src0": 1, "a": 1, "b": 1}, "lang": {"en": 2, "de": 1, "fr": 1}}
    a = mixing.sample_to_targets(d, wanted)
    assert a.columns == d.columns
    got = a.collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in mixing.sample_to_targets(d.repartition(3), wanted).collect()}
    tokens = collections.Counter()
    for r in got:
        tokens[r.source] += len(r.text.split(" "))
    share = {k: v / sum(tokens.values()) for k, v in tokens.items()}
    assert set(share) == {"src0", "a", "b"} and all(abs(v - 1 / 3) < 0.06 for v in share.values())
    assert mixing.sample_to_targets(docs(spark, [])).count() == 0 and 0 < mixing.sample_to_targets(docs(spark)).count() <= len(TEXTS)


def test_stages_take_effect(spark):
    rng = random.Random(2)
    words = ["the", "and", "ation", "under", "shen", "ing", "ofer"]
    base = [(i, " ".join(rng.choices(words, k=3)) + " " + " ".join(f"{rng.choice(words)}{rng.choice(words)}{rng.choice(words)}" for _ in range(60))) for i in range(60)]
    near = [(1000 + i, t + " tail") for i, t in base[:10]]
    same = [(2000 + i, t.replace(" ", "  ")) for i, t in base[:20]]
    rows = base + near + same + [(3000, None), (3001, "12 34"), (3002, "")]
    d = spark.createDataFrame([(i, t, "en", "src0", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").cache()
    kept = [r.doc_id for r in corpus_pipeline.identify_language(spark, d, "").collect()]
    assert sorted(kept) == sorted(i for i, t in rows if t and re.search("[a-z]", t))
    d = d.filter("doc_id < 3000").cache()
    one = corpus_pipeline.dedup_exact(spark, d, "")
    assert sorted(r.doc_id for r in one.collect()) == sorted(i for i, _ in base + near)
    two = corpus_pipeline.dedup_near(spark, one, "")
    assert sorted(r.doc_id for r in two.collect()) == sorted({c for _, _, c in components(base + near)})
    for frame in (one, two, corpus_pipeline.mix_sources(spark, two, "")):
        assert tuple(frame.columns) == corpus_pipeline.COLUMNS
    assert corpus_pipeline.pack(spark, two, "").count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language id", "exact dedup", "near dedup", "mixing", "packing"]
