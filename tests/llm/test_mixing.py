"""Calibration of whole tables against a brute-force rake."""

import collections

import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import lit

import __spark_entry__
from factloom.llm import mixing
from tests.llm.cases import DOCS, TEXTS, docs
from tests.llm.test_pipeline import many


def kind(text):
    n, lines, words, sentence = len(text), text.count("\n") + 1, text.count(" ") + 1, text.count(".") + 1
    if not n:
        return "none"
    tests = [("table", text.count("|") / n >= mixing.BARS), ("list", lines >= 5 and n / lines < mixing.LIST_LINE), ("short", words < mixing.FEW_WORDS)]
    tests += [("terse", words / sentence < mixing.TERSE), ("wordy", words / sentence >= mixing.WORDY)]
    return next((k for k, yes in tests if yes), "plain")


def tempered(have):
    total, raised = sum(have.values()), sum(v**mixing.TEMPER for v in have.values())
    out = {k: min(v**mixing.TEMPER / raised, mixing.LIFT * v / total) for k, v in have.items()}
    return {k: v / sum(out.values()) for k, v in out.items()}


def brute(rows, rounds=300):
    """{(source, lang, topic): (tokens, weight)} of rows (source, lang, text) by plain raking."""
    have = collections.Counter()
    for source, lang, text in rows:
        have[source, lang, kind(text or "")] += (text or "").count(" ") + 1
    total = sum(have.values())
    weight = {k: v / total for k, v in have.items()}

    def side(w, i):
        out = collections.Counter()
        for k, v in w.items():
            out[k[i]] += v
        return out

    want = [tempered(side(have, i)) for i in range(3)]
    for _ in range(rounds):
        for i in range(3):
            now = side(weight, i)
            weight = {k: v * want[i][k[i]] / now[k[i]] for k, v in weight.items()}
    return {k: (have[k], weight[k]) for k in have}


def test_op5_is_registered_over_all_documents(spark, tmp_path):
    d = spark.createDataFrame(many(), DOCS).cache()
    d.write.parquet(f"{tmp_path}/documents.parquet")
    name = next(k for k in __spark_entry__.queries() if k.startswith("op5_"))
    got = __spark_entry__.queries()[name](spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in d.collect())
    want = brute([(r.source, r.lang, r.text) for r in d.collect()])
    for r in got:
        tokens, weight = want[r.source, r.lang, r.topic]
        assert r.weight == pytest.approx(weight * r.tokens / tokens, rel=1e-3) and 0 < r.probability <= 1 and r.gap < mixing.CLOSE
    assert sum(r.weight for r in got) == pytest.approx(1)
    assert {r.doc_id for r in got if r.drawn} == {r.doc_id for r in mixing.sample_to_targets(d).collect()}


def test_op5_takes_every_kind_of_row(spark):
    got = mixing.calibrate_documents(docs(spark)).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in TEXTS)
    assert mixing.calibrate_documents(docs(spark, [])).count() == 0
    clash = docs(spark).withColumns({c: lit(c) for c in ("_source", "_lang", "_topic", "_tokens", "_chance", "_row", "_ratio", "tokens", "weight")})
    kept = mixing.sample_to_targets(clash)
    assert kept.columns == clash.columns
    assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in clash.collect()}
    assert {r.topic for r in mixing.calibrate_documents(clash, topics=F.col("shard")).collect()} == {"1"}


def test_shares_of_the_draw_meet_the_targets(spark):
    """Small cells too: what is drawn is expected to hold every source's target share."""
    d = spark.createDataFrame(many(3000), DOCS)
    got = mixing.calibrate_documents(d).collect()
    expected, weight = collections.Counter(), collections.Counter()
    for r in got:
        expected[r.source] += r.tokens * r.probability
        weight[r.source] += r.weight
    whole = sum(expected.values())
    for k, v in expected.items():
        assert v / whole == pytest.approx(weight[k], rel=1e-6)


def linked(spark):
    """Cells whose source and language go together, so that 10 rounds of raking leave a share 2e-5 off."""
    rows = [(f"s{i}", f"l{j}", "prose", 1.0 + 3 * (j == i % 4) * (1 + i % 7)) for i in range(8) for j in range(4)]
    cells = spark.createDataFrame(rows, "_source string, _lang string, _topic string, tokens double").coalesce(1)
    return mixing.targets(cells).cache()


def off_target(rows):
    """The largest distance between a share and its target, added up from the rows."""
    off = collections.Counter()
    for r in rows:
        for d in mixing.DIMENSIONS:
            off[d, r[d], r[f"_to{d}"]] += r.weight
    return max(abs(x - to) for (_, _, to), x in off.items())


@pytest.mark.parametrize("alone", [True, False])
def test_both_ways_of_raking_meet_one_tolerance(spark, alone):
    rows = mixing.rake(linked(spark), alone).collect()
    assert off_target(rows) < mixing.CLOSE
    assert len({r.gap for r in rows}) == 1 and rows[0].gap == pytest.approx(off_target(rows), abs=1e-12)


@pytest.mark.parametrize("alone", [True, False])
def test_raking_reports_what_it_misses(spark, alone, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_ROUNDS", 5)
    with pytest.warns(UserWarning, match="off its target"):
        rows = mixing.rake(linked(spark), alone).collect()
    assert len({r.gap for r in rows}) == 1 and rows[0].gap == pytest.approx(off_target(rows)) and rows[0].gap > mixing.CLOSE
