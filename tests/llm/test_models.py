import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import langid, trie_lm
from tests.llm.cases import TEXTS, docs


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=400))
def test_elias_fano_round_trip(values):
    values = np.sort(np.array(values, np.int64))
    ef = trie_lm.EliasFano.encode(values)
    assert (trie_lm.EliasFano.access(ef, np.arange(len(values))) == values).all()


def words(text):
    return (text or "").encode().lower().split() + [None]


def texts(n=300):
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(40)]
    return TEXTS + [(1000 + i, " ".join(rng.choices(pool, weights=range(1, 41), k=rng.randrange(30)))) for i in range(n)]


def brute(rows, order, least, d=trie_lm.DISCOUNT):
    train = [words(t) for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    c = [Counter(tuple(w[i : i + k]) for w in train for i in range(len(w) - k + 1)) for k in range(1, order + 1)]
    follow = [Counter() for _ in c]
    for k in range(1, order):
        for g, n in c[k].items():
            follow[k][g[:-1]] += n
    n, v = sum(c[0].values()), len(c[0])
    kept = [{g: x for g, x in t.items() if k == 0 or x >= least} for k, t in enumerate(c)]
    mass = [Counter() for _ in c]
    for k in range(1, order):
        for g, x in kept[k].items():
            mass[k][g[:-1]] += (x - d) / follow[k][g[:-1]]

    def p(context, w):
        if not context:
            return (c[0][(w,)] + 1) / (n + v + 1)
        k = len(context)
        low = p(context[1:], w)
        if context not in kept[k - 1]:
            return low
        x = kept[k].get((*context, w))
        return ((x - d) / follow[k][context] if x else 0) + (1 - mass[k][context]) * low

    out = []
    for i, t in rows:
        w = words(t)
        base = sum(math.log10((c[0][(x,)] + 1) / (n + v + 1)) for x in w)
        full = sum(math.log10(p(tuple(w[max(0, j - order + 1) : j]), x)) for j, x in enumerate(w))
        out.append((i, zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, len(w), sum(c[0][(x,)] > 0 for x in w), n, base, full))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_match_brute_force(spark, order):
    rows = texts()
    got = [tuple(r) for r in trie_lm.score_documents(docs(spark, rows), order).collect()]
    want = brute(rows, order, trie_lm.LEAST)
    by = lambda r: (str(r[0]), r[2], r[5])
    for a, b in zip(sorted(got, key=by), sorted(want, key=by), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], abs=1e-3 + 2e-4 * b[2])


def test_lm_edge_tables(spark):
    assert trie_lm.score_documents(docs(spark, [])).count() == 0
    only = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = trie_lm.score_documents(docs(spark, [(only, "nothing learned")])).collect()[0]
    assert (r.n_known, r.train_tokens, r.base_score, r.score) == (0, 0, 0, 0)


def test_gradients_match_differences():
    net = langid.Network(["a", "b", "c"], hidden=4)
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 101, (5, 6)), rng.integers(0, 3, 6)
    for o, k in net._parts():
        setattr(o, k, getattr(o, k).astype(np.float64))
    grads, _ = net.gradients(x, y)
    for (o, k), g in zip(net._parts(), grads):
        w = getattr(o, k)
        for at in [(97, 3), (98, 9)] if k == "table" else [tuple(rng.integers(0, s) for s in w.shape) for _ in range(3)]:
            old, side = w[at], []
            for e in (1e-3, -1e-3):
                w[at] = old + e
                side.append(net.gradients(x, y)[1])
            w[at] = old
            assert g[at] == pytest.approx((side[0] - side[1]) / 2e-3, abs=2e-4)


def test_language_accuracy_and_edges(spark):
    rng = random.Random(1)
    parts = {"en": ["the", "ing", "tion", "and", "sh"], "de": ["sch", "ung", "und", "ein", "ü"], "es": ["ción", "ado", "los", "ñ", "que"]}
    rows = [(i, " ".join("".join(rng.choices(parts[k], k=rng.randrange(1, 4))) for _ in range(30)), k) for i, k in enumerate(rng.choices(list(parts), k=400))]
    odd = [(9001, None, "en"), (9002, "", None), (9003, "123 !!! ²½", "de"), (9004, "x" * 50_000, None), (None, "schungein und einung", "de"), (9001, None, "en")]
    d = spark.createDataFrame([(i, t, k, "s", 1, 0.5) for i, t, k in rows + odd], "doc_id long, text string, lang string, source string, n_chars long, score double")
    got = langid.identify(d).collect()
    assert len(got) == len(rows) + len(odd)
    want = {i: k for i, _, k in rows}
    test = [r for r in got if r.held_out and r.doc_id in want]
    assert len(test) > 40 and sum(r.lang_pred == want[r.doc_id] for r in test) / len(test) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.lang_pred == "und" for r in got if r.doc_id in (9001, 9002, 9003)) and not any(r.lang_pred == "und" for r in got if r.doc_id == 9004)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert langid.keep_identified(d).columns == d.columns
    assert langid.identify(d.limit(0)).count() == 0 and langid.identify(d.filter("lang is null")).filter("lang_pred != 'und'").count() == 0


def test_pooling_equals_a_loop_over_whole_texts():
    """Chunks with bytes around them against both networks over each text's bytes from end to end."""
    net = langid.Network(["a", "b", "c"], seed=3)
    rng = random.Random(2)
    texts = ["", None, "123 !?", "a", "Zwölf Boxkämpfer jagen Viktor quer über den Sylter Deich. " * 40, "x" * 256, "ñ" * 200, *["".join(rng.choices("abc de,.\n1é", k=n)) for n in (5, 255, 256, 257, 1000, 3000)]]
    got = langid.Labeller(net)(pa.array(texts, pa.string()))
    for t, row in zip(texts, got):
        codes = langid.raw(t)
        want = np.zeros(3)
        if len(codes):
            space = np.full(langid.WARM, 32, np.uint8)
            p = net.positions(np.concatenate([space, codes, space])[:, None])[langid.WARM : -langid.WARM, 0]
            want = p[langid._LETTER[codes]].mean(0)
        assert np.allclose(row, want, atol=2e-3), t
    assert np.allclose(langid.Labeller(net)(pa.array(texts[::-1] + ["other " * 999], pa.string()))[:-1][::-1], got, atol=1e-6)


def test_very_long_text_is_read_by_parts(monkeypatch):
    net = langid.Network(["a", "b"])
    text = pa.array(["one two three. " * 2000], pa.string())
    whole = langid.Labeller(net)(text)
    monkeypatch.setattr(langid, "LANES", 5)
    assert np.allclose(langid.Labeller(net)(text), whole, atol=1e-6)
