"""SimHash index against all pairs, nodes cut at every size."""

import random

import numpy as np
import pytest
import xxhash

from factloom.llm import simhash_index as si

from .cases import TEXTS, docs


def plain_print(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(codes, d=4):
    top = list(range(len(codes)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= d:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def families(rnd, n, members):
    codes = []
    for _ in range(n):
        code = rnd.getrandbits(64)
        for _ in range(members):
            codes.append(code)
            for b in rnd.sample(range(64), rnd.randrange(7)):
                code ^= 1 << b
    return codes


def test_fingerprint_of_every_text(monkeypatch):
    for block in (1, 7, 1 << 16):
        monkeypatch.setattr(si, "BLOCK", block)
        for _, text in TEXTS:
            if block > 1 or len(text or "") < 1000:
                assert si.fingerprint(text) == plain_print(text)


def test_gray_rank_inverts_the_code():
    n = np.arange(1 << 12, dtype=np.uint64)
    assert (si.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


@pytest.mark.parametrize("pairs", [3, 1 << 20])
def test_linked_in_nodes(monkeypatch, pairs):
    monkeypatch.setattr(si, "PAIRS", pairs)
    rnd = random.Random(pairs)
    sets = [sorted(set(families(rnd, n, m)), key=lambda c: int(si.gray_rank(np.array([c], np.uint64))[0])) for n, m in [(1, 1), (30, 5), (1, 300), (200, 1), (3, 60)]]
    node = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    top = si.linked(node, np.array([c for s in sets for c in s], np.uint64))
    at = 0
    for s in sets:
        assert [t - at for t in top[at : at + len(s)]] == plain_components(s)
        at += len(s)


@pytest.mark.parametrize("limit", [4, 64, 16_384])
def test_components_of_codes(spark, monkeypatch, limit):
    monkeypatch.setattr(si, "NODE_CODES", limit)
    rnd = random.Random(limit)
    codes = sorted({c - (1 << 64) if c >> 63 else c for c in [*families(rnd, 40, 6), *families(rnd, 1, 60 if limit == 4 else 200), *[0xABC0 ^ k for k in range(32)], 0, 15, 31]})
    got = {r.id: r.group for r in si.code_components(spark.createDataFrame([(c,) for c in codes], "code long")).collect()}
    want = plain_components([c & (1 << 64) - 1 for c in codes])
    assert [got.get(c, c) for c in codes] == [codes[w] for w in want]


def test_documents_of_every_kind(spark):
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    more = []
    for k in range(12):
        text = rnd.choices(words, k=rnd.randrange(3, 400))
        for j in range(4):
            more.append((1000 + 4 * k + j, " ".join(text)))
            text[rnd.randrange(len(text))] = rnd.choice(words)
    table = docs(spark, TEXTS + more)
    got = sorted(tuple(r) for r in si.near_components(table).select("doc_id", "fingerprint", "component_id").collect() if r.doc_id is not None)
    rows = [(d, plain_print(t)) for d, t in TEXTS + more]
    top = plain_components([c for _, c in rows])
    least = {}
    for (d, _), t in zip(rows, top):
        if d is not None:
            least[t] = min(d, least.get(t, d))
    assert got == sorted((d, f"{c:016x}", least[t]) for (d, c), t in zip(rows, top) if d is not None)
    assert si.near_components(docs(spark, [])).count() == 0
