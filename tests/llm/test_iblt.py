import hashlib
import random

import pytest
from pyspark.sql import functions as F

from factloom.llm import iblt
from tests.llm.cases import TEXTS, docs


def key(x):
    return tuple(str(v) for v in x)


@pytest.mark.parametrize("least", [None, 1, 4])
def test_differences_are_exact(spark, least):
    rng = random.Random(4)
    rows = []
    for k in range(60):
        base = [rng.getrandbits(63) - (1 << 62) for _ in range(rng.choice([0, 1, 5, 40, 200]))]
        a, b = set(base), set(base)
        a |= {rng.getrandbits(62) for _ in range(rng.randrange(12))}
        b |= {rng.getrandbits(62) for _ in range(rng.randrange(40))}
        rows.append((k, sorted(a), sorted(b)))
    d = spark.createDataFrame(rows, "who long, x array<long>, y array<long>").repartition(2)
    # sketches that are too small must fail and grow
    sizes = None if least is None else lambda n, m: F.lit(least).cast("long")
    got = {k: set() for k, _, _ in rows}
    for r in iblt.differences(d, sizes).collect():
        assert (r.key, r.n) not in got[r.who]
        got[r.who].add((r.key, r.n))
    for k, a, b in rows:
        assert got[k] == {(x, 1) for x in set(a) - set(b)} | {(x, -1) for x in set(b) - set(a)}


def pieces(text):
    """The set of a text's lines, long ones cut after sentence ends."""
    out = set()
    for line in text.split("\n"):
        while line:
            cut = len(line)
            if cut > iblt.LEAST:
                ends = [k + 1 for k in range(iblt.LEAST, min(len(line), iblt.MOST + 1)) if line[k] == " " and line[k - 1] in ".!?"]
                cut = ends[0] if ends else len(line) if len(line) <= iblt.MOST else iblt.MOST
            out.add(line[:cut])
            line = line[cut:]
    return out


def alike(x, y):
    x, y = pieces(x), pieces(y)
    return len(x & y) / len(x | y) if x | y else 1.0


def brute(rows):
    order = sorted(((i is None, -(i or 0), t or "", i) for i, t in rows))
    out = []
    for k, (_, _, t, i) in enumerate(order):
        nxt = order[(k + 1) % len(order)][2]
        h = len(t) // 2
        e = t[: len(t) - h] + nxt[:h]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), pytest.approx(alike(t, e)), pytest.approx(alike(t, nxt))))
    return sorted(out, key=lambda x: tuple(str(v) for v in x[:3]))


@pytest.mark.parametrize("parts", [1, 3])
def test_fingerprints_and_edits(spark, parts, monkeypatch):
    monkeypatch.setattr(iblt, "PART_ROWS", 1 if parts > 1 else 500)
    monkeypatch.setattr(iblt, "QUANTILES", 8)
    lines = [f"This is line {i} of some text, and a unique one." for i in range(300)]
    more = [(100 + 7 * k, "\n".join(lines[k : k + 12])) for k in range(40)] + [(5000, "\n".join(lines[:12])), (1 << 60, "far away")]
    rows = TEXTS + more
    got = iblt.fingerprint_documents(docs(spark, rows)).collect()
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got], key=lambda x: key(x[:3])) == brute(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert by[100].fingerprint == by[5000].fingerprint and by[100].fingerprint != by[107].fingerprint
    assert by[107].near_next == pytest.approx(11 / 13)
    assert 0.2 < by[107].near_edited < 1


def test_fingerprints_of_few(spark):
    assert iblt.fingerprint_documents(docs(spark, [])).count() == 0
    r = iblt.fingerprint_documents(docs(spark, [(3, "only\none")])).collect()[0]
    assert r.near_next == 1.0
    assert iblt.fingerprint_documents(docs(spark, [(None, "a"), (None, None)])).count() == 2


def test_sketch_holds_what_it_was_given(spark):
    rng = random.Random(8)
    rows = [(k, [rng.getrandbits(62) for _ in range(n)]) for k, n in enumerate([1, 2, 7, 50, 400])]
    d = spark.createDataFrame(rows, "row long, keys array<long>")
    got = {r.row: r.fingerprint for r in iblt.fingerprints(d, ["row"]).collect()}
    for k, keys in rows:
        size, cells = got[k].split("|")
        held = [c.split(":") for c in cells.split(",")]
        assert 2 * len(keys) <= int(size) <= max(iblt.LEAST_SIZE, 4 * len(keys))
        for t in "012":
            xor = 0
            for at, n, x, _ in held:
                xor ^= int(x, 16) if at[0] == t else 0
            for x in keys:
                xor ^= x
            assert xor == 0 and sum(int(n) for at, n, _, _ in held if at[0] == t) == len(keys)


def test_numbers_of_the_whole_table(spark):
    import glob

    d = "/root/testdata/sf0.001"
    if not glob.glob(d):
        pytest.skip("no tables here")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = iblt.fingerprint_documents(spark.read.parquet(f"{d}/documents.parquet")).collect()
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got], key=lambda x: key(x[:3])) == brute(rows)
