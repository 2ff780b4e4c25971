import random

from pyspark.sql.functions import lit

from factloom.llm import shingle_join
from tests.llm.brute import components, shingle_set
from tests.llm.cases import TEXTS, docs


def key(x):
    return tuple(str(v) for v in x)


def check(spark, texts):
    got = [tuple(r) for r in shingle_join.link_components(docs(spark, texts)).collect()]
    assert sorted(got, key=key) == sorted(components(texts), key=key)


def families(seed, n=120, words=60):
    """Documents with copies changed by more and more words, shared passages and chains of links."""
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choices(pool, k=40))
    out, k = [], 0
    for _ in range(n // 6):
        base = rng.choices(pool, k=rng.choice([3, 8, words, 3 * words]))
        out.append((k := k + 1, " ".join(base)))
        last = list(base)
        for _ in range(rng.randrange(6)):
            last = list(last)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                last[rng.randrange(len(last))] = rng.choice(pool)
            out.append((k := k + 1, " ".join(last)))
    out += [((k := k + 1), passage + " " + " ".join(rng.choices(pool, k=rng.choice([2, 8, 12, 40])))) for _ in range(30)]
    rng.shuffle(out)
    return out


def test_sets_have_every_shingle():
    for _, t in TEXTS + families(3):
        assert len(shingle_join.shingles(t)) == len(shingle_set(t))


def test_matches_brute_force(spark):
    check(spark, TEXTS + families(1))


def test_large_groups_and_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "CHUNK", 4)
    monkeypatch.setattr(shingle_join, "ROUNDS", 1)
    monkeypatch.setattr(shingle_join, "FLUSH", 500)
    check(spark, families(2, 150))


def no_star(table):
    import pyarrow as pa

    return pa.table({"round": pa.array([], pa.int32())} | {c: pa.array([], pa.int64()) for c in ("head", "a", "b", "links")})


def test_only_the_matrix_finds_links(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "_star", no_star)
    check(spark, families(4))


def around(seed, copies, changes, words=200):
    """Copies of one text, each with words changed by one position or more apart, near the bound on both sides."""
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(5000)]
    base = rng.choices(pool, k=words)
    out = [(0, " ".join(base))]
    for k in range(1, copies):
        own = list(base)
        for at in rng.sample(range(words), rng.choice(changes)):
            own[at] = rng.choice(pool)
        out.append((k, " ".join(own[: words - rng.randrange(4)])))
    return out


def test_copies_near_the_bound(spark, monkeypatch):
    check(spark, around(6, 150, [1, 3, 5, 6, 7, 8, 9]))
    monkeypatch.setattr(shingle_join, "_star", no_star)
    monkeypatch.setattr(shingle_join, "CHUNK", 8)
    monkeypatch.setattr(shingle_join, "BUCKET", 3000)
    monkeypatch.setattr(shingle_join, "BLOCK", 100)
    monkeypatch.setattr(shingle_join, "PART", 20)
    check(spark, around(7, 120, [1, 4, 6, 7, 8]) + [(1000 + i, t) for i, t in around(7, 60, [5, 6, 7])] + [(2000 + i, t) for i, t in families(8)])


def test_overlap_matrix(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in [0, 1, 5, 90, 200, 400, 3]]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets[1:]] for a in sets])
    for dense, columns in ((1024, 2048), (1, 7), (8, 3)):
        monkeypatch.setattr(shingle_join, "DENSE", dense)
        monkeypatch.setattr(shingle_join, "COLUMNS", columns)
        assert (shingle_join._overlap(sets, sets[1:]) == want).all()


def test_ranges_hold_another_group():
    import numpy as np

    rng = np.random.default_rng(5)
    n = 60
    group, value, least, lo = (rng.integers(0, k, n) for k in (4, 9, 10, n))
    hi = np.minimum(n, lo + rng.integers(0, 20, n))
    want = [any(group[j] != group[i] and value[j] >= least[i] for j in range(lo[i], hi[i])) for i in range(n)]
    assert shingle_join._exists(lo, hi, group, value, least).tolist() == want


def test_slices_of_long_texts(monkeypatch):
    text = " ".join(f"w{i % 97}x{i % 13}" for i in range(1000))
    whole = shingle_join.shingles(text)
    monkeypatch.setattr(shingle_join, "SLICE", 64)
    assert (shingle_join.shingles(text) == whole).all()


def test_one_row_of_a_component_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (2, text + " tail"), (2, "quite another text of seven words"), (3, text), (1, text), (4, None), (5, ""), (5, "")]
    got = sorted((r.doc_id, r.text) for r in shingle_join.keep_representatives(docs(spark, rows)).select("doc_id", "text").na.fill("-").collect())
    assert got == [(1, text), (2, "quite another text of seven words"), (4, "-"), (5, ""), (5, "")]
    clash = docs(spark, TEXTS + rows).withColumns({c: lit(1) for c in ("_keep", "_sha", "_of", "_at", "node", "id", "label", "rows")})
    assert shingle_join.keep_representatives(clash).columns == clash.columns
    assert shingle_join.keep_representatives(clash).count() == shingle_join.keep_representatives(docs(spark, TEXTS + rows)).count()


def test_empty_and_unlinked(spark):
    assert shingle_join.link_components(docs(spark, [])).count() == 0
    check(spark, [(1, "a b c"), (2, None), (3, "")])
    assert shingle_join.keep_representatives(docs(spark, families(5))).columns == docs(spark, []).columns
