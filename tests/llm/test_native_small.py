import collections
import hashlib
import re
import zlib

import pytest

from factloom.llm import exact_dedup, secrets, sharding
from tests.llm.cases import TEXTS, docs


def rows(df):
    return [tuple(r) for r in df.collect()]


def key(x):
    return tuple(str(v) for v in x)


def base_spans(text):
    out = []
    for m in re.finditer(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets_match_brute_force(spark):
    want = []
    for i, t in TEXTS:
        s = base_spans(t or "")
        listed = ",".join(f"{k}:{a}:{b}" for a, _, k, b in s)
        n = collections.Counter(k for _, _, k, _ in s)
        want.append((i, n["assign"], n["access"], n["hex"], hashlib.sha256(listed.encode()).hexdigest(), listed))
    got = rows(secrets.scan_documents(docs(spark)).drop("blob"))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_ledger_scans_only_unseen(spark):
    d = docs(spark)
    first = secrets.scan_unseen(d)
    first.cache()
    assert first.count() == len({t or "" for _, t in TEXTS})
    assert secrets.scan_unseen(d, first).count() == 0
    more = (*secrets.RULES[:2], secrets.Rule("hex", 2, "[0-9a-f]{10,}"))
    again = secrets.scan_unseen(d, first, more)
    assert {tuple(r.checked) for r in again.collect()} == {("hex@2",)}


def listed(df):
    return sorted(((r.doc_id, r.blob, [(s.kind, s.start, s.end) for s in r.spans]) for r in df.collect()), key=key)


def test_only_current_versions_findings_come_back(spark):
    texts = [(1, "password = hunter2222 and cafe1234cafe"), (2, "password = hunter2222 and cafe1234cafe"), (3, "token: abcdefgh")]
    ledger = secrets.Ledger(spark)
    ledger.record(docs(spark, texts))
    assert ledger.rows().count() == 2
    newer = (secrets.Rule("assign", 2, "(password) is ([a-z]+)", 2, 6), secrets.RULES[1], secrets.Rule("hex", 2, "[0-9a-f]{10,}"))
    ledger.record(docs(spark, texts), newer)
    assert ledger.rows().count() == 4
    want = secrets.join_back(docs(spark, texts), secrets.scan_unseen(docs(spark, texts), None, newer), newer)
    got = secrets.join_back(docs(spark, texts), ledger.rows(), newer)
    assert listed(got) == listed(want) and {s.rule for r in got.collect() for s in r.spans} == {"hex@2"}
    # the older book still has its own findings, and a new path of a known blob needs no scan
    more = docs(spark, texts + [(9, texts[0][1])])
    ledger.record(more, newer)
    assert ledger.rows().count() == 4
    old = secrets.join_back(more, secrets.Ledger(spark, ledger.path).rows())
    assert [[s.rule for s in r.spans] for r in old.orderBy("doc_id").collect()] == [["assign@1"]] * 4


def test_versions_of_a_corpus_share_scans(spark):
    """Two runs over one ledger folder: the second scans blobs that are new, findings come back to all paths of both."""
    one = [(1, "token: abcdefgh"), (2, "nothing"), (3, "api_key=zyxwvuts"), (3, "api_key=zyxwvuts")]
    two = [(1, "token: abcdefgh"), (2, "password=qwertyu"), (4, "api_key=zyxwvuts")]
    path = secrets.Ledger(spark).path
    secrets.Ledger(spark, path).commit(docs(spark, one), "a")
    assert secrets.Ledger(spark, path).rows().count() == 3
    again = secrets.Ledger(spark, path)
    assert secrets.scan_unseen(docs(spark, two), again.rows()).count() == 1
    again.commit(docs(spark, two), "b")
    assert again.rows().count() == 4
    again.commit(docs(spark, two), "b")
    got = {(r.version, r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans)) for r in again.history().collect()}
    assert got == {("a", 1, (("assign", 0, 15),)), ("a", 2, ()), ("a", 3, (("assign", 0, 16),)), ("b", 1, (("assign", 0, 15),)), ("b", 2, (("assign", 0, 16),)), ("b", 4, (("assign", 0, 16),))}


def test_a_text_of_many_spans(spark):
    """Places come from one running sum: 100,000 spans in one text."""
    text = " ".join(f"{i:024x}" for i in range(100_000))
    row = secrets.scan_documents(docs(spark, [(1, text)])).first()
    assert row.n_hex == 100_000 and row.spans.endswith(f"hex:{25 * 99_999}:{25 * 99_999 + 24}")


def test_secrets_empty(spark):
    assert secrets.scan_documents(docs(spark, [])).count() == 0


def test_dedup_matches_brute_force(spark):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in TEXTS]
    groups = collections.defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    want = []
    for i, t in norm:
        keep = min((x for x in groups[t] if x is not None), default=None)
        want.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    got = rows(exact_dedup.exact_groups(docs(spark)).drop("n_chunks"))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0


def test_chunks_rejoin_and_resynchronise(spark):
    from pyspark.sql import functions as F

    a = " ".join(f"Sentence number {i} is here." for i in range(400))
    got = {r[0]: r[1] for r in spark.createDataFrame([(1, a), (2, "New start. " + a), (3, "x" * 9000)], "i int, t string").select("i", exact_dedup.chunks(F.col("t"))).collect()}
    assert "".join(got[1]) == a and "".join(got[3]) == "x" * 9000
    assert len(set(got[1]) & set(got[2])) > len(got[1]) // 2


def test_drop_copies_keeps_columns(spark):
    d = docs(spark)
    kept = exact_dedup.drop_copies(d)
    assert kept.columns == d.columns
    assert len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in TEXTS}) <= kept.count() < len(TEXTS)


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_ring_counts_slots_and_ties(spark, shards):
    many = TEXTS + [(i, f"text {i}") for i in range(100, 400)] + [(500, "same")] * 50
    got = sharding.shard_documents(docs(spark, many), shards).collect()
    assert len(got) == len(many)
    n = collections.Counter(r.shard for r in got)
    assert max(n.values()) - min(n[s] for s in range(shards)) <= 1
    for s in n:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n[s]))
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in many)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert all(r.law == "rows" and r.grown_shard is None for r in got)
    assert sum(r.shard == r.home_shard for r in got) > len(got) * 0.6
    assert sharding.shard_documents(docs(spark, []), shards).count() == 0


def test_ring_moves_little(spark):
    many = [(i, "x") for i in range(2000)]
    a = {r.doc_id: r.home_shard for r in sharding.shard_documents(docs(spark, many), 8).collect()}
    b = {r.doc_id: r.home_shard for r in sharding.shard_documents(docs(spark, many), 9).collect()}
    assert all(b[i] in (a[i], 8) for i in a)


def test_a_thousand_shards_all_have_keys():
    nodes = sharding.virtual_nodes(1000, 64)
    assert len(nodes) == 64_000 and len({s for _, s in nodes}) == 1000


def test_many_shards_fill_evenly(spark):
    many = [(i, "x") for i in range(4000)]
    table = docs(spark, many).withColumnRenamed("keep_id", "_cut").withColumnRenamed("source", "_rank")
    got = sharding.bounded_ring(table, table.doc_id, [table.doc_id], 300, 16)
    assert {"_cut", "_rank", "_h"} <= set(got.columns)
    rows_ = got.select("doc_id", "shard", "slot").collect()
    n = collections.Counter(r.shard for r in rows_)
    assert len(rows_) == 4000 and set(n) == set(range(300)) and set(n.values()) <= {13, 14}
    assert len({(r.shard, r.slot) for r in rows_}) == 4000


def test_growing_moves_few_shards(spark):
    """From 8 to 9 shards at least a ninth of the rows has to move; overflow moves a few per cent more."""
    many = [(i, "x") for i in range(4000)]
    a, b = ({r.doc_id: r.shard for r in sharding.shard_documents(docs(spark, many), n).collect()} for n in (8, 9))
    assert sum(a[i] != b[i] for i in a) < 0.25 * len(a)
