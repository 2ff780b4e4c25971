"""Filter audit against a plain loop over all orders."""

import collections
import itertools

import duckdb
import pytest

from factloom.llm import filter_audit
from factloom.llm.queries import ORACLE

from .cases import TEXTS, docs

LABELS = "doc_id long, quality int, toxic int, extra string"
MORE = [(i, t) for i, t in enumerate(["Copy of this", "copy of this", "Copy of this", "A B C D", "word " * 120, " ".join(f"w{k}" for k in range(130)), "a # b", "Copy of this"], 100)]


def brute(rows, labels):
    """{(part, order, step): counts} by applying the filters in turn."""
    fails = []
    for i, text, part in rows:
        words = text.encode().split()
        copy = i is not None and any(j is not None and j < i and t == text for j, t, _ in rows)
        f = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": copy,
        }
        mine = [x for x in labels if x[0] == i and i is not None]
        fails.append((part, {k for k, v in f.items() if v}, any(q == 1 for _, q, _ in mine), any(t == 1 for *_, t in mine)))
    out, shares = {}, collections.Counter()
    for order in itertools.permutations("ABCDE"):
        for part in {r[2] for r in rows}:
            left = [f for f in fails if f[0] == part]
            for step, name in enumerate(order, 1):
                gone = [f for f in left if name in f[1]]
                all_ = [f for f in fails if f[0] == part and name in f[1]]
                left = [f for f in left if name not in f[1]]
                shares[part, name] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(all_) - len(gone), sum(f[1] == {name} for f in all_), sum(f[2] for f in gone), sum(f[3] for f in gone)]
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.fixture(scope="module", params=["small chains", "usual chains"])
def chains(request):
    had = filter_audit.CHAIN_BYTES
    filter_audit.CHAIN_BYTES = 1 if request.param == "small chains" else had
    yield
    filter_audit.CHAIN_BYTES = had


def test_audit_equals_plain_loop(spark, chains):
    table = docs(spark, TEXTS + MORE).repartition(5)
    labels = [(1, 1, 0), (9, 1, 1), (100, 1, 0), (102, 0, 1), (102, 1, None), (107, None, 1), (None, 1, 1), (999, 1, 1)]
    said = spark.createDataFrame([(*x, "y") for x in labels], LABELS)
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(table, said).collect()}
    want = brute([(r.doc_id, r.text or "", r.lang or "") for r in table.collect()], labels)
    assert got == want


def test_non_minimum_ids_of_a_hot_text(spark):
    rows = [(k, "the same text " * 9 if k % 3 else f"text {k}", "en", None, 0, 0, 0, "") for k in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard int, _h long, keep_id string").repartition(7)
    assert sorted(r.doc_id for r in filter_audit.non_minimum_ids(table).collect()) == [k for k in range(600) if k % 3 and k > 1]


def test_collisions_are_told_apart(spark, monkeypatch):
    """Records of one fingerprint keep a chain by text."""
    rows = [((7, 1), (b"x", 1, (("en", 1),), 0)), ((7, 2), (b"y", 2, (("en", 1),), 0)), ((7, 3), (b"x", 3, (("en", 2),), 4))]
    assert list(filter_audit._masked(rows)) == [(1, "en", 0, 1), (2, "en", 0, 1), (3, "en", 4 | filter_audit.COPY, 2)]


def test_empty_table_and_sql(spark):
    empty = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(docs(spark, []), empty).count() == 0
    con = duckdb.connect()
    documents = docs(spark, MORE).toPandas()  # noqa: F841
    labels = spark.createDataFrame([(100, 1, 0, "")], LABELS).toPandas()
    con.register("labels", labels)
    con.register("documents", documents)
    want = {tuple(r) for r in con.sql(ORACLE["op11_filter_audit"]).select("part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley").fetchall()}
    assert {tuple(r) for r in filter_audit.audit(docs(spark, MORE), spark.createDataFrame(labels)).collect()} == want
