"""Pending values composed by partition against a loop."""

import random

import pytest

from factloom.operators import scans


def loop(steps):
    out, now = [], None
    for kind, value in steps:
        out.append(now)
        now = value if kind == scans.SET else None if kind == scans.CLEAR else (value if now is None else now) if kind == scans.DEFAULT else now
    return out


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_pending_equals_a_loop(spark, parts):
    rnd = random.Random(parts)
    rows, want = [], {}
    for key in ["hot", "a", "b", None]:
        steps = [(rnd.choice([scans.SET, scans.CLEAR, scans.DEFAULT, scans.DEFAULT, scans.KEEP, scans.KEEP, scans.KEEP]), f"{key}{i}") for i in range(400 if key == "hot" else 9)]
        rows += [(key, i, k, v) for i, (k, v) in enumerate(steps)]
        want |= {(key, i): b for i, b in enumerate(loop(steps))}
    table = spark.createDataFrame(rnd.sample(rows, len(rows)), "key string, n int, step string, value string")
    got = {(r.key, r.n): r.before for r in scans.pending(table, "key", ["n"], table.step, table.value, parts).collect()}
    assert got == want
    assert scans.pending(table.limit(0), "key", ["n"], table.step, table.value, parts).count() == 0


def test_sections_go_on(spark):
    pages = [(1, 1, 2, ["A"], False), (1, 2, 0, [], True), (1, 3, 2, ["B"], True), (1, 4, 0, [], False), (1, 5, 1, [], True), (1, 6, 1, None, None), (2, 1, 1, [], False), (2, 2, 3, ["C", "D"], False), (2, 3, None, None, None), (2, 4, 1, ["E", "F"], False)]
    df = spark.createDataFrame(pages, "doc int, page int, tables int, heads array<string>, continued boolean")
    got = {(r.doc, r.page, r["at"]): (r.section, r.begun) for r in scans.continued_tables(df, 3).collect()}
    assert got == {
        (1, 1, 0): ("A", 1), (1, 1, 1): ("A", 1), (1, 3, 0): ("A", 1), (1, 3, 1): ("B", 3), (1, 5, 0): ("Unknown", 5), (1, 6, 0): ("Unknown", 5),
        (2, 1, 0): ("Unknown", 1), (2, 2, 0): ("C", 2), (2, 2, 1): ("D", 2), (2, 2, 2): ("D", 2), (2, 4, 0): ("E", 4),
    }


def test_stretches_grow_in_number_and_not_in_size(spark, monkeypatch):
    monkeypatch.setattr(scans, "STRETCH", 50, raising=False)
    rows = [("hot", i, scans.SET if i % 10 == 0 else scans.KEEP, str(i)) for i in range(600)]
    table = spark.createDataFrame(rows, "key string, n int, step string, value string")
    met = scans.pending(table, "key", ["n"], table.step, table.value)
    assert len({r._part for r in spark.read.parquet(*met.inputFiles()).select("_part").distinct().collect()}) == 12
    assert {r.n: r.before for r in met.collect()} == {i: None if i == 0 else str((i - 1) // 10 * 10) for i in range(600)}
