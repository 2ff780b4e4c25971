"""Two writers of one table, locks of crashed holders, and reading what was."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from factloom.sources.commits import Conflict, Log, lease
from factloom.sources.database import Table

SCHEMA = "k long, v string, n long"


def test_a_number_has_one_writer(spark, tmp_path):
    log = Log(spark, str(tmp_path / "l"), "_m")
    assert log.numbers() == [] and log.put(1, "a") and not log.put(1, "b") and log.text(1) == "a"
    won = []

    def race(x):
        for n in range(2, 12):
            if log.put(n, x):
                won.append(n)

    threads = [threading.Thread(target=race, args=(str(i),)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(won) == list(range(2, 12)) and log.numbers() == list(range(1, 12))


def test_no_update_is_lost(spark, tmp_path):
    """Two writers merge at once, into the same buckets and others: everything of both is there."""
    path = str(tmp_path / "t")

    def write(who):
        rows = spark.range(120).filter(F.col("id") % 2 == who).selectExpr("id as k", f"'{who}' as v", "1L as n")
        shared = spark.range(5).selectExpr("id + 1000 as k", f"'{who}' as v", f"{who}L as n")
        for part in range(3):
            Table(spark, path).merge(rows.filter(F.col("k") % 3 == part).unionByName(shared), "k", "n", buckets=8)

    threads = [threading.Thread(target=write, args=(who,)) for who in (0, 1)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    got = {r.k: r.v for r in Table(spark, path).read(SCHEMA).collect()}
    assert got == {k: str(k % 2) for k in range(120)} | {k + 1000: "1" for k in range(5)}


def test_a_stale_base_is_refused(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    t.replace(spark.range(1).selectExpr("id as k", "'a' as v", "1L as n"))
    base, manifest = t._state()
    t.replace(spark.range(2).selectExpr("id as k", "'b' as v", "1L as n"))
    with pytest.raises(Conflict):
        t.commit(base, manifest)
    assert t.read(SCHEMA).count() == 2


def test_earlier_versions_and_changes(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), keep=3)
    rows = lambda *xs: spark.createDataFrame(list(xs), SCHEMA)
    t.merge(rows((1, "a", 1), (2, "a", 1), (3, "a", 1)), "k", "n")
    t.merge(rows((2, "b", 2), (4, "b", 2)), "k", "n")
    assert t.versions() == [1, 2]
    assert sorted(r.k for r in t.read(SCHEMA, 1).collect()) == [1, 2, 3]
    made = t.changes(SCHEMA, "k", 1, 2)
    got = {r.k: (r.change, r.was and r.was.v, r.now and r.now.v) for r in made.collect()}
    assert got == {2: ("changed", "a", "b"), 4: ("added", None, "b")}
    # buckets that both versions share are left out of the scan
    first = t.manifest(1)
    assert not any(first[b] in f for b in first if t.manifest(2).get(b) == first[b] for f in made.inputFiles())
    t.replace(rows((9, "c", 3)))
    t.replace(rows((9, "d", 3)))
    assert t.versions() == [2, 3, 4] and t.changes(SCHEMA, "k", 3, 4).first().now.v == "d"
    assert {r.change for r in t.changes(SCHEMA, "k", 2, 3).collect()} == {"added", "removed"}


def test_unfinished_versions_stay_until_they_are_old(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    t.replace(spark.range(1).selectExpr("id as k", "'a' as v", "1L as n"))
    spark.range(3).write.parquet(f"{t.path}/v-of-another")
    for _ in range(3):
        t.replace(spark.range(1).selectExpr("id as k", "'a' as v", "1L as n"))
    assert (tmp_path / "t" / "v-of-another").exists()
    t.vacuum()
    assert (tmp_path / "t" / "v-of-another").exists()
    time.sleep(0.05)
    t.vacuum(0.01)
    assert not (tmp_path / "t" / "v-of-another").exists() and t.read(SCHEMA).count() == 1


def test_a_lock_of_a_crashed_holder_lapses(spark, tmp_path):
    at = str(tmp_path / "l")
    with lease(spark, at) as first, lease(spark, at) as second:
        assert first and not second
    with lease(spark, at) as again:
        assert again
    log = Log(spark, at, "_lock")
    log.put(log.numbers()[-1] + 1, "taken")
    with lease(spark, at, 60) as early:
        assert not early
    time.sleep(1.2)
    with lease(spark, at, 1) as late, lease(spark, at, 1) as other:
        assert late and not other
        time.sleep(1.5)
        with lease(spark, at, 1) as third:
            assert not third, "the holder lives"
